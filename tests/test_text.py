"""Golden cases of the text functions."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from histlake.functions import commandline as c
from histlake.functions import diff, grep, highlight, redact, terminal, text


@pytest.mark.parametrize(
    ("line", "head"),
    [
        ("ls -la", "ls"), ("git status", "git status"), ("git -C /tmp status", "git status"), ("sudo apt install x", "apt install"), ("FOO=1 BAR=2 make test", "make test"),
        ("env | grep x", "env"), ("/usr/bin/python3 a.py", "python3"), ("\\ls", "ls"), ("make && git push", "make"), ("sudo", "sudo"), ("", "(other)"), ("> out", "(other)"),
        ("docker compose up -d", "docker compose"), ("go ./cmd", "go"), ("echo a\nrm b", "echo"), ("time nohup cargo build", "cargo build"), ("make 2>err", "make"),
    ],
)
def test_head(line, head):
    assert c.head_of(line) == head


def test_words():
    assert [w for w in ("A=1", "a_b=", "x9=y", "_=") if not c.is_assignment(w)] == []
    assert [w for w in ("=x", "a-b=c", "a", "a.b=1", "", "-x=1") if c.is_assignment(w)] == []
    assert all(map(c.is_shell_operator, ("|", "&&", ";", "2>", "<", "(")))
    assert not any(map(c.is_shell_operator, ("a", "2", "", "a|")))


@pytest.mark.parametrize(
    ("quoted", "want"),
    [("plain", "plain"), ("'a b'", "a b"), ('"a b"', "a b"), ('"a\\"b"', 'a"b'), ("a\\ b", "a b"), ("$'a\\nb'", "a\nb"), ("$'\\x41\\u00e9'", "Aé"), ("$'\\101'", "A"), ("$'\\cA'", "\x01"), ("'open", "'open"), ("$HOME", "$HOME"), ("$'\\q'", "\\q"), ("", "")],
)
def test_unquote(quoted, want):
    assert c.unquote(quoted) == want


def test_quote(spark):
    rows = spark.createDataFrame([("a b",), ("it's",), ("",), ("x/y",)], "s string").select(c.exec_quote(F.col("s")), c.shell_quote(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [("'a b'", "'a b'"), ("'it'\\''s'", "'it'\\''s'"), ("''", "''"), ("x/y", "'x/y'")]


@pytest.mark.parametrize(
    ("raw", "plain"),
    [
        (b"a\x1b[31mb\x1b[0m", b"ab"), (b"\x1b]0;t\x07x", b"x"), (b"\x1b]0;t\x1b\\x", b"x"), (b"\x1bPq\x1b\\x", b"x"), (b"\x1b(Bx", b"x"), (b"a\tb", b"a b"),
        (b"old\rnew", b"new"), (b"a\r\nb", b"a\nb"), (b"ab\x08c", b"ac"), (b"\x08\x08a", b"a"), (b"a\n\x08b", b"a\nb"), (b"x\r\r\ny", b"\ny"), (b"x\r\x1b[0m\ny", b"\ny"), (b"\x00\x7fa", b"a"), (b"a\x1b[31", b"a"),
    ],
)
def test_strip(raw, plain):
    assert terminal.strip(raw) == plain


def test_strip_in_a_plan(spark):
    rows = spark.createDataFrame([("a\x1b[1mb",), ("plain\nlines",), (None,)], "s string").select(terminal.strip_ansi(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["ab", "plain\nlines", None]


@pytest.mark.parametrize(
    ("raw", "html"),
    [
        (b"<a&b>", "&lt;a&amp;b&gt;"), (b"\x1b[31mx\x1b[0my", '<span class="f1">x</span>y'), (b"\x1b[1;4mx", '<span class="bo ul">x</span>'), (b"\x1b[38;5;9mx", '<span class="f9">x</span>'),
        (b"\x1b[38;5;196mx", '<span style="color:#ff0000">x</span>'), (b"\x1b[48;5;244mx", '<span style="background:#808080">x</span>'), (b"\x1b[38:2:1:2:3mx", '<span style="color:#010203">x</span>'), (b"\x1b[7mx", '<span class="rv">x</span>'),
        (b"\x1b[31;7mx", '<span class="b1">x</span>'), (b"a\tb", "a\tb"), (b"old\rnew", "new"), (b"\x1b[38;5mx", "x"), (b"\x1b[97mx\x1b[39my", '<span class="f15">x</span>y'),
    ],
)
def test_html(raw, html):
    assert terminal.render(raw) == html


SECRETS = [
    "AKIA" + "A" * 16, "ghp_" + "a" * 36, "github_pat_" + "a" * 30, "xoxb-" + "1" * 12, "sk_live_" + "a" * 24, "sk-" + "a" * 40, "AIza" + "b" * 35, "npm_" + "a" * 36,
    "pypi-" + "a" * 30, "glpat-" + "a" * 20, "dop_v1_" + "a" * 64, "hf_" + "a" * 34, "eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 10,
]


def test_redact(spark):
    lines = [f"x {s} y" for s in SECRETS] + ["https://user:hunter22@host/", "Authorization: Bearer abc.def", 'api_key = "abcdef"', "PASSWORD=hunter2"]
    block = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
    clean = ["git status", "the password is long", "token", "ssh user@host", "a:b@c"]
    rows = spark.createDataFrame([(x,) for x in [*lines, block, *clean]], "s string")
    once = rows.select("s", redact.redact(F.col("s")).alias("r"), redact.redact_lean(F.col("s")).alias("l"), redact.hits(F.col("s")).alias("n"))
    found = once.select("*", redact.redact(F.col("r")).alias("again")).collect()
    for r in found:
        assert r.r == r.again == r.l
        assert (redact.MASK in r.r) == (r.s not in clean) == (r.n > 0), r.s
    extra = rows.limit(1).select(redact.redact(F.lit("abc 123"), ["[0-9]+"])).first()[0]
    assert extra == "abc [REDACTED]"


def test_grep():
    hunks, total, shown = grep.context("a\nHIT\nb\nc\nd\nhit\n", "hit", 1, 1)
    assert [(h.start, h.lines, h.is_match) for h in hunks] == [(0, ["a", "HIT", "b"], [False, True, False]), (4, ["d", "hit"], [False, True])]
    assert (total, shown) == (2, 2)
    assert len(grep.context("x\n\n\nx\n" * 20, "x", 0, 0)[0]) == 5


def test_grep_windows_equal_the_plain_form(spark, sf):
    from histlake.operators import search

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).select(F.col("doc_id").alias("id"), F.col("text").alias("plain"))
    found = {}
    for r in search.grep_hunks(docs, "tion", 1, 2).orderBy("id", "hunk").collect():
        found.setdefault(r.id, []).append((r.start, r.lines, r.is_match))
    for r in docs.collect():
        hunks, _, _ = grep.context(r.plain, "tion", 1, 2)
        assert found.get(r.id, []) == [(h.start, h.lines, h.is_match) for h in hunks]


def test_highlight():
    assert highlight.mark("aXbx", "x", "[", "]") == "a[X]b[x]"
    assert highlight.mark("none", "x", "[", "]") == "none"
    assert highlight.match_offset("éx", "x") == 2
    assert highlight.clip_line("a" * 500 + "HIT" + "b" * 500, "hit", 100).count("HIT") == 1
    assert highlight.clip_line("short", "x", 100) == "short"
    assert highlight.merge_ranges([(5, 7), (0, 3), (2, 4)]) == [(0, 4), (5, 7)]
    assert highlight.query_terms("ab AND abc") == ["abc", "ab"]
    assert "\x01needle\x02" in highlight.snippet_of("x" * 100 + "needle" + "y" * 100, "NEEDLE")


lines = st.lists(st.sampled_from(["a", "b", "c", ""]), max_size=12)


@settings(max_examples=200, deadline=None)
@given(lines, lines)
def test_diff_rebuilds_both(a, b):
    ops = diff.script(a, b)
    assert [x for k, x in ops if k != "+"] == a
    assert [x for k, x in ops if k != "-"] == b


def test_diff_is_shortest():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("ab") for _ in range(rng.randint(0, 7))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
        assert sum(k == " " for k, _ in diff.script(a, b)) == best[-1][-1]


def test_unified():
    assert diff.unified("same\n", "same\n") == ""
    assert diff.unified("", "x\n") == "@@ -0,0 +1,1 @@\n+x\n"
    far = diff.unified("\n".join("abcdefghijklmnop"), "\n".join("aXcdefghijklmnYp"))
    assert far.count("@@ -") == 2
    assert len(diff.clip("line\n" * 20000, 1000).encode()) < 1100


def test_diff_of_long_texts_is_whole(spark):
    same = [f"kept {k}" for k in range(3000)]
    a, b = ([x for k, line in enumerate(same) for x in (f"{side} {k} {'x' * 40}", line)] for side in ("old", "new"))
    ops = diff.script(a, b)  # a distance of 6,000
    assert [x for k, x in ops if k == " "] == same
    assert [x for k, x in ops if k != "+"] == a
    assert [x for k, x in ops if k != "-"] == b
    rows = spark.createDataFrame([("\n".join(a), "\n".join(b))], "old string, new string")
    (r,) = rows.select(diff.unified_diff("old", "new").alias("diff")).collect()
    assert len(r["diff"]) > diff.DIFF_CAP
    assert r["diff"] == "@@ -1,6000 +1,6000 @@\n" + "".join(f"{k}{x}\n" for k, x in ops)


def test_small_functions(spark):
    one = spark.range(1).select(
        text.one_line(F.lit("a\nb"), 80), text.one_line(F.lit("x" * 10), 5), text.fence_length(F.lit("a ```` b")), text.human_bytes(F.lit(1536)), text.human_bytes(F.lit(5)),
        text.human_duration(F.lit(250)), text.human_duration(F.lit(4200)), text.human_duration(F.lit(221_000)), text.human_duration(F.lit(4_320_000)), text.human_duration(F.lit(183_600_000)), text.human_duration(F.lit(0)),
        text.html_escape(F.lit("<&\">")), text.strip_space(F.lit(" a\tb\n")), text.exit_label(F.lit("130")), text.home_label(F.lit("/home/x/y"), "/home/x"), text.plural(F.lit(2), "row"),
    ).first()
    assert tuple(one) == (
        "a ⏎ b", "xxxx…", 5, "1.5 KB", "5 B", "250ms", "4.2s", "3m41s", "1h12m", "2d3h", "-", '&lt;&amp;"&gt;', "ab", "130 (SIGINT)", "~/y", "2 rows",
    )


def test_decoders():
    assert text.percent_decode("a%20b+c%zz%") == "a b+c%zz%"
    assert text.vsc_unescape(r"a\\b\x3bc\q") == "a\\b;c\\q"
    assert text.osc7_path("file://host/home/x%20y") == "/home/x y"
    assert text.osc7_path("file:///C:/x/y") == "C:\\x\\y"
    assert text.fnv_sequence("") == 0xCBF29CE484222325 & 0x7FFFFFFFFFFFFFFF


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"\r", b"\n", b"\x1b", b"[", b"31", b"m", b"]", b"\x07", b"\\", b"(", b"\t", b"\x08", b"?", b"P"]), max_size=14))
def test_strip_short_cut_is_exact(parts):
    data = b"".join(parts)
    assert terminal.strip(data) == terminal._resolved(data)
