"""Every query with SQL gives what DuckDB gives; every other one runs."""

import duckdb
import pytest

from histlake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in catalog.ORACLES:
        assert cols
        return
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()), key=repr)
    assert cols == sorted(names)
    assert rows == want


def test_search_filters_reach_the_scan(spark, sf, tmp_path):
    from histlake import fixtures
    from histlake.operators import search

    path = str(tmp_path / "c")
    fixtures.commands(spark, sf).write.parquet(path)
    plan = spark.read.parquet(path).filter(search.text_hit("nting"))._jdf.queryExecution().toString()
    assert "StringContains(plain_lc,nting)" in plan or "Contains(plain_lc" in plan


def test_every_failed_run_is_diffed(spark, sf):
    from histlake import fixtures

    rows = fixtures.slim_commands(spark, sf).select("id", "cmd", "started_ms", "exit_code", "machine").collect()
    want, last = set(), {}
    for r in sorted(rows, key=lambda r: (r.started_ms, r.id)):
        if r.exit_code and r.cmd in last:
            want.add((r.id, last[r.cmd]))
        if not (r.machine or "").startswith("hist:"):
            last[r.cmd] = r.id
    got = [(r.id, r.prev_id) for r in catalog.QUERIES["diff_unified"](spark, sf).select("id", "prev_id").collect()]
    assert sorted(got) == sorted(want)
    assert any(i % 10 >= 8 for i, _ in got)


def test_search_reads_whole_texts(spark):
    from histlake.operators import search
    from histlake.plans.filters import Filter
    from histlake.schema import with_search_text

    text = "x" * 300_000 + " Needle at the end"
    schema = "id long, started_ms long, cmd string, plain string, note string"
    rows = with_search_text(spark.createDataFrame([(1, 10, "ls", text, None), (2, 20, "ls", "short", None)], schema))
    postings = search.trigrams(rows)
    assert [(r.id, r.snippet) for r in search.search(rows, "needle").select("id", "snippet").collect()] == [(1, "…xxx \x01Needle\x02 at …")]
    assert [r.id for r in search.search_ids(rows, "needle").collect()] == [1]
    assert [r.id for r in search.search_by_trigrams(rows, postings, "needle", Filter()).collect()] == [1]


def test_postings_of_each_text_once(spark, sf, tmp_path, monkeypatch):
    """Events five times over: no more postings, and still what DuckDB finds."""
    from histlake.operators import search

    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (event_id + k * 1000 AS event_id) FROM '{sf}/events.parquet', range(5) t(k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.execute(f"COPY (FROM '{sf}/documents.parquet') TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    for t in ("events", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    made, trigrams = [], search.trigrams
    monkeypatch.setattr(search, "trigrams", lambda *a: made.append(trigrams(*a)) or made[-1])
    rows = catalog.QUERIES["search_postings"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == sorted(c.execute(catalog.ORACLES["search_postings"]).fetchall())
    texts = [t for (t,) in c.execute("SELECT lower(text) FROM documents").fetchall()]
    assert len(made) == 1 and made[0].count() == sum(len({t[k : k + 3] for k in range(len(t) - 2)}) for t in texts)


def test_trigrams_are_of_whole_characters(spark):
    from histlake.operators import search

    texts = [None, "", "ab", "abc", "a\n\r b", "a😀b😀a😀b", "é́日本語\x00\x85x", "aaaaaa"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, plain_lc string").selectExpr("id", "cast(null AS string) AS cmd", "plain_lc")
    want = {(i, t[k : k + 3]) for i, t in enumerate(texts) if t for k in range(len(t) - 2)}
    got = [(r.id, r.tri) for r in search.trigrams(rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_shared_texts_are_searched_as_copies_are(spark):
    """Lines and outputs, both at once, no output, a text nothing printed, candidates without the word, filters and short queries."""
    from histlake.operators import search
    from histlake.plans.filters import Filter

    texts = spark.createDataFrame([(0, "a needle"), (1, "needl eedle"), (2, None), (3, "needle unprinted"), (4, "needle, needle")], "text_id long, plain_lc string")
    schema = "id long, started_ms long, cmd string, text_id long, session_id long"
    rows = [(1, 5, "ls", 0, 1), (2, 5, "find NEEDLE", 0, 1), (3, 0, "needle", None, 2), (4, 9, "ls", None, 2), (5, 9, None, 4, 2), (6, 9, "ls", 1, 2), (7, 9, "needle", 2, 1), (8, 1, "ls", 4, 1)]
    commands = spark.createDataFrame(rows, schema)
    postings = search.trigrams(texts, "text_id", texts.plain_lc)
    joined = commands.join(texts, "text_id", "left")
    for query in ("Needle", "needle ", "ee", "", "none such"):
        for where in (Filter(), Filter(limit=2), Filter(session=1)):
            want = search.search_by_trigrams(joined, search.trigrams(joined), query, where)
            got = search.search_shared(commands, texts, postings, query, where)
            assert got.columns == want.columns and got.collect() == want.collect(), (query, where)
    assert [r.id for r in search.search_shared(commands, texts, postings, "needle").collect()] == [7, 5, 2, 1, 8, 3]
