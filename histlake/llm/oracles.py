"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from .decontam import SPAN, WIDTH
from .pii import AGAINST, CONTEXT, IBAN_LENGTH
from .sharding import ROW_COST
from .substring import WINDOW

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Every word removed that a window covers which starts at two places or more.
SUBSTRING_DEDUP = rf"""
WITH w AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents
), s AS (
    SELECT rid, l, unnest(range(1, len(l) - {WINDOW - 2})) AS i FROM w WHERE len(l) >= {WINDOW}
), k AS (
    SELECT rid, i, array_to_string(l[i : i + {WINDOW - 1}], ' ') AS key FROM s
), d AS (
    SELECT rid, i FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING count(*) > 1)
), gone AS (
    SELECT DISTINCT rid, unnest(range(i, i + {WINDOW})) AS pos FROM d
), n AS (
    SELECT rid, count(*) AS n_removed FROM gone GROUP BY rid
), word AS (
    SELECT rid, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS word FROM w
), kept AS (
    SELECT rid, string_agg(word, ' ' ORDER BY pos) AS text FROM word ANTI JOIN gone USING (rid, pos) GROUP BY rid
)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)
"""

_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every occurrence of an item's window, by joining windows of each length that items have; and every item with a
#: window whose terms stand within SPAN words: sought around the window's rarest term, then from each of its terms on.
DECONTAMINATION = rf"""
WITH t AS (
    SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS l FROM documents
), item AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_TERMS} AS l FROM benchmark
), iw AS (
    SELECT item, l, least(len(l), {WIDTH}) AS n, unnest(range(1, greatest(len(l) - {WIDTH - 1}, 1) + 1)) AS i FROM item WHERE len(l) > 0
), ik AS (
    SELECT DISTINCT item, n, array_to_string(l[i : i + n - 1], ' ') AS key FROM iw
), lengths AS (
    SELECT DISTINCT n FROM ik
), dw AS (
    SELECT rid, l, n, unnest(range(1, len(l) - n + 2)) AS i FROM t, lengths WHERE len(l) >= n
), hit AS (
    SELECT rid, i, dk.n, item FROM (SELECT rid, i, n, array_to_string(l[i : i + n - 1], ' ') AS key FROM dw) dk JOIN ik USING (n, key)
), pos AS (
    SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM hit
), a AS (
    SELECT rid, count(*) AS n_hit FROM pos GROUP BY rid
), b AS (
    SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid
), word AS (
    SELECT rid, unnest(l) AS term, unnest(range(1, len(l) + 1)) AS pos FROM t
), wt AS (
    SELECT DISTINCT key, unnest(string_split(key, ' ')) AS term FROM (SELECT DISTINCT key FROM ik)
), size AS (
    SELECT key, count(*) AS terms FROM wt GROUP BY key
), df AS (
    SELECT term, count(*) AS n FROM word WHERE term IN (SELECT term FROM wt) GROUP BY term
), rare AS (
    SELECT key, arg_min(term, coalesce(n, 0)) AS term FROM wt LEFT JOIN df USING (term) GROUP BY key
), place AS (
    SELECT key, rid, pos AS p FROM rare JOIN word USING (term)
), seen AS (
    SELECT place.key, place.rid, p, word.pos, word.term FROM place JOIN wt USING (key) JOIN word ON word.rid = place.rid AND word.term = wt.term AND abs(word.pos - p) < {SPAN}
), full_ AS (
    SELECT key, rid, p FROM seen JOIN size USING (key) GROUP BY key, rid, p, terms HAVING count(DISTINCT term) = terms
), run AS (
    SELECT DISTINCT a.key, a.rid FROM full_ f JOIN seen a USING (key, rid, p) JOIN seen b USING (key, rid, p) JOIN size USING (key)
    WHERE a.pos <= p AND b.pos BETWEEN a.pos AND a.pos + {SPAN - 1} GROUP BY a.key, a.rid, p, a.pos, terms HAVING count(DISTINCT b.term) = terms
), close AS (
    SELECT rid, count(DISTINCT item) AS n_near FROM run JOIN ik USING (key) GROUP BY rid
)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(l) AS contaminated, coalesce(n_near, 0) AS n_near
FROM t LEFT JOIN a USING (rid) LEFT JOIN b USING (rid) LEFT JOIN close USING (rid)
"""


def _words(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


#: A kind's matches as the odd pieces between marks put around each; a piece's place is the length of those before it.
_BASE_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: TRY_CAST(x AS HUGEINT) IS NULL OR TRY_CAST(x AS HUGEINT) > 255)) = 0"),
    ("card", r"[0-9]([\x20-]?[0-9])+", "len(digits) BETWEEN 12 AND 19 AND luhn % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "len(digits) BETWEEN 9 AND 15"),
    ("ssn", r"[0-9-]+", r"regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND m[1:3] NOT IN ('000', '666') AND m[1] <> '9' AND m[5:6] <> '00' AND m[8:11] <> '0000'"),
)
_MATCHES = " UNION ALL ".join(
    f"SELECT rid, '{kind}' AS kind, string_split(regexp_replace(t, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS l FROM t" for kind, pattern, _ in _BASE_KINDS
)
_HELD = " OR ".join(f"(kind = '{kind}' AND {rule})" for kind, _, rule in _BASE_KINDS)
_LENGTHS = "MAP {" + ", ".join(f"'{c}': {n}" for c, n in IBAN_LENGTH.items()) + "}"
_NEAR = " OR ".join(f"(kind = '{kind}' AND list_has_any(near, {_words(words)}))" for kind, words in CONTEXT.items())
_LETTER = r"[\p{L}\p{Nl}\p{No}]"

#: Base kinds by the contract's own patterns; IBANs tried at every place where one can begin; scores by words nearby.
PII = rf"""
WITH t AS (
    SELECT row_number() OVER () AS rid, doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents
), piece AS (
    SELECT rid, kind, unnest(l) AS m, unnest(range(1, len(l) + 1)) AS k FROM ({_MATCHES}) WHERE len(l) > 1
), placed AS (
    SELECT rid, kind, m, k, CAST(sum(len(m)) OVER (PARTITION BY rid, kind ORDER BY k) AS BIGINT) AS b FROM piece
), summed AS (
    SELECT rid, kind, m, b, string_split(reverse(regexp_replace(m, '[^0-9]', '', 'g')), '') AS digits,
           list_sum(list_transform(digits, lambda d, i: CASE WHEN i % 2 = 1 THEN ascii(d) - 48 ELSE 2 * (ascii(d) - 48) % 10 + (ascii(d) - 48) // 5 END)) AS luhn
    FROM placed WHERE k % 2 = 0 AND regexp_matches(m, '[0-9]') OR k % 2 = 0 AND kind = 'email'
), direct AS (
    SELECT rid, kind, b - len(m) AS a, b FROM summed WHERE {_HELD}
), head AS (
    SELECT rid, string_split(regexp_replace(t, '(^|[^A-Za-z0-9])([A-Z][A-Z][0-9][0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l FROM t
), tail AS (
    SELECT rid, unnest(l) AS m, unnest(range(1, len(l) + 1)) AS k FROM head WHERE len(l) > 1
), begun AS (
    SELECT rid, k, m, CAST(sum(len(m)) OVER (PARTITION BY rid ORDER BY k) AS BIGINT) - len(m) AS a FROM tail
), run AS (
    SELECT rid, a, substring(t, a + 1, 80) AS rest, {_LENGTHS}[substring(t, a + 1, 2)] AS n FROM begun JOIN t USING (rid) WHERE k > 1
), sized AS (
    SELECT rid, a, rest, n, list_filter(range(n, 2 * n), lambda w: len(replace(rest[1:w], ' ', '')) = n)[1] AS w FROM run WHERE n IS NOT NULL
), iban AS (
    SELECT rid, a, a + w AS b, replace(rest[1:w], ' ', '') AS code FROM sized
    WHERE regexp_full_match(rest[1:w], '[A-Z]{{2}}[0-9]{{2}}( ?[A-Z0-9])+') AND NOT regexp_matches(rest[w + 1 : w + 1], '[\p{{L}}\p{{N}}]')
), valid AS (
    SELECT rid, a, b FROM iban WHERE list_reduce(
        list_transform(string_split(code[5:] || code[1:4], ''), lambda c: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1),
        lambda x, y: (x * CASE WHEN y > 9 THEN 100 ELSE 10 END + y) % 97) = 1
), base AS (
    SELECT * FROM direct WHERE kind <> 'ssn'
), added AS (
    SELECT rid, kind, a, b FROM direct WHERE kind = 'ssn'
    UNION ALL SELECT rid, 'iban', a, b FROM valid v WHERE NOT EXISTS (FROM valid o WHERE o.rid = v.rid AND o.a < v.a AND o.b > v.a)
), span AS (
    FROM base UNION ALL FROM added d WHERE NOT EXISTS (FROM base WHERE base.rid = d.rid AND base.a < d.b AND d.a < base.b)
), around AS (
    SELECT rid, kind, a, b, list_transform(list_concat(
        regexp_extract_all(substring(t, greatest(a - 40, 0) + 1, least(a, 40)), '{_LETTER}+(-{_LETTER}+)?'), regexp_extract_all(substring(t, b + 1, 40), '{_LETTER}+(-{_LETTER}+)?')
    ), lambda w: lower(w)) AS near FROM span JOIN t USING (rid)
), scored AS (
    SELECT rid, kind, a, b, list_position(['email', 'ip', 'card', 'phone', 'iban', 'ssn'], kind) AS rank,
           round(least(1.0, CAST(CASE kind WHEN 'email' THEN 80 WHEN 'ip' THEN 50 WHEN 'card' THEN 70 WHEN 'phone' THEN 50 WHEN 'iban' THEN 80 ELSE 20 END
               + CASE WHEN {_NEAR} THEN 15 ELSE 0 END - CASE WHEN list_has_any(near, {_words(AGAINST)}) THEN 20 ELSE 0 END AS DOUBLE) / 100), 4) AS score
    FROM around
), joined AS (
    SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
           count(*) FILTER (kind = 'phone') AS n_phone, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank <= 4) AS base,
           string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans, max(score) AS top_score
    FROM scored WHERE kind <> 'ssn' OR score >= 0.3 GROUP BY rid
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(top_score AS DOUBLE) AS top_score
FROM t LEFT JOIN joined USING (rid)
"""

# XXH64 in integers modulo 2**64. A rotation is a product modulo 2**64 - 1, which is exact but for the one value of all ones.
# The hash's five primes.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_MOD, _ONES = 18446744073709551616, 18446744073709551615


def _rot(x: str, bits: int) -> str:
    return f"(({x}) * {1 << bits} % {_ONES})"


def _round(acc: str, lane: str) -> str:
    return f"({_rot(f'({acc} + {lane} * {_P2}) % {_MOD}', 31)} * {_P1} % {_MOD})"


def _lane(start: str, width: int) -> str:
    """The little-endian number of ``width`` bytes from ``start`` on; ``rx`` is the bytes in hex, last byte first."""
    return f"CAST(CAST('0x' || substr(rx, 2 * (n - ({start}) - {width}) + 1, {2 * width}) AS UBIGINT) AS UHUGEINT)"


def _folded(first: str, starts: str, width: int, step: str) -> str:
    """``step`` of h and x over the lanes that begin at ``starts``."""
    return f"list_reduce(list_prepend(CAST({first} AS UHUGEINT), list_transform({starts}, lambda p: {_lane('p', width)})), lambda h, x: {step})"


def _xxh64(source: str, seed: int = 42) -> str:
    """CTEs over the column ``s`` of a table of texts; the last, ``hashed``, has s and h (UHUGEINT)."""
    firsts = [(seed + _P1 + _P2) % _MOD, (seed + _P2) % _MOD, seed, (seed - _P1) % _MOD]
    v = [_folded(str(a), f"range({8 * k}, n // 32 * 32, 32)", 8, _round("h", "x")) for k, a in enumerate(firsts)]
    mixed = "(" + " + ".join(_rot(f"v{k + 1}", b) for k, b in enumerate((1, 7, 12, 18))) + f") % {_MOD}"
    for k in range(4):
        zero = f"CAST(0 AS UHUGEINT) + v{k + 1}"
        mixed = f"((xor({mixed}, {_round('CAST(0 AS UHUGEINT)', f'({zero})')}) * {_P1} + {_P4}) % {_MOD})"
    eight = _folded("h0", "range(n // 32 * 32, n // 8 * 8, 8)", 8, f"({_rot('xor(h, ' + _round('CAST(0 AS UHUGEINT)', 'x') + ')', 27)} * {_P1} + {_P4}) % {_MOD}")
    four = f"CASE WHEN n % 8 >= 4 THEN ({_rot(f'xor(h1, {_lane(chr(110) + ' // 8 * 8', 4)} * {_P1} % {_MOD})', 23)} * {_P2} + {_P3}) % {_MOD} ELSE h1 END"
    one = _folded("h2", "range(n // 4 * 4, n)", 1, f"{_rot(f'xor(h, x * {_P5} % {_MOD})', 11)} * {_P1} % {_MOD}")
    return f"""
xx AS (
    SELECT s, strlen(s) AS n, regexp_replace(reverse(hex(encode(s))), '(.)(.)', '\\2\\1', 'g') AS rx FROM {source}
), x0 AS (
    SELECT s, n, rx, {', '.join(f'{x} AS v{k + 1}' for k, x in enumerate(v))} FROM xx
), x1 AS (
    SELECT s, n, rx, ((CASE WHEN n >= 32 THEN {mixed} ELSE CAST({(seed + _P5) % _MOD} AS UHUGEINT) END) + CAST(n AS UHUGEINT)) % {_MOD} AS h0 FROM x0
), x2 AS (
    SELECT s, n, rx, {eight} AS h1 FROM x1
), x3 AS (
    SELECT s, n, rx, {four} AS h2 FROM x2
), x4 AS (
    SELECT s, {one} AS h3 FROM x3
), x5 AS (
    SELECT s, xor(h3, h3 >> 33) * {_P2} % {_MOD} AS h4 FROM x4
), x6 AS (
    SELECT s, xor(h4, h4 >> 29) * {_P3} % {_MOD} AS h5 FROM x5
), hashed AS (
    SELECT s, xor(h5, h5 >> 32) AS h FROM x6
)"""


#: Fingerprints by bits in most shingles, and all links between different fingerprints followed.
SIMHASH = rf"""
WITH RECURSIVE w AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS l FROM documents
), i AS (
    SELECT rid, l, unnest(range(1, greatest(len(l) - 2, 1) + 1)) AS i FROM w WHERE len(l) > 0
), k AS (
    SELECT rid, array_to_string(l[i : i + 2], ' ') AS s FROM i
), distinct_ AS (
    SELECT DISTINCT s FROM k
), {_xxh64('distinct_').strip()}, f AS (
    SELECT rid, {' + '.join(f'CASE WHEN 2 * count(*) FILTER (h & {1 << b} <> 0) > count(*) THEN CAST({1 << b} AS UBIGINT) ELSE 0 END' for b in range(64))} AS fp
    FROM k JOIN (SELECT s, CAST(h AS UBIGINT) AS h FROM hashed) USING (s) GROUP BY rid
), own AS (
    SELECT doc_id, CAST(coalesce(fp, 0) AS UBIGINT) AS fp FROM w LEFT JOIN f USING (rid)
), least_ AS (
    SELECT fp, min(doc_id) AS id FROM own GROUP BY fp
), link AS (
    SELECT a.fp AS a, b.fp AS b FROM least_ a JOIN least_ b ON a.fp <> b.fp AND bit_count(CAST(xor(a.fp, b.fp) AS BIT)) <= 3
), reach AS (
    SELECT fp AS a, fp AS b FROM least_ UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), comp AS (
    SELECT reach.a AS fp, min(id) AS component_id FROM reach JOIN least_ ON least_.fp = reach.b GROUP BY reach.a
)
SELECT doc_id, printf('%016x', fp) AS fingerprint, component_id FROM own JOIN comp USING (fp)
"""

_CRC_POLY = 0xEDB88320


def _crc_of(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ _CRC_POLY * (byte & 1)
    return byte


_CRC_STEP = "h >> 8"
for _b in range(8):  # the step's table is linear over xor: one entry for each bit of the byte
    _CRC_STEP = f"xor({_CRC_STEP}, (xor(h, x) >> {_b} & 1) * {_crc_of(1 << _b)})"

#: Shards by minimax contiguous partition: the least capacity by binary search over the ends of the ordered groups, each
#: tried shard by shard. Slots are those of one numbering cell, so of at most ``SLOT_ROWS`` rows in file order.
SHARDING = f"""
WITH RECURSIVE w AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS s FROM documents
), distinct_ AS (
    SELECT DISTINCT s FROM w
), {_xxh64('distinct_').strip()}, b AS (
    SELECT s, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS l FROM distinct_
), crc AS (
    SELECT s, xor(list_reduce(list_prepend(CAST({0xFFFFFFFF} AS BIGINT), l), lambda h, x: {_CRC_STEP}), {0xFFFFFFFF}) AS crc FROM b
), slim AS (
    SELECT rid, doc_id, CAST(strlen(s) + {ROW_COST} AS BIGINT) AS size, crc, CAST(h AS HUGEINT) AS h FROM w JOIN hashed USING (s) JOIN crc USING (s)
), g AS (
    SELECT h, h - CASE WHEN h >= {1 << 63} THEN {_MOD} ELSE 0 END AS signed, CAST(sum(size) AS BIGINT) AS size FROM slim GROUP BY h
), ranked AS (
    SELECT h, size, row_number() OVER o - 1 AS k, sum(size) OVER () - sum(size) OVER o + size AS rest FROM g WINDOW o AS (ORDER BY size DESC, signed ROWS UNBOUNDED PRECEDING)
), heavy AS (
    SELECT h, k FROM (SELECT h, k, bool_and(k + 1 < 24 AND size * (24 - k) >= rest) OVER (ORDER BY k) AS yes FROM ranked) WHERE yes
), o AS (
    SELECT h, size, CAST(sum(size) OVER (ORDER BY h ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM g ANTI JOIN heavy USING (h)
), all_ AS (
    SELECT list(e ORDER BY e) AS ends, max(e) AS total, max(size) AS largest, 24 - (SELECT count(*) FROM heavy) AS shards FROM o
), tried AS (
    SELECT greatest(largest, (total + shards - 1) // shards) AS low, largest + (total + shards - 1) // shards AS high, CAST(0 AS BIGINT) AS mark, CAST(0 AS BIGINT) AS used FROM all_
    UNION ALL
    SELECT CASE WHEN used = shards AND mark < total THEN (low + high) // 2 + 1 ELSE low END, CASE WHEN mark = total THEN (low + high) // 2 ELSE high END,
           CASE WHEN mark = total OR used = shards THEN 0 ELSE list_max(list_filter(ends, lambda x: x <= mark + (low + high) // 2)) END,
           CASE WHEN mark = total OR used = shards THEN 0 ELSE used + 1 END
    FROM tried, all_ WHERE low < high
), capacity AS (
    SELECT min(high) AS c FROM tried WHERE low >= high
), cut AS (
    SELECT CAST(0 AS BIGINT) AS mark
    UNION ALL
    SELECT list_max(list_filter(ends, lambda x: x <= mark + c)) FROM cut, all_, capacity WHERE mark + c < total
), placed AS (
    SELECT o.h, (SELECT count(*) FROM heavy) + (SELECT count(*) FROM cut WHERE mark > 0 AND mark <= o.e - o.size) AS shard FROM o
    UNION ALL
    SELECT h, k FROM heavy
)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY rid) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM slim JOIN placed USING (h)
"""
