"""DuckDB SQL of the operators that SQL can express, written apart from the Spark code."""

from __future__ import annotations

from geoflow.llm import secret_scan, templates

_SLOTS = ", ".join(f"'{x}'" for x in templates.SLOTS)
_UNIT = "|".join(templates.UNITS)
_NUMBERS = "|".join(templates.NUMBERS)
_UNITS = ", ".join(f"'{x}'" for x in templates.UNITS)
_COUNTS = """count(DISTINCT nth) AS n_windows, count(DISTINCT CASE WHEN NOT dense THEN nth END) AS n_usual,
    any_value(total) AS item_windows, any_value(usual) AS usual, sum(slots) AS slots"""
_ENOUGH = f"(n_windows >= least({templates.MATCHES}, item_windows) OR (usual > 0 AND n_usual >= least({templates.MATCHES}, usual)))"

# every window of every text against every window of every item, by the tokens themselves
OP1 = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS k, * FROM (
    SELECT DISTINCT 'd' AS side, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL
    UNION ALL SELECT 'b', item_id, text FROM benchmark WHERE item_id IS NOT NULL)),
words AS (
  SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
    SELECT k, list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0d \x02]+'), lambda x: x <> '') AS ws FROM texts)),
bare AS (
  SELECT k, i, regexp_replace(regexp_replace(w, '^[^\p{{L}}\p{{N}}$€£+\-]+', ''), '[^\p{{L}}\p{{N}}%]+$', '') AS c,
    coalesce(regexp_matches(lag(w) OVER (PARTITION BY k ORDER BY i), '[.!?:]["'')\]]*$'), true) AS starts FROM words),
parted AS (SELECT *, CASE WHEN regexp_full_match(c, '([+\-]?[$€£]?[0-9][0-9.,:/]*)((?i:{_UNIT}))') THEN [regexp_extract(c, '^[+\-]?[$€£]?[0-9][0-9.,:/]*'), regexp_replace(c, '^[+\-]?[$€£]?[0-9][0-9.,:/]*', '')] ELSE [c] END AS cs FROM bare),
cores AS (SELECT k, 2 * i + j AS i, cs[j] AS c, starts AND j = 1 AS starts FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS j FROM parted)),
kinds AS (SELECT *, regexp_full_match(c, '[+\-]?[$€£]?[0-9][0-9.,:/]*%?') OR regexp_full_match(lower(c), '({_NUMBERS})(-(one|{_NUMBERS}))*') AS num FROM cores),
named AS (
  SELECT k, i, lower(c) AS v, CASE WHEN num THEN '<num>'
    WHEN lower(c) IN ({_UNITS}) AND NOT starts AND lag(num) OVER (PARTITION BY k ORDER BY i) THEN '<unit>'
    WHEN NOT starts AND regexp_full_match(c, '\p{{Lu}}\p{{Ll}}+(-\p{{Lu}}\p{{Ll}}+)*') THEN '<name>' ELSE lower(c) END AS t
  FROM kinds),
lists AS (
  SELECT k, list(t ORDER BY i) AS t, list(v ORDER BY i) AS v, list(CASE WHEN t IN ({_SLOTS}) THEN t || chr(1) || v ELSE t END ORDER BY i) AS tv
  FROM named WHERE v <> '' GROUP BY k),
items AS (SELECT id AS item, l.*, least({templates.WINDOW}, len(t)) AS size FROM lists l JOIN texts USING (k) WHERE side = 'b'),
item_windows AS (
  SELECT item, size, nth, n AS total, t[nth + 1 : nth + size] AS w, tv[nth + 1 : nth + size] AS wv,
    len(list_filter(t[nth + 1 : nth + size], lambda x: x IN ({_SLOTS}))) AS slots
  FROM (SELECT *, len(t) - size + 1 AS n, unnest(range(len(t) - size + 1)) AS nth FROM items)),
judged_windows AS (SELECT *, slots * 2 > size AND total > 1 AS dense FROM item_windows),
asked AS (SELECT *, sum(CASE WHEN dense THEN 0 ELSE 1 END) OVER (PARTITION BY item) AS usual FROM judged_windows),
doc_windows AS (
  SELECT k, size, pos, t[pos + 1 : pos + size] AS w, tv[pos + 1 : pos + size] AS wv
  FROM (SELECT k, t, tv, size, unnest(range(len(t) - size + 1)) AS pos FROM lists JOIN texts USING (k), (SELECT DISTINCT size FROM items) WHERE side = 'd')),
hits AS (
  SELECT k, pos, item, nth, d.size, total, usual, slots, dense FROM doc_windows d JOIN asked a ON d.size = a.size AND d.w = a.w AND NOT dense
  UNION ALL SELECT k, pos, item, nth, d.size, total, usual, slots, dense FROM doc_windows d JOIN asked a ON d.size = a.size AND d.wv = a.wv AND dense),
pairs AS (SELECT * FROM (SELECT k, item, {_COUNTS} FROM hits GROUP BY k, item) WHERE {_ENOUGH}),
far AS (SELECT h.*, pos - nth AS diagonal, pos - nth - lag(pos - nth) OVER (PARTITION BY k, item ORDER BY pos - nth) >= h.size AS new FROM hits h JOIN pairs p USING (k, item) WHERE p.slots > 0),
runs AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY k, item ORDER BY diagonal RANGE UNBOUNDED PRECEDING) AS run FROM far),
occurrences AS (SELECT *, 0 AS level, 0 AS part FROM runs UNION ALL SELECT *, 1, run FROM runs UNION ALL SELECT *, 2, diagonal FROM runs),
whole AS (SELECT * FROM (SELECT k, item, level, part, {_COUNTS} FROM occurrences GROUP BY k, item, level, part) WHERE {_ENOUGH}),
filled AS (
  SELECT DISTINCT o.k, o.item, level, part, nth + j AS q, d.v[pos + j + 1] AS said
  FROM (SELECT *, unnest(range(size)) AS j FROM occurrences) o JOIN lists d USING (k) JOIN items i ON i.item = o.item WHERE i.t[nth + j + 1] IN ({_SLOTS})),
ways AS (SELECT k, item, level, part, q, count(*) AS n FROM filled GROUP BY k, item, level, part, q),
consistent AS (SELECT k, item, level, part, count(*) AS n_slots, max(n) = 1 AS ok FROM ways GROUP BY k, item, level, part),
held AS (
  SELECT k, item, max(n_slots) AS n_slots FROM whole LEFT JOIN consistent USING (k, item, level, part) WHERE coalesce(ok, true) GROUP BY k, item),
found AS (
  SELECT k, item, n_windows, item_windows, 0 AS n_slots FROM pairs WHERE slots = 0
  UNION ALL SELECT k, item, n_windows, item_windows, coalesce(h.n_slots, 0) FROM pairs JOIN held h USING (k, item) WHERE slots > 0)
SELECT id AS doc_id, item AS item_id, max(n_windows) AS n_windows, max(item_windows)::BIGINT AS item_windows, max(n_slots)::BIGINT AS n_slots
FROM found JOIN texts USING (k) GROUP BY id, item
"""

# every 200-byte string by itself, as 400 hexadecimal digits
OP4 = """
WITH texts AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT k, p, substring(h, 2 * p + 1, 1398) AS h FROM (SELECT k, h, unnest(range(0, greatest(length(h) // 2 - 199, 0), 500)) AS p FROM texts)),
windows AS (SELECT k, p + i AS i, substring(h, 2 * i + 1, 400) AS s FROM (SELECT k, p, h, unnest(range(length(h) // 2 - 199)) AS i FROM pieces)),
again AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
hits AS (SELECT k, i, coalesce(i > lag(i) OVER (PARTITION BY k ORDER BY i) + 200, true) AS new FROM windows SEMI JOIN again USING (s)),
numbered AS (SELECT k, i, sum(new::INT) OVER (PARTITION BY k ORDER BY i) AS part FROM hits),
spans AS (SELECT k, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY k, part),
cuts AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS since FROM spans),
kept AS (
  SELECT k, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS upto, string_agg(substring(any_h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS left_
  FROM (SELECT c.*, t.h AS any_h FROM cuts c JOIN texts t USING (k)) GROUP BY k)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(left_, '') || substring(h, 2 * coalesce(upto, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN kept USING (k)
"""


def _xxh64(texts: str, seed: int = 42) -> str:
    """CTEs xx0 ... hashed (every column of `texts`, h UBIGINT): XXH64 of the UTF-8 bytes of its column s, by the published algorithm.

    A rotation by r is a product with 2**r modulo 2**64 - 1.
    """
    # Fixed values of XXH64.
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    m = 1 << 64
    big = lambda x: f"{x}::UHUGEINT"
    times = lambda x, p: f"(({x}) * {big(p)} % {big(m)})"
    turn = lambda x, r: f"(({x}) * {big(1 << r)} % {big(m - 1)})"
    plus = lambda x, y: f"((({x}) + ({y})) % {big(m)})"
    step = lambda acc, lane: times(turn(plus(acc, times(lane, p2)), 31), p1)
    byte = lambda i: f"substring(x, 2 * ({i}) + 1, 2)"
    lane = lambda i, n: f"('0x' || {' || '.join(byte(f'{i} + {k}') for k in reversed(range(n)))})::UBIGINT::UHUGEINT"
    start = ", ".join(big((seed + x) % m) for x in (p1 + p2, p2, 0, -p1))
    stripes = f"list_transform(range(n // 32), lambda j: [{', '.join(lane(f'j * 32 + {8 * k}', 8) for k in range(4))}])"
    merged = "h"
    for k in range(4):
        merged = plus(times(f"xor({merged}, {step(big(0), f'v[{k + 1}]')})", p1), big(p4))
    first = plus(plus(turn("v[1]", 1), turn("v[2]", 7)), plus(turn("v[3]", 12), turn("v[4]", 18)))
    after8 = plus(times(turn(f"xor(acc, {step(big(0), 'y')})", 27), p1), big(p4))
    after4 = plus(times(turn(f"xor(h, {times(lane('n // 8 * 8', 4), p1)})", 23), p2), big(p3))
    after1 = times(turn(f"xor(acc, {times('y', p5)})", 11), p1)
    return f"""
xx0 AS (SELECT DISTINCT s, hex(encode(s)) AS x, length(hex(encode(s))) // 2 AS n FROM {texts}),
xx1 AS (SELECT *, list_reduce(list_prepend([{start}], {stripes}), lambda a, y: [{", ".join(step(f"a[{k}]", f"y[{k}]") for k in range(1, 5))}]) AS v FROM xx0),
xx2 AS (SELECT s, x, n, v, CASE WHEN n >= 32 THEN {first} ELSE {big((seed + p5) % m)} END AS h FROM xx1),
xx3 AS (SELECT s, x, n, (CASE WHEN n >= 32 THEN {merged} ELSE h END + n::UHUGEINT) % {big(m)} AS h FROM xx2),
xx4 AS (SELECT s, x, n, list_reduce(list_prepend(h, list_transform(range(n // 32 * 4, n // 8), lambda j: {lane("j * 8", 8)})), lambda acc, y: {after8}) AS h FROM xx3),
xx5 AS (SELECT s, x, n, CASE WHEN n % 8 >= 4 THEN {after4} ELSE h END AS h FROM xx4),
xx6 AS (SELECT s, list_reduce(list_prepend(h, list_transform(range(n // 4 * 4, n), lambda j: ('0x' || {byte("j")})::UBIGINT::UHUGEINT)), lambda acc, y: {after1}) AS h FROM xx5),
xx7 AS (SELECT s, {times(f"xor(h, h // {big(1 << 33)})", p2)} AS h FROM xx6),
xx8 AS (SELECT s, {times(f"xor(h, h // {big(1 << 29)})", p3)} AS h FROM xx7),
xx9 AS (SELECT s, xor(h, h // {big(1 << 32)})::UBIGINT AS h FROM xx8),
hashed AS (SELECT t.*, xx9.h FROM {texts} t JOIN xx9 USING (s))"""


def _shingles(texts: str, words: int) -> str:
    """CTEs ... shingles (k, s): each run of `words` words of the texts (k, text), repeats included; a shorter text is one."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
split AS (SELECT k, list_filter(string_split_regex(translate(text, '{upper}', '{upper.lower()}'), '[\x20\x09-\x0d]+'), lambda x: x <> '') AS w FROM {texts}),
shingles AS (SELECT k, array_to_string(w[i + 1 : i + {words}], ' ') AS s FROM (SELECT k, w, unnest(range(greatest(len(w) - {words - 1}, least(len(w), 1)))) AS i FROM split))"""


_BITS = " + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::UBIGINT ELSE 0 END" for b in range(64))

OP7 = f"""
WITH RECURSIVE texts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),{_shingles("texts", 3)},{_xxh64("shingles")},
voted AS (SELECT k, {_BITS} AS fp FROM hashed GROUP BY k),
prints AS (SELECT doc_id, coalesce(fp, 0)::UBIGINT AS fp FROM texts LEFT JOIN voted USING (k)),
least_ids AS (SELECT fp, min(doc_id) AS id FROM prints GROUP BY fp),
links AS (SELECT a.fp AS u, b.fp AS v FROM least_ids a, least_ids b WHERE bit_count(xor(a.fp, b.fp)::HUGEINT) <= 2),
reached AS (SELECT fp AS u, fp AS v FROM least_ids UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u),
named AS (SELECT u AS fp, min(id) AS component_id FROM reached JOIN least_ids ON v = least_ids.fp GROUP BY u)
SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, component_id FROM prints JOIN named USING (fp)
"""

OP6 = f"""
WITH ordered AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS r, count(*) OVER () AS n FROM documents),
pairs AS (SELECT a.r, a.doc_id, a.text, b.text AS next_text, length(a.text) AS n_chars, length(a.text) // 4 AS cut FROM ordered a JOIN ordered b ON b.r = a.r % a.n + 1),
edited AS (SELECT *, substring(text, 1, n_chars - cut) || substring(next_text, 1, cut) AS edit FROM pairs),
texts AS (SELECT row_number() OVER () AS k, text FROM (SELECT DISTINCT text FROM edited UNION SELECT edit FROM edited UNION SELECT next_text FROM edited)),{_shingles("texts", 5)},{_xxh64("shingles")},
sketches AS (SELECT text, coalesce(sk, []) AS sk FROM texts LEFT JOIN (SELECT k, list_sort(list(DISTINCT h))[1:128] AS sk FROM hashed GROUP BY k) USING (k)),
three AS (
  SELECT e.*, a.sk AS own, b.sk AS other, c.sk AS following FROM edited e
  JOIN sketches a ON a.text = e.text JOIN sketches b ON b.text = e.edit JOIN sketches c ON c.text = e.next_text),
unions AS (SELECT *, list_sort(list_distinct(own || other))[1:128] AS with_edited, list_sort(list_distinct(own || following))[1:128] AS with_next FROM three)
SELECT doc_id, n_chars, sha256(edit) AS edited_sha256,
  array_to_string(list_transform(own, lambda x: lpad(lower(hex(x)), 16, '0')), '') AS fingerprint,
  array_to_string(list_transform(other, lambda x: lpad(lower(hex(x)), 16, '0')), '') AS edited_fingerprint,
  CASE WHEN len(with_edited) = 0 THEN 1.0 ELSE len(list_intersect(list_intersect(with_edited, own), other)) / len(with_edited) END AS near_edited,
  CASE WHEN len(with_next) = 0 THEN 1.0 ELSE len(list_intersect(list_intersect(with_next, own), following)) / len(with_next) END AS near_next,
  DISTINCT_OF AS distinct_shingles,
  CASE WHEN len(own) = 0 THEN 1.0 ELSE least(1.0, (CASE WHEN len(with_edited) = 0 THEN 1.0 ELSE len(list_intersect(list_intersect(with_edited, own), other)) / len(with_edited) END) * UNION_OF / DISTINCT_OF) END AS containment_edited
FROM unions
""".replace("DISTINCT_OF", "(CASE WHEN len(own) < 128 THEN len(own)::DOUBLE ELSE 127 / ((own[128]::DOUBLE + 1) / 18446744073709551616::DOUBLE) END)").replace(
    "UNION_OF", "(CASE WHEN len(with_edited) < 128 THEN len(with_edited)::DOUBLE ELSE 127 / ((with_edited[128]::DOUBLE + 1) / 18446744073709551616::DOUBLE) END)"
)


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


_BASE = " UNION ALL ".join(
    f"SELECT doc_id, k, {kind} AS kind, string_split_regex(t, '{_quoted(p)}') AS gaps, regexp_extract_all(t, '{_quoted(p)}') AS found, {group} AS part, {least} AS least, '{_quoted(p)}' AS p FROM texts"
    for kind, (_, p, group, least) in enumerate(secret_scan.BASE)
)
_CLASS = " ".join(
    f"WHEN len(f) >= {window} AND " + " AND ".join(f"regexp_matches(f, '{x}')" for x in ([f"^{p}$"] if p else secret_scan.MIXED)) + f" THEN {kind}"
    for kind, (_, p, _, window, _) in enumerate(secret_scan.CLASSES, len(secret_scan.BASE))
)
_WINDOW = "CASE kind " + " ".join(f"WHEN {kind} THEN {c[3]}" for kind, c in enumerate(secret_scan.CLASSES, len(secret_scan.BASE))) + " END"
_LIMIT = "CASE kind " + " ".join(f"WHEN {kind} THEN {secret_scan.limit(c[3], c[4])}" for kind, c in enumerate(secret_scan.CLASSES, len(secret_scan.BASE))) + " END"
_WEIGHTS = str([secret_scan.weight(n) for n in range(1, 1 + max(c[3] for c in secret_scan.CLASSES))])
_KINDS = str(secret_scan.KINDS)

# every window of every candidate by itself: its characters grouped and counted
OP11 = f"""
WITH texts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
looked AS ({_BASE} UNION ALL SELECT doc_id, k, 99, string_split_regex(t, '{secret_scan.CANDIDATE}'), regexp_extract_all(t, '{secret_scan.CANDIDATE}'), 0, 0, '' FROM texts),
each AS (SELECT k, kind, part, least, p, unnest(found) AS f, unnest(gaps[1:len(found)]) AS g, generate_subscripts(found, 1) AS i FROM looked WHERE len(found) > 0),
placed AS (SELECT *, (sum(len(f) + len(g)) OVER (PARTITION BY k, kind ORDER BY i))::BIGINT AS e FROM each),
base AS (SELECT k, e - len(f) AS s, kind, e FROM placed WHERE kind < 99 AND len(CASE WHEN part > 0 THEN regexp_extract(f, p, 2) ELSE f END) >= least),
runs AS (SELECT k, i, f, e - len(f) AS s, CASE WHEN regexp_matches(lower(f), '{secret_scan.ALLOW}') THEN NULL {_CLASS} END AS kind FROM placed WHERE kind = 99),
chars AS (SELECT k, i, s, kind, {_WINDOW} AS w, len(f) AS n, unnest(string_split(f, '')) AS c, generate_subscripts(string_split(f, ''), 1) AS q FROM runs WHERE kind IS NOT NULL),
spread AS (SELECT k, i, s, kind, w, c, unnest(range(greatest(q, w), least(q + w - 1, n) + 1)) AS z FROM chars),
counted AS (SELECT k, i, s, kind, w, z, count(*) AS n FROM spread GROUP BY k, i, s, kind, w, z, c),
hits AS (SELECT k, i, s, kind, w, z FROM counted GROUP BY k, i, s, kind, w, z HAVING sum({_WEIGHTS}[n]) <= any_value({_LIMIT})),
news AS (SELECT *, coalesce(z - w > lag(z) OVER (PARTITION BY k, i ORDER BY z), true) AS new FROM hits),
parts AS (SELECT *, sum(new::INT) OVER (PARTITION BY k, i ORDER BY z) AS part FROM news),
more AS (SELECT k, any_value(s) + min(z) - any_value(w) AS s, any_value(kind) AS kind, any_value(s) + max(z) AS e FROM parts GROUP BY k, i, part),
said AS (SELECT k, kind, s, e, {_KINDS}[kind + 1] || ':' || s || ':' || e AS x FROM (SELECT k, s, kind, e FROM base UNION ALL SELECT k, s, kind, e FROM more)),
whole AS (SELECT k, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(x, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS b, string_agg(x, ',' ORDER BY s, kind, e) AS spans FROM said GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN whole USING (k)
"""

# every anchor with every row
OP12 = """
WITH vectors AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.id AS anchor, b.id AS other, a.l = b.l AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM vectors a JOIN vectors b ON a.id % 50 = 0 AND a.id <> b.id),
positives AS (SELECT anchor, other AS positive, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, positive AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, positive ORDER BY s.score DESC, other) AS INT) AS rank, other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, positive ORDER BY s.score DESC, other) <= 3
"""
