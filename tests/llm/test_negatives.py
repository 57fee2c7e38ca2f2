"""Hard negatives against brute force, and against SQL over the driver's vectors."""

import math
import random

import duckdb
import pytest
from conftest import canonical
from pyspark.sql import functions as F

from geoflow.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, l string, slot int, d int"


def brute(rows, positives=5, n=3):
    """Rows (vec_id, vector, label) by exact scores of all pairs."""
    use = {(i, tuple(math.floor(256 * x) for x in v), y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)}
    anchors = {}
    for i, v, y in sorted(use, key=lambda r: (r[0], str(r[2]), r[1])):
        anchors.setdefault(i, (v, y))
    out = []
    for a, (v, y) in anchors.items():
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, z) for i, w, z in use if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == y][:positives]:
            s = -s
            inside = [x for x in scored if x[2] != y and 50 * s <= -100 * x[0] <= 95 * s][:n]
            out += [(a, p, k, i, s, -t) for k, (t, i, _) in enumerate(inside, 1)]
    return sorted(out)


def result(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 7, "x", "y", 1, 2) for r in rows], SCHEMA).repartition(3)
    found = negatives.hard_negatives(negatives.whole_vectors(df, "vec_id", "embedding", "label"), F.col("id") % 50 == 0, **kw)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in found.collect())


def vectors(seed, n=700, d=8, labels=3):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 0.4) for _ in range(d)] for _ in range(6)]
    near = lambda: [round(x + rng.gauss(0, 0.2), 2) for x in rng.choice(middles)]
    return [(i, near(), rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    assert result(spark, vectors(seed)) == brute(as_floats(vectors(seed)))


def as_floats(rows):
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]


def test_missing_odd_and_repeated_vectors(spark):
    rows = vectors(3, 300)
    odd = [(50, None, 1), (350, [0.1] * 8, None), (None, [0.1] * 8, 1), (400, [float("nan")] * 8, 1), (450, [None, *[0.1] * 7], 1), (500, [float("inf"), *[0.1] * 7], 1), (550, [], 1), (551, [], 2), (600, [0.5, 0.5], 1), (601, [0.5, 0.25], 1), (602, [0.5, 0.1], 2), (650, [-0.5] * 8, 0)]
    copies = [(1000 + i, [0.3] * 8, i % 2) for i in range(200)]
    rows = [r for r in rows if r[0] != 50] + odd + copies + rows[:60] + [(0, [0.2] * 8, 2)]
    rows = [r for r in rows if r[0] != 50 or r[1] is None]
    assert result(spark, rows) == brute(as_floats(rows))


def test_large_components(spark):
    rows = [(i, [x * 1000.0 for x in v], y) for i, v, y in vectors(4, 200)]
    assert result(spark, rows) == brute(as_floats(rows))
    assert result(spark, [(0, [1e30] * 8, 1), (1, [0.5] * 8, 1), (2, [0.3] * 8, 2)]) == []


def test_empty_table(spark):
    assert result(spark, []) == []


def test_query_equals_sql(spark, sf):
    df = queries.queries()["op12_hard_negatives"](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    done = con.execute(queries.oracle_sql()["op12_hard_negatives"])
    theirs, other = canonical(done.fetchall(), [c[0] for c in done.description])
    mine, columns = canonical([tuple(r) for r in df.collect()], df.columns)
    assert columns == other and mine == theirs and mine
