"""Queries of the training-data operators against their SQL: over the driver's tables and over odd texts."""

import random

import duckdb
import pytest
from conftest import canonical

from geoflow.llm import queries

ODD = [None, "", " \n\t ", "one", "Ünïcode \U0001f600 text", "x" * 3000, "word " * 700, "line\n\nline\nother", "<|endoftext|> it's  two   spaces 123", "“Quoted” (5) km -- 7 km. Km 8 Cups"]


def compare(spark, name, folder):
    df = queries.queries()[name](spark, folder)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    done = con.execute(queries.oracle_sql()[name])
    theirs, other = canonical(done.fetchall(), [c[0] for c in done.description])
    mine, columns = canonical([tuple(r) for r in df.collect()], df.columns)
    assert columns == other
    assert mine == theirs
    return mine


def random_texts(seed, n=60):
    """Texts of few words, numbers, units and names, with pieces of each other."""
    rng = random.Random(seed)
    words = ["the", "a", "train", "goes", "from", "to", "town", "in", "and", "then", "of", "it", "has", "apples"]
    some = lambda: rng.choice([rng.choice(words), rng.choice(words), rng.choice([str(rng.randrange(30)), f"{rng.randrange(30)}km", "15Min", "five", "Twenty-one", "two-door"]), rng.choice(["km", "mph", "Hours"]), rng.choice(["Anna", "Berg-Dahl", "(Carl),", "end.", "--", "$5.20"])])
    texts = [" ".join(some() for _ in range(rng.randrange(5, 60))) for _ in range(n)]
    for _ in range(n):
        a, b = rng.sample(range(n), 2)
        w = texts[a].split()
        k = rng.randrange(len(w))
        piece = [str(rng.randrange(30)) if x.isdigit() and rng.random() < 0.5 else x for x in w[k : k + 25]]
        texts[b] += " " + " ".join(piece)
    return texts


TEXTS = sorted(set(queries.oracle_sql()) - {"op12_hard_negatives"})  # that one reads vectors, see test_negatives.py


@pytest.mark.parametrize("name", TEXTS)
def test_query_equals_sql(spark, sf, name):
    assert compare(spark, name, sf)


@pytest.mark.parametrize("name", TEXTS)
def test_query_equals_sql_on_odd_texts(spark, tmp_path, name):
    texts = [*random_texts(1), *ODD]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    items = [*random_texts(2, 6), *[t[:150] for t in texts[:12]], None, "", "it has 5", "3 4 5 6 7 8 9 10 11 12 13"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):  # one file, as the driver's tables are
        con.execute(f"COPY (SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')) TO '{tmp_path}/one-{t}.parquet'")
    folder = tmp_path / "in"
    folder.mkdir()
    for t in ("documents", "benchmark"):
        (tmp_path / f"one-{t}.parquet").rename(folder / f"{t}.parquet")
    assert compare(spark, name, str(folder))
