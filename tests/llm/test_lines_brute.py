"""Line dedup of whole tables against sets of lines, document by document."""

import random

from geoflow.llm import lines


def brute(rows):
    """Of rows (id, text) in order: which lines of text stay, blank ones aside; alike rows are one document."""
    first, out = {}, {}
    for i, t in sorted(set(rows)):
        for x in (t or "").split("\n"):
            if x.strip(" "):
                first.setdefault(x.strip(" "), (i, t))
    for i, t in rows:
        out[i, t] = [x for x in (t or "").split("\n") if x.strip(" ") and first[x.strip(" ")] == (i, t)]
    return out


def compare(spark, rows):
    df = spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, text string, whole string")
    got = lines.dedup_lines(df).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert [x for x in (r["text"] or "").split("\n") if x.strip(" ")] == want[r["doc_id"], r["whole"]], r["doc_id"]


def test_no_shared_line_stays_in_a_later_document(spark):
    rng = random.Random(7)
    pool = [f"line {i}" for i in range(60)] + ["", "  ", "end"]
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own {rng.random()}" for _ in range(rng.randrange(1, 40))) for _ in range(120)]
    moved = texts[0].split("\n")
    texts += ["\n".join(reversed(moved)), "\n".join(moved * 50), "x\n" * 3000 + "line 1", texts[3], "", " \n ", "long " * 50_000]
    compare(spark, list(enumerate(texts)))


def test_documents(spark, sf):
    compare(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
