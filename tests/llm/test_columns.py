"""Every public operator on tables with columns named as its own inner ones."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from geoflow.llm import alignment, bpe, licenses, lines, quality, rindex, secret_scan, simhash, sketch, templates, token_counts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Names that the operators' own tables have had, or have.
NAMES = "_text _gone _id _sum _found gone sum id fp k t b s n m e h c a v x y i j pos part row label least kept key value doc first last lines item at size text_ _after _part _to _p _said own html host set place sketch spans cuts __text words".split()
TEXTS = ["one two three four five six", "one two three four five six", "Released under the MIT License.", "a train goes 60km in 2h from town to town and back again", "line a\nline b\nline c", "line x\nline b\nline c", "", None]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    return df.select("*", *(F.lit(f"mine {n}").alias(n) for n in NAMES))


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0, "z") for i in range(8)], "doc_id long, quality int, toxic int, text string")


def benchmark(spark):
    return spark.createDataFrame([(1, "a train goes 80km in 3h from town to town and back again", "z")], "item_id long, text string, doc_id string")


WHOLE = {
    "bpe": lambda spark, df: bpe.bpe_round_trip(df, BPE),
    "counts": lambda spark, df: token_counts.token_counts(df, BPE),
    "fingerprint": lambda spark, df: sketch.fingerprint(df),
    "simhash": lambda spark, df: simhash.fingerprints(df, "text", 3, 42),
    "near": lambda spark, df: simhash.simhash_dedup(df),
    "decontaminate": lambda spark, df: templates.decontaminate(df, benchmark(spark)),
    "lines": lambda spark, df: lines.dedup_lines(df),
    "secrets": lambda spark, df: secret_scan.scan(df),
    "alignment": lambda spark, df: alignment.align(df, BPE, PIECES),
}
PART = {
    "edited": lambda spark, df: sketch.edited_fingerprints(df),
    "groups": lambda spark, df: simhash.simhash_groups(df),
    "contaminated": lambda spark, df: templates.contaminated(df, benchmark(spark)),
    "repeats": lambda spark, df: rindex.remove_repeats(df),
    "licenses": lambda spark, df: licenses.license_matches(df),
    "quality": lambda spark, df: quality.quality_scores(df, labels(spark)),
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_the_callers_columns_stay(spark, table, name):
    out = WHOLE[name](spark, table)
    made = {c for c in out.columns if c not in table.columns}
    kept = [n for n in NAMES if n in out.columns]
    assert set(NAMES) - set(kept) <= {"fp", "spans"}
    rows = out.collect()
    assert rows and all(r[n] == f"mine {n}" for r in rows for n in kept if n not in made | {"fp", "spans"})


@pytest.mark.parametrize("name", sorted(PART))
def test_clashing_columns_change_no_result(spark, table, name):
    rows = lambda df: sorted(map(str, PART[name](spark, df).collect()))
    assert rows(table) == rows(table.select("doc_id", "text"))
