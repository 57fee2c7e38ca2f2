"""Document fingerprints: bottom-k sketches of shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoflow.llm.common import documents, fresh, in_arrow, partitions
from geoflow.llm.shingles import shingle_hashes

#: Hashes a sketch keeps: the standard error of a resemblance is at most 0.5 / sqrt(K).
K = 128
#: Groups whose sketches a task holds before it passes them on.
GROUPS = 10_000


class Sketch:
    """The k smallest distinct shingle hashes of a text, or of all texts that were merged."""

    def __init__(self, hashes: np.ndarray, k: int = K):
        self.k, self.hashes = k, np.unique(hashes)[:k]

    @classmethod
    def of(cls, text: str | None, words: int = 5, k: int = K) -> Sketch:
        return cls(shingle_hashes(text, words), k)

    @classmethod
    def parse(cls, fingerprint: str, k: int = K) -> Sketch:
        return cls(np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype("uint64"), k)

    def __str__(self) -> str:
        return self.hashes.astype(">u8").tobytes().hex()

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of both texts' shingles together."""
        return Sketch(np.concatenate([self.hashes, other.hashes]), min(self.k, other.k))

    def distinct(self) -> float:
        """Distinct shingles: exact below k, else from the k-th smallest hash."""
        return float(len(self.hashes)) if len(self.hashes) < self.k else (self.k - 1) / ((float(self.hashes[-1]) + 1) / 2.0**64)

    def resemblance(self, other: Sketch) -> float:
        """Shared part of the union (Jaccard); 1 for two texts without shingles."""
        both = self.merge(other)
        if not len(both.hashes):
            return 1.0
        shared = np.isin(both.hashes, self.hashes) & np.isin(both.hashes, other.hashes)
        return float(shared.mean())

    def containment(self, other: Sketch) -> float:
        """Part of this text's shingles that the other has; 1 for a text without shingles."""
        if not len(self.hashes):
            return 1.0
        j = self.resemblance(other)
        return float(min(1.0, j * self.merge(other).distinct() / self.distinct()))


def fingerprint(df: DataFrame, text: str = "text", words: int = 5, k: int = K) -> DataFrame:
    """`df` without `text`, with `fingerprint`: hex of the k smallest shingle hashes ("" for null, empty, blank)."""
    keep = [c for c in df.columns if c not in (text, "fingerprint")]
    own = fresh(df, "_text")
    df = df.select(*keep, F.col(text).cast("string").alias(own))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = [str(Sketch.of(x.as_py(), words, k)) for x in batch.column(own)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], [*keep, "fingerprint"])

    return in_arrow(df, run, df.drop(own).schema.add("fingerprint", "string", True))


def merged(df: DataFrame, by: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """(by, n_sketches, fingerprint, distinct_shingles): the sketch of all shingles of each group's texts together.

    Each task first merges its own rows, so a group reaches the shuffle as one sketch a task (or one for every
    GROUPS groups that a task has met), whatever its size. Null fingerprints are empty; null groups are a group.
    """
    schema = df.select(by).schema.add("n_sketches", "long", True).add("hashes", T.ArrayType(T.StringType()), True)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind, groups = None, {}

        def answer() -> pa.RecordBatch:
            columns = [pa.array(groups, kind), pa.array([n for n, _ in groups.values()], pa.int64()), pa.array([[f"{int(h):016x}" for h in s.hashes] for _, s in groups.values()], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, [by, "n_sketches", "hashes"])

        for batch in batches:
            kind = batch.column(by).type
            for group, said in zip(batch.column(by).to_pylist(), batch.column("_said").to_pylist(), strict=True):
                new = Sketch.parse(said or "", k)
                n, old = groups.get(group, (0, None))
                groups[group] = n + 1, old.merge(new) if old else new
            if len(groups) >= GROUPS:
                yield answer()
                groups.clear()
        if groups:
            yield answer()

    parts = in_arrow(df.select(by, F.col(fingerprint).alias("_said")), run, schema)
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hashes")))), 1, k)
    out = parts.groupBy(by).agg(F.sum("n_sketches").alias("n_sketches"), least.alias("hashes"))  # hexadecimal of one length: in the order of numbers
    last = F.conv(F.substring(F.get("hashes", F.lit(k - 1)), 1, 13), 16, 10).cast("double") * 4096.0 + F.conv(F.substring(F.get("hashes", F.lit(k - 1)), 14, 3), 16, 10).cast("double")
    distinct = F.when(F.size("hashes") < k, F.size("hashes").cast("double")).otherwise((k - 1) / ((last + 1) / 2.0**64))
    return out.select(by, "n_sketches", F.array_join("hashes", "").alias("fingerprint"), distinct.alias("distinct_shingles"))


def in_order(df: DataFrame, id: str, text: str) -> DataFrame:
    """`df` (id, text) dealt by ranges of id, each partition in order and followed by the row that comes after it.

    Rows added in that way have `_after` true and stand last in their partition. The last row of all is followed by
    the first of all. Order: null ids first, then id, then text. One shuffle; the driver gets one id per partition.
    """
    spark = df.sparkSession
    n = partitions(spark)
    cuts = sorted({int(x) for x in df.approxQuantile(id, [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    near = max(1, int(len(cuts) ** 0.5))
    coarse = F.array(*(F.lit(c) for c in cuts[near - 1 :: near])).cast("array<long>")
    every = F.array(*(F.lit(c) for c in cuts)).cast("array<long>")
    # which range: first among every near-th cut, then among the cuts after it
    skip = F.size(F.filter(coarse, lambda c: c <= F.col(id))) * near
    rest = F.size(F.filter(F.slice(every, skip + 1, near), lambda c: c <= F.col(id)))
    df = df.withColumn("_part", F.when(F.col(id).isNull(), 0).otherwise(skip + rest) if cuts else F.lit(0))
    first = {r["_part"]: (None if r["nulls"] else r["least"]) for r in df.groupBy("_part").agg(F.min(id).alias("least"), F.max(F.col(id).isNull()).alias("nulls")).collect()}
    used = sorted(first)
    before = {p: used[i - 1] for i, p in enumerate(used)}  # the first of all follows the last of all
    copies = F.lit(None).cast("int")
    if used:
        least = F.array(*(F.lit(first.get(p)).cast("long") for p in range(used[-1] + 1)))
        to = F.array(*(F.lit(before.get(p)).cast("int") for p in range(used[-1] + 1)))
        copies = F.when(F.get(least, F.col("_part")).eqNullSafe(F.col(id)), F.get(to, F.col("_part")))
    places = F.array(F.struct(F.col("_part").alias("to"), F.lit(False).alias("after")), F.struct(copies.alias("to"), F.lit(True).alias("after")))
    rows = df.select(id, text, F.explode(places).alias("_p")).where("_p.to IS NOT NULL").select(id, text, F.col("_p.to").alias("_to"), F.col("_p.after").alias("_after"))
    return rows.repartitionById(n, F.col("_to").cast("int")).sortWithinPartitions("_after", F.asc_nulls_first(id), F.asc_nulls_first(text)).select(id, text, "_after")


def edited_fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, k: int = K) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and how near they and the next document's are; how many
    distinct shingles the text has, and which part of them the edited text has, as the sketches tell.

    Edited: the last floor(n / 4) code points give way to the first as many (or all) of the next document, ascending
    id. Null texts are empty; texts without words have fingerprint "" and are wholly alike. Repeated ids are ordered
    by text; a lone row is its own next.
    """
    rows = in_order(df.select(F.col(id).cast("long").alias(id), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")), id, "_text")
    schema = f"`{id}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double, containment_edited double"

    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import pyarrow as pa

        names = [id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "distinct_shingles", "containment_edited"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
        held, done = None, False
        for batch in batches:
            out = []
            for key, value, after in zip(batch.column(id), batch.column("_text"), batch.column("_after"), strict=True):
                if done:
                    continue
                value = value.as_py()
                sketch = Sketch.of(value, words, k)
                if held is not None:
                    key0, value0, sketch0 = held
                    cut = len(value0) // 4
                    edited = value0[: len(value0) - cut] + value[:cut]
                    other = Sketch.of(edited, words, k) if edited != value0 else sketch0
                    out.append((key0, len(value0), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), str(sketch0), str(other), sketch0.resemblance(other), sketch0.resemblance(sketch), sketch0.distinct(), sketch0.containment(other)))
                held, done = (key.as_py(), value, sketch), after.as_py()
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    return in_arrow(rows, run, schema)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
