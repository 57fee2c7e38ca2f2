"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoflow.llm.common import documents, in_arrow, spill

#: Labelled rows used at most: above it, rows are taken by a hash of their id.
MAX_LABELLED = 500_000
FEATURES, RIDGE, WIDTH, BINS, PARTS = 256, 1e-3, 1.0, 1000, 16
STATISTICS = 20


def statistics(value: str | None) -> list[float]:
    """Fixed-length statistics of a whole text; zeros for null and empty."""
    data = (value or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * STATISTICS
    n, m = len(data), len(words)
    counts = np.bincount(np.frombuffer(data, "uint8"), minlength=256)
    p = counts[counts > 0] / n
    upper, lower, digit = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    high, space, lines = counts[128:].sum(), counts[32] + counts[9:14].sum(), data.split(b"\n")
    stops = counts[[ord(c) for c in ".,;:'\"-()?"]].sum()
    size = np.fromiter(map(len, words), "int64", m)
    kinds = len(set(words))
    same = sum(map(bytes.__eq__, words[1:], words[:-1]))
    odd = sum(not (97 <= w[-1] <= 122 or w[-1] >= 128 or w[-1] in b".,?;:'\")") for w in words)
    return [
        np.log1p(n), np.log1p(m), float(size.mean()), float(size.std()), float(np.log1p(size.max())),
        upper / n, lower / n, digit / n, high / n, space / n, stops / n, (n - upper - lower - digit - high - space - stops) / n,
        kinds / m, kinds / m**0.7, same / m, odd / m, len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        float(-(p * np.log(p)).sum()), sum(w[:1].isupper() for w in words) / m,
    ]


@dataclass
class Model:
    """A fitted classifier: scores statistics with random Fourier features and calibrates them."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.array([0.0]), np.array([0.5])))

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.steps).clip(0, 1)


def fourier(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel, from a fixed seed, with a constant."""
    rng = np.random.default_rng(20)
    w = rng.standard_normal((z.shape[1], FEATURES)) / (WIDTH * z.shape[1] ** 0.5)
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.cos(z.clip(-8, 8) @ w + b) * (2 / FEATURES) ** 0.5, np.ones((len(z), 1))])


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing means nearest to y, weighed by n."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, n, strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, k = blocks.pop()
            u, t, j = blocks[-1]
            blocks[-1] = [(u * t + v * w) / (t + w), t + w, j + k]
    return np.concatenate([[v] * int(k) for v, _, k in blocks])


def document_statistics(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, x): the statistics of each row's whole text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = pa.array([statistics(t.as_py()) for t in batch.column("_text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(id), x], [id, "x"])

    df = df.select(F.col(id), F.col(text).cast("string").alias("_text"))
    return in_arrow(df, run, df.select(id).schema.add("x", T.ArrayType(T.DoubleType())))


def _matrix(batch) -> np.ndarray:
    return np.array(batch.column("x").flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)


def fit(train: DataFrame) -> Model | None:
    """Fit on rows (x, y 0/1, half 0/1): None without rows.

    Each partition sums its normal equations by half; their sum gives the model, and each half's own sum scores the
    other half for the calibration, in BINS bins of equal width. Only PARTS pairs of matrices and the bins reach the
    driver.
    """
    train = spill(train.select("x", "y", "half").repartition(PARTS), "train")
    of = lambda i: F.get("x", F.lit(i))
    total = train.agg(F.count(F.lit(1)).alias("n"), *(F.avg(of(i)).alias(f"m{i}") for i in range(STATISTICS)), *(F.stddev_pop(of(i)).alias(f"s{i}") for i in range(STATISTICS))).first()
    if not total["n"]:
        return None
    model = Model(np.array([total[f"m{i}"] for i in range(STATISTICS)]), np.array([max(total[f"s{i}"], 1e-9) for i in range(STATISTICS)]), np.zeros(FEATURES + 1))

    def sums(batches: Iterator) -> Iterator:
        import pyarrow as pa

        d = FEATURES + 1
        a = np.zeros((2, d, d + 1))
        for batch in batches:
            z, y = model.features(_matrix(batch)), batch.column("y").to_numpy(zero_copy_only=False)
            half = batch.column("half").to_numpy(zero_copy_only=False)
            for h in (0, 1):
                zh = z[half == h]
                a[h] += zh.T @ np.column_stack([zh, y[half == h]])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([x.tobytes() for x in a], pa.binary())], ["half", "sums"])

    d, parts = FEATURES + 1, {0: 0.0, 1: 0.0}
    for row in in_arrow(train, sums, "half int, sums binary").toLocalIterator():
        parts[row["half"]] = parts[row["half"]] + np.frombuffer(row["sums"]).reshape(d, d + 1)

    def solve(a: np.ndarray) -> np.ndarray:
        n = max(1.0, a[d - 1, d - 1])  # the constant's own sum is the number of rows
        return np.linalg.solve(a[:, :d] + RIDGE * n / FEATURES * np.eye(d), a[:, d])

    halves = {h: solve(parts[1 - h]) for h in (0, 1)}
    model.weights = solve(parts[0] + parts[1])

    def binned(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, s = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            z, y = model.features(_matrix(batch)), batch.column("y").to_numpy(zero_copy_only=False)
            half = batch.column("half").to_numpy(zero_copy_only=False)
            raw = np.where(half == 0, z @ halves[0], z @ halves[1])
            at = ((raw + 0.5) / 2 * BINS).clip(0, BINS - 1).astype("int64")
            n += np.bincount(at, minlength=BINS)
            s += np.bincount(at, y, minlength=BINS)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int64()), pa.array(n[has]), pa.array(s[has])], ["at", "n", "s"])

    bins = in_arrow(train, binned, "at long, n double, s double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("at").collect()
    n, s = np.array([b["n"] for b in bins]), np.array([b["s"] for b in bins])
    model.steps = (np.array([(b["at"] + 0.5) / BINS * 2 - 0.5 for b in bins]), isotonic(s / n, n))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(id, held_out, score, predicted) per row of `docs`, learnt from `labels` (id, quality).

    Rows whose crc32(id as text) mod 3 is 1 are held out; of the others, at most about `max_labelled` are used. Only
    the text's statistics enter a score, so equal texts have equal scores. Null and empty texts are scored as all
    zeros. Labels other than 0 and 1 are ignored, repeated ones count each. Without usable labels every score is 0.5.
    A null id is not held out.
    """
    stats = spill(document_statistics(docs, id, text), "statistics")
    share = F.crc32(F.col(id).cast("string")) % 3
    known = labels.select(F.col(id).alias("_id"), F.col("quality").cast("int").alias("y")).where("y IN (0, 1)")
    train = stats.join(known, F.col(id) == F.col("_id")).where(share != 1).select("x", "y", F.when(share == 0, 0).otherwise(1).alias("half"), id)
    if (n := known.where(F.crc32(F.col("_id").cast("string")) % 3 != 1).count()) > max_labelled:
        train = train.where(F.pmod(F.xxhash64(id), F.lit(1_000_000)) < int(1e6 * max_labelled / n))
    model = fit(train)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            score = model.score(_matrix(batch)) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(id), pa.array(score, pa.float64())], [id, "score"])

    scored = in_arrow(stats, run, stats.select(id).schema.add("score", "double", True))
    return scored.select(id, F.coalesce(share == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
