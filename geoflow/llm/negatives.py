"""Hard negatives by a vector-approximation file: cells of each dimension bound the scores, only candidates are scored exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoflow.llm.common import in_arrow, partitions, spill

#: Cells a dimension is cut in, anchors of a block, and anchors whose bounds are held at once.
CELLS, ANCHORS, AT_ONCE = 64, 1024, 128
#: Greatest component, in whole numbers, whose products 64 bits hold.
MOST = 1 << 26
#: A block of vectors of one dimension: ids, labels, vectors, and for rows the cells and each cell's least and greatest value.
ROWS = "d int, slot int, ids array<long>, labels array<string>, kind string, vectors binary, cells binary, low binary, high binary"
ASKED = "d int, slot int, ids array<long>, labels array<string>, kind string, vectors binary, positives array<array<long>>, scores array<array<long>>"


def whole_vectors(df: DataFrame, vec_id: str, vector: str, label: str | Column, scale: int = 256) -> DataFrame:
    """(id, l, v): rows that take part, with components floor(scale * x)."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(F.floor(F.least(F.abs(x.cast("double")), F.lit(1e9)) * scale)) < MOST))
    label = F.col(label) if isinstance(label, str) else label
    rows = df.where(F.col(vector).isNotNull() & fine).select(F.col(vec_id).cast("long").alias("id"), label.cast("string").alias("l"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))
    return rows.where("l IS NOT NULL AND id IS NOT NULL")


def _smallest(v: np.ndarray) -> np.ndarray:
    """`v` in the least type that holds it."""
    most = int(np.abs(v).max(initial=0))
    return v.astype("int16" if most < 1 << 15 else "int32")


def _matrix(batch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, vectors) of a batch."""
    import pyarrow.compute as pc

    lists = batch.column("v")
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield int(d), rows, flat[start[rows][:, None] + np.arange(d)]


def _first_copies(ids: np.ndarray, labels: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Rows in order of id, of each text of label and vector the first `most` ids: copies score alike, so later ones never come in."""
    order = np.argsort(ids, kind="stable")
    key = np.column_stack([np.unique(labels, return_inverse=True)[1].reshape(-1, 1), v])[order]
    copy = np.unique(key, axis=0, return_inverse=True)[1].ravel()
    by = np.argsort(copy, kind="stable")
    new = np.diff(copy[by], prepend=-1) != 0
    nth = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    return order[np.sort(by[nth < most])]


def _cells(v: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell of each component, least and greatest value of each cell) by the block's own quantiles."""
    n, d = v.shape
    ordered = np.sort(v, axis=0)
    low = ordered[np.arange(cells) * n // cells].T.copy()
    high = np.column_stack([np.maximum(low[:, :-1], low[:, 1:] - 1), ordered[-1]])
    at = np.empty((n, d), "uint8")
    for k in range(d):
        at[:, k] = np.searchsorted(low[k], v[:, k], "right") - 1
    return at, low, high


def _approximated(rows: DataFrame, slots: int, copies: int, cells: int) -> DataFrame:
    """The rows' blocks, dealt to `slots`."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            ids, labels = batch.column("id").to_numpy(), np.array(batch.column("l").to_pylist(), dtype=object).astype("U")
            for d, which, v in _matrix(batch):
                kept = _first_copies(ids[which], labels[which], v, copies)
                v = v[kept].astype("int64")
                at, low, high = _cells(v, cells)
                v, named = _smallest(v), which[kept]
                values = [d, (part + i) % slots, ids[named].tolist(), labels[named].tolist(), v.dtype.name, v.tobytes(), at.tobytes(), low.astype("int32").tobytes(), high.astype("int32").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.string(), *[pa.binary()] * 4], strict=True)], ["d", "slot", "ids", "labels", "kind", "vectors", "cells", "low", "high"])

    return in_arrow(rows, run, ROWS)


def _packed(anchors: DataFrame, slots: int) -> DataFrame:
    """Blocks of anchors (id, l, v, positives, scores), dealt to `slots`."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        for whole in batches:
            for k in range(0, whole.num_rows, ANCHORS):
                batch = whole.slice(k, ANCHORS)
                for d, which, v in _matrix(batch):
                    v, rows = _smallest(v), batch.take(pa.array(which))
                    values = [d, (part + made) % slots, rows.column("id").to_pylist(), rows.column("l").to_pylist(), v.dtype.name, v.tobytes(), rows.column("positives").to_pylist(), rows.column("scores").to_pylist()]
                    made += 1
                    longs = pa.list_(pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, [pa.int32(), pa.int32(), longs, pa.list_(pa.string()), pa.string(), pa.binary(), pa.list_(longs), pa.list_(longs)], strict=True)], ["d", "slot", "ids", "labels", "kind", "vectors", "positives", "scores"])

    return in_arrow(anchors, run, ASKED)


class _Block:
    """One block of rows as arrays, with the bounds that its cells give."""

    def __init__(self, row: dict):
        d = row["d"]
        self.ids, self.labels = np.array(row["ids"], "int64"), np.array(row["labels"], dtype=object).astype("U")
        self.vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(len(self.ids), d)
        at = np.frombuffer(row["cells"], "uint8").reshape(len(self.ids), d)
        low, high = (np.frombuffer(row[x], "int32").reshape(d, len(row[x]) // 4 // max(1, d)) for x in ("low", "high"))
        self.most = max(int(np.abs(low).max(initial=0)), int(np.abs(high).max(initial=0)))
        k = np.arange(d)
        self.low, self.high = low[k, at], high[k, at]  # table lookup of each cell's bounds

    def bounds(self, anchors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) scores of anchors with rows."""
        kind = self._kind(anchors)
        up, down = np.maximum(anchors, 0).astype(kind), np.minimum(anchors, 0).astype(kind)
        low, high = self.low[rows].astype(kind).T, self.high[rows].astype(kind).T
        return up @ low + down @ high, up @ high + down @ low

    def _kind(self, anchors: np.ndarray) -> str:
        """A type in which sums of products are exact."""
        top = self.most * int(np.abs(anchors).max(initial=0)) * max(1, anchors.shape[1])
        return "float32" if top < 1 << 24 else "float64" if top < 1 << 53 else "int64"

    def scores(self, anchors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact scores of pairs of anchors and rows."""
        out = np.empty(len(i), "int64")
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            out[k : k + len(a)] = np.einsum("ij,ij->i", anchors[a].astype("int64"), self.vectors[b].astype("int64"))
        return out


def _best(i: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` of each `i`: by score, then id."""
    order = np.lexsort((ids, -score, i))
    new = np.diff(i[order], prepend=-1) != 0
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[nth < most]


def _kth(lower: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row; the least number if there are fewer."""
    n = lower.shape[1]
    return np.partition(lower, n - k, axis=1)[:, n - k] if n >= k else np.full(len(lower), -np.inf)


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.array(row["ids"], "int64")
    return ids, np.array(row["labels"], dtype=object).astype("U"), np.frombuffer(row["vectors"], row["kind"]).reshape(len(ids), row["d"]).astype("int64")


def _positives_of(asked: dict, block: _Block, most: int) -> list[np.ndarray]:
    """(anchor, positive, score) of the block's best rows of each anchor's label."""
    ids, labels, vectors = _read(asked)
    out = []
    for label in np.intersect1d(labels, block.labels):
        mine, rows = np.flatnonzero(labels == label), np.flatnonzero(block.labels == label)
        for k in range(0, len(mine), AT_ONCE):
            a = mine[k : k + AT_ONCE]
            lower, upper = block.bounds(vectors[a], rows)
            own = ids[a][:, None] == block.ids[rows]
            lower, upper = np.where(own, -np.inf, lower), np.where(own, -np.inf, upper)
            i, j = np.nonzero((upper >= _kth(lower, most)[:, None]) & ~own)
            score = block.scores(vectors[a], i, rows[j])
            top = _best(i, score, block.ids[rows[j]], most)
            out.append(np.stack([ids[a][i[top]], block.ids[rows[j[top]]], score[top]]))
    return out


def _negatives_of(asked: dict, block: _Block, most: int, low: int, high: int) -> list[np.ndarray]:
    """(anchor, positive, score of it, negative, score of it): the block's best rows of other labels in each positive's window."""
    ids, labels, vectors = _read(asked)
    out, rows = [], np.arange(len(block.ids))
    for k in range(0, len(ids), AT_ONCE):
        a = np.arange(k, min(k + AT_ONCE, len(ids)))
        lower, upper = block.bounds(vectors[a], rows)
        other = labels[a][:, None] != block.labels
        for nth in range(max(len(asked["positives"][x]) for x in a)):
            has = np.array([x for x in range(len(a)) if nth < len(asked["positives"][a[x]])])
            positive, ps = (np.array([asked[name][a[x]][nth] for x in has], "int64") for name in ("positives", "scores"))
            # whole scores s with low * ps <= 100 * s <= high * ps
            least, greatest = -((-low * ps) // 100), (high * ps) // 100
            lo, up, fits = lower[has], upper[has], other[has]
            sure = np.where(fits & (lo >= least[:, None]) & (up <= greatest[:, None]), lo, -np.inf)
            i, j = np.nonzero(fits & (up >= np.maximum(least, _kth(sure, most))[:, None]) & (lo <= greatest[:, None]))
            score = block.scores(vectors[a[has]], i, j)
            inside = (score >= least[i]) & (score <= greatest[i])
            i, j, score = i[inside], j[inside], score[inside]
            top = _best(i, score, block.ids[j], most)
            i, j = i[top], j[top]
            out.append(np.stack([ids[a[has]][i], positive[i], ps[i], block.ids[j], score[top]]))
    return out


def _met(blocks: DataFrame, asked: DataFrame, rows_by: int, asked_by: int, of, names: list[str]) -> DataFrame:
    """`of(anchors, block)` for all pairs of blocks of one dimension, met in a grid of `rows_by` times `asked_by` tasks."""
    left = blocks.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(asked_by - 1))))
    right = asked.select("d", F.struct(*asked.columns).alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(rows_by - 1))).alias("slot"), F.col("slot").alias("to"))
    pairs = left.join(right, ["d", "slot", "to"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                found = of(row["asked"], _Block(row))
                columns = np.concatenate([np.zeros((len(names), 0), "int64"), *found], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

    return in_arrow(pairs, run, ", ".join(f"{n} long" for n in names))


def hard_negatives(rows: DataFrame, asked: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, cells: int = CELLS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (id, l, v) from `whole_vectors`.

    Anchors are the rows where `asked` holds. Scores are whole inner products, higher ones first, ties by smaller id. An
    anchor's positives are its first rows of the same label and another id; for each, the first rows of other labels
    with low * positive_score <= 100 * negative_score <= high * positive_score come out. Rows whose label or vector is
    missing, or holds null, non-finite or over-large components, take no part; vectors of different length never meet;
    rows repeated exactly count once, and an id that stands for several anchors is the least of them. An empty table
    gives no row.

    Rows are packed in blocks with their cells by quantiles of the block; anchors, in blocks too, meet all of them in a
    grid. Bounds of the scores come from the cells; only rows that can be among the first are scored. What each block
    gives, a few rows an anchor, is merged by anchor. Of exact copies a block keeps the few with the least ids.
    """
    spark = rows.sparkSession
    wide = partitions(spark)
    anchors = rows.where(asked).groupBy("id").agg(F.min(F.struct("l", "v")).alias("m")).select("id", "m.l", "m.v")
    anchors = spill(anchors, "anchors")
    n_rows, n_anchors = max(1, rows.count()), max(1, anchors.count())
    # rows are sent asked_by times, anchors rows_by times: least where both volumes are alike
    asked_by = max(1, round(math.sqrt(wide * n_anchors / n_rows)))
    rows_by = -(-wide // asked_by)
    blocks = spill(_approximated(rows, rows_by, max(positives + 1, negatives), cells), "blocks")
    dealt = lambda df: _packed(df.repartition(max(1, -(-n_anchors // ANCHORS)), "id"), asked_by)
    none = F.array().cast("array<long>")

    first = _met(blocks, dealt(anchors.select("id", "l", "v", none.alias("positives"), none.alias("scores"))), rows_by, asked_by, lambda a, b: _positives_of(a, b, positives), ["anchor", "positive", "score"]).distinct()
    by = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive")
    first = first.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= positives)
    held = first.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", "positive", "score"))).alias("p"))  # a few a key
    full = anchors.join(held, anchors.id == held.anchor).select("id", "l", "v", F.col("p.positive").alias("positives"), F.col("p.score").alias("scores"))
    full = spill(full, "positives")
    found = _met(blocks, dealt(full), rows_by, asked_by, lambda a, b: _negatives_of(a, b, negatives, low, high), ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]).distinct()
    by = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(whole_vectors(df, "vec_id", "embedding", label), F.col("id") % 50 == 0)
