"""What the operators of this subpackage share: shared-folder tables and components of links."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's own bound on an Arrow batch, and the smaller one that in_arrow sets in its place.
_BATCH, _DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`, or, in local mode only, a temporary one where that is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='geoflow-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory of this Python worker to the system: workers are reused, and stand beside the executor's heap."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def in_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """`df.mapInArrow(run, schema)` in batches of at most BATCH_BYTES, so that memory does not follow the length of texts.

    A bound that the session sets otherwise stays. At the end of a task, the worker gives its free memory back.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, _DEFAULT) == _DEFAULT:
        conf.set(_BATCH, str(BATCH_BYTES))

    def released(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return df.mapInArrow(released, schema)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with `value` computed once a row: a generator's output, which no later lambda computes again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of `links` (u, v): one row (node, label) per node, label the smallest node reachable.

    Every round takes the least label among the neighbours and then the label's own label, so the number of rounds
    follows the logarithm of a component's diameter. A label that many nodes share is a skewed key of an equi-join
    with a unique right side, which adaptive execution splits. Self links and nulls are dropped; no link, no row.
    """
    links = links.where("u <> v").select("u", "v")
    edges = spill(links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = spill(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    for _ in range(rounds):
        seen = edges.join(labels, edges.v == labels.node).groupBy("u").agg(F.min("label").alias("least"))
        near = spill(
            labels.join(seen, labels.node == seen.u).select("node", F.col("label").alias("before"), F.least("label", "least").alias("label")),
            "near",
        )
        up = near.select(F.col("node").alias("root"), F.col("label").alias("to"))
        labels = spill(near.join(up, near.label == up.root).select("node", "before", F.col("to").alias("label")), "labels")
        if labels.where("label <> before").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels.select("node", "label")
