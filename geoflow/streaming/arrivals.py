"""The batch operators over files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """Rows of the Parquet files that arrive in a folder, `files` of them a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def flood_counts(rows: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window start, image_id, n, n_flooded) of a stream of objects; rows later than `late` are dropped by the watermark."""
    by = rows.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "image_id")
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("flooded").cast("long")).alias("n_flooded")).select(F.col("w.start").alias("start"), "image_id", "n", "n_flooded")


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "tile_id") -> StreamingQuery:
    """Run a batch operator on each batch of whole tiles and write its rows to a folder of that batch, so that a batch that runs again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
