"""Folds, splits and samples: seeded hashes give the order that shuffling would."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoflow.operators.features import numbered


def shuffled(*columns: str, seed: int = 0) -> Column:
    """A value to order by: a seeded hash of the row's key."""
    return F.xxhash64(F.lit(seed), *columns)


def random_split(rows: DataFrame, key: str, share: float, seed: int = 0, exact: bool = False) -> DataFrame:
    """`rows` with `part`, 'val' or 'train'. Of n rows, ceil(n * share) + 1 are for validation, or ceil(n * share) if `exact`; none if share is 0."""
    n_val = math.ceil(rows.count() * share) + (0 if exact or not share else 1)
    placed = numbered(rows.withColumn("_h", shuffled(key, seed=seed)), ["_h", key], "_k")
    return placed.withColumn("part", F.when(F.col("_k") <= n_val, "val").otherwise("train")).drop("_h", "_k")


def contiguous_folds(rows: DataFrame, groups: list[str], order: list[str], n: int = 7) -> DataFrame:
    """`rows` with `fold`, 0 to n - 1: contiguous parts of each group, larger ones first."""
    return rows.withColumn("fold", F.ntile(n).over(Window.partitionBy(*groups).orderBy(*order)) - 1)


def even_folds(rows: DataFrame, groups: list[str], order: list[str], n: int = 5) -> DataFrame:
    """`rows` with `fold`: group places cut at floor(size * i / n), as evenly spaced cut points cut to whole numbers do.

    Each group is ordered by itself; sizes come from a pre-aggregation.
    """
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    placed = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1).join(sizes, groups)
    fold = sum(((F.col("_k") >= F.floor(F.col("_n") * i / n)).cast("int") for i in range(1, n)), F.lit(0))
    return placed.withColumn("fold", fold).drop("_k", "_n")


def box_folds(tiles: DataFrame, boxes: DataFrame) -> DataFrame:
    """Tiles (prefix, x, y, …) by fold: 'val' where a box (fold, prefix, x0, x1, y0, y1) holds the tile, 'train' for the rest of each fold.

    Boxes are a short list by hand, so they are broadcast.
    """
    folds = boxes.select("fold").distinct()
    each = tiles.join(F.broadcast(folds))
    box = boxes.select(F.col("fold").alias("_f"), F.col("prefix").alias("_p"), "x0", "x1", "y0", "y1")
    inside = (F.col("fold") == F.col("_f")) & (F.col("prefix") == F.col("_p")) & F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    val = each.join(F.broadcast(box), inside, "left_semi").withColumn("part", F.lit("val"))
    return val.unionByName(each.join(F.broadcast(box), inside, "left_anti").withColumn("part", F.lit("train")))


def sample_quarter(rows: DataFrame, group: str, listed: list[str], order: list[str | Column]) -> DataFrame:
    """All rows, but of the listed groups only a quarter, the first by `order`."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    placed = rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).join(sizes, group)
    return placed.where(~F.col(group).isin(listed) | (F.col("_k") <= F.floor(F.col("_n") / 4))).drop("_k", "_n")


def sample_negatives(rows: DataFrame, flag: str, ratio: float, groups: list[str], order: list[str | Column]) -> DataFrame:
    """All rows with `flag`, and of each group's others at most int(positives * ratio), the first by `order`."""
    counts = rows.groupBy(*groups).agg(F.sum(F.col(flag).cast("long")).alias("_pos"))
    placed = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*groups, flag).orderBy(*order))).join(counts, groups)
    return placed.where(F.col(flag) | (F.col("_k") <= F.floor(F.col("_pos") * ratio))).drop("_k", "_pos")


def balanced(rows: DataFrame, flag: str, groups: list[str], order: list[str]) -> DataFrame:
    """Rows of both flags in equal number: those of the rarer one come again, in turn, with `round` from 0."""
    by = [*groups, flag]
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.groupBy(*groups).agg(F.max("_n").alias("_m")) if groups else sizes.agg(F.max("_n").alias("_m"))
    placed = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).join(sizes, by)
    placed = placed.join(most, groups) if groups else placed.join(F.broadcast(most))
    times = F.floor((F.col("_m") - F.col("_k") - 1) / F.col("_n"))
    return placed.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), times))).drop("_k", "_n", "_m")


def train_valid(rows: DataFrame, fold: int, column: str = "fold") -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col(column) != fold), rows.where(F.col(column) == fold)


def prefix_folds(rows: DataFrame, folds: DataFrame, area: str, name: str) -> DataFrame:
    """`rows` by the folds (fold, area, prefix) of their area whose prefix their name starts with; rows of none are left out.

    The folds are a short list by hand, so they are broadcast.
    """
    listed = F.broadcast(folds.select("fold", F.col("area").alias("_area"), F.col("prefix").alias("_prefix")))
    return rows.join(listed, (F.col(area) == F.col("_area")) & F.startswith(F.col(name), F.col("_prefix"))).drop("_area", "_prefix")
