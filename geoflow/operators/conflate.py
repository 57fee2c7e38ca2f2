"""Flood state and speed of objects from the pixels under them, and votes over tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoflow.functions.geom import segments
from geoflow.functions.speed import BAND_SPEED
from geoflow.operators.features import without_twins

SIDE = 1300

# Fixed value: metres a second in a mile an hour.
MPS_PER_MPH = 0.44704


def _share(rows: DataFrame, flag: Column, tile: str) -> DataFrame:
    """Share of flooded rows per tile, joined back: pre-aggregated, so a tile with many rows is not one task."""
    shares = rows.groupBy(F.col(tile).alias("_tile")).agg(F.avg(F.coalesce(flag, F.lit(False)).cast("int")).alias("_share"))
    return rows.join(shares, F.col(tile).eqNullSafe(F.col("_tile"))).drop("_tile")


def tile_vote(rows: DataFrame, above: float, tile: str = "image_id", flag: str = "flooded") -> DataFrame:
    """All of a tile's rows flooded if more than `above` of them are, else none."""
    return _share(rows, F.col(flag), tile).withColumn(flag, F.col("_share") > above).drop("_share")


def tile_hysteresis(rows: DataFrame, tile: str = "image_id", flag: str = "flooded", low: float = 0.4, high: float = 0.7) -> DataFrame:
    """Up to `low` flooded: none of the tile is; from `high`: all are; between: as they were. Twins go altogether."""
    old = F.coalesce(F.col(flag), F.lit(False))
    new = F.when(F.col("_share") <= low, False).when(F.col("_share") >= high, True).otherwise(old)
    return without_twins(_share(rows, F.col(flag), tile).withColumn(flag, new).drop("_share"))


def zonal_vote(pixels: DataFrame, labels: DataFrame, above: float = 0.5) -> DataFrame:
    """(tile_id, label, n, n_flooded, flood_class) of components of building pixels.

    `labels` (tile_id, row, col, label) marks the pixels of each component, `pixels` (tile_id, row, col, value) their
    flood class, 0 where none: that counts as 1. More than `above` of class 2 makes the component 2, else 1.
    """
    each = labels.join(pixels, ["tile_id", "row", "col"], "left").groupBy("tile_id", "label")
    hit = F.sum((F.coalesce("value", F.lit(0)) == 2).cast("long"))
    return each.agg(F.count(F.lit(1)).alias("n"), hit.alias("n_flooded")).withColumn("flood_class", F.when(F.col("n_flooded") / F.col("n") > above, 2).otherwise(1))


def road_windows(lines: DataFrame, points: str = "points", side: int = SIDE, reach: int = 2) -> DataFrame:
    """(tile_id, line_id, row, col): pixels of the windows around samples of each segment, repeats included.

    A segment has ceil(length) evenly spaced samples, ends included, cut to whole pixels. A window runs from `reach`
    before the sample up to, not including, `reach` after it, and stops at the last row and column.
    """
    each = lines.select("tile_id", "line_id", F.explode(segments(F.col(points))).alias("s"))
    n = F.ceil(F.sqrt(F.pow(F.col("s.x2") - F.col("s.x1"), 2) + F.pow(F.col("s.y2") - F.col("s.y1"), 2))).cast("int")
    each = each.withColumn("n", n).where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.when(F.col("n") > 1, F.col("k") / (F.col("n") - 1)).otherwise(0.0)
    at = lambda a, b: (F.col(a) + t * (F.col(b) - F.col(a))).cast("int")
    span = lambda c: F.sequence(F.greatest(F.col(c) - reach, F.lit(0)), F.greatest(F.least(F.col(c) + reach, F.lit(side - 1)) - 1, F.greatest(F.col(c) - reach, F.lit(0))))
    return each.select("tile_id", "line_id", at("s.x1", "s.x2").alias("x"), at("s.y1", "s.y2").alias("y")).select("tile_id", "line_id", F.explode(span("y")).alias("row"), "x").select("tile_id", "line_id", "row", F.explode(span("x")).alias("col"))


def road_flood(lines: DataFrame, pixels: DataFrame, points: str = "points", flooded: int = 4, above: float | None = None) -> DataFrame:
    """(tile_id, line_id, flooded): by the most frequent class under a road (the smallest of equals), or by its share if `above`.

    Samples are counted by pixel before the join, and by class after it; roads over no known pixel are left out.
    """
    counted = road_windows(lines, points).groupBy("tile_id", "line_id", "row", "col").agg(F.count(F.lit(1)).alias("n"))
    by = counted.join(pixels, ["tile_id", "row", "col"]).groupBy("tile_id", "line_id", "value").agg(F.sum("n").alias("n"))
    if above is not None:
        share = F.sum(F.when(F.col("value") == flooded, F.col("n")).otherwise(0)) / F.sum("n")
        return by.groupBy("tile_id", "line_id").agg((share > above).alias("flooded"))
    mode = F.max_by("value", F.struct("n", -F.col("value")))
    return by.groupBy("tile_id", "line_id").agg((mode == flooded).alias("flooded"))


def band_values(patches: DataFrame, percentile: float = 0.85) -> DataFrame:
    """(…, band, z): the percentile of each band's pixels, cut to a whole number (rounded at the ninth digit first)."""
    keys = [c for c in patches.columns if c != "value"]
    return patches.groupBy(*keys).agg(F.floor(F.round(F.percentile("value", percentile), 9)).cast("int").alias("z"))


def patch_speed(bands: DataFrame, least: int = 128, weighted: bool = True) -> DataFrame:
    """(…, speed) from (…, band, z): bands above `least` weighed by z, or the speed of the strongest band; -1 where none."""
    keys = [c for c in bands.columns if c not in ("band", "z")]
    speed = F.get(F.array(*map(F.lit, BAND_SPEED)), F.col("band"))
    if weighted:
        w = F.when(F.col("z") > least, F.col("z"))
        return bands.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(w * speed), F.sum(w)), F.lit(-1.0)).alias("speed"))
    best = F.max_by(F.struct("z", speed.alias("s")), F.struct("z", -F.col("band")))
    return bands.groupBy(*keys).agg(best.alias("b")).select(*keys, F.when(F.col("b.z") >= least, F.col("b.s")).otherwise(-1.0).alias("speed"))


def edge_speed(middles: DataFrame, pixels: DataFrame, reach: int = 6, percentile: float = 0.85) -> DataFrame:
    """(tile_id, edge_id, speed_mph): the speed of the band whose percentiles, summed over an edge's segments, are greatest.

    `middles` (tile_id, edge_id, seq, x, y) are segment middles, `pixels` (tile_id, band, row, col, value) the raster.
    """
    span = lambda c: F.explode(F.sequence(F.greatest(F.col(c) - reach, F.lit(0)).cast("int"), (F.col(c) + reach).cast("int")))
    # segments whose middles fall on one pixel see one window: it is read once
    window = middles.select("tile_id", "x", "y").distinct().select("tile_id", "x", "y", span("y").alias("row")).select("tile_id", "x", "y", "row", span("x").alias("col"))
    bands = pixels.where(F.col("band") < len(BAND_SPEED)).groupBy("tile_id", "row", "col").agg(F.collect_list(F.struct("band", "value")).alias("bands"))
    seen = window.join(bands, ["tile_id", "row", "col"]).select(F.struct("tile_id", "x", "y").alias("seen"), F.explode("bands").alias("b")).select("seen", "b.band", "b.value")
    z = band_values(seen, percentile).select("seen.*", "band", "z")
    total = middles.join(z, ["tile_id", "x", "y"]).groupBy("tile_id", "edge_id", "band").agg(F.sum("z").alias("z"))
    return patch_speed(total, least=0, weighted=False).withColumnRenamed("speed", "speed_mph")


def apply_speeds(edges: DataFrame, speeds: DataFrame, keys: list[str]) -> DataFrame:
    """`edges` (…, length_miles) with the speeds (…, speed_mph) inferred for them: inferred_speed_mph and _mps to two digits,
    travel_time_s to three, halves to even; null for edges without a speed, and no time at speed 0."""
    mph = F.col("speed_mph")
    out = edges.join(speeds.select(*keys, "speed_mph"), keys, "left")
    hours = F.try_divide(F.col("length_miles"), mph)
    return out.withColumn("inferred_speed_mph", F.bround(mph, 2)).withColumn("inferred_speed_mps", F.bround(mph * MPS_PER_MPH, 2)).withColumn("travel_time_s", F.bround(3600 * hours, 3)).drop("speed_mph")


def weighted_stats(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean, population variance and standard deviation per group."""
    v, w = F.col(value), F.col(weight)
    sums = rows.groupBy(*keys).agg(F.sum(w).alias("_w"), F.sum(w * v).alias("_wv"), F.sum(w * v * v).alias("_wvv"))
    mean = F.try_divide("_wv", "_w")
    var = F.greatest(F.try_divide("_wvv", "_w") - mean * mean, F.lit(0.0))
    return sums.select(*keys, mean.alias("mean"), var.alias("var"), F.sqrt(var).alias("std"))


def overlay_classes(pixels: DataFrame) -> DataFrame:
    """(tile_id, row, col, value) from building, road and flood columns: 1 or 2 on buildings, 3 or 4 on roads, which win."""
    wet = F.coalesce(F.col("flood").cast("int"), F.lit(0))
    value = F.when(F.col("road") > 0, 3 + wet).when(F.col("building") > 0, 1 + wet).otherwise(0)
    return pixels.select("tile_id", "row", "col", value.alias("value"))


def first_zone(nodes: DataFrame, order: str = "node_id") -> DataFrame:
    """Nodes (tile_id, lon, …) with the UTM zone of their tile's first node."""
    from geoflow.functions.coords import utm_zone

    return nodes.withColumn("utm_zone", utm_zone(F.first_value("lon").over(Window.partitionBy("tile_id").orderBy(order))))
