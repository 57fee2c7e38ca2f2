"""Rasters as pixel rows (tile_id, row, col, …): classes, ensembles, windows, statistics; no Python functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIXEL = ["tile_id", "row", "col"]


def to_channels(pixels: DataFrame, values: list[int], any_band: bool = False) -> DataFrame:
    """(tile_id, row, col, band, value): one band per class value, 1 where the pixel has it; the last one, if asked, for any."""
    bands = [F.struct(F.lit(i).alias("band"), (F.col("value") == v).cast("int").alias("value")) for i, v in enumerate(values)]
    if any_band:
        bands.append(F.struct(F.lit(len(values)).alias("band"), (F.col("value") > 0).cast("int").alias("value")))
    return pixels.select(*PIXEL, F.explode(F.array(*bands)).alias("b")).select(*PIXEL, "b.*")


def from_channels(bands: DataFrame) -> DataFrame:
    """(tile_id, row, col, value): 1 + the band of the greatest value, the first of equals; 0 where all are 0."""
    best = F.max_by(F.struct("band", "value"), F.struct("value", -F.col("band"))).alias("b")
    return bands.groupBy(*PIXEL).agg(best).select(*PIXEL, F.when(F.col("b.value") > 0, F.col("b.band") + 1).otherwise(0).alias("value"))


def merge_classes(bands: DataFrame, classes: int = 5) -> DataFrame:
    """Four flood bands (0, 1 buildings; 2, 3 roads) as one class map: buildings win among five classes, roads among three."""
    has = {b: F.max(F.when(F.col("band") == b, F.col("value")).otherwise(0)) > 0 for b in range(4)}
    if classes == 5:
        value = F.when(has[1], 2).when(has[0], 1).when(has[3], 4).when(has[2], 3).otherwise(0)
    else:
        value = F.when(has[2] | has[3], 2).when(has[0] | has[1], 1).otherwise(0)
    return bands.groupBy(*PIXEL).agg(value.alias("value"))


def body_minus_border(pixels: DataFrame, at: float) -> DataFrame:
    """(tile_id, row, col, value): 1 where a building's body, less its border (both 0 to 255), is at least `at`; null is none."""
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / 255
    return pixels.select(*PIXEL, (share("body") * (1 - share("border")) >= at).cast("int").alias("value"))


def normalised(bands: DataFrame, mean: list[float], std: list[float]) -> DataFrame:
    """Values 0 to 255 of each band as shares, less the band's mean, by its standard deviation; bands beyond the lists go."""
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("band"))
    return bands.where(F.col("band").between(0, len(mean) - 1)).withColumn("value", (F.col("value") / 255 - of(mean)) / of(std))


def class_masks(pixels: DataFrame) -> DataFrame:
    """Building (255) and road (254) masks of a class map 0 to 4."""
    return pixels.select(*PIXEL, F.when(F.col("value").isin(1, 2), 255).otherwise(0).alias("building"), F.when(F.col("value").isin(3, 4), 254).otherwise(0).alias("road"))


def threshold(pixels: DataFrame, at: float, strict: bool = False) -> DataFrame:
    return pixels.withColumn("value", ((F.col("value") > at) if strict else (F.col("value") >= at)).cast("int"))


def ensemble(pixels: DataFrame, how: str = "mean", above: float = 0.5) -> DataFrame:
    """One raster from those of several models (model, tile_id, row, col, value).

    mean: cut to a whole number; clip: the same within 0 to 255; vote: share of positive ones times 255; above: 1 where
    the mean exceeds `above`; sharpen: as that, with the square root of all but the model of least number.
    """
    by = pixels.groupBy(*PIXEL)
    mean = F.avg("value")
    if how == "vote":
        return by.agg(F.floor(F.avg((F.col("value") > 0).cast("int")) * 255).cast("int").alias("value"))
    if how == "above":
        return by.agg((mean > above).cast("int").alias("value"))
    if how == "sharpen":
        first = F.min_by("value", "model")
        return by.agg((((F.sum(F.sqrt("value")) - F.sqrt(first) + first) / F.count(F.lit(1))) > above).cast("int").alias("value"))
    value = F.floor(mean)
    return by.agg((F.greatest(F.lit(0), F.least(F.lit(255), value)) if how == "clip" else value).cast("int").alias("value"))


def blend(a: DataFrame, b: DataFrame, weight: float) -> DataFrame:
    """weight * a + (1 - weight) * b on the pixels of both."""
    return a.join(b.select(*PIXEL, F.col("value").alias("_b")), PIXEL).select(*PIXEL, (F.col("value") * weight + F.col("_b") * (1 - weight)).alias("value"))


def image_mse(pre: DataFrame, post: DataFrame) -> DataFrame:
    """(tile_id, mse) of the pixels (…, band, value) whose bands before the event do not sum to 0."""
    both = pre.join(post.select(*PIXEL, "band", F.col("value").alias("_post")), [*PIXEL, "band"])
    seen = both.groupBy(*PIXEL).agg(F.sum("value").alias("_sum"), F.sum(F.pow(F.col("value") - F.col("_post"), 2)).alias("_sq"), F.count(F.lit(1)).alias("_n")).where("_sum > 0")
    return seen.groupBy("tile_id").agg((F.sum("_sq") / F.sum("_n")).alias("mse"))


def pick_post(tiles: DataFrame) -> DataFrame:
    """`tiles` (mse1, mse2, post_image_1, post_image_2) with `post_image`: of the lower error, the first of equals or alone."""
    second = F.col("mse2").isNotNull() & (F.col("mse1").isNull() | (F.col("mse2") < F.col("mse1")))
    return tiles.withColumn("post_image", F.when(second, F.col("post_image_2")).otherwise(F.col("post_image_1")))


def percentile_rescale(pixels: DataFrame, low: float = 0.02, high: float = 0.98, positive: bool = False, top: int = 255) -> DataFrame:
    """Values of each (tile, band) stretched so that the two percentiles become 0 and `top`; `positive` takes them over positive pixels."""
    v = F.when(F.col("value") > 0, F.col("value")) if positive else F.col("value")
    marks = pixels.groupBy("tile_id", "band").agg(F.percentile(v, low).alias("_lo"), F.percentile(v, high).alias("_hi"))
    new = F.coalesce(F.try_divide((F.col("value") - F.col("_lo")) * top, F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return pixels.join(marks, ["tile_id", "band"]).withColumn("value", F.floor(F.round(F.greatest(F.lit(0.0), F.least(F.lit(float(top)), new)), 9)).cast("int")).drop("_lo", "_hi")


def class_shares(pixels: DataFrame) -> DataFrame:
    """(value, n, percent) over all pixels."""
    counts = pixels.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(total)).select("value", "n", (F.col("n") * 100 / F.col("_t")).alias("percent"))  # one row


def offsets(length: int, size: int, stride: int) -> list[int]:
    """Window starts along a side: every `stride`, the last one moved back to the edge."""
    return sorted({min(k, max(0, length - size)) for k in range(0, max(1, length - size + stride), stride)})


def crops(pixels: DataFrame, side: int, size: int, stride: int) -> DataFrame:
    """Pixels in each window that holds them: (tile_id, top, left, row, col, value), places counted in the window."""
    at = offsets(side, size, stride)
    holds = lambda c: F.filter(F.array(*map(F.lit, at)), lambda k: (k <= F.col(c)) & (F.col(c) < k + size))
    each = pixels.withColumn("top", F.explode(holds("row"))).withColumn("left", F.explode(holds("col")))
    return each.select("tile_id", "top", "left", (F.col("row") - F.col("top")).alias("row"), (F.col("col") - F.col("left")).alias("col"), "value")


def merge_crops(windows: DataFrame) -> DataFrame:
    """Means of the windows' values at each pixel of the tile; missing ones do not count."""
    return windows.groupBy("tile_id", (F.col("top") + F.col("row")).alias("row"), (F.col("left") + F.col("col")).alias("col")).agg(F.avg("value").alias("value"))


def flips(pixels: DataFrame, side: int) -> DataFrame:
    """Test-time variants: as it is, mirrored by columns, mirrored by rows (variant 0, 1, 2)."""
    last = F.lit(side - 1)
    kinds = [(0, F.col("row"), F.col("col")), (1, F.col("row"), last - F.col("col")), (2, last - F.col("row"), F.col("col"))]
    return pixels.select("tile_id", F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), r.alias("row"), c.alias("col"), F.col("value").alias("value")) for k, r, c in kinds))).alias("v")).select("tile_id", "v.*")


def merge_flips(scored: DataFrame, side: int, sharpen: bool = True) -> DataFrame:
    """Means of the variants, turned back; mirrored ones by their square root if `sharpen`."""
    last = F.lit(side - 1)
    row = F.when(F.col("variant") == 2, last - F.col("row")).otherwise(F.col("row"))
    col = F.when(F.col("variant") == 1, last - F.col("col")).otherwise(F.col("col"))
    value = F.when((F.col("variant") > 0) & F.lit(sharpen), F.sqrt("value")).otherwise(F.col("value"))
    return scored.select("tile_id", row.alias("row"), col.alias("col"), value.alias("value")).groupBy(*PIXEL).agg(F.avg("value").alias("value"))


def stitch(pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """(aoi, row, col, value) of all tiles placed by their geotransforms; where tiles overlap the one of greatest `seq` stays.

    `tiles` has (tile_id, aoi, seq, geotransform). Offsets are rounded from the least x and the greatest y of the area.
    """
    g = lambda i: F.get("geotransform", F.lit(i))
    origin = tiles.groupBy("aoi").agg(F.min(g(0)).alias("_x"), F.max(g(3)).alias("_y"))
    placed = tiles.join(origin, "aoi").select("tile_id", "aoi", "seq", F.round((g(0) - F.col("_x")) / g(1)).cast("int").alias("_c"), F.round((g(3) - F.col("_y")) / g(5)).cast("int").alias("_r"))
    return pixels.join(placed, "tile_id").groupBy("aoi", (F.col("row") + F.col("_r")).alias("row"), (F.col("col") + F.col("_c")).alias("col")).agg(F.max_by("value", "seq").alias("value"))


def composite_median(pixels: DataFrame) -> DataFrame:
    """Median of a tile's images at each pixel and band (the mean of two), stretched to 0..255 over the tile."""
    mid = pixels.groupBy(*PIXEL, "band").agg(F.percentile("value", 0.5).alias("value"))
    ends = mid.groupBy("tile_id").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    new = F.coalesce(F.try_divide((F.col("value") - F.col("_lo")) * 255, F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return mid.join(ends, "tile_id").withColumn("value", F.floor(F.round(new, 9)).cast("int")).drop("_lo", "_hi")


def gamma(value: Column, g: float, top: float = 255.0) -> Column:
    return F.pow(value / top, g) * top


def flood_label(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("tile_id").agg(F.max(F.col("value") > 0).alias("flooded"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def minmax_normalize(pixels: DataFrame, share: float = 0.02) -> DataFrame:
    """Values of each (tile, band) stretched to 0 to 255 between two percentiles, cut to whole numbers.

    Where a tile has pixels that are 0 in all bands, its lower percentile is over values other than 0, and those pixels
    stay 0. A band of one value becomes 0.
    """
    dark = pixels.groupBy(*PIXEL).agg((F.sum(F.abs("value")) == 0).alias("_dark"))
    seen = pixels.join(dark, PIXEL)
    v = F.col("value")
    marks = seen.groupBy("tile_id", "band").agg(F.max("_dark").alias("_any"), F.percentile(v, share).alias("_all"), F.percentile(F.when(v != 0, v), share).alias("_lit"), F.percentile(v, 1 - share).alias("_hi"))
    # a dark pixel is dark in every band that it has; the tile decides
    tiles = marks.groupBy("tile_id").agg(F.max("_any").alias("_any"))
    marks = marks.drop("_any").join(tiles, "tile_id").select("tile_id", "band", F.when(F.col("_any"), F.col("_lit")).otherwise(F.col("_all")).alias("_lo"), "_hi")
    part = F.coalesce(F.try_divide(v - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    new = F.floor(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)) * 255, 9)).cast("int")
    return seen.join(marks, ["tile_id", "band"]).withColumn("value", F.when(F.col("_dark"), 0).otherwise(new)).drop("_dark", "_lo", "_hi")


def hard_pixels(pixels: DataFrame, threshold: float, keep: int, keys: list[str]) -> DataFrame:
    """Pixels (…, prob) of a group whose prob is below the greater of `threshold` and the group's value at place `keep`, from 0.

    Places are counted over distinct probs, so that no group is sorted whole; a group with fewer takes its greatest.
    """
    counts = pixels.groupBy(*keys, "prob").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("prob"))
    placed = counts.withColumn("_upto", upto)
    marks = placed.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_upto") > keep, F.col("prob"))), F.max("prob")).alias("_mark"))
    return pixels.join(marks, keys).where(F.col("prob") < F.greatest(F.lit(threshold), F.col("_mark"))).drop("_mark")
