"""Features, tile matching and submission tables: filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoflow.functions.flags import mask_class
from geoflow.functions.geom import EMPTY_LINE, EMPTY_POLYGON

# Property keys that every feature has after cleaning.
PROPERTIES = ("id", "@id", "building", "flooded", "ghosted", "highway", "lanes", "surface", "oneway", "lanes:forward", "bridge", "tunnel", "layer")
# Cut-off names of old files and what they stand for.
LEGACY_NAMES = {"ingest_tim": "ingest_time", "bridge_typ": "bridge_type", "lane_numbe": "lane_number"}


def buildings(features: DataFrame) -> DataFrame:
    return features.where(F.col("building").isNotNull())


def roads(features: DataFrame) -> DataFrame:
    return features.where(F.col("highway").isNotNull())


def without_bad(features: DataFrame) -> DataFrame:
    """Features that are a building or a road with lanes."""
    bad = (F.col("building").isNull() & F.col("highway").isNull()) | (F.col("highway").isNotNull() & F.col("lanes").isNull())
    return features.where(~bad)


def with_properties(features: DataFrame, props: str = "props") -> DataFrame:
    """One string column for each of PROPERTIES (`@id` as id2, `:` as _), NULL where missing; the map stays."""
    known = features.withColumn(props, F.transform_keys(props, lambda k, _: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in LEGACY_NAMES.items() for x in p)), k), k)))
    return known.select("*", *(F.element_at(props, k).alias("id2" if k == "@id" else k.replace(":", "_")) for k in PROPERTIES))


def typed_layer(features: DataFrame) -> DataFrame:
    """Features with mask_id (2 flooded, 1 not) and speed_mph, NULL for buildings."""
    return features.withColumn("mask_id", mask_class(F.col("flooded"))).withColumn("speed_mph", F.when(F.col("building").isNull(), F.col("inferred_speed_mph")))


def of_types(features: DataFrame, valid: list[str], column: str = "highway") -> DataFrame:
    """Features of the given types; an empty list keeps all."""
    return features.where(F.col(column).isin(valid)) if valid else features


def without_listed(rows: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """Rows whose `column` is not in `listed`: an anti-join, so NULLs stay."""
    return rows.join(listed.select(column).distinct(), column, "left_anti")


def match_by_tile(left: DataFrame, right: DataFrame, key: str = "tile_id", order: str = "path", strict: bool = False) -> DataFrame:
    """`left` with the first `right` row (least `order`) of its tile. A row without a match goes, or fails the job if `strict`."""
    rest = [c for c in right.columns if c != key]
    first = right.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_m"))
    joined = left.join(first, key, "left" if strict else "inner")
    if strict:
        joined = joined.where(F.assert_true(F.col("_m").isNotNull(), F.concat(F.lit("no match for "), F.col(key).cast("string"))).isNull())
    return joined.select(*left.columns, *(F.col(f"_m.{c}").alias(c) for c in rest))


def with_neighbours(tiles: DataFrame) -> DataFrame:
    """Tiles (prefix, x, y, tile_id) that have a right, a lower and a diagonal neighbour, with their ids.

    Each tile is sent to the four places it can stand in, so three self-joins become one grouping.
    """
    places = F.array(*(F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(name).alias("as")) for name, dx, dy in (("tile_id", 0, 0), ("right", 1, 0), ("below", 0, 1), ("diagonal", 1, 1))))
    sent = tiles.select("prefix", "tile_id", F.explode(places).alias("p")).select("prefix", "tile_id", "p.*")
    found = sent.groupBy("prefix", "x", "y").agg(*(F.min(F.when(F.col("as") == n, F.col("tile_id"))).alias(n) for n in ("tile_id", "right", "below", "diagonal")))
    return found.where(" AND ".join(f"`{n}` IS NOT NULL" for n in ("tile_id", "right", "below", "diagonal")))


def without_twins(rows: DataFrame) -> DataFrame:
    """Only the rows that occur once; every copy of the others goes."""
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")


def with_missing_tiles(rows: DataFrame, tiles: DataFrame, wkt: str, flooded: Column | None = None) -> DataFrame:
    """`rows` and one sentinel row (`wkt`, no flag, zero lengths) for each tile that has none."""
    none = tiles.select("image_id").distinct().join(rows.select("image_id").distinct(), "image_id", "left_anti")
    flag = F.lit(None) if flooded is None else flooded
    blank = {"image_id": F.col("image_id"), "object": F.lit("Building" if wkt == EMPTY_POLYGON else "Road"), "wkt_pix": F.lit(wkt), "flooded": flag.cast("boolean"), "length_m": F.lit(0.0), "travel_time_s": F.lit(0.0)}
    return rows.unionByName(none.select(*(blank.get(c, F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns)))


def assemble_submission(road_rows: DataFrame, building_rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """Both classes with sentinels for tiles that lack one; flags that are missing become False, repeats go."""
    both = with_missing_tiles(road_rows, tiles, EMPTY_LINE).unionByName(with_missing_tiles(building_rows, tiles, EMPTY_POLYGON), allowMissingColumns=True)
    return both.na.fill({"flooded": False, "length_m": 0.0, "travel_time_s": 0.0}).distinct()


def edge_rows(edges: DataFrame) -> DataFrame:
    """One row per undirected edge of a tile: of parallel edges the one of least edge_id."""
    a, b = F.least("u", "v"), F.greatest("u", "v")
    rest = [c for c in edges.columns if c not in ("tile_id", "u", "v")]
    first = edges.groupBy("tile_id", a.alias("u"), b.alias("v")).agg(F.min_by(F.struct(*rest), "edge_id").alias("e"))
    return first.select("tile_id", "u", "v", *(F.col(f"e.{c}").alias(c) for c in rest))


def segment_rows(lines: DataFrame, points: str = "points", speed: str = "speed") -> DataFrame:
    """One row per segment of every line, with its length and travel time."""
    from geoflow.functions.geom import segments
    from geoflow.functions.speed import travel_time

    each = lines.select(*(c for c in lines.columns if c != points), F.posexplode(segments(F.col(points))).alias("seq", "s"))
    length = F.sqrt(F.pow(F.col("s.x2") - F.col("s.x1"), 2) + F.pow(F.col("s.y2") - F.col("s.y1"), 2))
    return each.select(*(c for c in each.columns if c != "s"), "s.*", length.alias("length")).withColumn("travel_time_s", travel_time(F.col("length"), F.col(speed)))


def numbered(rows: DataFrame, order: list[str], name: str = "number", groups: list[str] | None = None) -> DataFrame:
    """Running numbers from 1 by `order` in each group, without one window over all rows.

    Rows are ranged over partitions, counted there, and each partition starts after the sum of those before it. Only
    one count per partition is summed on one task. Rows alike in the whole order are numbered as they come.
    """
    from geoflow.operators.shared import written

    if groups:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    ranged = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_local", local).join(F.broadcast(before), "_part").withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def joined_submission(roads: DataFrame, buildings: DataFrame, columns: list[str], numbers: list[str]) -> DataFrame:
    """Roads and buildings in one table of `columns`; missing `numbers` are 0, columns that a side lacks are null."""
    both = roads.unionByName(buildings, allowMissingColumns=True)
    return both.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in numbers else F.col(c) for c in columns))


def flooded_percentage(rows: DataFrame, flag: str = "flooded") -> DataFrame:
    """(percentage): how many of 100 rows are flooded; null flags are not, and an empty table gives null."""
    return rows.agg(F.try_divide(100 * F.count_if(F.coalesce(F.col(flag).cast("boolean"), F.lit(False))), F.count(F.lit(1))).alias("percentage"))
