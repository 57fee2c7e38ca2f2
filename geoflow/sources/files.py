"""Readers and writers: GeoJSON, WKT tables, manifests, submissions, score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflow.functions.flags import as_bool, as_text
from geoflow.functions.geom import POINTS, parse_wkt

GEOJSON = "type string, features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>, _corrupt_record string"
# Damage subtypes and their index; from 3 on a tile counts as flooded.
DAMAGE = {"un-classified": 1, "no-damage": 2, "minor-damage": 3, "major-damage": 4, "destroyed": 5}


def read_geojson(spark: SparkSession, path: str, tolerant: bool = True) -> DataFrame:
    """(path, props, geom_type, coordinates) of every feature; files that do not parse give none, or fail unless `tolerant`.

    `coordinates` stays JSON text: `line_points` and `ring_points` read it.
    """
    files = spark.read.schema(GEOJSON).option("multiLine", True).option("mode", "PERMISSIVE" if tolerant else "FAILFAST").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    each = files.select(F.col("_metadata.file_path").alias("path"), F.explode("features").alias("f"))
    return each.select("path", F.col("f.properties").alias("props"), F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def _points(numbers) -> F.Column:
    return F.transform(numbers, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def line_points(features: DataFrame) -> DataFrame:
    """LineString and MultiLineString features with `points`, one row per part; a third coordinate goes."""
    one = F.array(F.from_json("coordinates", "array<array<double>>"))
    parts = F.when(F.col("geom_type") == "LineString", one).when(F.col("geom_type") == "MultiLineString", F.from_json("coordinates", "array<array<array<double>>>"))
    return features.where(F.col("geom_type").isin("LineString", "MultiLineString")).withColumn("part", F.explode(parts)).withColumn("points", _points(F.col("part"))).drop("part")


def ring_points(features: DataFrame) -> DataFrame:
    """Polygon and MultiPolygon features with `points`: the first ring, or all first rings in a row."""
    one = F.get(F.from_json("coordinates", "array<array<array<double>>>"), F.lit(0))
    many = F.flatten(F.transform(F.from_json("coordinates", "array<array<array<array<double>>>>"), lambda p: F.get(p, F.lit(0))))
    rings = F.when(F.col("geom_type") == "Polygon", one).when(F.col("geom_type") == "MultiPolygon", many)
    return features.where(F.col("geom_type").isin("Polygon", "MultiPolygon")).withColumn("points", _points(rings))


def read_wkt_table(spark: SparkSession, path: str) -> DataFrame:
    """A submission as (image_id, object, wkt_pix, flooded, length_m, travel_time_s, points); header names in either case."""
    raw = spark.read.option("header", True).csv(path)
    by = {c.lower(): c for c in raw.columns}
    col = lambda name: F.col(f"`{by[name]}`") if name in by else F.lit(None).cast("string")
    return raw.select(
        col("imageid").alias("image_id"), col("object").alias("object"), col("wkt_pix").alias("wkt_pix"), as_bool(col("flooded")).alias("flooded"),
        col("length_m").try_cast("double").alias("length_m"), col("travel_time_s").try_cast("double").alias("travel_time_s"), parse_wkt(col("wkt_pix")).cast(POINTS).alias("points"),
    )


def read_mapping(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Image mappings of all areas as (label, pre_image, post_image_1, post_image_2, aoi)."""
    parts = [spark.read.option("header", True).csv(path).select(F.col("label"), F.col("`pre-event image`").alias("pre_image"), F.col("`post-event image 1`").alias("post_image_1"), F.col("`post-event image 2`").alias("post_image_2"), F.lit(aoi).alias("aoi")) for aoi, path in paths.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_manifest(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The asked columns of a manifest; those it lacks are NULL."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*(F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns))


def read_damage(spark: SparkSession, path: str) -> DataFrame:
    """(path, wkt, damage) of damage files; subtypes outside DAMAGE are left out."""
    schema = "features struct<xy:array<struct<wkt:string,properties:struct<subtype:string>>>>"
    kinds = F.create_map(*(F.lit(x) for pair in DAMAGE.items() for x in pair))
    each = spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("path"), F.explode("features.xy").alias("f"))
    return each.select("path", "f.wkt", F.element_at(kinds, F.col("f.properties.subtype")).alias("damage")).where("damage IS NOT NULL")


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Tile rows (tile_id, rows, cols, data, …) of Parquet."""
    return spark.read.parquet(path)


def write_geojson(features: DataFrame, path: str, key: str = "tile_id") -> None:
    """One feature a line as JSON text (newline-delimited GeoJSON), in a folder per key: (key, props, points)."""
    shape = F.struct(F.lit("LineString").alias("type"), F.transform("points", lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    line = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("props").alias("properties"), shape.alias("geometry")))
    features.select(key, line.alias("value")).write.partitionBy(key).text(path)


def geojson_collections(features: DataFrame, key: str = "tile_id") -> DataFrame:
    """(key, value): one GeoJSON FeatureCollection a key of features (key, props, points), lines in the order of their text; a key's features are one value."""
    shape = F.struct(F.lit("LineString").alias("type"), F.transform("points", lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    each = features.select(key, F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("props").alias("properties"), shape.alias("geometry"))).alias("f"))
    joined = F.array_join(F.array_sort(F.collect_list("f")), ",")
    return each.groupBy(key).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), joined, F.lit("]}")).alias("value"))


def write_geojson_collections(features: DataFrame, path: str, key: str = "tile_id") -> None:
    """`geojson_collections` as text, a folder per key: what `read_geojson` reads."""
    geojson_collections(features, key).write.partitionBy(key).text(path)


def write_submission(rows: DataFrame, path: str, append: bool = False) -> None:
    """A submission as CSV: flags as text, header names as the scorer wants them."""
    out = rows.select(F.col("image_id").alias("ImageId"), F.col("object").alias("Object"), F.col("wkt_pix").alias("Wkt_Pix"), as_text(F.col("flooded")).alias("Flooded"), "length_m", "travel_time_s")
    out.write.mode("append" if append else "errorifexists").option("header", True).csv(path)


def with_means(scores: DataFrame, key: str = "tile_id") -> DataFrame:
    """A score table and its rows `means` and `stds` (population)."""
    values = [c for c in scores.columns if c != key]
    row = lambda name, f: scores.agg(*(f(c).alias(c) for c in values)).select(F.lit(name).alias(key), *values)
    return scores.withColumn(key, F.col(key).cast("string")).unionByName(row("means", F.avg)).unionByName(row("stds", F.stddev_pop))
