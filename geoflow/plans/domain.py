"""Domain tables derived from the driver's tables by whole-number arithmetic, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name: (source table, columns in an order both engines read alike, group-by or "")
TABLES = {
    "pixel": ("lineitem", {"tile_id": "l_orderkey % 64", '"row"': "l_partkey % 32", "col": "l_suppkey % 32", "value": "max(l_linenumber % 5)", "pred": "max((l_linenumber + l_partkey) % 5)", "prob": "max(CAST(l_quantity AS INT) * 5)"}, 3),
    "model_pixel": ("lineitem", {"model": "l_linenumber % 3", "tile_id": "l_orderkey % 64", '"row"': "l_partkey % 32", "col": "l_suppkey % 32", "value": "max(CAST(l_quantity AS INT) * 5)"}, 4),
    "band_pixel": ("lineitem", {"tile_id": "l_orderkey % 64", "band": "l_linenumber % 7", '"row"': "l_partkey % 32", "col": "l_suppkey % 32", "value": "max(CAST(l_quantity AS INT) * 5)", "after": "max(CAST(floor(l_extendedprice) AS INT) % 256)"}, 4),
    "feature": ("part", {
        "tile_id": "p_partkey % 50", "id": "p_partkey", "building": "CASE WHEN p_partkey % 5 = 0 THEN 'yes' END",
        "highway": "CASE WHEN p_partkey % 5 = 0 OR p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN 'motorway' WHEN p_partkey % 7 = 2 THEN 'primary' WHEN p_partkey % 7 = 3 THEN 'footway' WHEN p_partkey % 7 = 4 THEN 'tertiary' WHEN p_partkey % 7 = 5 THEN 'Residential' WHEN p_partkey % 7 = 6 THEN 'service' ELSE 'track' END",
        "lanes": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 1 + p_size % 14 END", "paved": "1 + p_partkey % 2",
        "flooded": "CASE p_partkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'True' END",
        "bridge": "CASE WHEN p_partkey % 17 = 0 THEN 'yes' END", "length": "1 + p_partkey % 997",
    }, 0),
    "edge": ("orders", {"tile_id": "o_custkey % 16", "edge_id": "o_orderkey", "u": "o_custkey % 200", "v": "o_orderkey % 200", "length": "CAST(1 + o_orderkey % 97 AS DOUBLE)"}, 0),
    "submission": ("orders", {"image_id": "o_custkey % 25", "object": "CASE WHEN o_orderkey % 3 = 0 THEN 'Road' ELSE 'Building' END", "wkt_pix": "concat('POINT (', CAST(o_orderkey % 1300 AS VARCHAR(9)), ' ', CAST(o_custkey % 1300 AS VARCHAR(9)), ')')", "flooded": "(o_orderkey * 7 + o_custkey) % 25 + o_orderkey % 10 < o_custkey % 25 + 4", "length_m": "CAST(o_orderkey % 5 AS DOUBLE)", "travel_time_s": "CAST(o_orderkey % 3 AS DOUBLE)"}, 0),
    "manifest": ("customer", {"tile_id": "c_custkey", "aoi": "c_mktsegment", "lon": "c_custkey * 37 % 360 - 180", "lat": "c_custkey * 11 % 161 - 80", "flooded": "c_custkey % 3 = 0", "x": "CAST(c_custkey % 40 AS INT)", "y": "CAST(FLOOR(c_custkey / 40) AS INT)", "mse1": "c_custkey * 13 % 997", "mse2": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey * 29 % 997 END"}, 0),
    "vertex": ("events", {"line_id": "user_id", "tile_id": "user_id % 20", "pos": "event_id", "x": "CAST(event_id * 7919 % 1300 AS DOUBLE)", "y": "CAST(event_id * 104729 % 1300 AS DOUBLE)"}, 0),
    "route": ("orders", {"tile_id": "o_custkey % 16", '"start"': "o_custkey % 100", '"end"': "o_orderkey % 100", "length": "CAST(min(o_orderkey % 97) AS DOUBLE)", "proposed": "CAST(min(o_orderkey % 89 - 4) AS DOUBLE)"}, 3),
}
#: The source tables have unique keys (o_orderkey, p_partkey, c_custkey, event_id); ties fall to those.


def sql(*names: str) -> str:
    """`WITH` clause of the named tables; queries may add recursive ones."""
    each = []
    for name in names:
        source, columns, keys = TABLES[name]
        listed = ", ".join(f"{e} AS {c}" for c, e in columns.items())
        by = f" GROUP BY {', '.join(map(str, range(1, keys + 1)))}" if keys else ""
        each.append(f"{name} AS (SELECT {listed} FROM {source}{by})")
    return "WITH RECURSIVE " + ", ".join(each) + " "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns, keys = TABLES[name]
    df = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    named = [F.expr(e).alias(c.strip('"')) for c, e in columns.items()]
    return df.groupBy(*named[:keys]).agg(*named[keys:]) if keys else df.select(*named)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile_id, line_id, points): the vertices of each line in order."""
    at = F.array_sort(F.collect_list(F.struct("pos", "x", "y")))
    return table(spark, sf_dir, "vertex").groupBy("tile_id", "line_id").agg(F.transform(at, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
