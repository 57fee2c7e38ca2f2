"""GeoJSON collections, polygons with holes, and strict tags."""

import json

import pytest
from pyspark.sql import functions as F

from geoflow.functions import geom, speed
from geoflow.sources import files


def test_collections_round_trip(spark, tmp_path):
    rows = [(1, {"a": "x"}, [(0.0, 0.0), (1.0, 2.0)]), (1, {"a": "y"}, [(3.0, 4.0), (5.0, 6.0)]), (2, {}, [(7.0, 8.0), (9.0, 1.0)])]
    df = spark.createDataFrame(rows, "tile_id int, props map<string,string>, points array<struct<x:double,y:double>>")
    one = {r["tile_id"]: json.loads(r["value"]) for r in files.geojson_collections(df).collect()}
    assert [len(one[k]["features"]) for k in (1, 2)] == [2, 1] and one[1]["type"] == "FeatureCollection"
    files.write_geojson_collections(df, f"{tmp_path}/out")
    back = files.line_points(files.read_geojson(spark, f"{tmp_path}/out/*/*")).select("props", "points").collect()
    assert sorted((dict(r["props"] or {}), [tuple(p) for p in r["points"]]) == (p, q) for r, (_, p, q) in zip(sorted(back, key=lambda r: r["points"]), sorted(rows, key=lambda x: x[2]), strict=True)) == [True] * 3


def test_holes_are_taken_off(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    df = spark.createDataFrame([(1, [square(0.0, 10.0), square(2.0, 4.0), square(5.0, 8.0)]), (2, [square(0.0, 3.0)]), (3, [])], "id int, rings array<array<struct<x:double,y:double>>>")
    assert [r["area"] for r in df.orderBy("id").select(geom.polygon_area(F.col("rings")).alias("area")).collect()] == [100 - 4 - 9, 9, 0]


def test_strict_tags(spark):
    df = spark.createDataFrame([("primary",), ("footway",), (None,)], "highway string")
    assert [r["t"] for r in df.select(speed.road_type(F.col("highway"), strict=True).alias("t")).collect()] == [2, None, None]
    odd = spark.createDataFrame([("primary",), ("runway",)], "highway string")
    assert [r["t"] for r in odd.select(speed.road_type(F.col("highway")).alias("t")).collect()] == [2, None]
    with pytest.raises(Exception, match="unknown highway tag: runway"):
        odd.select(speed.road_type(F.col("highway"), strict=True).alias("t")).collect()
