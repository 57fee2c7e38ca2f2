"""Queries of the geospatial operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoflow.functions import coords, flags, geom, speed
from geoflow.operators import conflate, features, graph, metrics, pixels, sampling, spatial, tiles
from geoflow.plans.catalog import oracle_sql, queries, query  # noqa: F401
from geoflow.plans.domain import lines, table

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_hysteresis(spark, sf_dir)


# Features and flags


@query("SELECT tile_id, id, building, highway, lanes FROM feature WHERE NOT ((building IS NULL AND highway IS NULL) OR (highway IS NOT NULL AND lanes IS NULL))", "feature")
def filter_bad(spark, d):
    return features.without_bad(table(spark, d, "feature")).select("tile_id", "id", "building", "highway", "lanes")


@query("SELECT id FROM feature WHERE building IS NOT NULL", "feature")
def filter_buildings(spark, d):
    return features.buildings(table(spark, d, "feature")).select("id")


@query("SELECT id, highway FROM feature WHERE highway IN ('motorway', 'primary')", "feature")
def filter_valid_types(spark, d):
    return features.of_types(features.roads(table(spark, d, "feature")), ["motorway", "primary"]).select("id", "highway")


@query("SELECT id, coalesce(flooded NOT IN ('no', '0', 'No', 'false', 'False', 'None'), FALSE) AS building_flag, flooded IS NOT NULL AS road_flag, CASE WHEN flooded IN ('yes', '1', 'True') THEN 2 ELSE 1 END AS mask_id FROM feature", "feature")
def truth_flags(spark, d):
    f = F.col("flooded")
    return table(spark, d, "feature").select("id", flags.building_flag(f).alias("building_flag"), flags.road_flag(f).alias("road_flag"), flags.mask_class(f).alias("mask_id"))


_TYPE = "CASE lower(highway) WHEN 'motorway' THEN 1 WHEN 'primary' THEN 2 WHEN 'tertiary' THEN 4 WHEN 'residential' THEN 5 WHEN 'service' THEN 6 WHEN 'track' THEN 7 END"


@query(f"SELECT id, {_TYPE} AS road_type FROM feature WHERE highway IS NOT NULL", "feature")
def highway_to_type(spark, d):
    return features.roads(table(spark, d, "feature")).select("id", speed.road_type(F.col("highway")).alias("road_type"))


_SPEED = f"""SELECT *, CASE WHEN lanes IS NULL OR lanes > 12 OR road_type IS NULL THEN -1.0 ELSE (CASE road_type WHEN 1 THEN 55 WHEN 2 THEN 45 WHEN 4 THEN 30 WHEN 5 THEN 25 ELSE 20 END
  + CASE WHEN lanes <= 2 THEN 0 WHEN road_type <= 2 THEN 10 WHEN road_type <= 5 THEN 5 ELSE 0 END) * CASE WHEN paved = 2 THEN 0.75 ELSE 1.0 END END AS mph FROM (SELECT *, {_TYPE} AS road_type FROM feature WHERE highway IS NOT NULL)"""


def _with_speed(spark, d):
    return speed.add_road_speed(features.roads(table(spark, d, "feature")).withColumn("road_type", speed.road_type(F.col("highway"))))


@query(f"SELECT id, CAST(mph AS DOUBLE) AS mph, round(CASE WHEN mph < 0 THEN -1.0 ELSE mph * CAST(0.44704 AS DOUBLE) END, 6) AS mps FROM ({_SPEED})", "feature")
def road_speed(spark, d):
    return _with_speed(spark, d).select("id", F.col("inferred_speed_mph").alias("mph"), F.round("inferred_speed_mps", 6).alias("mps"))


@query(f"SELECT tile_id, count(*) AS n, round(sum(length / CASE WHEN mph < 0 THEN CAST(13.41 AS DOUBLE) ELSE mph * CAST(0.44704 AS DOUBLE) END), 4) AS seconds FROM ({_SPEED}) GROUP BY tile_id", "feature")
def travel_time(spark, d):
    mps = F.col("inferred_speed_mps")
    seconds = speed.travel_time(F.col("length"), F.when(mps > 0, mps))
    return _with_speed(spark, d).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(seconds), 4).alias("seconds"))


@query(f"SELECT mph, CAST(ceil(mph / 10) AS INT) AS bin, greatest(127, CAST(trunc(127 + (mph - 15) * (128.0::DOUBLE / 50)) AS INT)) AS burn FROM (SELECT DISTINCT CAST(mph AS DOUBLE) AS mph FROM ({_SPEED}) WHERE mph > 0)", "feature")
def speed_bins(spark, d):
    mph = F.col("mph")
    return _with_speed(spark, d).select(F.col("inferred_speed_mph").alias("mph")).where("mph > 0").distinct().select("mph", speed.speed_bin(mph).alias("bin"), speed.speed_burn(mph).alias("burn"))


@query("SELECT CAST(i AS INT) AS speed, CAST(ceil(i / 10.0) AS INT) * 36 AS burn_val, CAST(ceil(i / 10.0) AS INT) - 1 AS channel FROM range(1, 66) t(i)")
def speed_params(spark, d):
    return speed.speed_key(spark)


# Tile matching, submissions


@query("""SELECT m.tile_id, m.aoi, s.edge_id FROM manifest m JOIN (SELECT u AS tile_id, min(edge_id) AS edge_id FROM edge GROUP BY u) s ON s.tile_id = m.tile_id""", "manifest", "edge")
def join_tile_first(spark, d):
    right = table(spark, d, "edge").select(F.col("u").alias("tile_id"), "edge_id")
    return features.match_by_tile(table(spark, d, "manifest").select("tile_id", "aoi"), right, order="edge_id")


@query("""SELECT a.aoi AS prefix, a.tile_id, b.tile_id AS "right", c.tile_id AS below, e.tile_id AS diagonal, a.x, a.y FROM manifest a JOIN manifest b ON b.aoi = a.aoi AND b.x = a.x + 1 AND b.y = a.y
  JOIN manifest c ON c.aoi = a.aoi AND c.x = a.x AND c.y = a.y + 1 JOIN manifest e ON e.aoi = a.aoi AND e.x = a.x + 1 AND e.y = a.y + 1""", "manifest")
def join_neighbours(spark, d):
    return features.with_neighbours(table(spark, d, "manifest").withColumnRenamed("aoi", "prefix"))


_SHARES = "SELECT *, avg(CAST(flooded AS INT)) OVER (PARTITION BY image_id) AS share FROM submission"
_TWINS = "SELECT image_id, object, wkt_pix, flooded, length_m, travel_time_s FROM x GROUP BY ALL HAVING count(*) = 1"


@query(f", x AS (SELECT image_id, object, wkt_pix, CASE WHEN share <= 0.4 THEN FALSE WHEN share >= 0.7 THEN TRUE ELSE flooded END AS flooded, length_m, travel_time_s FROM ({_SHARES})) {_TWINS}", "submission")
def tile_hysteresis(spark, d):
    return conflate.tile_hysteresis(table(spark, d, "submission"))


@query(f"SELECT image_id, object, wkt_pix, share > 0.5 AS flooded FROM ({_SHARES})", "submission")
def building_tile_vote(spark, d):
    return conflate.tile_vote(table(spark, d, "submission"), 0.5).select("image_id", "object", "wkt_pix", "flooded")


@query(f"SELECT image_id, object, wkt_pix, share > 0.3 AS flooded FROM ({_SHARES})", "submission")
def road_flood_tile_vote(spark, d):
    return conflate.tile_vote(table(spark, d, "submission"), 0.3).select("image_id", "object", "wkt_pix", "flooded")


@query(f", x AS (SELECT image_id, object, wkt_pix, flooded, length_m, travel_time_s FROM submission) {_TWINS}", "submission")
def drop_all_dups(spark, d):
    return features.without_twins(table(spark, d, "submission"))


@query("""SELECT image_id, object, wkt_pix, flooded FROM submission WHERE object = 'Road' UNION ALL
  SELECT tile_id, 'Road', 'LINESTRING EMPTY', NULL FROM manifest WHERE tile_id NOT IN (SELECT image_id FROM submission WHERE object = 'Road')""", "submission", "manifest")
def add_missing_tiles(spark, d):
    rows = table(spark, d, "submission").where("object = 'Road'").select("image_id", "object", "wkt_pix", "flooded")
    return features.with_missing_tiles(rows, table(spark, d, "manifest").select(F.col("tile_id").alias("image_id")), geom.EMPTY_LINE)


@query(""", r AS (SELECT * FROM submission WHERE object = 'Road'), b AS (SELECT * FROM submission WHERE object = 'Building'),
  every AS (SELECT * FROM r UNION ALL SELECT tile_id, 'Road', 'LINESTRING EMPTY', NULL, 0, 0 FROM manifest WHERE tile_id NOT IN (SELECT image_id FROM r)
  UNION ALL SELECT * FROM b UNION ALL SELECT tile_id, 'Building', 'POLYGON EMPTY', NULL, 0, 0 FROM manifest WHERE tile_id NOT IN (SELECT image_id FROM b))
  SELECT DISTINCT image_id, object, wkt_pix, coalesce(flooded, FALSE) AS flooded, length_m, travel_time_s FROM every""", "submission", "manifest")
def assemble_submission(spark, d):
    rows, names = table(spark, d, "submission"), table(spark, d, "manifest").select(F.col("tile_id").alias("image_id"))
    return features.assemble_submission(rows.where("object = 'Road'"), rows.where("object = 'Building'"), names)


@query("SELECT tile_id, least(u, v) AS u, greatest(u, v) AS v, min(edge_id) AS edge_id, arg_min(length, edge_id) AS length FROM edge GROUP BY 1, 2, 3", "edge")
def edges_to_rows(spark, d):
    return features.edge_rows(table(spark, d, "edge"))


# Folds and samples

_PLACED = "SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY lon, lat, tile_id) - 1 AS k, count(*) OVER (PARTITION BY aoi) AS n FROM manifest"


@query(f"SELECT tile_id, CAST((k >= n // 5) AS INT) + CAST((k >= n * 2 // 5) AS INT) + CAST((k >= n * 3 // 5) AS INT) + CAST((k >= n * 4 // 5) AS INT) AS fold FROM ({_PLACED})", "manifest")
def folds_geo_strat(spark, d):
    return sampling.even_folds(table(spark, d, "manifest"), ["aoi"], ["lon", "lat", "tile_id"]).select("tile_id", "fold")


@query("SELECT tile_id, ntile(7) OVER (PARTITION BY aoi ORDER BY tile_id) - 1 AS fold FROM manifest", "manifest")
def split_kfold7(spark, d):
    return sampling.contiguous_folds(table(spark, d, "manifest"), ["aoi"], ["tile_id"]).select("tile_id", "fold")


@query("""SELECT tile_id, f.fold, CASE WHEN aoi = f.p AND x BETWEEN f.x0 AND f.x1 AND y BETWEEN 0 AND 99999 THEN 'val' ELSE 'train' END AS part FROM manifest,
  (VALUES (0, 'BUILDING', 0, 19), (1, 'MACHINERY', 5, 30)) f(fold, p, x0, x1)""", "manifest")
def folds_by_box(spark, d):
    boxes = spark.createDataFrame([(0, "BUILDING", 0, 19, 0, 99999), (1, "MACHINERY", 5, 30, 0, 99999)], "fold int, prefix string, x0 int, x1 int, y0 int, y1 int")
    return sampling.box_folds(table(spark, d, "manifest").withColumnRenamed("aoi", "prefix"), boxes).select("tile_id", "fold", "part")


@query(f"SELECT tile_id, aoi FROM ({_PLACED}) WHERE aoi NOT IN ('BUILDING', 'FURNITURE') OR k + 1 <= n // 4", "manifest")
def sample_down_quarter(spark, d):
    return sampling.sample_quarter(table(spark, d, "manifest"), "aoi", ["BUILDING", "FURNITURE"], ["lon", "lat", "tile_id"]).select("tile_id", "aoi")


@query("""SELECT tile_id, flooded FROM (SELECT *, row_number() OVER (PARTITION BY aoi, flooded ORDER BY tile_id) AS k, sum(CAST(flooded AS INT)) OVER (PARTITION BY aoi) AS pos FROM manifest)
  WHERE flooded OR k <= floor(pos * 1.2)""", "manifest")
def sample_nonflood_ratio(spark, d):
    return sampling.sample_negatives(table(spark, d, "manifest"), "flooded", 1.2, ["aoi"], ["tile_id"]).select("tile_id", "flooded")


@query(""", s AS (SELECT *, row_number() OVER (PARTITION BY aoi, flooded ORDER BY tile_id) - 1 AS k, count(*) OVER (PARTITION BY aoi, flooded) AS n FROM manifest),
  m AS (SELECT *, max(n) OVER (PARTITION BY aoi) AS most FROM s) SELECT tile_id, flooded, r.i AS round FROM m, LATERAL (SELECT unnest(range(0, (most - k - 1) // n + 1)) AS i) r""", "manifest")
def sample_balanced_over(spark, d):
    return sampling.balanced(table(spark, d, "manifest"), "flooded", ["aoi"], ["tile_id"]).select("tile_id", "flooded", "round")


@query()
def split_random(spark, d):
    return sampling.random_split(table(spark, d, "manifest"), "tile_id", 0.15).select("tile_id", "part")


# Pixels


@query('SELECT tile_id, "row", col, v.b AS band, CASE WHEN v.b < 4 THEN CAST(value = v.b + 1 AS INT) ELSE CAST(value > 0 AS INT) END AS value FROM pixel, (VALUES (0), (1), (2), (3), (4)) v(b)', "pixel")
def to_channels(spark, d):
    return pixels.to_channels(table(spark, d, "pixel"), [1, 2, 3, 4], any_band=True)


@query('SELECT tile_id, "row", col, CAST(CASE WHEN max(value) > 0 THEN min(band) FILTER (value = most) + 1 ELSE 0 END AS BIGINT) AS value FROM (SELECT *, max(value) OVER (PARTITION BY tile_id, "row", col) AS most FROM band_pixel) GROUP BY 1, 2, 3', "band_pixel")
def from_channels(spark, d):
    return pixels.from_channels(table(spark, d, "band_pixel")).withColumn("value", F.col("value").cast("long"))


_BANDS = ", h AS (SELECT tile_id, \"row\", col, bool_or(band = 0 AND value > 99) AS b0, bool_or(band = 1 AND value > 99) AS b1, bool_or(band = 2 AND value > 99) AS b2, bool_or(band = 3 AND value > 99) AS b3 FROM band_pixel GROUP BY 1, 2, 3)"


@query(_BANDS + ' SELECT tile_id, "row", col, CASE WHEN b1 THEN 2 WHEN b0 THEN 1 WHEN b3 THEN 4 WHEN b2 THEN 3 ELSE 0 END AS value FROM h', "band_pixel")
def merge_classes(spark, d):
    return pixels.merge_classes(pixels.threshold(table(spark, d, "band_pixel"), 99, strict=True))


@query(_BANDS + ' SELECT tile_id, "row", col, CASE WHEN b2 OR b3 THEN 2 WHEN b0 OR b1 THEN 1 ELSE 0 END AS value FROM h', "band_pixel")
def merge_classes3(spark, d):
    return pixels.merge_classes(pixels.threshold(table(spark, d, "band_pixel"), 99, strict=True), 3)


@query('SELECT tile_id, "row", col, CASE WHEN value IN (1, 2) THEN 255 ELSE 0 END AS building, CASE WHEN value IN (3, 4) THEN 254 ELSE 0 END AS road FROM pixel', "pixel")
def class_to_foundation(spark, d):
    return pixels.class_masks(table(spark, d, "pixel"))


_BY = 'GROUP BY tile_id, "row", col'


@query(f'SELECT tile_id, "row", col, CAST(floor(avg(value)) AS INT) AS value FROM model_pixel {_BY}', "model_pixel")
def ensemble_mean(spark, d):
    return pixels.ensemble(table(spark, d, "model_pixel"))


@query(f'SELECT tile_id, "row", col, CAST(floor(avg(CAST(value > 120 AS INT)) * 255) AS INT) AS value FROM model_pixel {_BY}', "model_pixel")
def ensemble_vote(spark, d):
    return pixels.ensemble(pixels.threshold(table(spark, d, "model_pixel"), 120, strict=True), "vote")


@query(f'SELECT tile_id, "row", col, CAST(avg(value) > 125.5 AS INT) AS value FROM model_pixel {_BY}', "model_pixel")
def ensemble_thresh(spark, d):
    return pixels.ensemble(table(spark, d, "model_pixel"), "above", 125.5)


@query(f'SELECT tile_id, "row", col, CAST((sum(sqrt(value)) - sqrt(arg_min(value, model)) + arg_min(value, model)) / count(*) > 30.01 AS INT) AS value FROM model_pixel {_BY}', "model_pixel")
def ensemble_sharpen(spark, d):
    return pixels.ensemble(table(spark, d, "model_pixel"), "sharpen", 30.01)


@query('SELECT a.tile_id, a."row", a.col, round(a.value * 0.25 + b.value * 0.75, 6) AS value FROM model_pixel a JOIN model_pixel b ON a.tile_id = b.tile_id AND a."row" = b."row" AND a.col = b.col WHERE a.model = 0 AND b.model = 1', "model_pixel")
def ensemble_blend(spark, d):
    m = table(spark, d, "model_pixel")
    return pixels.blend(m.where("model = 0"), m.where("model = 1"), 0.25).withColumn("value", F.round("value", 6))


@query("SELECT tile_id, round(sum(sq) / sum(n), 6) AS mse FROM (SELECT tile_id, sum(value) AS s, sum((value - after) * (value - after)) AS sq, count(*) AS n FROM band_pixel GROUP BY tile_id, \"row\", col) WHERE s > 0 GROUP BY tile_id", "band_pixel")
def image_mse(spark, d):
    b = table(spark, d, "band_pixel")
    return pixels.image_mse(b.drop("after"), b.select("tile_id", "band", "row", "col", F.col("after").alias("value"))).withColumn("mse", F.round("mse", 6))


@query("SELECT tile_id, CASE WHEN mse1 <= coalesce(mse2, 1e9) THEN 'a' ELSE 'b' END AS post_image FROM manifest", "manifest")
def pick_post_image(spark, d):
    return pixels.pick_post(table(spark, d, "manifest").withColumn("post_image_1", F.lit("a")).withColumn("post_image_2", F.lit("b"))).select("tile_id", "post_image")


@query(""", m AS (SELECT tile_id, band, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM band_pixel GROUP BY 1, 2)
  SELECT tile_id, band, "row", col, CAST(floor(round(greatest(0, least(255, coalesce((value - lo) * 255 / nullif(hi - lo, 0), 0))), 9)) AS INT) AS value FROM band_pixel JOIN m USING (tile_id, band)""", "band_pixel")
def percentile_rescale(spark, d):
    return pixels.percentile_rescale(table(spark, d, "band_pixel").drop("after"))


@query("SELECT value, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM pixel), 6) AS percent FROM pixel GROUP BY value", "pixel")
def class_hist(spark, d):
    return pixels.class_shares(table(spark, d, "pixel")).withColumn("percent", F.round("percent", 6))


@query('SELECT tile_id, a.t AS top, b.l AS "left", "row" - a.t AS "row", col - b.l AS col, value FROM pixel, (VALUES (0), (8), (16)) a(t), (VALUES (0), (8), (16)) b(l) WHERE "row" BETWEEN a.t AND a.t + 15 AND col BETWEEN b.l AND b.l + 15', "pixel")
def crop_window(spark, d):
    return pixels.crops(table(spark, d, "pixel"), 32, 16, 8)


@query('SELECT tile_id, "row", col, CAST(value AS DOUBLE) AS value FROM pixel', "pixel")
def slide_inference(spark, d):
    """A scorer that keeps values gives each pixel back, however many windows hold it."""
    return pixels.merge_crops(pixels.crops(table(spark, d, "pixel"), 32, 16, 8))


@query('SELECT tile_id, "row", col, round((value + 2 * sqrt(value)) / 3, 6) AS value FROM pixel', "pixel")
def tta_flip_mean(spark, d):
    return pixels.merge_flips(pixels.flips(table(spark, d, "pixel"), 32), 32).withColumn("value", F.round("value", 6))


# Flood and speed by pixels


@query("SELECT tile_id, label, count(*) AS n, count(*) FILTER (value = 2) AS n_flooded, CASE WHEN count(*) FILTER (value = 2) / count(*) > 0.3 THEN 2 ELSE 1 END AS flood_class FROM (SELECT *, \"row\" // 8 AS label FROM pixel) GROUP BY 1, 2", "pixel")
def zonal_vote_building(spark, d):
    p = table(spark, d, "pixel")
    return conflate.zonal_vote(p.select("tile_id", "row", "col", "value"), p.select("tile_id", "row", "col", F.floor(F.col("row") / 8).alias("label")), 0.3)


_SEGMENTS = ", seg AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM vertex WINDOW w AS (PARTITION BY line_id ORDER BY pos))"
_WINDOWS = _SEGMENTS + """, s AS (SELECT *, CAST(ceil(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))) AS INT) AS n FROM (SELECT tile_id, line_id, pos, x / 41 AS x, y / 41 AS y, x2 / 41 AS x2, y2 / 41 AS y2 FROM seg WHERE x2 IS NOT NULL)),
  t AS (SELECT tile_id, line_id, pos, x, y, x2, y2, n, unnest(range(0, n)) AS k FROM s WHERE n > 0),
  c AS (SELECT tile_id, line_id, CAST(trunc(x + (CASE WHEN n > 1 THEN k / (n - 1) ELSE 0 END) * (x2 - x)) AS INT) AS px, CAST(trunc(y + (CASE WHEN n > 1 THEN k / (n - 1) ELSE 0 END) * (y2 - y)) AS INT) AS py FROM t),
  v AS (SELECT c.line_id, c.tile_id, p.value, count(*) AS n FROM c JOIN pixel p ON p.tile_id = c.tile_id AND p."row" >= greatest(py - 2, 0) AND p."row" <= greatest(least(py + 2, 1299) - 1, greatest(py - 2, 0)) AND p.col >= greatest(px - 2, 0) AND p.col <= greatest(least(px + 2, 1299) - 1, greatest(px - 2, 0)) GROUP BY 1, 2, 3)"""


def _small_lines(spark, d):
    return lines(spark, d).withColumn("points", F.transform("points", lambda p: F.struct((p["x"] / 41).alias("x"), (p["y"] / 41).alias("y"))))


@query(_WINDOWS + " SELECT tile_id, line_id, arg_max(value, n * 10 - value) = 4 AS flooded FROM v GROUP BY 1, 2", "vertex", "pixel")
def road_flood_mode(spark, d):
    return conflate.road_flood(_small_lines(spark, d), table(spark, d, "pixel").select("tile_id", "row", "col", "value"))


@query(_WINDOWS + " SELECT tile_id, line_id, sum(n) FILTER (value = 4) / sum(n) > 0.2 AS flooded FROM v GROUP BY 1, 2", "vertex", "pixel")
def road_flood_ratio(spark, d):
    return conflate.road_flood(_small_lines(spark, d), table(spark, d, "pixel").select("tile_id", "row", "col", "value"), above=0.2)


_Z = ", z AS (SELECT tile_id, band, CAST(floor(round(quantile_cont(value, 0.85), 9)) AS INT) AS z FROM band_pixel GROUP BY 1, 2), zs AS (SELECT *, [7.5, 17.5, 25, 35, 45, 55, 65][band + 1] AS s FROM z)"


@query(_Z + " SELECT tile_id, round(coalesce(sum(z * s) FILTER (z > 128) / sum(z) FILTER (z > 128), -1), 6) AS speed FROM zs GROUP BY 1", "band_pixel")
def speed_patch_multi(spark, d):
    bands = conflate.band_values(table(spark, d, "band_pixel").select("tile_id", "band", "value"))
    return conflate.patch_speed(bands).withColumn("speed", F.round("speed", 6))


@query(_SEGMENTS + """, m AS (SELECT tile_id, line_id, pos, round_even((x + x2) / 82, 0) AS mx, round_even((y + y2) / 82, 0) AS my FROM seg WHERE x2 IS NOT NULL),
  w AS (SELECT m.tile_id, line_id AS edge_id, m.pos, p.band, CAST(floor(round(quantile_cont(p.value, 0.85), 9)) AS INT) AS z FROM m JOIN band_pixel p ON p.tile_id = m.tile_id AND p."row" BETWEEN my - 6 AND my + 6 AND p.col BETWEEN mx - 6 AND mx + 6 GROUP BY 1, 2, 3, 4),
  b AS (SELECT tile_id, edge_id, band, sum(z) AS z FROM w GROUP BY 1, 2, 3)
  SELECT tile_id, edge_id, [7.5, 17.5, 25, 35, 45, 55, 65][arg_max(band, z * 10 - band) + 1]::DOUBLE AS speed_mph FROM b GROUP BY 1, 2""", "vertex", "band_pixel")
def edge_speed(spark, d):
    middles = _small_lines(spark, d).select("tile_id", F.col("line_id").alias("edge_id"), F.posexplode(geom.midpoints(F.col("points"))).alias("seq", "m")).select("tile_id", "edge_id", "seq", "m.x", "m.y")
    return conflate.edge_speed(middles, table(spark, d, "band_pixel").drop("after"))


@query("SELECT tile_id, round(sum(length * paved) / sum(length), 6) AS mean, round(sum(length * paved * paved) / sum(length) - (sum(length * paved) / sum(length)) ** 2, 6) AS var FROM feature GROUP BY tile_id", "feature")
def weighted_stats(spark, d):
    return conflate.weighted_stats(table(spark, d, "feature"), ["tile_id"], "paved", "length").select("tile_id", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


@query('SELECT tile_id, "row", col, CASE WHEN value > 2 THEN 3 + pred % 2 WHEN value > 0 THEN 1 + pred % 2 ELSE 0 END AS value FROM pixel', "pixel")
def flood_class_assign(spark, d):
    p = table(spark, d, "pixel").withColumn("building", (F.col("value") > 0).cast("int")).withColumn("road", (F.col("value") > 2).cast("int")).withColumn("flood", F.col("pred") % 2)
    return conflate.overlay_classes(p).withColumn("value", F.col("value").cast("long"))


# Coordinates and lines


@query(_SEGMENTS + " SELECT line_id, count(x2) + 1 AS n, round(coalesce(sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))), 0), 4) AS length FROM seg GROUP BY 1", "vertex")
def line_length(spark, d):
    return lines(spark, d).select("line_id", F.size("points").cast("long").alias("n"), F.round(geom.line_length(F.col("points")), 4).alias("length"))


@query(_SEGMENTS + ", f AS (SELECT *, first(x) OVER w AS fx, first(y) OVER w AS fy FROM seg WINDOW w AS (PARTITION BY line_id ORDER BY pos)) SELECT line_id, round(abs(sum(x * coalesce(y2, fy) - coalesce(x2, fx) * y)) / 2, 3) AS area FROM f GROUP BY 1", "vertex")
def polygon_area(spark, d):
    ring = F.concat("points", F.slice("points", 1, 1))
    return lines(spark, d).select("line_id", F.round(geom.ring_area(ring), 3).alias("area"))


@query(_SEGMENTS + " SELECT line_id, pos, round_even((x + x2) / 2, 0) AS x, round_even((y + y2) / 2, 0) AS y FROM seg WHERE x2 IS NOT NULL", "vertex")
def segment_midpoints(spark, d):
    at = lines(spark, d).join(table(spark, d, "vertex").groupBy("line_id").agg(F.array_sort(F.collect_list("pos")).alias("places")), "line_id")
    return at.select("line_id", "places", F.posexplode(geom.midpoints(F.col("points"))).alias("k", "m")).select("line_id", F.get("places", F.col("k")).alias("pos"), "m.x", "m.y")


_DMS = "SELECT *, sin(radians(CAST(lat AS DOUBLE)) / 2) AS s, sin(radians(CAST(lon AS DOUBLE)) / 2) AS t FROM manifest"


@query(f"SELECT tile_id, round(2 * asin(sqrt(s * s + cos(radians(lat)) * t * t)) * 6367000, 2) AS haversine, round(2 * asin(sqrt(least(1.0, s * s + cos(radians(lat)) * t * t))) * 6371009, 2) AS great_circle FROM ({_DMS})", "manifest")
def sphere_distances(spark, d):
    zero = F.lit(0.0)
    return table(spark, d, "manifest").select("tile_id", F.round(coords.haversine(zero, zero, F.col("lon"), F.col("lat")), 2).alias("haversine"), F.round(coords.great_circle(zero, zero, F.col("lat"), F.col("lon")), 2).alias("great_circle"))


@query("SELECT tile_id, CAST((CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END) + floor((lon + 180) / 6) % 60 + 1 AS INT) AS epsg, CAST(floor((lon + 180) / 6) AS INT) AS legacy_zone FROM manifest", "manifest")
def utm_epsg(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    return table(spark, d, "manifest").select("tile_id", coords.utm_epsg(lat, lon).alias("epsg"), coords.utm_zone(lon, legacy=True).alias("legacy_zone"))


@query("SELECT line_id, pos, x * 0.25 - 90 AS lon, y * -0.25 + 30 AS lat, CAST(trunc((x / 8 - 81) / 0.5) AS INT) AS px, CAST(trunc((y / 8 - 81) / -0.5) AS INT) AS py FROM vertex", "vertex")
def affine_pixels(spark, d):
    there = F.array(*map(F.lit, (-90.0, 0.25, 0.0, 30.0, 0.0, -0.25)))
    back = F.array(*map(F.lit, (81.0, 0.5, 0.0, 81.0, 0.0, -0.5)))
    lon, lat = coords.pixel_to_geo(F.col("x"), F.col("y"), there)
    px, py = coords.geo_to_pixel(F.col("x") / 8, F.col("y") / 8, back)
    return table(spark, d, "vertex").select("line_id", "pos", lon.alias("lon"), lat.alias("lat"), px.alias("px"), py.alias("py"))


@query("SELECT line_id, CASE WHEN count(*) > 1 THEN 'LINESTRING (' || string_agg(CAST(CAST(x AS DECIMAL(9, 1)) AS VARCHAR) || ' ' || CAST(CAST(y AS DECIMAL(9, 1)) AS VARCHAR), ', ' ORDER BY pos) || ')' ELSE 'LINESTRING EMPTY' END AS wkt, count(*) > 1 AS same FROM vertex GROUP BY 1", "vertex")
def wkt_codec(spark, d):
    """Text of each line, and whether it reads back as the line."""
    return lines(spark, d).withColumn("wkt", geom.line_wkt(F.col("points"))).select("line_id", "wkt", (geom.parse_wkt(F.col("wkt")) == F.col("points")).alias("same"))


@query(_SEGMENTS + " SELECT tile_id, line_id, x AS x1, y AS y1, x2, y2, round(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)), 6) AS length, round(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) / 10, 6) AS travel_time_s FROM seg WHERE x2 IS NOT NULL", "vertex")
def segments_to_rows(spark, d):
    rows = features.segment_rows(lines(spark, d).withColumn("speed", F.lit(10.0)))
    return rows.select("tile_id", "line_id", "x1", "y1", "x2", "y2", F.round("length", 6).alias("length"), F.round("travel_time_s", 6).alias("travel_time_s"))


# Distance joins


@query("SELECT a.tile_id, a.pos AS id, b.pos AS other, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM vertex a JOIN vertex b ON a.tile_id = b.tile_id AND a.pos <> b.pos AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2500", "vertex")
def radius_join(spark, d):
    p = table(spark, d, "vertex").select("tile_id", F.col("pos").alias("id"), "x", "y")
    return spatial.radius_join(p, p, 50.0).where("id <> other").withColumn("distance", F.round("distance", 6))


@query(_SEGMENTS + """, p AS (SELECT tile_id, pos AS id, y AS px, x AS py FROM vertex),
  e AS (SELECT tile_id, edge_id, x AS x1, y AS y1, x2 - x AS dx, y2 - y AS dy FROM (SELECT *, line_id * 100000 + row_number() OVER (PARTITION BY tile_id, line_id ORDER BY pos) - 1 AS edge_id FROM seg) WHERE x2 IS NOT NULL),
  t AS (SELECT p.tile_id, id, edge_id, px, py, x1, y1, dx, dy, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0, least(1, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM p JOIN e ON p.tile_id = e.tile_id),
  n AS (SELECT tile_id, id, edge_id, sqrt((x1 + t * dx - px) * (x1 + t * dx - px) + (y1 + t * dy - py) * (y1 + t * dy - py)) AS distance FROM t),
  m AS (SELECT tile_id, id, min(struct_pack(d := round(distance, 9), e := edge_id)) AS m FROM n WHERE distance <= 100 GROUP BY 1, 2)
  SELECT tile_id, id, m.e AS edge_id, round(m.d, 5) AS distance FROM m""", "vertex")
def nearest_edge(spark, d):
    segs = features.segment_rows(lines(spark, d).withColumn("speed", F.lit(1.0))).withColumn("edge_id", F.col("line_id") * 100000 + F.col("seq"))
    p = table(spark, d, "vertex").select("tile_id", F.col("pos").alias("id"), F.col("y").alias("x"), F.col("x").alias("y"))
    return spatial.snap_to_edges(p, segs.select("tile_id", "edge_id", "x1", "y1", "x2", "y2"), 100.0).select("tile_id", "id", "edge_id", F.round("distance", 5).alias("distance"))


# Graphs

_ENDS = "SELECT tile_id, edge_id, length, unnest([u, v]) AS node_id FROM edge"


@query(f"SELECT tile_id, node_id, count(*) AS degree FROM ({_ENDS}) GROUP BY 1, 2", "edge")
def degree_filter(spark, d):
    return graph.degrees(table(spark, d, "edge"))


@query("SELECT e.tile_id, n.n AS n_nodes, count(*) AS n_edges, round(sum(length) / 1000, 6) AS length_km FROM edge e JOIN (SELECT tile_id, count(DISTINCT node_id) AS n FROM (" + _ENDS + ") GROUP BY 1) n ON n.tile_id = e.tile_id GROUP BY 1, 2", "edge")
def graph_totals(spark, d):
    return graph.graph_totals(table(spark, d, "edge")).withColumn("length_km", F.round("length_km", 6))


@query(f", ends AS ({_ENDS}), one AS (SELECT tile_id, node_id FROM ends GROUP BY 1, 2 HAVING count(*) = 1) SELECT tile_id, edge_id FROM edge WHERE NOT (length < 50 AND ((tile_id, u) IN (SELECT (tile_id, node_id) FROM one) OR (tile_id, v) IN (SELECT (tile_id, node_id) FROM one)))", "edge")
def remove_short_edges(spark, d):
    return graph.without_short_ends(table(spark, d, "edge"), 50).select("tile_id", "edge_id")


@query("SELECT tile_id, edge_id FROM edge WHERE u < 100 AND v < 100 AND (tile_id, u) IN (SELECT (tile_id, v) FROM edge) AND (tile_id, v) IN (SELECT (tile_id, v) FROM edge)", "edge")
def induce_subgraph(spark, d):
    e = table(spark, d, "edge")
    return graph.induced(e, e.select("tile_id", F.col("v").alias("node_id")).where("node_id < 100")).select("tile_id", "edge_id")


_V = """, n AS (SELECT tile_id, x, y, row_number() OVER (PARTITION BY tile_id ORDER BY f) + 9999 AS node_id FROM (SELECT tile_id, x, y, min(line_id * 1000000000 + pos) AS f FROM vertex GROUP BY 1, 2, 3))"""


@query(_V + " SELECT * FROM n", "vertex")
def lines_to_graph(spark, d):
    return graph.lines_to_graph(lines(spark, d))[0]


_E = _V + """, g AS (SELECT vertex.tile_id, line_id, pos, node_id AS u, vertex.x AS x1, vertex.y AS y1, lead(node_id) OVER w AS v, lead(vertex.x) OVER w AS x2, lead(vertex.y) OVER w AS y2 FROM vertex JOIN n ON n.tile_id = vertex.tile_id AND n.x = vertex.x AND n.y = vertex.y WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
  k AS (SELECT *, row_number() OVER (PARTITION BY tile_id, least(u, v), greatest(u, v) ORDER BY line_id, pos) AS copy FROM g WHERE v IS NOT NULL AND u <> v),
  ge AS (SELECT tile_id, row_number() OVER (PARTITION BY tile_id ORDER BY line_id, pos) AS edge_id, u, v, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length, x1, y1, x2, y2 FROM k WHERE copy = 1)"""


@query(_E + " SELECT tile_id, edge_id, u, v, round(length, 6) AS length, x1, y1, x2, y2 FROM ge", "vertex")
def lines_to_graph_edges(spark, d):
    return graph.lines_to_graph(lines(spark, d))[1].withColumn("length", F.round("length", 6))


_ARCS = ", b AS (SELECT tile_id, u, v, min(length) AS w FROM (SELECT tile_id, u, v, length FROM edge UNION ALL SELECT tile_id, v, u, length FROM edge) GROUP BY 1, 2, 3)"
_REACH = _ARCS + """, c AS (SELECT tile_id, u AS node_id, u AS component FROM b UNION SELECT b.tile_id, b.v, c.component FROM c JOIN b ON b.tile_id = c.tile_id AND b.u = c.node_id AND c.component < b.v),
  cc AS (SELECT tile_id, node_id, min(component) AS component FROM c GROUP BY 1, 2)"""


@query(_REACH.replace("FROM edge", "FROM edge WHERE u <> v") + " SELECT * FROM cc", "edge")
def connected_components_graph(spark, d):
    return graph.node_components(table(spark, d, "edge").where("u <> v"))


#: Rounds of the SQL: nodes of a tile are below 200, so no shortest path has more edges.
_PATHS = "UNION ALL SELECT b.tile_id, r.source, b.v, min(r.length + b.w), any_value(r.k) + 1 FROM r JOIN b ON b.tile_id = r.tile_id AND b.u = r.node_id WHERE r.k < {} GROUP BY b.tile_id, r.source, b.v"


@query(_ARCS + ", r AS (SELECT tile_id, min(u) AS source, min(u) AS node_id, CAST(0 AS DOUBLE) AS length, 0 AS k FROM b GROUP BY 1 " + _PATHS.format(200) + ") SELECT tile_id, source, node_id, min(length) AS length FROM r GROUP BY 1, 2, 3", "edge")
def shortest_paths(spark, d):
    """From each tile's least node to all it reaches."""
    e = table(spark, d, "edge")
    return graph.shortest_paths(e, e.groupBy("tile_id").agg(F.min(F.least("u", "v")).alias("node_id")))


@query(_E + """, en AS (SELECT tile_id, edge_id, unnest([u, v]) AS node_id FROM ge), p AS (SELECT tile_id, node_id, min(edge_id) AS a, max(edge_id) AS b FROM en GROUP BY 1, 2 HAVING count(*) = 2),
  l AS (SELECT tile_id, a, b FROM p WHERE a <> b UNION ALL SELECT tile_id, b, a FROM p WHERE a <> b),
  r AS (SELECT tile_id, edge_id, edge_id AS chain FROM ge UNION SELECT l.tile_id, l.b, r.chain FROM r JOIN l ON l.tile_id = r.tile_id AND l.a = r.edge_id AND r.chain < l.b),
  c AS (SELECT tile_id, edge_id, min(chain) AS chain FROM r GROUP BY 1, 2), t AS (SELECT c.tile_id, chain, sum(length) AS length, count(*) AS n_edges FROM c JOIN ge ON ge.tile_id = c.tile_id AND ge.edge_id = c.edge_id GROUP BY 1, 2),
  s AS (SELECT c.tile_id, chain, min(en.node_id) FILTER (p.a IS NULL) AS lo, max(en.node_id) FILTER (p.a IS NULL) AS hi, min(en.node_id) AS least_id FROM c JOIN en ON en.tile_id = c.tile_id AND en.edge_id = c.edge_id LEFT JOIN p ON p.tile_id = en.tile_id AND p.node_id = en.node_id GROUP BY 1, 2)
  SELECT t.tile_id, t.chain AS edge_id, coalesce(lo, least_id) AS u, coalesce(hi, least_id) AS v, round(length, 5) AS length, n_edges FROM t JOIN s ON s.tile_id = t.tile_id AND s.chain = t.chain""", "vertex")
def simplify_graph(spark, d):
    return graph.simplify(graph.lines_to_graph(lines(spark, d))[1]).withColumn("length", F.round("length", 5))


@query(_REACH + ", few AS (SELECT tile_id, component FROM cc GROUP BY 1, 2 HAVING count(*) <= 20), r AS (SELECT cc.tile_id, node_id AS source, node_id, CAST(0 AS DOUBLE) AS length, 0 AS k FROM cc JOIN few ON few.tile_id = cc.tile_id AND few.component = cc.component " + _PATHS.format(20) + """),
  far AS (SELECT tile_id, source, node_id, min(length) AS length FROM r GROUP BY 1, 2, 3), gone AS (SELECT far.tile_id, component FROM far JOIN cc ON cc.tile_id = far.tile_id AND cc.node_id = far.node_id GROUP BY 1, 2 HAVING max(length) < 150)
  SELECT tile_id, edge_id, u, v, length FROM edge WHERE (tile_id, u) NOT IN (SELECT (cc.tile_id, node_id) FROM cc JOIN gone ON gone.tile_id = cc.tile_id AND gone.component = cc.component)""", "edge")
def clean_components(spark, d):
    return graph.without_small_components(table(spark, d, "edge").select("tile_id", "edge_id", "u", "v", "length"), 150.0)


# Scores


@query("SELECT value AS truth, pred, count(*) AS n FROM pixel WHERE value BETWEEN 0 AND 3 GROUP BY 1, 2", "pixel")
def confusion_matrix(spark, d):
    return metrics.confusion(table(spark, d, "pixel"), 4, "value", "pred")


_TOTALS = ", c AS (SELECT value AS truth, pred, count(*) AS n FROM pixel GROUP BY 1, 2), k AS (SELECT v.v AS value, coalesce(sum(n) FILTER (truth = v.v AND pred = v.v), 0) AS tp, coalesce(sum(n) FILTER (truth <> v.v AND pred = v.v), 0) AS fp, coalesce(sum(n) FILTER (truth = v.v AND pred <> v.v), 0) AS fn FROM c, (VALUES (0), (1), (2), (3), (4)) v(v) GROUP BY 1)"


@query(_TOTALS + " SELECT CAST(value AS BIGINT) AS value, round(tp / (tp + fp + fn), 6) AS iou, round(tp / (tp + fn), 6) AS acc, round(2 * tp / (2 * tp + fp + fn), 6) AS dice FROM k", "pixel")
def eval_metrics(spark, d):
    scores = metrics.class_scores(metrics.class_totals(metrics.confusion(table(spark, d, "pixel"), 5, "value", "pred")))
    return scores.select(F.col("value").cast("long").alias("value"), *(F.round(c, 6).alias(c) for c in ("iou", "acc", "dice")))


@query(_TOTALS + " SELECT CAST(value AS BIGINT) AS value, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / (tp + fp + 1e-5), 6) AS precision, round(tp / (tp + fn + 1e-5), 6) AS recall, round(tp / (tp + fp + fn + 1e-5), 6) AS iou FROM k", "pixel")
def pixel_prf(spark, d):
    scores = metrics.pixel_scores(table(spark, d, "pixel").select(F.col("value").alias("truth"), "pred"), 5)
    return scores.select(F.col("value").cast("long").alias("value"), "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "iou")))


_DIFF = "CASE WHEN length <= 0 THEN 0.0 WHEN proposed < 0 THEN 1.0 ELSE least(1.0, abs(length - proposed) / length) END"


def _routes(spark, d):
    r = table(spark, d, "route")
    return r.drop("proposed"), r.select("tile_id", "start", "end", F.col("proposed").alias("length"))


@query(f"SELECT tile_id, round(1 - avg({_DIFF}), 6) AS similarity, count(*) AS routes FROM route GROUP BY 1", "route")
def path_sim(spark, d):
    return metrics.path_similarity(*_routes(spark, d), ["tile_id"]).withColumn("similarity", F.round("similarity", 6))


@query(f""", s AS (SELECT tile_id, 1 - avg({_DIFF}) AS there, 1 - avg(CASE WHEN proposed < 0 THEN NULL WHEN proposed = 0 THEN 0.0 WHEN length < 0 THEN 1.0 ELSE least(1.0, abs(length - proposed) / proposed) END) AS back FROM route GROUP BY 1)
  SELECT tile_id, round(CASE WHEN there > 0 AND back > 0 THEN 2 * there * back / (there + back) ELSE 0 END, 6) AS apls FROM s""", "route")
def apls(spark, d):
    return metrics.apls(*_routes(spark, d), ["tile_id"]).select("tile_id", F.round("apls", 6).alias("apls"))


@query("SELECT tile_id, round(avg(CAST(abs(length - proposed) <= 0.05::DOUBLE * length AS INT)), 6) AS sp, count(*) AS routes FROM route GROUP BY 1", "route")
def sp(spark, d):
    return metrics.path_agreement(*_routes(spark, d), ["tile_id"]).withColumn("sp", F.round("sp", 6))


@query(f"SELECT least(10, CAST(floor(({_DIFF}) * 10) AS BIGINT) + 1) AS bin, count(*) AS n FROM route GROUP BY 1", "route")
def route_hist(spark, d):
    return metrics.difference_histogram(table(spark, d, "route").select(metrics.path_difference(F.col("length"), F.col("proposed")).alias("diff")))


@query()
def topo(spark, d):
    p = table(spark, d, "vertex").select("tile_id", F.col("pos").alias("id"), "x", "y")
    return metrics.topology(p, p.withColumn("x", F.col("x") + 3).withColumn("y", F.col("y") - 2), 4.0)


# Tiles


_NEAR = ", o AS (SELECT a.i - 1 AS dr, b.i - 1 AS dc FROM range(3) a(i), range(3) b(i))"


@query(_NEAR + """, m AS (SELECT tile_id, "row", col, "row" * 32 + col AS i FROM pixel WHERE value > 2),
  nb AS (SELECT a.tile_id, a.i, b.i AS j FROM m a, o, m b WHERE b.tile_id = a.tile_id AND b."row" = a."row" + dr AND b.col = a.col + dc AND a.i <> b.i),
  r AS (SELECT tile_id, i, i AS f FROM m UNION SELECT nb.tile_id, nb.j, r.f FROM r JOIN nb ON nb.tile_id = r.tile_id AND nb.i = r.i AND r.f < nb.j), f AS (SELECT tile_id, i, min(f) AS f FROM r GROUP BY 1, 2)
  SELECT tile_id, CAST(i // 32 AS INT) AS "row", CAST(i % 32 AS INT) AS col, CAST(dense_rank() OVER (PARTITION BY tile_id ORDER BY f) AS INT) AS label FROM f""", "pixel")
def connected_components(spark, d):
    p = table(spark, d, "pixel").withColumn("value", (F.col("value") > 2).cast("int"))
    return tiles.label_components(tiles.pack(p, 32))


@query(_NEAR + """, m AS (SELECT tile_id, "row", col FROM pixel WHERE value > 0),
  e AS (SELECT a.tile_id, a."row", a.col FROM m a, o, m b WHERE b.tile_id = a.tile_id AND b."row" = a."row" + dr AND b.col = a.col + dc GROUP BY 1, 2, 3
  HAVING count(*) = (CASE WHEN a."row" IN (0, 31) THEN 2 ELSE 3 END) * (CASE WHEN a.col IN (0, 31) THEN 2 ELSE 3 END))
  SELECT DISTINCT tile_id, CAST("row" + dr AS INT) AS "row", CAST(col + dc AS INT) AS col, CAST(1 AS INT) AS value FROM e, o WHERE "row" + dr BETWEEN 0 AND 31 AND col + dc BETWEEN 0 AND 31""", "pixel")
def morph_open(spark, d):
    p = table(spark, d, "pixel").withColumn("value", (F.col("value") > 0).cast("int"))
    return tiles.pixels_of(tiles.transform(tiles.pack(p, 32), lambda a: tiles.opened(a, 3)))


@query()
def skeletonize(spark, d):
    p = table(spark, d, "pixel").withColumn("value", (F.col("value") > 0).cast("int"))
    return tiles.pixels_of(tiles.transform(tiles.pack(p, 32), tiles.thin))


@query()
def skeleton_to_graph(spark, d):
    p = table(spark, d, "pixel").withColumn("value", (F.col("value") > 0).cast("int"))
    return tiles.skeleton_lines(tiles.transform(tiles.pack(p, 32), tiles.thin))


@query()
def polygonize(spark, d):
    return tiles.polygonize(tiles.pack(table(spark, d, "pixel"), 32))


@query()
def rdp(spark, d):
    return tiles.simplified(lines(spark, d), 10.0)


@query(""", g AS (SELECT CAST(i AS INT) AS i, greatest(0.0::DOUBLE, least(31.0::DOUBLE, (i + 0.5::DOUBLE) * 32 / 48 - 0.5::DOUBLE)) AS p FROM range(48) t(i)),
  h AS (SELECT i, CAST(floor(p) AS BIGINT) AS a, least(CAST(floor(p) AS BIGINT) + 1, 31) AS b, p - floor(p) AS f FROM g), t AS (SELECT DISTINCT tile_id FROM pixel),
  q AS (SELECT t.tile_id, y.i AS "row", x.i AS col, y.a AS r0, y.b AS r1, x.a AS c0, x.b AS c1, y.f AS fy, x.f AS fx FROM t, h y, h x)
  SELECT q.tile_id, q."row", q.col, CAST(round_even((coalesce(a.value, 0) * (1 - fx) + coalesce(b.value, 0) * fx) * (1 - fy) + (coalesce(c.value, 0) * (1 - fx) + coalesce(e.value, 0) * fx) * fy, 0) AS INT) AS value FROM q
  LEFT JOIN pixel a ON a.tile_id = q.tile_id AND a."row" = r0 AND a.col = c0 LEFT JOIN pixel b ON b.tile_id = q.tile_id AND b."row" = r0 AND b.col = c1
  LEFT JOIN pixel c ON c.tile_id = q.tile_id AND c."row" = r1 AND c.col = c0 LEFT JOIN pixel e ON e.tile_id = q.tile_id AND e."row" = r1 AND e.col = c1""", "pixel")
def warp_resize(spark, d):
    return tiles.pixels_of(tiles.transform(tiles.pack(table(spark, d, "pixel"), 32), lambda a: tiles.resized(a, 48, 48)), zero=True)


@query(_SEGMENTS + """, s AS (SELECT tile_id, x / 41 AS x1, y / 41 AS y1, x2 / 41 - x / 41 AS dx, y2 / 41 - y / 41 AS dy FROM seg WHERE x2 IS NOT NULL),
  p AS (SELECT s.*, r.i AS r, c.i AS c, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0, least(1, ((c.i + 0.5 - x1) * dx + (r.i + 0.5 - y1) * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM s, range(32) r(i), range(32) c(i))
  SELECT DISTINCT tile_id, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, CAST(1 AS INT) AS value FROM p WHERE sqrt((x1 + t * dx - c - 0.5) ** 2 + (y1 + t * dy - r - 0.5) ** 2) <= 0.75""", "vertex")
def rasterize(spark, d):
    shapes = _small_lines(spark, d).withColumn("seq", F.col("line_id")).withColumn("value", F.lit(1)).where(F.size("points") > 1)
    return tiles.burned(shapes, 32, radius=0.75)


# Small operators


@query('SELECT tile_id, "row", col, CAST(prob / 255 * (1 - pred * 50 / 255) >= 0.5 AS INT) AS value FROM pixel', "pixel")
def body_minus_border(spark, d):
    return pixels.body_minus_border(table(spark, d, "pixel").withColumnRenamed("prob", "body").withColumn("border", F.col("pred") * 50), 0.5)


@query('SELECT tile_id, band, "row", col, round((value / 255 - [0.485, 0.456, 0.406][band + 1]) / [0.229, 0.224, 0.225][band + 1], 6) AS value FROM band_pixel WHERE band < 3', "band_pixel")
def mean_std_normalise(spark, d):
    return pixels.normalised(table(spark, d, "band_pixel").drop("after"), [0.485, 0.456, 0.406], [0.229, 0.224, 0.225]).withColumn("value", F.round("value", 6))


@query("SELECT tile_id, round(count(*) FILTER (value > 2 AND pred > 2) / (count(*) FILTER (value > 2 OR pred > 2) + 1e-7), 6) AS iou FROM pixel GROUP BY 1", "pixel")
def iou_binary(spark, d):
    p = table(spark, d, "pixel").select("tile_id", (F.col("value") > 2).cast("int").alias("truth"), (F.col("pred") > 2).cast("int").alias("pred"))
    return metrics.binary_iou(p, ["tile_id"]).withColumn("iou", F.round("iou", 6))


@query("""SELECT tile_id, id, round_even(lanes * 5.5::DOUBLE, 2) AS inferred_speed_mph, round_even(lanes * 5.5::DOUBLE * 0.44704::DOUBLE, 2) AS inferred_speed_mps,
  round_even(3600 * (length / 1609.344::DOUBLE / (lanes * 5.5::DOUBLE)), 3) AS travel_time_s FROM feature""", "feature")
def edge_speed_apply(spark, d):
    f = table(spark, d, "feature")
    edges = f.select("tile_id", "id", (F.col("length") / F.lit(1609.344)).alias("length_miles"))
    speeds = f.where("lanes IS NOT NULL").select("tile_id", "id", (F.col("lanes") * F.lit(5.5)).alias("speed_mph"))
    return conflate.apply_speeds(edges, speeds, ["tile_id", "id"]).drop("length_miles")


@query("SELECT image_id, object, wkt_pix, flooded, CASE WHEN object = 'Road' AND length_m > 0 THEN length_m ELSE 0 END::DOUBLE AS length_m, CASE WHEN object = 'Road' THEN travel_time_s ELSE 0 END::DOUBLE AS travel_time_s FROM submission", "submission")
def union_per_tile(spark, d):
    rows = table(spark, d, "submission")
    roads = rows.where("object = 'Road'").withColumn("length_m", F.when(F.col("length_m") > 0, F.col("length_m")))
    buildings = rows.where("object = 'Building'").drop("length_m", "travel_time_s")
    return features.joined_submission(roads, buildings, ["image_id", "object", "wkt_pix", "flooded", "length_m", "travel_time_s"], ["length_m", "travel_time_s"])


@query("SELECT round(100 * count(*) FILTER (flooded) / count(*), 6) AS percentage FROM submission", "submission")
def join_and_filter(spark, d):
    rows = table(spark, d, "submission")
    both = features.joined_submission(rows.where("object = 'Road'"), rows.where("object = 'Building'"), ["image_id", "flooded"], [])
    return features.flooded_percentage(both).withColumn("percentage", F.round("percentage", 6))


@query(_SEGMENTS + " SELECT line_id, pos, CAST(x AS BIGINT) * 10000 + CAST(y AS BIGINT) AS here, (CAST(x AS BIGINT) * 10000 + CAST(y AS BIGINT)) * 100000000 + CAST(x2 AS BIGINT) * 10000 + CAST(y2 AS BIGINT) AS pair FROM seg WHERE x2 IS NOT NULL", "vertex")
def point_pair_keys(spark, d):
    by = Window.partitionBy("line_id").orderBy("pos")
    v = table(spark, d, "vertex").withColumn("here", geom.point_key(F.col("x"), F.col("y")))
    v = v.withColumn("next", F.lead("here").over(by)).where("next IS NOT NULL")
    return v.select("line_id", "pos", "here", geom.pair_key(F.col("here"), F.col("next")).alias("pair"))


@query("SELECT id, CASE WHEN id % 15 = 14 THEN 0 ELSE [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 7, 8][id % 15 + 1] END AS class FROM feature", "feature")
def map_speed_values(spark, d):
    value = F.get(F.array(*map(F.lit, [*speed.SPEED_CLASS, 0])), (F.col("id") % 15).cast("int"))
    return table(spark, d, "feature").select("id", speed.speed_class(value).alias("class"))


@query("SELECT length % 40 AS burn_val, arg_max(paved * 10 + id % 7, id) AS speed FROM feature GROUP BY 1", "feature")
def burn_speeds(spark, d):
    keys = table(spark, d, "feature").select("id", (F.col("length") % 40).alias("burn_val"), (F.col("paved") * 10 + F.col("id") % 7).alias("speed"))
    return speed.burn_speeds(keys, "id")


@query("""SELECT id, CAST(CASE WHEN lanes IS NULL OR id % 9 = 0 THEN 6 ELSE 1 + id % 7 END AS INT) AS road_type, CAST(CASE WHEN lanes IS NULL OR id % 9 = 0 THEN 1 ELSE lanes END AS INT) AS lanes,
  CAST(CASE WHEN lanes IS NULL OR id % 9 = 0 THEN 1 ELSE paved END AS INT) AS paved, CAST(CASE WHEN lanes IS NULL OR id % 9 = 0 THEN 2 ELSE 1 + id % 2 END AS INT) AS bridge FROM feature""", "feature")
def road_speed_sn3(spark, d):
    """Every second lane count stands under the cut name; every ninth road has no type."""
    f, i = table(spark, d, "feature"), F.col("id")
    raw = f.select("id", F.when(i % 9 != 0, (1 + i % 7).cast("string")).alias("road_type"), F.when(i % 2 == 0, F.col("lanes")).alias("lane_numbe"), F.when(i % 2 == 1, F.col("lanes")).alias("lane_number"), "paved", (1 + i % 2).alias("bridge_type"))
    return speed.parsed_roads(raw).select("id", "road_type", "lanes", "paved", "bridge")


@query(_SEGMENTS + """, s AS (SELECT *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS l FROM seg WHERE x2 IS NOT NULL)
  SELECT line_id, pos, CAST(greatest(0, least(1299, round_even(x + (l + 20) * ((x2 - x) / l), 0))) AS INT) AS nx, CAST(greatest(0, least(1299, round_even(y + (l + 20) * ((y2 - y) / l), 0))) AS INT) AS ny FROM s WHERE l > 0""", "vertex")
def next_point(spark, d):
    by = Window.partitionBy("line_id").orderBy("pos")
    s = table(spark, d, "vertex").withColumn("x2", F.lead("x").over(by)).withColumn("y2", F.lead("y").over(by)).where("x2 IS NOT NULL")
    return s.withColumn("p", geom.next_point(*(F.col(c) for c in ("x", "y", "x2", "y2")), 20.0)).where("p IS NOT NULL").select("line_id", "pos", F.col("p.x").alias("nx"), F.col("p.y").alias("ny"))


@query(_SEGMENTS + """, s AS (SELECT line_id, pos, x AS x1, y AS y1, x2 - x AS dx, y2 - y AS dy, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS l FROM seg WHERE x2 IS NOT NULL),
  a AS (SELECT *, sum(l) OVER (PARTITION BY line_id ORDER BY pos) - l AS gone, CASE WHEN l > 0 THEN greatest(0, least(1, ((650 - x1) * dx + (650 - y1) * dy) / (l * l))) ELSE 0 END AS t FROM s),
  o AS (SELECT line_id, pos, gone + t * l AS place, sqrt((x1 + t * dx - 650) ** 2 + (y1 + t * dy - 650) ** 2) AS off FROM a)
  SELECT line_id, round(arg_min(place, row(round(off, 9), pos)), 4) AS place FROM o GROUP BY 1""", "vertex")
def line_project(spark, d):
    """Place of each line nearest to the tile's middle."""
    at = geom.project(F.col("points"), F.lit(650.0), F.lit(650.0))
    return lines(spark, d).where(F.size("points") > 1).select("line_id", F.round(at, 4).alias("place"))


@query(""", p AS (SELECT tile_id, band, "row", col, value * (tile_id % 2) AS value FROM band_pixel), k AS (SELECT tile_id, "row", col, sum(value) = 0 AS dark FROM p GROUP BY 1, 2, 3),
  t AS (SELECT tile_id, bool_or(dark) AS any_dark FROM k GROUP BY 1), s AS (SELECT p.*, dark, any_dark FROM p JOIN k USING (tile_id, "row", col) JOIN t USING (tile_id)),
  m AS (SELECT tile_id, band, CASE WHEN bool_or(any_dark) THEN quantile_cont(value, 0.02) FILTER (value <> 0) ELSE quantile_cont(value, 0.02) END AS lo, quantile_cont(value, 0.98) AS hi FROM s GROUP BY 1, 2)
  SELECT tile_id, band, "row", col, CASE WHEN dark THEN 0 ELSE CAST(floor(round(greatest(0, least(1, coalesce((value - lo) / nullif(hi - lo, 0), 0))) * 255, 9)) AS INT) END AS value FROM s JOIN m USING (tile_id, band)""", "band_pixel")
def minmax_normalize(spark, d):
    """Tiles of even number are dark."""
    return pixels.minmax_normalize(table(spark, d, "band_pixel").drop("after").withColumn("value", F.col("value") * (F.col("tile_id") % 2)))


@query(""", o AS (SELECT tile_id, prob, row_number() OVER (PARTITION BY tile_id ORDER BY prob) - 1 AS k FROM pixel),
  m AS (SELECT tile_id, coalesce(min(prob) FILTER (k >= 100), max(prob)) AS mark FROM o GROUP BY 1) SELECT tile_id, "row", col, prob FROM pixel JOIN m USING (tile_id) WHERE prob < greatest(60, mark)""", "pixel")
def ohem_topk(spark, d):
    return pixels.hard_pixels(table(spark, d, "pixel").select("tile_id", "row", "col", "prob"), 60, 100, ["tile_id"])


@query(_REACH + " SELECT tile_id, component, count(*) AS n FROM cc GROUP BY 1, 2", "edge")
def connected_set_sizes(spark, d):
    return graph.component_sizes(table(spark, d, "edge"))


@query("SELECT tile_id, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, max(x) - min(x) AS dx, max(y) - min(y) AS dy FROM vertex GROUP BY 1", "vertex")
def graph_extent(spark, d):
    return graph.extent(table(spark, d, "vertex"))


@query(""", h AS (SELECT e.tile_id, e.edge_id, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM edge e LEFT JOIN manifest a ON a.tile_id = e.u LEFT JOIN manifest b ON b.tile_id = e.v),
  s AS (SELECT *, sin(radians(CAST(lat2 - lat1 AS DOUBLE)) / 2) AS s, sin(radians(CAST(lon2 - lon1 AS DOUBLE)) / 2) AS t FROM h)
  SELECT tile_id, edge_id, round(round(coalesce(2 * asin(sqrt(least(1.0, s * s + cos(radians(lat1)) * cos(radians(lat2)) * t * t))) * 6371009, 0), 3), 1) AS length FROM s""", "edge", "manifest")
def edge_lengths(spark, d):
    """Node 0 has no place."""
    e = table(spark, d, "edge").drop("length")
    m = table(spark, d, "manifest").select(F.col("tile_id").alias("node_id"), "lat", "lon").where("node_id < 200")
    nodes = e.select("tile_id").distinct().join(F.broadcast(m))  # at most 200 places, in each of the 16 tiles
    return graph.with_lengths(e, nodes).select("tile_id", "edge_id", F.round("length", 1).alias("length"))


@query("SELECT tile_id, aoi, f.fold FROM manifest, (VALUES (0, 'BUILDING', '1'), (1, 'BUILDING', '2'), (2, 'MACHINERY', '13')) f(fold, p, s) WHERE aoi = p AND starts_with(CAST(tile_id AS VARCHAR), s)", "manifest")
def folds_by_prefix(spark, d):
    folds = spark.createDataFrame([(0, "BUILDING", "1"), (1, "BUILDING", "2"), (2, "MACHINERY", "13")], "fold int, area string, prefix string")
    named = table(spark, d, "manifest").withColumn("name", F.col("tile_id").cast("string"))
    return sampling.prefix_folds(named, folds, "aoi", "name").select("tile_id", "aoi", "fold")


_STROKES = ", st AS (SELECT tile_id, pos AS line_id, x AS x1, y AS y1, x + pos % 41 - 20 AS x2, y + pos % 37 - 18 AS y2 FROM vertex)"


@query(_STROKES + """, w AS (SELECT * FROM st WHERE sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) < 200 AND least(x1, x2, y1, y2) >= 50 AND greatest(x1, x2, y1, y2) < 1250),
  met AS (SELECT DISTINCT a.tile_id, a.line_id FROM w a JOIN st b ON b.tile_id = a.tile_id AND b.line_id <> a.line_id
  AND greatest(a.x1, a.x2) >= least(b.x1, b.x2) AND greatest(b.x1, b.x2) >= least(a.x1, a.x2) AND greatest(a.y1, a.y2) >= least(b.y1, b.y2) AND greatest(b.y1, b.y2) >= least(a.y1, a.y2)
  AND sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) <= 0
  AND sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) <= 0)
  SELECT tile_id, line_id FROM st WHERE line_id NOT IN (SELECT line_id FROM w) OR line_id IN (SELECT line_id FROM met)""", "vertex")
def intersects_self(spark, d):
    p = F.col("pos")
    ends = F.array(geom.point(F.col("x"), F.col("y")), geom.point(F.col("x") + p % 41 - 20, F.col("y") + p % 37 - 18))
    return spatial.without_isolated(table(spark, d, "vertex").select("tile_id", p.alias("line_id"), ends.alias("points"))).select("tile_id", "line_id")


# The queries of road graphs and rasters add themselves.
from geoflow.plans import rasters, roads  # noqa: E402, F401
