"""Operators against hand-made cases and plain versions."""

import heapq
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoflow.functions import coords, geom, speed
from geoflow.operators import conflate, features, graph, metrics, pixels, sampling, spatial, tiles
from geoflow.sources import files
from geoflow.streaming import arrivals

LINES = "tile_id int, line_id int, points array<struct<x:double,y:double>>"


# Two line graphs whose scores are known.
def test_length_score_golden(spark):
    loop = [(1, 1), (3, 1), (5, 1), (5, 3), (5, 4), (3, 4), (3, 1)]
    cut = [(1, 1), (3, 1), (5, 1), (5, 3), (5, 4), (3, 4)]
    a = spark.createDataFrame([(1, 1, [(float(x), float(y)) for x, y in loop])], LINES)
    b = spark.createDataFrame([(1, 1, [(float(x), float(y)) for x, y in cut]), (1, 2, [(1.0, 2.0), (1.0, 3.0)])], LINES)
    assert metrics.length_apls(a, b, 0.5).first()["score"] == pytest.approx(1.0)
    assert metrics.length_apls(b, a, 0.5).first()["score"] == pytest.approx(0.2777777777777778)
    assert metrics.length_apls(a, b.where("tile_id = 2"), 0.5).first()["score"] == 0.0


def _edges(spark, n=40, m=50, seed=1):
    rng = random.Random(seed)
    return [(1, i, rng.randrange(n), rng.randrange(n), float(rng.randint(1, 9))) for i in range(m)]


def test_paths_and_components(spark):
    rows = _edges(spark)
    df = spark.createDataFrame(rows, "tile_id int, edge_id int, u int, v int, length double")
    near = {}
    for _, _, u, v, w in rows:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    want = {}
    for s in near:
        best, todo = {s: 0.0}, [(0.0, s)]
        while todo:
            d, x = heapq.heappop(todo)
            for y, w in near[x] if d <= best[x] else []:
                if d + w < best.get(y, 1e9):
                    best[y] = d + w
                    heapq.heappush(todo, (d + w, y))
        want |= {(s, y): d for y, d in best.items()}
    nodes = spark.createDataFrame([(1, x) for x in near], "tile_id int, node_id int")
    got = {(r["source"], r["node_id"]): r["length"] for r in graph.shortest_paths(df, nodes).collect()}
    assert got == want
    least = {r["node_id"]: r["component"] for r in graph.node_components(df.where("u <> v")).collect()}
    assert all(least.get(x, x) == min(y for (s, y) in want if s == x) for x in near)


def test_simplify_keeps_length_and_joins_chains(spark):
    df = spark.createDataFrame([(1, 1, 1, 2, 1.0), (1, 2, 2, 3, 2.0), (1, 3, 3, 4, 3.0), (1, 4, 3, 5, 1.0), (2, 1, 1, 2, 1.0), (2, 2, 2, 3, 1.0), (2, 3, 3, 1, 1.0)], "tile_id int, edge_id int, u int, v int, length double")
    got = {(r["tile_id"], r["edge_id"]): (r["u"], r["v"], r["length"], r["n_edges"]) for r in graph.simplify(df).collect()}
    assert got == {(1, 1): (1, 3, 3.0, 2), (1, 3): (3, 4, 3.0, 1), (1, 4): (3, 5, 1.0, 1), (2, 1): (1, 1, 3.0, 3)}


def test_greedy_pairs_equal_a_walk(spark):
    rng = random.Random(3)
    rows = [(1, f"a{a}", f"b{b}", float(rng.randint(1, 20))) for a, b in itertools.product(range(8), range(8)) if rng.random() < 0.5]
    used, want = set(), set()
    for _, a, b, d in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b, d))
    got = spatial.greedy_pairs(spark.createDataFrame(rows, "tile_id int, a string, b string, distance double"))
    assert {(r["a"], r["b"], r["distance"]) for r in got.collect()} == want


def test_components_kernel_equals_flood_fill():
    rng = np.random.default_rng(0)
    for eight in (True, False):
        a = rng.random((25, 30)) < 0.5
        got, seen, k = tiles.components(a, eight), np.zeros(a.shape, int), 0
        for p in zip(*np.nonzero(a), strict=True):
            if not seen[p]:
                k, todo = k + 1, [p]
                while todo:
                    y, x = todo.pop()
                    if 0 <= y < 25 and 0 <= x < 30 and a[y, x] and not seen[y, x]:
                        seen[y, x] = k
                        todo += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if eight or not (dy and dx)]
        assert (got == seen).all()


def test_outlines_give_the_region_back():
    rng = np.random.default_rng(1)
    labels = tiles.components(rng.random((12, 12)) < 0.6, eight=False)
    for k in range(1, labels.max() + 1):
        area = sum(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(r, r[1:], strict=False)) / 2 for r in tiles.outlines(labels, k))
        assert area == (labels == k).sum()


def test_kernels():
    a = np.zeros((9, 9), "uint8")
    a[2:7, 2:7] = 1
    assert (tiles.opened(a, 3) == a).all() and (tiles.closed(a, 3, 2) == a).all()
    assert tiles.without_small(a, 26).sum() == 0 and tiles.without_small(a, 25).sum() == 25
    assert 0 < tiles.thin(a).sum() < 10
    assert (tiles.resized(a, 9, 9) == a).all()
    assert tiles.filled([(2, 2), (7, 2), (7, 7), (2, 7), (2, 2)], 9, 9).sum() == 25


def test_lines_and_utm(spark):
    row = spark.createDataFrame([(1, 1, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)])], LINES)
    p = F.col("points")
    east, north = coords.utm(F.lit(52.0), F.lit(5.0), F.lit(31))
    r = row.select(geom.line_length(p).alias("n"), geom.interpolate(p, F.lit(15.0)).alias("at"), geom.cut_line(p, F.lit(10.0)).alias("cut"), geom.spaced_points(p, 5.0).alias("some"), east.alias("e"), north.alias("m")).first()
    assert r["n"] == 20 and tuple(r["at"]) == (10, 5)
    assert [[tuple(q) for q in part] for part in r["cut"]] == [[(0, 0), (10, 0)], [(10, 0), (10, 10)]]
    assert len(r["some"]) == 4
    assert (r["e"], r["m"]) == pytest.approx(_utm_by_powers(52.0, 2.0), abs=0.02)


def _utm_by_powers(lat, d):
    """UTM of a place `d` degrees east of the middle, by powers of the longitude and a summed meridian arc."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    phi, t = np.radians(lat), np.tan(np.radians(lat)) ** 2
    c, x = e2 / (1 - e2) * np.cos(phi) ** 2, np.radians(d) * np.cos(phi)
    n = a / np.sqrt(1 - e2 * np.sin(phi) ** 2)
    s = np.linspace(0, phi, 200001)
    g = a * (1 - e2) / (1 - e2 * np.sin(s) ** 2) ** 1.5
    arc = ((g[1:] + g[:-1]) / 2 * np.diff(s)).sum()
    q = e2 / (1 - e2)
    east = n * (x + (1 - t + c) * x**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * q) * x**5 / 120)
    north = arc + n * np.tan(phi) * (x**2 / 2 + (5 - t + 9 * c + 4 * c * c) * x**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * q) * x**6 / 720)
    return 500000 + 0.9996 * east, 0.9996 * north


def test_rdp():
    assert geom.rdp([(0, 0), (1, 0.1), (2, 0), (3, 5)], 1.0) == [[0, 0], [2, 0], [3, 5]]
    assert geom.rdp([], 1.0) == []


def test_empty_tables_and_nulls(spark):
    none = spark.createDataFrame([], "image_id int, object string, wkt_pix string, flooded boolean, length_m double, travel_time_s double")
    assert conflate.tile_hysteresis(none).count() == 0
    names = spark.createDataFrame([(1,), (2,)], "image_id int")
    got = features.assemble_submission(none, none, names)
    assert sorted((r["image_id"], r["wkt_pix"], r["flooded"]) for r in got.collect()) == [(i, w, False) for i in (1, 2) for w in ("LINESTRING EMPTY", "POLYGON EMPTY")]
    odd = spark.createDataFrame([(None, None, 1), ("motorway", 13, 1), ("footway", 2, 2), ("Track", 2, 2)], "highway string, lanes int, paved int")
    speeds = speed.add_road_speed(odd.withColumn("road_type", speed.road_type(F.col("highway"))))
    assert sorted(r["inferred_speed_mph"] for r in speeds.collect()) == [-1, -1, -1, 15]


def test_hysteresis_thresholds(spark):
    rows = [(t, "o", f"{t}-{i}", i < wet, 0.0, 0.0) for t, wet in ((1, 4), (2, 5), (3, 7)) for i in range(10)]
    df = spark.createDataFrame(rows, "image_id int, object string, wkt_pix string, flooded boolean, length_m double, travel_time_s double")
    got = {r["image_id"]: r["n"] for r in conflate.tile_hysteresis(df).groupBy("image_id").agg(F.sum(F.col("flooded").cast("int")).alias("n")).collect()}
    assert got == {1: 0, 2: 5, 3: 10}


def test_splits(spark):
    rows = spark.range(20).select(F.col("id").alias("tile_id"))
    parts = sampling.random_split(rows, "tile_id", 0.15).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"val": 4, "train": 16}
    assert sampling.random_split(rows, "tile_id", 0.0).where("part = 'val'").count() == 0
    numbers = features.numbered(rows, ["tile_id"], "k").orderBy("tile_id").collect()
    assert [r["k"] for r in numbers] == list(range(1, 21))


def test_crops_cover(spark):
    assert pixels.offsets(10, 4, 3) == [0, 3, 6] and pixels.offsets(11, 4, 3) == [0, 3, 6, 7] and pixels.offsets(3, 4, 2) == [0]


def test_files(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"highway":"track","lanes":2},"geometry":{"type":"LineString","coordinates":[[1,2,9],[3,4,9]]}},{"type":"Feature","properties":{"building":"yes"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}')
    (tmp_path / "b.geojson").write_text("{not json")
    df = files.read_geojson(spark, str(tmp_path))
    assert df.count() == 2
    assert [tuple(p) for p in files.line_points(df).first()["points"]] == [(1, 2), (3, 4)]
    assert len(files.ring_points(df).first()["points"]) == 4
    assert features.with_properties(df).where("highway = 'track'").first()["lanes"] == "2"
    rows = spark.createDataFrame([("t", "Road", "LINESTRING (1.0 2.0, 3.0 4.0)", True, 1.5, 2.5), ("u", "Road", "LINESTRING EMPTY", None, 0.0, 0.0)], "image_id string, object string, wkt_pix string, flooded boolean, length_m double, travel_time_s double")
    files.write_submission(rows, str(tmp_path / "out"))
    back = {r["image_id"]: r for r in files.read_wkt_table(spark, str(tmp_path / "out")).collect()}
    assert back["t"]["flooded"] is True and back["u"]["flooded"] is None and len(back["t"]["points"]) == 2 and back["u"]["points"] == []
    scores = files.with_means(spark.createDataFrame([("a", 1.0), ("b", 3.0)], "tile_id string, s double"))
    assert {r["tile_id"]: r["s"] for r in scores.collect()} == {"a": 1, "b": 3, "means": 2, "stds": 1}


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, True), (1, False), (2, True)], "tile_id int, flooded boolean")
    rows.write.parquet(str(tmp_path / "in"))
    q = arrivals.each_batch(arrivals.arriving(spark, str(tmp_path / "in"), "tile_id int, flooded boolean"), lambda df: conflate.tile_vote(df, 0.4, tile="tile_id"), str(tmp_path / "out"), str(tmp_path / "at"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).where("flooded").count() == 3


def test_topology_and_lovasz(spark):
    t = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 10.0, 0.0)], "tile_id int, id int, x double, y double")
    p = spark.createDataFrame([(1, 7, 1.0, 0.0), (1, 8, 0.5, 0.0)], "tile_id int, id int, x double, y double")
    r = metrics.topology(t, p, 2.0).first()
    assert (r["tp"], r["fp"], r["fn"], r["f1"]) == (1, 1, 1, 0.5)
    rng = np.random.default_rng(2)
    truth, prob = rng.integers(0, 2, 30), rng.random(30).round(1)
    e = np.abs(truth - prob)
    order = np.argsort(-e)
    tt = truth[order]
    j = 1 - (tt.sum() - tt.cumsum()) / (tt.sum() + (1 - tt).cumsum())
    want = (e[order] * np.diff(np.concatenate([[0], j]))).sum()
    got = metrics.lovasz(spark.createDataFrame([(1, int(a), float(b)) for a, b in zip(truth, prob, strict=True)], "tile_id int, truth int, prob double"), ["tile_id"]).first()["lovasz"]
    assert got == pytest.approx(want)


def test_speed_classes(spark):
    from pyspark.errors import PySparkException

    got = spark.createDataFrame([(0,), (15,), (26,), (65,), (None,)], "v int").select(speed.speed_class(F.col("v")).alias("c"))
    assert [r.c for r in got.collect()] == [0, 1, 3, 8, None]
    with pytest.raises(PySparkException, match="no class for speed 16"):
        spark.createDataFrame([(16,)], "v int").select(speed.speed_class(F.col("v")).alias("c")).collect()


def test_next_point_and_place_on_line(spark):
    one = spark.range(1)
    far = lambda *p: one.select(geom.next_point(*map(F.lit, p), 20.0).alias("p")).first().p
    assert tuple(far(0.0, 0.0, 0.0, 10.0)) == (0, 30)
    assert tuple(far(100.0, 5.0, 50.0, 5.0)) == (30, 5)
    assert tuple(far(10.0, 0.0, 1295.0, 0.0)) == (1299, 0)
    assert far(3.0, 3.0, 3.0, 3.0) is None
    line = F.array(*(geom.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (10, 0), (10, 10))))
    at = lambda x, y: one.select(geom.project(line, F.lit(x), F.lit(y)).alias("d")).first().d
    assert [at(4.0, 3.0), at(-5.0, 0.0), at(12.0, 6.0), at(10.0, 50.0), at(5.0, 5.0)] == [4.0, 0.0, 16.0, 20.0, 5.0]
    assert one.select(geom.project(F.slice(line, 1, 1), F.lit(1.0), F.lit(1.0)).alias("d")).first().d is None


def test_isolated_lines_go(spark):
    rows = [
        (1, 1, [(100, 100), (150, 100)]),  # alone
        (1, 2, [(300, 300), (350, 350)]),  # crosses 3
        (1, 3, [(300, 350), (350, 300)]),
        (1, 4, [(600, 600), (900, 600)]),  # long
        (1, 5, [(10, 700), (60, 700)]),  # at the border
        (1, 6, [(800, 600), (800, 650)]),  # touches 4
        (2, 7, [(100, 100), (150, 100)]),  # like 1, in another tile
        (3, 8, [(500, 500), (520, 500)]),  # on one line with 9, without a common point
        (3, 9, [(521, 500), (540, 500)]),
    ]
    df = spark.createDataFrame([(t, i, [(float(x), float(y)) for x, y in p]) for t, i, p in rows], f"tile_id int, line_id int, points {geom.POINTS}")
    assert sorted(r.line_id for r in spatial.without_isolated(df).collect()) == [2, 3, 4, 5, 6]
    assert spatial.without_isolated(df.where("false")).count() == 0


def test_stretch_and_hard_pixels(spark):
    px = spark.createDataFrame([(1, 0, c, b, v) for c in range(4) for b, v in ((0, c * 10), (1, 7 if c else 0))], "tile_id int, row int, col int, band int, value int")
    got = {(r.band, r.col): r.value for r in pixels.minmax_normalize(px, 0.0).collect()}
    assert [got[0, c] for c in range(4)] == [0, 0, 127, 255]  # the dark pixel stays, the least other value becomes 0
    assert [got[1, c] for c in range(4)] == [0, 0, 0, 0]  # a band of one value
    p = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.1, 0.2, 0.2, 0.2, 0.9])], "tile_id int, id int, prob double")
    ids = lambda t, k: sorted(r.id for r in pixels.hard_pixels(p, t, k, ["tile_id"]).collect())
    assert ids(0.0, 1) == [0]
    assert ids(0.5, 1) == [0, 1, 2, 3]
    assert ids(0.0, 99) == [0, 1, 2, 3]


def test_older_road_columns(spark):
    df = spark.createDataFrame([("3", None, 2, 1, 1), ("3", "4", 2, 1, 1), (None, "4", 2, 1, 1)], "road_type string, lane_numbe string, lane_number int, paved int, bridge_type int")
    got = [tuple(r) for r in speed.parsed_roads(df).select("road_type", "lanes", "paved", "bridge").collect()]
    assert got == [(3, 2, 1, 1), (3, 4, 1, 1), (6, 1, 1, 2)]
