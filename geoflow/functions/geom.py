"""Lines and rings as arrays of points (x, y): codecs, measures, cuts, all as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"
EMPTY_LINE, EMPTY_POLYGON = "LINESTRING EMPTY", "POLYGON EMPTY"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def parse_wkt(wkt: Column) -> Column:
    """Points of a LINESTRING, or of the first ring of a POLYGON; EMPTY has none, a third coordinate goes."""
    first = F.regexp_extract(wkt, r"\(+\s*([^()]*)\)", 1)
    pairs = F.filter(F.split(first, r"\s*,\s*"), lambda p: F.trim(p) != "")
    return F.transform(pairs, lambda p: point(F.get(F.split(F.trim(p), r"\s+"), F.lit(0)), F.get(F.split(F.trim(p), r"\s+"), F.lit(1))))


def line_wkt(points: Column, digits: int = 1) -> Column:
    """LINESTRING text with fixed digits; fewer than two points are EMPTY."""
    text = F.array_join(F.transform(points, lambda p: F.format_string(f"%.{digits}f %.{digits}f", p["x"], p["y"])), ", ")
    return F.when(F.size(points) >= 2, F.concat(F.lit("LINESTRING ("), text, F.lit(")"))).otherwise(EMPTY_LINE)


def polygon_wkt(points: Column, digits: int = 1) -> Column:
    """POLYGON text of one ring; fewer than four points are EMPTY."""
    text = F.array_join(F.transform(points, lambda p: F.format_string(f"%.{digits}f %.{digits}f", p["x"], p["y"])), ", ")
    return F.when(F.size(points) >= 4, F.concat(F.lit("POLYGON (("), text, F.lit("))"))).otherwise(EMPTY_POLYGON)


def segments(points: Column) -> Column:
    """(x1, y1, x2, y2) of each pair of consecutive points."""
    n = F.size(points)
    pair = lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    return F.when(n >= 2, F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), pair)).otherwise(F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))


def _length(s: Column) -> Column:
    return F.sqrt((s["x2"] - s["x1"]) * (s["x2"] - s["x1"]) + (s["y2"] - s["y1"]) * (s["y2"] - s["y1"]))


def line_length(points: Column) -> Column:
    """Sum of the segments; 0 for fewer than two points."""
    return F.aggregate(segments(points), F.lit(0.0), lambda total, s: total + _length(s))


def ring_area(points: Column) -> Column:
    """Area in a closed ring, by the shoelace sum."""
    return F.abs(F.aggregate(segments(points), F.lit(0.0), lambda total, s: total + s["x1"] * s["y2"] - s["x2"] * s["y1"])) / 2


def polygon_area(rings: Column) -> Column:
    """Area of a polygon of closed rings: the first less the others, its holes; 0 without rings."""
    holes = F.aggregate(F.slice(rings, 2, 1 << 30), F.lit(0.0), lambda total, ring: total + ring_area(ring))
    return F.when(F.size(rings) > 0, ring_area(F.get(rings, F.lit(0))) - holes).otherwise(0.0)


def midpoints(points: Column) -> Column:
    """(x, y, length) of each segment; middles are rounded half to even."""
    return F.transform(segments(points), lambda s: F.struct(F.bround((s["x1"] + s["x2"]) / 2).alias("x"), F.bround((s["y1"] + s["y2"]) / 2).alias("y"), _length(s).alias("length")))


def without_repeats(points: Column) -> Column:
    """`points` less those equal to the one before."""
    return F.filter(points, lambda p, i: (i == 0) | ~(p == F.get(points, i - 1)))


def without_closing_point(points: Column) -> Column:
    """A line of three points that ends where it began loses its last point."""
    return F.when((F.size(points) == 3) & (F.get(points, F.lit(0)) == F.get(points, F.lit(2))), F.slice(points, 1, 2)).otherwise(points)


def angle(x0: Column, y0: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Signed degrees between p1->p0 and p1->p2."""
    ax, ay, bx, by = x0 - x1, y0 - y1, x2 - x1, y2 - y1
    return F.degrees(F.atan2(ax * by - ay * bx, ax * bx + ay * by))


def point_line_distance(x: Column, y: Column, s: Column) -> Column:
    """Signed distance to the endless line through segment `s`."""
    return ((s["x2"] - s["x1"]) * (s["y1"] - y) - (s["x1"] - x) * (s["y2"] - s["y1"])) / _length(s)


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a segment; one of no length is its point."""
    dx, dy = x2 - x1, y2 - y1
    d = dx * dx + dy * dy
    t = F.when(d > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / d))).otherwise(0.0)
    px, py = x1 + t * dx - x, y1 + t * dy - y
    return F.sqrt(px * px + py * py)


def interpolate(points: Column, distance: Column) -> Column:
    """The point at `distance` along a line; its ends beyond them."""
    start = F.struct(F.lit(0.0).alias("gone"), F.lit(None).cast("struct<x:double,y:double>").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        d = _length(s)
        t = (distance - acc["gone"]) / d
        here = F.when(d > 0, point(s["x1"] + t * (s["x2"] - s["x1"]), s["y1"] + t * (s["y2"] - s["y1"])))
        return F.struct((acc["gone"] + d).alias("gone"), F.coalesce(acc["at"], F.when(distance <= acc["gone"] + d, here)).alias("at"))

    inside = F.aggregate(segments(points), start, step, lambda acc: acc["at"])
    return F.when(distance <= 0, F.get(points, F.lit(0))).otherwise(F.coalesce(inside, F.get(points, F.size(points) - 1)))


def cut_line(points: Column, distance: Column) -> Column:
    """The line cut in two at `distance`; as it is where that is at or beyond an end. A vertex there is both ends."""
    at = interpolate(points, distance)
    so_far = lambda i: line_length(F.slice(points, 1, i + 1))
    before = F.filter(points, lambda p, i: so_far(i) < distance)
    after = F.filter(points, lambda p, i: so_far(i) > distance)
    return F.when((distance <= 0) | (distance >= line_length(points)), F.array(points)).otherwise(F.array(F.concat(before, F.array(at)), F.concat(F.array(at), after)))


def spaced_points(points: Column, step: float) -> Column:
    """Points along a line: its middle if it is no longer than `step`, else int(length / step) of them, evenly spaced inside."""
    length = line_length(points)
    n = F.greatest(F.lit(1), (length / step).cast("int"))
    return F.transform(F.sequence(F.lit(1), n), lambda i: interpolate(points, length * i / (n + 1)))


def rdp(points: list, epsilon: float = 1.0) -> list:
    """Douglas-Peucker: points of a line that stay; a split needs a distance of at least `epsilon`. A helper for Arrow functions."""
    import numpy as np

    p = np.asarray(points, "float64").reshape(-1, 2)
    keep = np.zeros(len(p), bool)
    keep[[0, -1] if len(p) else []] = True
    todo = [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        v, w = p[b] - p[a], p[a + 1 : b] - p[a]
        size = float(np.hypot(*v))
        d = np.abs(v[0] * w[:, 1] - v[1] * w[:, 0]) / size if size else np.hypot(w[:, 0], w[:, 1])
        k = int(d.argmax())
        if d[k] >= epsilon:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return p[keep].tolist()


def point_key(x: Column, y: Column) -> Column:
    """A whole-number point, with y below 10,000, as one number."""
    return F.floor(x).cast("long") * 10_000 + F.floor(y).cast("long")


def pair_key(a: Column, b: Column) -> Column:
    """Two point keys, each below 100,000,000, as one number: a comes first."""
    return a.cast("long") * 100_000_000 + b.cast("long")


def next_point(x1: Column, y1: Column, x2: Column, y2: Column, add: float, side: int = 1300) -> Column:
    """The pixel `add` beyond the second point on the way from the first, inside a tile; NULL for equal points."""
    length = F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))
    on = lambda a, b: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.bround(a + (length + add) * ((b - a) / length)).cast("int")))
    return F.when(length > 0, F.struct(on(x1, x2).alias("x"), on(y1, y2).alias("y")))


def project(points: Column, x: Column, y: Column) -> Column:
    """How far along a line its place nearest to a point is, the first of equals; NULL for fewer than two points."""
    start = F.struct(F.lit(0.0).alias("gone"), F.lit(None).cast("double").alias("near"), F.lit(None).cast("double").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        d = _length(s)
        t = F.when(d > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - s["x1"]) * (s["x2"] - s["x1"]) + (y - s["y1"]) * (s["y2"] - s["y1"])) / (d * d)))).otherwise(0.0)
        off = segment_distance(x, y, s["x1"], s["y1"], s["x2"], s["y2"])
        nearer = acc["near"].isNull() | (off < acc["near"])
        return F.struct((acc["gone"] + d).alias("gone"), F.when(nearer, off).otherwise(acc["near"]).alias("near"), F.when(nearer, acc["gone"] + t * d).otherwise(acc["at"]).alias("at"))

    return F.aggregate(segments(points), start, step, lambda acc: acc["at"])
