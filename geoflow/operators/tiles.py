"""Rasters as one row a tile (tile_id, rows, cols, data): neighbourhood kernels in Arrow batches, a tile at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of the tiles; a tile is the unit that fits a task.
SIDE = 1300


def pack(pixels: DataFrame, side: int) -> DataFrame:
    """Pixel rows as tiles of `side` by `side` bytes; missing pixels are 0."""

    def run(frame):
        import pandas as pd

        a = np.zeros((side, side), "uint8")
        a[frame["row"], frame["col"]] = frame["value"]
        return pd.DataFrame({"tile_id": [frame["tile_id"].iloc[0]], "rows": [side], "cols": [side], "data": [a.tobytes()]})

    kind = pixels.schema["tile_id"].dataType.simpleString()
    return pixels.select("tile_id", "row", "col", "value").groupBy("tile_id").applyInPandas(run, f"tile_id {kind}, rows int, cols int, data binary")


def _each(tiles: DataFrame, schema: str, work: Callable) -> DataFrame:
    """Rows that `work(tile_id, array)` yields for each tile."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = [row for t, r, c, d in zip(frame["tile_id"], frame["rows"], frame["cols"], frame["data"], strict=True) for row in work(t, np.frombuffer(d, "uint8").reshape(r, c))]
            yield pd.DataFrame(out, columns=names)

    return tiles.select("tile_id", "rows", "cols", "data").mapInPandas(run, schema)


def _kind(tiles: DataFrame) -> str:
    return tiles.schema["tile_id"].dataType.simpleString()


def transform(tiles: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Tiles with `kernel` applied to each; also the hook for a model that scores a tile."""

    def work(tile, a):
        b = np.ascontiguousarray(kernel(a)).astype("uint8")
        yield tile, b.shape[0], b.shape[1], b.tobytes()

    return _each(tiles, f"tile_id {_kind(tiles)}, rows int, cols int, data binary", work)


def _pixels(tiles: DataFrame, name: str, work: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """(tile_id, row, col, name) of the arrays that `work` gives for each tile."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                found = work(np.frombuffer(batch.column("data")[k].as_py(), "uint8").reshape(batch.column("rows")[k].as_py(), batch.column("cols")[k].as_py()))
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("tile_id")[k], len(found[0])), *(pa.array(x.astype("int32")) for x in found)], ["tile_id", "row", "col", name])

    return tiles.select("tile_id", "rows", "cols", "data").mapInArrow(run, f"tile_id {_kind(tiles)}, row int, col int, {name} int")


def pixels_of(tiles: DataFrame, zero: bool = False) -> DataFrame:
    """Pixel rows of tiles; zeros only if asked for."""

    def work(a):
        rows, cols = np.indices(a.shape).reshape(2, -1) if zero else np.nonzero(a)
        return rows, cols, a[rows, cols]

    return _pixels(tiles, "value", work)


def _slid(a: np.ndarray, k: int, least: bool) -> np.ndarray:
    before = k // 2
    p = np.pad(a, ((before, k - 1 - before), (before, k - 1 - before)), constant_values=255 if least else 0)
    v = np.lib.stride_tricks.sliding_window_view(p, (k, k))
    return v.min((2, 3)) if least else v.max((2, 3))


def erode(a: np.ndarray, k: int = 3) -> np.ndarray:
    return _slid(a, k, True)


def dilate(a: np.ndarray, k: int = 3) -> np.ndarray:
    return _slid(a, k, False)


def opened(a: np.ndarray, k: int = 5) -> np.ndarray:
    return dilate(erode(a, k), k)


def closed(a: np.ndarray, k: int = 7, times: int = 5) -> np.ndarray:
    for _ in range(times):
        a = erode(dilate(a, k), k)
    return a


def components(mask: np.ndarray, eight: bool = True) -> np.ndarray:
    """Labels from 1 in row order of first pixels; 0 outside. Runs of each row are joined with those above."""
    rows, up = mask.shape[0], []
    labels = np.zeros(mask.shape, "int64")
    reach, last = int(eight), []

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for r in range(rows):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[r].astype(bool).view("int8"), [0]])))
        runs, k = [], 0
        for a, b in edge.reshape(-1, 2).tolist():
            i = len(up)
            up.append(i)
            while k < len(last) and last[k][1] + reach <= a:
                k += 1
            for c, d, j in last[k:]:
                if c >= b + reach:
                    break
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
            runs.append((a, b, i))
            labels[r, a:b] = i + 1
        last = runs
    final = np.array([0, *(root(i) + 1 for i in range(len(up)))])
    kinds, number = np.unique(final, return_inverse=True)
    return (number if kinds[0] == 0 else number + 1)[labels]


def without_small(a: np.ndarray, least: int = 300) -> np.ndarray:
    """Any non-zero as 1, less objects and holes of fewer than `least` pixels."""
    mask = a > 0
    for _ in range(2):  # objects, then holes as objects of the inverse
        labels = components(mask)
        mask = ~(mask & (np.bincount(labels.ravel())[labels] >= least))
    return mask.astype("uint8")


def thin(a: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning of the non-zero pixels."""
    m = np.pad(a > 0, 1)
    while True:
        changed = False
        for step in (0, 1):
            p = [m[1 + dy : m.shape[0] - 1 + dy, 1 + dx : m.shape[1] - 1 + dx] for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
            n = sum(x.astype("int8") for x in p)
            turns = sum((~x & y).astype("int8") for x, y in zip(p, p[1:] + p[:1], strict=True))
            up, right, down, left = p[0], p[2], p[4], p[6]
            free = ~(up & right & down) & ~(right & down & left) if step == 0 else ~(up & right & left) & ~(up & down & left)
            gone = m[1:-1, 1:-1] & (n >= 2) & (n <= 6) & (turns == 1) & free
            if gone.any():
                m[1:-1, 1:-1] &= ~gone
                changed = True
        if not changed:
            return m[1:-1, 1:-1].astype("uint8")


def resized(a: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Bilinear resampling with pixel centres aligned, rounded."""
    y, x = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((rows, a.shape[0]), (cols, a.shape[1])))
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None], x - x0
    top, low = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx, a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype("uint8")


def filled(ring: list, rows: int, cols: int) -> np.ndarray:
    """Pixels whose centre lies in a ring, by even and odd crossings of each row."""
    p = np.asarray(ring, "float64").reshape(-1, 2)
    out = np.zeros((rows, cols), bool)
    y1, y2, x1, x2 = p[:-1, 1], p[1:, 1], p[:-1, 0], p[1:, 0]
    for r in range(max(0, int(np.floor(p[:, 1].min()))) if len(p) else rows, min(rows, int(np.ceil(p[:, 1].max())) if len(p) else 0)):
        y = r + 0.5
        hit = (y1 <= y) != (y2 <= y)
        cross = np.sort(x1[hit] + (y - y1[hit]) * (x2[hit] - x1[hit]) / (y2[hit] - y1[hit]))
        for a, b in cross.reshape(-1, 2):
            out[r, max(0, int(np.ceil(a - 0.5))) : max(0, int(np.ceil(b - 0.5)))] = True
    return out


def _burned(points: list, side: int, radius: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of one shape's pixels."""
    p = np.array([(q["x"], q["y"]) for q in points], "float64").reshape(-1, 2)
    if radius is None:
        return np.nonzero(filled(p, side, side))
    a = np.zeros((side, side), bool)
    for (x1, y1), (x2, y2) in zip(p, p[1:], strict=False):
        r0, r1 = max(0, int(min(y1, y2) - radius)), min(side, int(max(y1, y2) + radius) + 2)
        c0, c1 = max(0, int(min(x1, x2) - radius)), min(side, int(max(x1, x2) + radius) + 2)
        y, x = np.mgrid[r0:r1, c0:c1] + 0.5
        d = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = np.clip(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / d, 0, 1) if d else 0
        a[r0:r1, c0:c1] |= np.hypot(x1 + t * (x2 - x1) - x, y1 + t * (y2 - y1) - y) <= radius
    return np.nonzero(a)


def burned(shapes: DataFrame, side: int = SIDE, radius: float | None = None) -> DataFrame:
    """Pixel rows (tile_id, row, col, value) of shapes (tile_id, seq, value, points): rings filled, or lines of `radius` pixels; a later seq overwrites.

    Each shape is burned by itself; where shapes meet, the greatest seq wins by an aggregate, so that a tile of many
    shapes is no task of its own.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k, points in enumerate(batch.column("points")):
                rows, cols = _burned(points.as_py() or [], side, radius)
                n = len(rows)
                yield pa.RecordBatch.from_arrays([*(pa.repeat(batch.column(c)[k], n) for c in ("tile_id", "seq", "value")), pa.array(rows.astype("int32")), pa.array(cols.astype("int32"))], ["tile_id", "seq", "value", "row", "col"])

    some = shapes.select("tile_id", "seq", "value", "points")
    schema = ", ".join(f"{c} {some.schema[c].dataType.simpleString()}" for c in ("tile_id", "seq", "value"))
    each = some.mapInArrow(run, f"{schema}, row int, col int")
    return each.groupBy("tile_id", "row", "col").agg(F.max_by("value", "seq").alias("value"))


def label_components(tiles: DataFrame, eight: bool = True) -> DataFrame:
    """(tile_id, row, col, label) of the non-zero pixels."""

    def work(a):
        labels = components(a > 0, eight)
        rows, cols = np.nonzero(labels)
        return rows, cols, labels[rows, cols]

    return _pixels(tiles, "label", work)


def outlines(labels: np.ndarray, label: int) -> list[list[tuple[int, int]]]:
    """Closed rings along the pixel edges of a region; the region lies to the right of each."""
    m = np.pad(labels == label, 1)
    after: dict = {}
    for r, c in zip(*(x.tolist() for x in np.nonzero(m)), strict=True):
        y, x = r - 1, c - 1
        for out, a, b in ((m[r - 1, c], (x, y), (x + 1, y)), (m[r, c + 1], (x + 1, y), (x + 1, y + 1)), (m[r + 1, c], (x + 1, y + 1), (x, y + 1)), (m[r, c - 1], (x, y + 1), (x, y))):
            if not out:
                after.setdefault(a, []).append(b)
    rings = []
    while after:
        start = at = min(after, key=lambda p: (p[1], p[0]))
        ring, way = [start], None
        while True:
            ways = after[at]
            turn = lambda b, at=at, way=way: 0 if way is None else {0: 1, 1: 0, -1: 2}[way[0] * (b[1] - at[1]) - way[1] * (b[0] - at[0])]
            to = min(ways, key=turn)  # the right turn first keeps regions that touch in a corner apart
            ways.remove(to)
            if not ways:
                del after[at]
            new = (to[0] - at[0], to[1] - at[1])
            if new == way:
                ring[-1] = to
            else:
                ring.append(to)
            at, way = to, new
            if at == start:
                break
        rings.append(ring)
    return rings


def polygonize(tiles: DataFrame) -> DataFrame:
    """(tile_id, value, label, rings): regions of equal value, joined by sides, with their rings; the outer one comes first."""

    def work(tile, a):
        for value in np.unique(a).tolist():
            labels = components(a == value, eight=False)
            for k in range(1, int(labels.max()) + 1):
                rings = [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in outlines(labels, k)]
                yield tile, value, k, rings

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = [row for t, r, c, d in zip(frame["tile_id"], frame["rows"], frame["cols"], frame["data"], strict=True) for row in work(t, np.frombuffer(d, "uint8").reshape(r, c))]
            yield pd.DataFrame(out, columns=["tile_id", "value", "label", "rings"])

    return tiles.select("tile_id", "rows", "cols", "data").mapInPandas(run, f"tile_id {_kind(tiles)}, value int, label int, rings array<array<struct<x:double,y:double>>>")


def skeleton_lines(tiles: DataFrame) -> DataFrame:
    """(tile_id, line_id, points): the lines of a thinned mask between its ends and crossings; loops begin at any pixel."""

    def work(tile, a):
        on = set(zip(*(x.tolist() for x in np.nonzero(a)), strict=True))
        near = {p: [q for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (q := (p[0] + dy, p[1] + dx)) in on] for p in on}
        knots = {p for p, q in near.items() if len(q) != 2}
        seen, lines = set(), []

        def walk(p, q):
            line = [p, q]
            while line[-1] not in knots and line[-1] != p:
                step = next((x for x in near[line[-1]] if x != line[-2]), None)
                if step is None:
                    break
                line.append(step)
            return line

        for p in sorted(knots):
            for q in near[p]:
                if (p, q) not in seen:
                    line = walk(p, q)
                    seen.add((line[-1], line[-2]))
                    lines.append(line)
                seen.add((p, q))
        rest = on - knots - {p for line in lines for p in line}
        while rest:
            line = walk(start := min(rest), near[start][0])
            lines.append(line)
            rest -= set(line)
        for k, line in enumerate(lines):
            yield tile, k, [{"x": float(c), "y": float(r)} for r, c in line]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = [row for t, r, c, d in zip(frame["tile_id"], frame["rows"], frame["cols"], frame["data"], strict=True) for row in work(t, np.frombuffer(d, "uint8").reshape(r, c))]
            yield pd.DataFrame(out, columns=["tile_id", "line_id", "points"])

    return tiles.select("tile_id", "rows", "cols", "data").mapInPandas(run, f"tile_id {_kind(tiles)}, line_id int, points array<struct<x:double,y:double>>")


def simplified(lines: DataFrame, epsilon: float = 1.0) -> DataFrame:
    """Lines (tile_id, line_id, points) by Douglas-Peucker."""
    from geoflow.functions.geom import POINTS, rdp

    @F.pandas_udf(POINTS)
    def short(points):
        import pandas as pd

        return pd.Series([None if p is None else [{"x": x, "y": y} for x, y in rdp([(q["x"], q["y"]) for q in p], epsilon)] for p in points])

    return lines.withColumn("points", short("points"))
