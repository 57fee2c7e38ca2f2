"""Building masks and mosaics: kernels over grids of numbers, a tile at a time, and labels joined across the seams of tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoflow.operators.graph import node_components
from geoflow.operators.shared import written

GRID = "rows int, cols int, data binary"


def grids(pixels: DataFrame, rows: int, cols: int, key: str = "tile_id") -> DataFrame:
    """(key, rows, cols, data): pixel rows (key, row, col, value) as grids of 32-bit numbers, 0 where a pixel is missing. A grid fits a task."""

    def run(table):
        import pyarrow as pa

        a = np.zeros((rows, cols), "int32")
        a[table.column("row").to_numpy(), table.column("col").to_numpy()] = table.column("value").to_numpy()
        return pa.table({key: table.column(key)[:1], "rows": pa.array([rows], pa.int32()), "cols": pa.array([cols], pa.int32()), "data": pa.array([a.tobytes()], pa.binary())})

    kind = pixels.schema[key].dataType.simpleString()
    return pixels.select(key, "row", "col", "value").groupBy(key).applyInArrow(run, f"{key} {kind}, {GRID}")


def pixels_by(tiles: DataFrame, work: Callable[[np.ndarray], dict[str, np.ndarray]], names: list[str], key: str = "tile_id") -> DataFrame:
    """Rows (key, row, col, …names) of the pixels and values that `work` gives for each grid, as arrays."""
    kind = tiles.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                found = work(np.frombuffer(batch.column("data")[k].as_py(), "int32").reshape(batch.column("rows")[k].as_py(), batch.column("cols")[k].as_py()))
                n = len(found["row"])
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(key)[k], n), *(pa.array(found[c].astype("int32")) for c in ("row", "col", *names))], [key, "row", "col", *names])

    return tiles.select(key, "rows", "cols", "data").mapInArrow(run, f"{key} {kind}, row int, col int, " + ", ".join(f"{n} int" for n in names))


def window(a: np.ndarray, size: int, least: bool, beyond: int) -> np.ndarray:
    """Least or greatest value in the square around each pixel; `beyond` stands outside of the grid."""
    r = size // 2
    v = np.lib.stride_tricks.sliding_window_view(np.pad(a, r, constant_values=beyond), (size, size))
    return v.min((2, 3)) if least else v.max((2, 3))


def flooded(labels: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Labels spread in `mask`, a step to the four sides at a time; pixels that two labels come to at once, or that lie
    beside another label, become a line and stay 0."""
    most = np.iinfo("int32").max
    out, line = np.where(mask, labels, 0).astype("int32"), np.zeros(mask.shape, bool)
    while True:
        p = np.pad(out, 1)
        sides = np.stack([p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
        top, low = sides.max(0), np.where(sides > 0, sides, most).min(0)
        open_ = mask & (out == 0) & ~line & (top > 0)
        if not open_.any():
            return out
        line |= open_ & (low != top)
        out = np.where(open_ & (low == top), top, out)


def building_channels(labels: np.ndarray, edge: int = 3, contact: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(footprint, border, contact) of a grid of building numbers.

    Border: building pixels with another label, or none, in the square of `edge` around them, the image's own edge
    aside. Contact: pixels near borders, or near the lines where flooded labels meet, that have two buildings within
    three pixels, or within one if they are of a building.
    """
    most = np.iinfo("int32").max
    inside = labels > 0
    border = inside & ((window(labels, edge, True, most) < labels) | (window(labels, edge, False, 0) > labels))
    wide = window(inside.astype("int32"), contact, False, 0) > 0
    lines = wide & (flooded(labels, wide) == 0)
    near = window((lines | border).astype("int32"), contact, False, 0) > 0
    some = np.where(inside, labels, most)

    def several(r: int) -> np.ndarray:
        low = window(some, 2 * r + 1, True, most)
        return (low < most) & (low != window(labels, 2 * r + 1, False, 0))

    return inside, border, near & np.where(inside, several(1), several(3))


def three_channels(tiles: DataFrame, edge: int = 3, contact: int = 9, key: str = "tile_id") -> DataFrame:
    """(key, row, col, footprint, border, contact) of pixels that have any of them, from grids of building numbers."""

    def work(a):
        channels = building_channels(a, edge, contact)
        rows, cols = np.nonzero(channels[0] | channels[1] | channels[2])
        return {"row": rows, "col": cols} | {n: c[rows, cols] for n, c in zip(("footprint", "border", "contact"), channels, strict=True)}

    return pixels_by(tiles, work, ["footprint", "border", "contact"], key)


def _at(x: Column, side: int) -> Column:
    return F.floor(x / side).cast("long")


def halo(pixels: DataFrame, side: int, width: int) -> DataFrame:
    """Pixel rows (tx, ty, row, col, …) of tiles on a lattice, with strips of `width` from the eight neighbours of each: rows and columns from -width to side + width - 1.

    Only pixels near a border go to other tiles, at most three of them each.
    """
    to = lambda c: F.filter(F.array(F.when(F.col(c) < width, -1), F.lit(0), F.when(F.col(c) >= side - width, 1)), lambda d: d.isNotNull())
    moved = pixels.withColumn("_dx", F.explode(to("col"))).withColumn("_dy", F.explode(to("row")))
    own = {"tx": F.col("tx") + F.col("_dx"), "ty": F.col("ty") + F.col("_dy"), "col": F.col("col") - F.col("_dx") * side, "row": F.col("row") - F.col("_dy") * side}
    out = moved.select(*(own[c].alias(c) if c in own else F.col(c) for c in pixels.columns))
    return out.join(pixels.select("tx", "ty").distinct(), ["tx", "ty"], "left_semi")


def components_across(pixels: DataFrame, side: int) -> DataFrame:
    """(tx, ty, row, col, component) of pixels on a lattice of tiles, joined to all eight sides as if the tiles were one raster.

    Each tile labels its own pixels; labels then meet at the seams, where only the outermost pixels are compared, and are
    united as a graph. A component is named by its first pixel: y * 2^31 + x over the whole lattice.
    """
    from geoflow.operators.tiles import components

    def work(a):
        labels = components(a > 0)
        rows, cols = np.nonzero(labels)
        return {"row": rows, "col": cols, "label": labels[rows, cols]}

    tile = F.struct("tx", "ty").alias("tile")
    local = pixels_by(grids(pixels.select(tile, "row", "col", F.lit(1).alias("value")), side, side, "tile"), work, ["label"], "tile")
    x, y = F.col("tile.tx") * side + F.col("col"), F.col("tile.ty") * side + F.col("row")
    local = written(local.withColumn("x", x.cast("long")).withColumn("y", y.cast("long")), "labels")
    first = local.groupBy("tile", "label").agg(F.min(F.shiftleft(F.col("y"), 31) + F.col("x")).alias("name"))
    named = written(local.join(first, ["tile", "label"]), "named")
    rim = named.where((F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == side - 1) | (F.col("col") == side - 1)).select("tile", "x", "y", "name")
    steps = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1))))).alias("s")
    there = rim.select(F.col("tile").alias("_tile"), "name", steps, "x", "y").select("_tile", F.col("name").alias("u"), (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    links = there.join(rim.withColumnRenamed("name", "v"), ["x", "y"]).where("_tile <> tile AND u <> v").select("u", "v").distinct()
    of = node_components(links.select(F.lit(0).alias("tile_id"), "u", "v")).select(F.col("node_id").alias("name"), "component")
    out = named.join(of, "name", "left")
    return out.select("tile.tx", "tile.ty", "row", "col", F.coalesce("component", "name").alias("component"))


def without_gap(a: np.ndarray, rows: int, cols: int, width: int = 5) -> np.ndarray:
    """A mosaic of four with the black joint closed: columns beside the middle that hold a 0 take the column `width` away, then rows as well."""
    before, out = a.copy(), a.copy()
    for axis, middle in ((1, cols), (0, rows)):
        for k in range(width):
            for at, source in ((middle + k, middle + width), (middle - k - 1, middle - width - 1)):
                line = (slice(None), at) if axis else (at, slice(None))
                if out[line].min() <= 0:
                    out[line] = before[(slice(None), source) if axis else (source, slice(None))]
    return out


def mosaics(pixels: DataFrame, side: int, cut: int, width: int = 5) -> DataFrame:
    """(mx, my, row, col, value) of the mosaics of two by two tiles (tx, ty, row, col, value) on a lattice: the middle `cut` by `cut` pixels, the joint closed.

    A mosaic is named by its upper left tile; those that lack a tile are left out. Zeros are given too.
    """
    shift = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)))).alias("s")
    all_tiles = pixels.select("tx", "ty").distinct()
    whole = all_tiles.select(F.col("tx"), F.col("ty"), shift).groupBy((F.col("tx") - F.col("s.dx")).alias("mx"), (F.col("ty") - F.col("s.dy")).alias("my")).agg(F.count(F.lit(1)).alias("n")).where("n = 4")
    moved = pixels.select("tx", "ty", "row", "col", "value", shift)
    name = F.struct((F.col("tx") - F.col("s.dx")).alias("mx"), (F.col("ty") - F.col("s.dy")).alias("my")).alias("m")
    rows = moved.select(name, (F.col("row") + F.col("s.dy") * side).alias("row"), (F.col("col") + F.col("s.dx") * side).alias("col"), "value")
    rows = rows.join(whole.select(F.struct("mx", "my").alias("m")), "m", "left_semi")
    start = side - cut // 2

    def work(a):
        b = without_gap(a, side, side, width)[start : start + cut, start : start + cut]
        r, c = (x.ravel() for x in np.indices(b.shape))
        return {"row": r, "col": c, "value": b.ravel()}

    out = pixels_by(grids(rows, 2 * side, 2 * side, "m"), work, ["value"], "m")
    return out.select("m.mx", "m.my", "row", "col", "value")
