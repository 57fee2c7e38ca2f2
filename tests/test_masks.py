"""Building channels, floods, halos and mosaics against plain loops."""

import numpy as np
import pytest

from geoflow.operators import masks, tiles

RNG = np.random.default_rng(2)


def several(labels, r, c, reach):
    part = labels[max(0, r - reach) : r + reach + 1, max(0, c - reach) : c + reach + 1]
    return len(set(part[part > 0].tolist())) > 1


@pytest.mark.parametrize("seed", range(3))
def test_building_channels(seed):
    rng = np.random.default_rng(seed)
    labels = np.where(rng.random((20, 25)) < 0.4, rng.integers(1, 6, (20, 25)), 0).astype("int32")
    inside, border, contact = masks.building_channels(labels, 3, 9)
    assert (inside == (labels > 0)).all()
    for r in range(20):
        for c in range(25):
            part = labels[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2]
            assert border[r, c] == bool(labels[r, c] > 0 and (part != labels[r, c]).any())
            assert contact[r, c] == several(labels, r, c, 1 if labels[r, c] else 3)


def test_floods_meet_in_a_line():
    labels = np.zeros((5, 9), "int32")
    labels[2, 0], labels[2, 8] = 7, 9
    out = masks.flooded(labels, np.ones((5, 9), bool))
    assert (out[:, :4] == 7).all() and (out[:, 5:] == 9).all() and not out[:, 4].any()
    half = np.ones((5, 9), bool)
    half[:, 3] = False
    out = masks.flooded(labels, half)
    assert (out[:, :3] == 7).all() and not out[:, 3].any() and (out[:, 4:] == 9).all()
    assert (masks.flooded(labels, labels > 0) == labels).all()


def lattice(spark, a, side):
    """Pixel rows of a raster cut into tiles."""
    rows = [(c // side, r // side, r % side, c % side, int(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1]) if a[r, c]]
    return spark.createDataFrame(rows, "tx long, ty long, row int, col int, value int")


def test_components_of_many_tiles_are_those_of_one_raster(spark):
    a = (RNG.random((30, 40)) < 0.45).astype("uint8")
    a[10, :] = 1  # one that runs through all tiles of a row
    whole = tiles.components(a > 0)
    got = {(r["ty"] * 10 + r["row"], r["tx"] * 10 + r["col"]): r["component"] for r in masks.components_across(lattice(spark, a, 10), 10).collect()}
    assert got.keys() == set(zip(*(x.tolist() for x in np.nonzero(a)), strict=True))
    names = {}
    for (r, c), name in got.items():
        names.setdefault(whole[r, c], set()).add(name)
    assert all(len(n) == 1 for n in names.values()) and len({next(iter(n)) for n in names.values()}) == len(names) == whole.max()
    first = np.argwhere(whole == 1)[0].tolist()
    assert names[1] == {(first[0] << 31) + first[1]}


def test_halo(spark):
    a = RNG.integers(1, 99, (24, 24))
    rows = masks.halo(lattice(spark, a, 8), 8, 2).collect()
    for tx in range(3):
        for ty in range(3):
            mine = {(r["row"], r["col"]): r["value"] for r in rows if (r["tx"], r["ty"]) == (tx, ty)}
            want = {(r - ty * 8, c - tx * 8): int(a[r, c]) for r in range(max(0, ty * 8 - 2), min(24, ty * 8 + 10)) for c in range(max(0, tx * 8 - 2), min(24, tx * 8 + 10))}
            assert mine == want


def test_mosaics_close_the_joint(spark):
    a = RNG.integers(1, 99, (16, 16))
    a[:, 7] = 0
    a[8, 3] = 0
    got = np.zeros((12, 12), int)
    for r in masks.mosaics(lattice(spark, a, 8), 8, 12, 2).collect():
        assert (r["mx"], r["my"]) == (0, 0)
        got[r["row"], r["col"]] = r["value"]
    want = a.copy()
    want[:, 7] = a[:, 5]  # column beside the middle with zeros
    want[8, :] = a[10, :]  # then a row
    assert (got == want[2:14, 2:14]).all()


def test_burned_shapes_overwrite_by_order(spark):
    ring = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    rows = [(1, 2, 20, ring(2.0, 2.0, 5.0)), (1, 1, 10, ring(4.0, 4.0, 5.0)), (1, 3, 30, []), (1, 4, 40, None)]
    df = spark.createDataFrame(rows, "tile_id long, seq int, value int, points array<struct<x:double,y:double>>")
    got = {(r["row"], r["col"]): r["value"] for r in tiles.burned(df, 12).collect()}
    assert got == {(r, c): 10 for r in range(4, 9) for c in range(4, 9)} | {(r, c): 20 for r in range(2, 7) for c in range(2, 7)}
