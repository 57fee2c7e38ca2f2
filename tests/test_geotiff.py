"""GeoTIFF files made by hand, and round trips through Spark."""

import struct

import numpy as np
import pytest

from geoflow.sources import geotiff

TYPE = {"H": 3, "I": 4, "d": 12, "Q": 16}


def lzw(data):
    """TIFF's LZW, written plainly: a table of strings, codes as bits."""
    bits, table, width, held = [], {bytes([i]): i for i in range(256)}, 9, b""
    put = lambda code: bits.append(format(code, f"0{width}b"))
    put(256)
    size = 258
    for x in data:
        both = held + bytes([x])
        if both in table:
            held = both
            continue
        put(table[held])
        table[both], size, held = size, size + 1, bytes([x])
        if size in (512, 1024, 2048):
            width += 1
        if size == 4094:
            put(256)
            table, width, size = {bytes([i]): i for i in range(256)}, 9, 258
    if held:
        put(table[held])
    put(257)
    text = "".join(bits)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def tiff(blocks, tags, order="<", big=False):
    """A file of these blocks; `tags` (tag, letter, values), PLACES and SIZES stand for where the blocks are."""
    head = 16 if big else 8
    places = np.cumsum([head, *(len(b) for b in blocks)])[:-1].tolist()
    at = head + sum(map(len, blocks))
    word, entry = ("Q", 20) if big else ("I", 12)
    out, beyond, base = [], b"", at + (8 if big else 2) + entry * len(tags) + struct.calcsize("<" + word)
    for tag, letter, values in sorted(tags):
        values = places if values == "PLACES" else [len(b) for b in blocks] if values == "SIZES" else values
        data = struct.pack(f"{order}{len(values)}{letter}", *values)
        inline = 8 if big else 4
        if len(data) > inline:
            place = struct.pack(order + word, base + len(beyond))
            beyond += data
        else:
            place = data.ljust(inline, b"\0")
        out.append(struct.pack(f"{order}HH{word}", tag, TYPE[letter], len(values)) + place)
    magic = struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at)
    return (b"II" if order == "<" else b"MM") + magic + b"".join(blocks) + struct.pack(order + ("Q" if big else "H"), len(tags)) + b"".join(out) + struct.pack(order + word, 0) + beyond


def read(data, bands=None, **kw):
    image = geotiff.Image(lambda at, size: data[at : at + size])
    out = np.zeros((image.bands, image.rows, image.cols), image.kind)
    for b, r, c, a in image.blocks(bands, **kw):
        out[b - 1, r : r + a.shape[0], c : c + a.shape[1]] = a
    return out, image


RNG = np.random.default_rng(1)


def base(rows, cols, n, bits, **more):
    tags = {256: ("I", [cols]), 257: ("I", [rows]), 258: ("H", [bits] * n), 259: ("H", [1]), 277: ("H", [n]), 284: ("H", [1])} | more
    return [(t, *v) for t, v in tags.items()]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_interleaved_strips(order, big):
    a = RNG.integers(0, 60000, (7, 5, 3)).astype("uint16")
    blocks = [a[r : r + 2].astype(order + "u2").tobytes() for r in range(0, 7, 2)]
    data = tiff(blocks, [*base(7, 5, 3, 16), (278, "I", [2]), (273, "I", "PLACES"), (279, "I", "SIZES")], order, big)
    out, image = read(data)
    assert (out == a.transpose(2, 0, 1)).all() and image.transform == [0, 1, 0, 0, 0, 1]
    only, _ = read(data, [2])
    assert (only[1] == a[..., 1]).all() and not only[[0, 2]].any()
    part, _ = read(data, first=1, last=3)
    assert (part[:, 2:6] == out[:, 2:6]).all() and not part[:, :2].any() and not part[:, 6:].any()


def test_tiles_with_lzw_and_differences():
    a = RNG.integers(0, 4, (50, 70)).astype("uint8")
    whole = np.zeros((64, 96), "uint8")
    whole[:50, :70] = a
    parts = [whole[r : r + 32, c : c + 32] for r in (0, 32) for c in (0, 32, 64)]
    blocks = [lzw(np.diff(p, axis=1, prepend=np.zeros((32, 1), "uint8")).astype("uint8").tobytes()) for p in parts]
    tags = [t for t in base(50, 70, 1, 8) if t[0] != 259]
    data = tiff(blocks, [*tags, (259, "H", [5]), (317, "H", [2]), (322, "I", [32]), (323, "I", [32]), (324, "I", "PLACES"), (325, "I", "SIZES"), (33550, "d", [0.5, 0.5, 0]), (33922, "d", [0, 0, 0, 100, 200, 0])])
    out, image = read(data)
    assert (out[0] == a).all() and image.transform == [100, 0.5, 0, 200, 0, -0.5]


def test_long_lzw():
    data = RNG.integers(0, 256, 30000).astype("uint8").tobytes() + b"abc" * 9000
    assert geotiff.unlzw(lzw(data)) == data


def test_one_bit_masks():
    a = RNG.integers(0, 2, (9, 13)).astype("uint8")
    data = tiff([np.packbits(a, axis=1).tobytes()], [*base(9, 13, 1, 1), (278, "I", [9]), (273, "I", "PLACES"), (279, "I", "SIZES")])
    assert (read(data)[0][0] == a).all()


@pytest.mark.parametrize("kind", ["uint8", "int16", "uint32", "float32", "float64"])
@pytest.mark.parametrize("compress", [True, False])
def test_what_the_sink_writes(kind, compress):
    a = (RNG.random((3, 400, 301)) * 200).astype(kind)
    data = geotiff.encoded(a, [10.0, 2.0, 0.0, 90.0, 0.0, -2.0], 32633, 0, compress)
    out, image = read(data)
    assert (out == a).all() and out.dtype == a.dtype
    assert (image.transform, image.epsg, image.nodata) == ([10, 2, 0, 90, 0, -2], 32633, 0)
    assert read(geotiff.encoded(a, [1.0, 2.0, 0.5, 3.0, 0.25, -2.0], 4326))[1].transform == [1, 2, 0.5, 3, 0.25, -2]


def test_round_trip_through_spark(spark, tmp_path):
    rows = [(t, b, r, c, (t * 31 + b * 7 + r * 3 + c) % 251) for t in range(3) for b in range(4) for r in range(20) for c in range(30)]
    pixels = spark.createDataFrame(rows, "tile_id long, band int, row int, col int, value int")
    geotiff.write_geotiff(geotiff.images(pixels, 20, 30, 4, [5, 1, 0, 6, 0, -1], 32601), f"file://{tmp_path}/a")
    blocks = geotiff.read_geotiff(spark, f"file://{tmp_path}/a", [1, 3])
    assert {r["band"] for r in blocks.collect()} == {1, 3}
    got = {(int(r["path"].split("/")[-1][:-4]), r["band"] - 1, r["row"], r["col"], int(r["value"])) for r in geotiff.pixels_of(blocks).collect()}
    assert got == {x for x in rows if x[1] in (0, 2)}
    first = blocks.first()
    assert (first["epsg"], first["transform"], first["nodata"]) == (32601, [5, 1, 0, 6, 0, -1], 0)


def test_filters_on_bands_reach_the_reader(spark, tmp_path):
    a = np.arange(2 * 4 * 4).reshape(2, 4, 4).astype("uint8")
    (tmp_path / "x.tif").write_bytes(geotiff.encoded(a))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert [r["band"] for r in geotiff.read_geotiff(spark, str(tmp_path)).where("band = 2").collect()] == [2]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = geotiff._PushedReader({"path": str(tmp_path)})
    list(reader.pushFilters([geotiff.EqualTo(("band",), 2)]))
    assert [r[1] for p in reader.partitions() for r in reader.read(p)] == [2]


def test_large_files_are_read_by_ranges(tmp_path):
    a = RNG.integers(0, 255, (1, 3000, 500)).astype("uint8")
    (tmp_path / "x.tif").write_bytes(geotiff.encoded(a, compress=False))
    reader = geotiff._Reader({"path": str(tmp_path), "partbytes": "200000"})
    parts = reader.partitions()
    assert len(parts) > 5
    out = np.zeros_like(a[0])
    for p in parts:
        for _, _, r, c, h, w, kind, *_, data in reader.read(p):
            out[r : r + h, c : c + w] = np.frombuffer(data, kind).reshape(h, w)
    assert (out == a[0]).all()
