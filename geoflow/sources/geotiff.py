"""GeoTIFF as a Spark data source: one row a block and band, read by ranges of bytes from any store that Arrow opens; and a sink."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

SCHEMA = "path string, band int, row int, col int, rows int, cols int, kind string, transform array<double>, epsg int, nodata double, data binary"
#: Bytes of small files in a partition, and of the blocks of a large one.
PART = 64 << 20
#: Bytes of a written strip, before compression.
STRIP = 1 << 16
# Fixed values of the format: tags, field types (code: struct letter), compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_COLS, TILE_ROWS, TILES, TILE_SIZES, FORMAT, SCALE, TIE, MATRIX, KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946


def unlzw(data: bytes) -> bytes:
    """TIFF's LZW: codes from the high bit on, wider one code early; 256 clears, 257 ends."""
    table: list[bytes] = []
    out, bits, held, width, last = [], 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


class Image:
    """The first image of a file: its directory, and its blocks."""

    def __init__(self, read):
        """`read(at, size)` gives bytes of the file."""
        head = read(0, 16)
        if head[:2] not in (b"II", b"MM"):
            raise ValueError("not a TIFF file")
        self.read, self.order = read, "<" if head[:2] == b"II" else ">"
        (magic,) = struct.unpack(self.order + "H", head[2:4])
        if magic not in (42, 43):
            raise ValueError("not a TIFF file")
        big = magic == 43
        (at,) = struct.unpack(self.order + ("Q" if big else "I"), head[8:16] if big else head[4:8])
        count_size, entry, place = (8, 20, "Q") if big else (2, 12, "I")
        (n,) = struct.unpack(self.order + ("Q" if big else "H"), read(at, count_size))
        data = read(at + count_size, n * entry)
        self.tags = {}
        inline = entry - 4 - struct.calcsize("<" + place)
        for k in range(0, n * entry, entry):
            tag, kind = struct.unpack(self.order + "HH", data[k : k + 4])
            (count,) = struct.unpack(self.order + place, data[k + 4 : k + entry - inline])
            value, letter = data[k + entry - inline : k + entry], TYPES.get(kind)
            if letter is None:
                continue
            size = struct.calcsize("<" + letter) * count
            if size > inline:
                value = read(struct.unpack(self.order + place, value)[0], size)
            self.tags[tag] = value[:size] if letter == "s" else struct.unpack(f"{self.order}{count * len(letter)}{letter[0]}", value[:size])
        one = lambda tag, default: self.tags.get(tag, (default,))[0]
        self.cols, self.rows, self.bands = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        self.compression, self.predictor, self.apart = one(COMPRESSION, PLAIN), one(PREDICTOR, 1), one(PLANAR, 1) == 2
        self.bits = one(BITS, 1)
        self.kind = np.dtype(f"{ {1: 'u', 2: 'i', 3: 'f'}.get(one(FORMAT, 1), 'u')}{max(1, self.bits // 8)}")
        tiled = TILES in self.tags
        self.block_cols = one(TILE_COLS, self.cols) if tiled else self.cols
        self.block_rows = one(TILE_ROWS, self.rows) if tiled else min(one(STRIP_ROWS, self.rows), self.rows)
        self.places, self.sizes = self.tags[TILES if tiled else STRIPS], self.tags[TILE_SIZES if tiled else STRIP_SIZES]
        self.across, self.down = -(-self.cols // self.block_cols), -(-self.rows // self.block_rows)
        self.tiled = tiled

    @property
    def transform(self) -> list[float]:
        """(xmin, xres, xskew, ymax, yskew, yres); pixels where the file has no place."""
        if m := self.tags.get(MATRIX):
            return [m[3], m[0], m[1], m[7], m[4], m[5]]
        if (s := self.tags.get(SCALE)) and (t := self.tags.get(TIE)):
            return [t[3] - t[0] * s[0], s[0], 0.0, t[4] + t[1] * s[1], 0.0, -s[1]]
        return [0.0, 1.0, 0.0, 0.0, 0.0, 1.0]

    @property
    def epsg(self) -> int | None:
        """The code of its projected, or else geographic, system."""
        keys = self.tags.get(KEYS, ())
        found = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
        return found.get(3072) or found.get(2048)

    @property
    def nodata(self) -> float | None:
        text = self.tags.get(NODATA, b"").split(b"\0")[0].strip()
        return float(text) if text else None

    def _unpacked(self, data: bytes, rows: int, samples: int) -> np.ndarray:
        """A block as (rows, cols, samples)."""
        if self.compression == LZW:
            data = unlzw(data)
        elif self.compression in (DEFLATE, OLD_DEFLATE):
            data = zlib.decompress(data)
        elif self.compression != PLAIN:
            raise ValueError(f"compression {self.compression} is not supported")
        shape = (rows, self.block_cols, samples)
        if self.bits == 1:
            line = -(-self.block_cols * samples // 8)
            bits = np.unpackbits(np.frombuffer(data, "u1", rows * line).reshape(rows, line), axis=1)
            return bits[:, : self.block_cols * samples].reshape(shape)
        if self.predictor == 3:  # bytes of floats, highest first, each line differenced
            planes = np.frombuffer(data, "u1", rows * self.block_cols * samples * self.kind.itemsize).reshape(rows, -1)
            planes = np.cumsum(planes.reshape(rows, -1, samples), axis=1, dtype="u1").reshape(rows, self.kind.itemsize, -1)
            return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(self.kind.newbyteorder(">"))[..., 0].reshape(shape).astype(self.kind)
        a = np.frombuffer(data, self.kind.newbyteorder(self.order), rows * self.block_cols * samples).reshape(shape).astype(self.kind)
        return np.cumsum(a, axis=1, dtype=self.kind) if self.predictor == 2 else a

    def blocks(self, bands: list[int] | None = None, first: int = 0, last: int | None = None) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(band from 1, first row, first column, pixels) of the blocks `first` to `last`, reading only what holds `bands`."""
        wanted = [b for b in (bands or range(1, self.bands + 1)) if 1 <= b <= self.bands]
        n = self.across * self.down
        for k in range(first, n if last is None else min(n, last)):
            row, col = k // self.across * self.block_rows, k % self.across * self.block_cols
            rows = self.block_rows if self.tiled else min(self.block_rows, self.rows - row)
            inside = np.s_[: self.rows - row, : self.cols - col]
            if not self.apart and wanted:
                whole = self._unpacked(self.read(self.places[k], self.sizes[k]), rows, self.bands)
            for b in wanted:
                if self.apart:
                    at = (b - 1) * n + k
                    yield b, row, col, self._unpacked(self.read(self.places[at], self.sizes[at]), rows, 1)[..., 0][inside]
                else:
                    yield b, row, col, whole[..., b - 1][inside]


def encoded(bands: np.ndarray, transform: list[float] | None = None, epsg: int | None = None, nodata: float | None = None, compress: bool = True) -> bytes:
    """A file of (bands, rows, cols): strips a band by itself, deflated, whole numbers with differences."""
    n, rows, cols = bands.shape
    kind = bands.dtype.newbyteorder("<")
    differ = compress and kind.kind in "ui"
    height = max(1, min(rows, STRIP // max(1, cols * kind.itemsize)))
    parts = []
    for band in bands:
        for r in range(0, rows, height):
            a = band[r : r + height].astype(kind)
            if differ:
                a = np.diff(a, axis=1, prepend=np.zeros((len(a), 1), kind)).astype(kind)
            parts.append(zlib.compress(a.tobytes()) if compress else a.tobytes())
    sizes = [len(p) for p in parts]
    places = [8 + sum(sizes[:i]) for i in range(len(sizes))] if len(sizes) < 1000 else (8 + np.cumsum([0, *sizes[:-1]])).tolist()
    tags = [(WIDTH, "I", [cols]), (HEIGHT, "I", [rows]), (BITS, "H", [kind.itemsize * 8] * n), (COMPRESSION, "H", [DEFLATE if compress else PLAIN]), (PHOTOMETRIC, "H", [1]), (STRIPS, "I", places), (SAMPLES, "H", [n]), (STRIP_ROWS, "I", [height]), (STRIP_SIZES, "I", sizes), (PLANAR, "H", [2])]
    tags += [(PREDICTOR, "H", [2 if differ else 1]), (FORMAT, "H", [{"u": 1, "i": 2, "f": 3}[kind.kind]] * n)]
    if transform:
        x, dx, skew_x, y, skew_y, dy = transform
        if skew_x or skew_y or dy > 0:
            tags.append((MATRIX, "d", [dx, skew_x, 0, x, skew_y, dy, 0, y, 0, 0, 0, 0, 0, 0, 0, 1]))
        else:
            tags += [(SCALE, "d", [dx, -dy, 0]), (TIE, "d", [0, 0, 0, x, y, 0])]
    if epsg:
        flat = 4000 <= epsg < 5000
        tags.append((KEYS, "H", [1, 1, 0, 3, 1024, 0, 1, 2 if flat else 1, 1025, 0, 1, 1, 2048 if flat else 3072, 0, 1, epsg]))
    if nodata is not None:
        tags.append((NODATA, "s", f"{nodata:g}".encode() + b"\0"))
    tags.sort(key=lambda t: t[0])
    at = 8 + sum(sizes)
    if at % 2:
        parts.append(b"\0")
        at += 1
    code = {"B": 1, "s": 2, "H": 3, "I": 4, "d": 12}
    entries, more, beyond = [], [], at + 2 + 12 * len(tags) + 4
    for tag, letter, values in tags:
        data = values if letter == "s" else struct.pack(f"<{len(values)}{letter}", *values)
        if len(data) <= 4:
            place = data.ljust(4, b"\0")
        else:
            place = struct.pack("<I", beyond)
            data += b"\0" * (len(data) % 2)
            more.append(data)
            beyond += len(data)
        entries.append(struct.pack("<HHI", tag, code[letter], len(values)) + place)
    if beyond >= 1 << 32:
        raise ValueError("the file would be over 4 GB; cut the tile")
    return b"".join([b"II*\0", struct.pack("<I", at), *parts, struct.pack("<H", len(tags)), *entries, b"\0\0\0\0", *more])


def _files(path: str):
    """(file system, [(path, size)]) of a file or of a folder's .tif and .tiff files, at any depth."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [x for x in store.get_file_info(fs.FileSelector(at, recursive=True)) if x.is_file and x.path.lower().endswith((".tif", ".tiff"))]
    return store, sorted((x.path, x.size) for x in found)


class _Part(InputPartition):
    """Whole files, or the blocks from `first` to `last` of one."""

    def __init__(self, paths: list[str], first: int = 0, last: int | None = None):
        self.paths, self.first, self.last = paths, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, bands = options["path"], options.get("bands", "")
        self.part = int(options.get("partbytes", PART))
        self.bands = [int(b) for b in bands.split(",")] if bands else None

    def partitions(self) -> list[_Part]:
        store, files = _files(self.path)
        out, held, size = [], [], 0
        for path, n in files:
            if n > self.part:  # blocks by ranges
                with store.open_input_file(path) as f:
                    image = Image(lambda at, size, f=f: f.read_at(size, at))
                blocks = image.across * image.down
                step = max(1, blocks * self.part // n)
                out += [_Part([path], k, k + step) for k in range(0, blocks, step)]
                continue
            held.append(path)
            size += n
            if size >= self.part:
                out.append(_Part(held))
                held, size = [], 0
        return [*out, _Part(held)] if held or not out else out

    def read(self, partition: _Part) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        if self.bands == []:
            return
        for path in partition.paths:
            with store.open_input_file(path) as f:
                image = Image(lambda at, size, f=f: f.read_at(size, at))
                for band, row, col, a in image.blocks(self.bands, partition.first, partition.last):
                    yield path, band, row, col, a.shape[0], a.shape[1], a.dtype.name, image.transform, image.epsg, image.nodata, a.tobytes()


class _PushedReader(_Reader):
    """Where the session pushes filters down to Python sources (`spark.sql.python.filterPushdown.enabled`)."""

    def pushFilters(self, filters):  # noqa: N802
        """A filter on `band` chooses what is read; Spark applies it again."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("band",):
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.bands = [b for b in values if self.bands is None or b in self.bands]
            yield f


class _Written(WriterCommitMessage):
    def __init__(self, n: int):
        self.n = n


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.compress = options["path"], options.get("compress", "true").lower() == "true"

    def write(self, rows: Iterator) -> _Written:
        """A file a row, named by it: a task that runs again writes the same files."""
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        store.create_dir(at, recursive=True)
        n = 0
        for r in rows:
            a = np.frombuffer(r["data"], r["kind"]).reshape(-1, r["rows"], r["cols"])
            with store.open_output_stream(f"{at}/{r['name']}.tif") as f:
                f.write(encoded(a, list(r["transform"]) if r["transform"] else None, r["epsg"], r["nodata"], self.compress))
            n += 1
        return _Written(n)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        pass


class GeoTiff(DataSource):
    """`spark.read.format("geotiff")`: options path, bands ("1,3"), partBytes; `df.write.format("geotiff")`: path, compress."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (_PushedReader if options.get("pushfilters") == "true" else _Reader)(options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer({k.lower(): v for k, v in self.options.items()})


def read_geotiff(spark: SparkSession, path: str, bands: list[int] | None = None) -> DataFrame:
    """Blocks (path, band, row, col, rows, cols, kind, transform, epsg, nodata, data) of a file or folder; only `bands` are read."""
    spark.dataSource.register(GeoTiff)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    reader = spark.read.format("geotiff").option("path", path).option("pushFilters", pushed)
    return (reader.option("bands", ",".join(map(str, bands))) if bands else reader).load()


def write_geotiff(images: DataFrame, path: str, compress: bool = True) -> None:
    """A file for each image (name, rows, cols, kind, transform, epsg, nodata, data), data being its bands one after the other."""
    images.sparkSession.dataSource.register(GeoTiff)
    images.select("name", "rows", "cols", "kind", "transform", "epsg", "nodata", "data").write.format("geotiff").option("path", path).option("compress", str(compress).lower()).mode("append").save()


def images(pixels: DataFrame, rows: int, cols: int, bands: int, transform: list[float] | None = None, epsg: int | None = None, kind: str = "uint8", key: str = "tile_id") -> DataFrame:
    """Images for `write_geotiff` of pixel rows (key, band from 0, row, col, value), one a key; missing pixels are 0. An image fits a task."""

    def run(table):
        import pyarrow as pa

        a = np.zeros((bands, rows, cols), kind)
        a[tuple(table.column(c).to_numpy() for c in ("band", "row", "col"))] = table.column("value").to_numpy()
        return pa.table({"name": [str(table.column("name")[0])], "rows": pa.array([rows], pa.int32()), "cols": pa.array([cols], pa.int32()), "kind": [kind], "data": pa.array([a.tobytes()], pa.binary())})

    named = pixels.select(F.col(key).cast("string").alias("name"), *(F.col(c).cast("int").alias(c) for c in ("band", "row", "col")), "value")
    packed = named.groupBy("name").applyInArrow(run, "name string, rows int, cols int, kind string, data binary")
    place = F.lit(None).cast("array<double>") if transform is None else F.array(*map(F.lit, map(float, transform)))
    return packed.withColumn("transform", place).withColumn("epsg", F.lit(epsg).cast("int")).withColumn("nodata", F.lit(0.0))


def pixels_of(blocks: DataFrame) -> DataFrame:
    """(path, band, row, col, value double) of blocks."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], r["kind"]).reshape(r["rows"], r["cols"])
                y, x = (k.ravel() for k in np.indices(a.shape))
                n = len(y)
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * n, pa.string()), pa.array(np.full(n, r["band"], "int32")), pa.array((y + r["row"]).astype("int32")), pa.array((x + r["col"]).astype("int32")), pa.array(a.ravel().astype("float64"))], ["path", "band", "row", "col", "value"])

    return blocks.select("path", "band", "row", "col", "rows", "cols", "kind", "data").mapInArrow(run, "path string, band int, row int, col int, value double")
