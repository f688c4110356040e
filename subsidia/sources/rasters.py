"""Tiled rasters: TIFF files without compression, written by tasks, read by windows.

A raster is one TIFF file, or a folder of them that write_raster() has made: files of a bounded number of tiles, each
with its place in the whole, and an index. The reader turns filters on row and col into a window: files outside it are not
opened, of the others the header is read and then the bytes of those tiles only that the window meets. Classic and
BigTIFF, either byte order, tiles or strips, one band of integers or floats are read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.geometry import Grid
from .scratch import sent_along

CELLS = T.StructType([T.StructField("row", T.LongType()), T.StructField("col", T.LongType()), T.StructField("value", T.DoubleType())])
#: Rows and columns of a tile, tiles of a file along either side, tiles of a partition when one file is read.
TILE, FILE_TILES, RUN_TILES = 256, 8, 64
#: Tags of the format, and its types by struct's letters.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
GEOGRAPHIC, PROJECTED, MODEL_TYPE = 2048, 3072, 1024


@dataclass
class Header:
    """Where a file's tiles lie, and what its grid is. transform: x and y of the corner and steps (a, b, c, d, e, f)."""

    width: int
    height: int
    tile_width: int
    tile_height: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    kind: np.dtype
    nodata: float | None
    transform: tuple[float, ...]
    crs: str | None

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    def box(self, tile: int) -> tuple[int, int, int, int]:
        """First and end row, first and end column of a tile, within the image."""
        row, col = tile // self.across * self.tile_height, tile % self.across * self.tile_width
        return row, min(row + self.tile_height, self.height), col, min(col + self.tile_width, self.width)


def read_header(f) -> Header:
    """The header of the first image of an open file."""
    start = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    if not order or (version := struct.unpack(f"{order}H", start[2:4])[0]) not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack(f"{order}Q", start[8:16])[0] if big else struct.unpack(f"{order}I", start[4:8])[0]
    word, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    f.seek(at)
    (n,) = struct.unpack(order + count, f.read(struct.calcsize(count)))
    raw, tags = f.read(n * entry), {}
    for i in range(n):
        own = raw[i * entry : (i + 1) * entry]
        tag, kind, size = struct.unpack(f"{order}HH{word}", own[: 4 + struct.calcsize(word)])
        if kind not in TYPES:
            continue
        letters = f"{size}s" if kind == 2 else TYPES[kind] * size if len(TYPES[kind]) > 1 else f"{size}{TYPES[kind]}"
        need, value = struct.calcsize(order + letters), own[-struct.calcsize(word) :]
        if need > len(value):
            f.seek(struct.unpack(order + word, value)[0])
            value = f.read(need)
        tags[tag] = struct.unpack(order + letters, value[:need])
    one = lambda tag, other: tags.get(tag, (other,))[0]
    if one(COMPRESSION, 1) != 1 or one(SAMPLES, 1) != 1:
        raise ValueError("only rasters of one band without compression are read")
    letter = {1: "u", 2: "i", 3: "f"}[one(SAMPLE_FORMAT, 1)]
    tiled = TILE_OFFSETS in tags
    nodata = tags.get(NODATA, (b"",))[0].rstrip(b"\0 ").decode()
    keys = tags.get(GEO_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    code = codes.get(PROJECTED) or codes.get(GEOGRAPHIC)
    if TRANSFORM in tags:
        m = tags[TRANSFORM]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif PIXEL_SCALE in tags:
        (sx, sy, _), tie = tags[PIXEL_SCALE], tags[TIE_POINT]
        transform = (sx, 0.0, tie[3] - tie[0] * sx, 0.0, -sy, tie[4] + tie[1] * sy)
    else:
        transform = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    width, height = one(WIDTH, 0), one(HEIGHT, 0)
    return Header(
        width, height, one(TILE_WIDTH, width) if tiled else width, one(TILE_HEIGHT, height) if tiled else min(height, one(STRIP_ROWS, height)),
        tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES], np.dtype(f"{order}{letter}{one(BITS, 1) // 8}"),
        float(nodata) if nodata else None, transform, f"EPSG:{code}" if code else None,
    )


def encode(values: np.ndarray, transform: tuple[float, ...], crs: str | None, tile: int = TILE, nodata: float | None = None) -> bytes:
    """A BigTIFF of an array; tiles that hold nothing but nodata take no bytes."""
    height, width = values.shape
    body, offsets, sizes, at = [], [], [], 16
    empty = lambda x: nodata is not None and bool((np.isnan(x) if np.isnan(nodata) else x == nodata).all())
    for row in range(0, height, tile):
        for col in range(0, width, tile):
            part = values[row : row + tile, col : col + tile]
            if empty(part):
                offsets.append(0)
                sizes.append(0)
                continue
            whole = np.full((tile, tile), 0 if nodata is None else nodata, dtype=values.dtype)
            whole[: part.shape[0], : part.shape[1]] = part
            body.append(whole.astype(values.dtype.newbyteorder("<")).tobytes())
            offsets.append(at)
            sizes.append(len(body[-1]))
            at += len(body[-1])
    a, b, c, d, e, f = transform
    matrix = (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    code = int(crs.removeprefix("EPSG:")) if crs else 0
    projected = not 4000 <= code < 5000
    keys = (1, 1, 0, 2, MODEL_TYPE, 0, 1, 1 if projected else 2, PROJECTED if projected else GEOGRAPHIC, 0, 1, code)
    tags = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (values.dtype.itemsize * 8,)), (COMPRESSION, 3, (1,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (1,)),
        (TILE_WIDTH, 4, (tile,)), (TILE_HEIGHT, 4, (tile,)), (TILE_OFFSETS, 16, tuple(offsets)), (TILE_BYTES, 16, tuple(sizes)), (SAMPLE_FORMAT, 3, ({"u": 1, "i": 2, "f": 3}[values.dtype.kind],)), (TRANSFORM, 12, matrix),
        *([(GEO_KEYS, 3, keys)] if code else []), *([(NODATA, 2, (repr(nodata).encode() + b"\0",))] if nodata is not None else []),
    ]
    entries = []
    for tag, kind, value in tags:
        size = len(value[0]) if kind == 2 else len(value)
        raw = struct.pack("<" + (f"{size}s" if kind == 2 else f"{size}{TYPES[kind]}"), *value)
        if len(raw) > 8:
            body.append(raw + b"\0" * (-len(raw) % 8))
            raw, at = struct.pack("<Q", at), at + len(body[-1])
        entries.append(struct.pack("<HHQ", tag, kind, size) + raw.ljust(8, b"\0"))
    head = b"II" + struct.pack("<HHHQ", 43, 8, 0, at)
    return b"".join([head, *body, struct.pack("<Q", len(entries)), *entries, struct.pack("<Q", 0)])


@dataclass
class Window:
    """Rows and columns, ends not included."""

    top: int = 0
    bottom: int = 1 << 62
    left: int = 0
    right: int = 1 << 62

    def meets(self, top: int, bottom: int, left: int, right: int) -> bool:
        return max(self.top, top) < min(self.bottom, bottom) and max(self.left, left) < min(self.right, right)

    def narrowed(self, flt) -> Window:
        """The window less what a filter on row or col leaves out."""
        low, high = -(1 << 62), 1 << 62
        if isinstance(flt, (EqualTo, In)):
            values = [v for v in (flt.value if isinstance(flt, In) else [flt.value]) if v is not None]
            low, high = (min(values), max(values) + 1) if values else (0, 0)
        elif isinstance(flt, (GreaterThan, GreaterThanOrEqual)):
            low = flt.value + isinstance(flt, GreaterThan)
        elif isinstance(flt, (LessThan, LessThanOrEqual)):
            high = flt.value + isinstance(flt, LessThanOrEqual)
        if flt.attribute == ("row",):
            return Window(max(self.top, low), min(self.bottom, high), self.left, self.right)
        return Window(self.top, self.bottom, max(self.left, low), min(self.right, high))


@dataclass
class Part(InputPartition):
    """A file, where it begins in the whole, and its tiles from first on, up to end."""

    path: str
    row: int
    col: int
    first: int = 0
    end: int = 1 << 62


class RasterReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.window = path, Window()

    def pushFilters(self, filters):
        for flt in filters:
            if isinstance(flt, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and flt.attribute in (("row",), ("col",)):
                self.window = self.window.narrowed(flt)
            yield flt

    def partitions(self) -> list[Part]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        if fs.get_file_info(root).type == pyarrow.fs.FileType.File:
            with fs.open_input_file(root) as f:
                n = len(read_header(f).offsets)
            return [Part(root, 0, 0, i, i + RUN_TILES) for i in range(0, n, RUN_TILES)]
        files = pyarrow.dataset.dataset(f"{root}/_index", filesystem=fs, format="parquet", exclude_invalid_files=True).to_table().to_pylist()
        return [Part(f"{root}/{x['file']}", x["top"], x["left"]) for x in files if self.window.meets(x["top"], x["top"] + x["height"], x["left"], x["left"] + x["width"])]

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no file is left
            return
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        with fs.open_input_file(part.path) as f:
            head = read_header(f)
            for tile in range(part.first, min(part.end, len(head.offsets))):
                top, bottom, left, right = head.box(tile)
                if not head.sizes[tile] or not self.window.meets(part.row + top, part.row + bottom, part.col + left, part.col + right):
                    continue
                f.seek(head.offsets[tile])
                cells = np.frombuffer(f.read(head.sizes[tile]), dtype=head.kind).reshape(-1, head.tile_width)[: bottom - top, : right - left]
                held = np.ones(cells.shape, bool) if head.nodata is None else ~np.isnan(cells) if np.isnan(head.nodata) else cells != head.nodata
                rows, cols = np.nonzero(held)
                value = cells[rows, cols].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(rows + (part.row + top)), pa.array(cols + (part.col + left)), pa.array(value)], CELLS.names)


class RasterSource(DataSource):
    """format("tiled_raster"), option path: (row, col, value) of the cells that hold data."""

    @classmethod
    def name(cls) -> str:
        return "tiled_raster"

    def schema(self) -> T.StructType:
        return CELLS

    def reader(self, schema: T.StructType) -> RasterReader:
        return RasterReader(self.options["path"])


sent_along(__name__)


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of a raster's cells that hold data; filters on row and col make a window."""
    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tiled_raster").load(path)


def write_raster(cells: DataFrame, path: str, grid: Grid, tile: int = TILE, file_tiles: int = FILE_TILES, nodata: float = -9999.0) -> DataFrame:
    """Write cells(row, col, value) as doubles, a file for each square of tiles that holds any; gives the index.

    Cells outside the grid, and those with a null in row, col or value, are left out; of cells at one place one stays. A
    file takes its name when it is whole, so a task that runs again does no harm.
    """
    side, height, width, transform, crs = tile * file_tiles, grid.height, grid.width, grid.transform, grid.crs

    def store(rows: pa.Table) -> pa.Table:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        top, left = (rows.column(c)[0].as_py() * side for c in ("down", "across"))
        values = np.full((min(side, height - top), min(side, width - left)), nodata)
        values[rows.column("row").to_numpy() - top, rows.column("col").to_numpy() - left] = rows.column("value").to_numpy()
        a, b, c, d, e, f = transform
        own = (a, b, c + a * left + b * top, d, e, f + d * left + e * top)
        name = f"tiles-{top}-{left}.tif"
        held = f"{root}/.{name}.{uuid.uuid4().hex}"
        fs.create_dir(root)
        with fs.open_output_stream(held) as out:
            out.write(encode(values, own, crs, tile, nodata))
        fs.move(held, f"{root}/{name}")
        found = {"file": name, "top": top, "left": left, "height": values.shape[0], "width": values.shape[1]}
        return pa.table({k: [v] for k, v in found.items()})

    inside = cells.where(F.col("value").isNotNull() & F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))
    squares = inside.select(F.floor(F.col("row") / side).alias("down"), F.floor(F.col("col") / side).alias("across"), F.col("row").cast("long"), F.col("col").cast("long"), F.col("value").cast("double"))
    index = squares.groupBy("down", "across").applyInArrow(store, "file string, top long, left long, height long, width long")
    index.write.mode("overwrite").parquet(f"{path}/_index")
    return cells.sparkSession.read.parquet(f"{path}/_index")


#: What raster_files() adds.
FOUND = T.StructType([T.StructField(n, t) for n, t in (("sha256", T.StringType()), ("crs", T.StringType()), ("transform", T.StringType()), ("height", T.IntegerType()), ("width", T.IntegerType()), ("nodata", T.DoubleType()), ("finite_count", T.LongType()), ("min_value", T.DoubleType()), ("max_value", T.DoubleType()))])


def _looked_at(where: str | None) -> tuple:
    """FOUND of one file, of which a tile or a piece of bytes is held at a time; nulls where there is none, or no raster."""
    fs, at = pyarrow.fs.FileSystem.from_uri(where) if where else (None, None)
    if not where or fs.get_file_info(at).type != pyarrow.fs.FileType.File:
        return (None,) * len(FOUND)
    digest, count, low, high = hashlib.sha256(), 0, np.inf, -np.inf
    with fs.open_input_file(at) as f:
        try:
            h = read_header(f)
        except (ValueError, KeyError, struct.error):  # not a raster that is read here
            h = None
        for tile, (offset, size) in enumerate(zip(h.offsets, h.sizes, strict=True) if h else ()):
            if size:
                top, bottom, left, right = h.box(tile)
                f.seek(offset)
                cells = np.frombuffer(f.read(size), dtype=h.kind).reshape(-1, h.tile_width)[: bottom - top, : right - left]
                cells = cells[np.isfinite(cells) & (cells != h.nodata)] if h.nodata is not None else cells[np.isfinite(cells)]
                if len(cells):
                    count, low, high = count + len(cells), min(low, float(cells.min())), max(high, float(cells.max()))
        f.seek(0)
        while piece := f.read(1 << 22):
            digest.update(piece)
    if h is None:
        return digest.hexdigest(), *(None,) * (len(FOUND) - 1)
    transform = ",".join(f"{x:.15g}" for x in h.transform)
    return digest.hexdigest(), h.crs, transform, h.height, h.width, h.nodata, count, low if count else None, high if count else None


def raster_files(files: DataFrame, path: str = "path") -> DataFrame:
    """files and FOUND of each: digest, grid, number and range of the finite cells. Tasks read the files."""
    out = T.StructType([*files.schema.fields, *FOUND.fields])
    kinds = (*(pa.string(),) * 3, pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.float64(), pa.float64())

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_looked_at(where) for where in batch.column(path).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[i] for x in found], k) for i, k in enumerate(kinds))], out.names)

    return files.mapInArrow(look, out)
