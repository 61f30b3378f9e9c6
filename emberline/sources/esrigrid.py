"""Binary ESRI GRID folders as cell tables: a partitioned data source, from the published description of the format.

A grid is a folder: ``hdr.adf`` (cell size, tile shape, whether cells are integers), ``dblbnd.adf``
(bounds), and for each sheet of tiles a data file with an index of places (``w001001.adf`` and
``w001001x.adf``). The driver reads the two small header files only. A partition is a range of
tile rows and columns; its task reads the index entries and the bytes of those tiles, whatever the
grid's size. A box of rows and columns, given as option or as filters on ``row`` and ``col``,
chooses the tiles that are read; columns that the schema leaves out are not built.

Files are opened by pyarrow (local folders, HDFS, S3, GCS). Integer tiles that are run-length
coded by bits (type 0xFF) are refused.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .geo import crs_code
from .geotiff import CELLS, HEADER

# Fixed values of the format: the numbers that stand for a missing cell.
NO_INTEGER = -2147483647
NO_FLOAT = float(np.float32(-3.4028234663852886e38))
#: Cells of a partition, about.
PART = 1 << 22


def _open(path: str) -> tuple[stores.FileSystem, str]:
    found = stores.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (stores.LocalFileSystem(), path)
    return found[0], found[1].rstrip("/")


@dataclass
class Grid:
    """What the header files say."""

    folder: str
    integer: bool
    packed: bool
    dx: float
    dy: float
    left: float
    top: float
    width: int
    height: int
    across: int  # tiles of a sheet
    down: int
    tile_width: int
    tile_height: int

    @property
    def columns(self) -> int:
        """Tiles from left to right, over all sheets."""
        return -(-self.width // self.tile_width)

    @property
    def rows(self) -> int:
        return -(-self.height // self.tile_height)


def read_grid(folder: str) -> Grid:
    store, root = _open(folder)
    with store.open_input_stream(f"{root}/hdr.adf") as f:
        head = f.read()
    with store.open_input_stream(f"{root}/dblbnd.adf") as f:
        left, bottom, right, top = struct.unpack(">4d", f.read()[:32])
    if head[:4] != b"GRID":
        raise ValueError(f"{folder} is not an ESRI GRID")
    kind, plain = struct.unpack(">2i", head[16:24])
    dx, dy = struct.unpack(">2d", head[256:272])
    across, down, tw, _, th = struct.unpack(">5i", head[288:308])
    return Grid(folder, kind == 1, kind == 1 and plain == 0, dx, dy, left, top, round((right - left) / dx), round((top - bottom) / dy), across, down, tw, th)


def sheet_name(x: int, y: int) -> str:
    """Name of the data file of the sheet in column x and row y (from 0)."""
    return f"w{x + 1:03d}{1 - y:03d}" if y < 2 else f"z{x + 1:03d}{y - 1:03d}"


def unpack_tile(data: bytes, cells: int) -> np.ndarray:
    """Cells of a coded integer tile, NaN where missing.

    A tile is its kind, the size and value of its least cell, and the cells' distances from that:
    one number each, or runs with a count before each, where counts over 127 stand for missing cells.
    """
    kind, size = data[0], data[1]
    least = int.from_bytes(data[2 : 2 + size], "big", signed=True) if size else 0
    body = data[2 + size :]
    if kind == 0x00:
        return np.full(cells, float(least))
    if kind in (0x01, 0x04):
        per = 8 // kind
        bits = np.unpackbits(np.frombuffer(body, np.uint8, -(-cells // per))).reshape(-1, kind)
        return least + (bits @ (1 << np.arange(kind)[::-1])).astype(float)[:cells]
    if kind in (0x08, 0x10, 0x20):
        v = np.frombuffer(body, f">{'i' if kind == 0x20 else 'u'}{kind // 8}", cells).astype(np.int64) + least
        return np.where(v == NO_INTEGER, np.nan, v)
    width = {0xE0: 4, 0xF0: 2, 0xF8: 1, 0xFC: 1, 0xCF: 2, 0xD7: 1, 0xDF: 0}.get(kind)
    if width is None:
        raise ValueError(f"tiles of kind {kind:#x} are not supported")
    out, at, n = np.full(cells, np.nan), 0, 0
    same = kind >= 0xE0
    while n < cells and at < len(body):
        count = body[at]
        at += 1
        if same:
            v = int.from_bytes(body[at : at + width], "big", signed=width == 4) + least
            out[n : n + count] = np.nan if v == NO_INTEGER else v
            at += width
        elif count > 127:
            count = 256 - count
        else:
            values = np.frombuffer(body, f">u{width}", count, at) if width else np.zeros(count)
            out[n : n + count] = (values.astype(float) + least)[: cells - n]
            at += count * width
        n += count
    return out


def tile_values(grid: Grid, data: bytes) -> np.ndarray:
    cells = grid.tile_width * grid.tile_height
    if grid.packed:
        got = unpack_tile(data, cells)
    else:
        v = np.frombuffer(data, ">i4" if grid.integer else ">f4", min(cells, len(data) // 4)).astype(float)
        got = np.concatenate([np.where(v == (NO_INTEGER if grid.integer else NO_FLOAT), np.nan, v), np.full(cells - len(v), np.nan)])
    return got.reshape(grid.tile_height, grid.tile_width)


@dataclass
class TileRange(InputPartition):
    """Tile rows and columns of a partition, ends excluded."""

    top: int
    bottom: int
    left: int
    right: int


@dataclass
class Box:
    """Cells that are asked for: first and last row and column."""

    row: list[int] = field(default_factory=lambda: [0, 1 << 31])
    col: list[int] = field(default_factory=lambda: [0, 1 << 31])

    def narrow(self, name: str, kind: type, value: int) -> None:
        span = getattr(self, name)
        if kind in (EqualTo, GreaterThanOrEqual, GreaterThan):
            span[0] = max(span[0], value + (kind is GreaterThan))
        if kind in (EqualTo, LessThanOrEqual, LessThan):
            span[1] = min(span[1], value - (kind is LessThan))


class GridReader(DataSourceReader):
    def __init__(self, folder: str, columns: list[str], box: Box) -> None:
        self.grid, self.wanted, self.box = read_grid(folder), columns, box

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name in ("row", "col") and type(f) in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) and isinstance(f.value, int):
                self.box.narrow(name, type(f), f.value)
            else:
                yield f

    def partitions(self) -> list[TileRange]:
        g = self.grid
        (r0, r1), (c0, c1) = ((max(0, a), min(b, n - 1)) for (a, b), n in ((self.box.row, g.height), (self.box.col, g.width)))
        if r0 > r1 or c0 > c1:
            return [TileRange(0, 0, 0, 0)]
        left, right = c0 // g.tile_width, c1 // g.tile_width + 1
        step = max(1, PART // ((right - left) * g.tile_width * g.tile_height))
        return [TileRange(t, min(t + step, r1 // g.tile_height + 1), left, right) for t in range(r0 // g.tile_height, r1 // g.tile_height + 1, step)]

    def _runs(self, part: TileRange) -> Iterator[tuple[int, int, list[bytes]]]:
        """(tile row, first tile column, tiles) of what lies in one sheet side by side; tiles that are not stored are empty."""
        g = self.grid
        store, root = _open(g.folder)
        for row in range(part.top, part.bottom):
            for x in range(part.left // g.across, (part.right - 1) // g.across + 1):
                first, last = max(part.left, x * g.across), min(part.right, (x + 1) * g.across)
                name = f"{root}/{sheet_name(x, row // g.down)}"
                if store.get_file_info(f"{name}.adf").type == stores.FileType.NotFound:
                    continue
                at = row % g.down * g.across + first - x * g.across
                with store.open_input_file(f"{name}x.adf") as f:
                    raw = f.read_at(min(8 * (last - first), max(0, f.size() - 100 - 8 * at)), 100 + 8 * at) if f.size() > 100 + 8 * at else b""
                places = np.frombuffer(raw, ">i4", len(raw) // 8 * 2).reshape(-1, 2).astype(np.int64) * 2
                tiles = []
                with store.open_input_file(f"{name}.adf") as f:
                    for offset, size in places.tolist():
                        tiles.append(f.read_at(size + 2, offset)[2:] if size else b"")
                yield row, first, tiles

    def read(self, partition: TileRange) -> Iterator[pa.RecordBatch]:
        g = self.grid
        kinds = {"raster_id": pa.string(), "row": pa.int32(), "col": pa.int32(), "value": pa.float64()}
        stored = {(row, first + k): data for row, first, tiles in self._runs(partition) for k, data in enumerate(tiles)}
        for row in range(partition.top, partition.bottom):
            for column in range(partition.left, partition.right):
                y, x = row * g.tile_height, column * g.tile_width
                r0, r1 = max(y, self.box.row[0]), min(y + g.tile_height, self.box.row[1] + 1, g.height)
                c0, c1 = max(x, self.box.col[0]), min(x + g.tile_width, self.box.col[1] + 1, g.width)
                if r0 >= r1 or c0 >= c1:
                    continue
                made = {}
                if "value" in self.wanted:
                    data = stored.get((row, column), b"")
                    v = tile_values(g, data)[r0 - y : r1 - y, c0 - x : c1 - x].ravel() if data else np.full((r1 - r0) * (c1 - c0), np.nan)
                    made["value"] = pa.array(v, from_pandas=True)
                made["row"] = pa.array(np.repeat(np.arange(r0, r1, dtype=np.int32), c1 - c0))
                made["col"] = pa.array(np.tile(np.arange(c0, c1, dtype=np.int32), r1 - r0))
                if "raster_id" in self.wanted:
                    made["raster_id"] = pa.array(np.full((r1 - r0) * (c1 - c0), g.folder), pa.string())
                yield pa.RecordBatch.from_arrays([made[c].cast(kinds[c]) for c in self.wanted], self.wanted)


class EsriGrid(DataSource):
    """``spark.read.format("esri_grid").load(folder)``; a schema with fewer columns builds only those.

    Options ``first_row``, ``last_row``, ``first_col`` and ``last_col`` name a box of cells.
    """

    @classmethod
    def name(cls) -> str:
        return "esri_grid"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> GridReader:
        box = Box()
        for span, names in ((box.row, ("first_row", "last_row")), (box.col, ("first_col", "last_col"))):
            for i, name in enumerate(names):
                if name in self.options:
                    span[i] = int(self.options[name])
        return GridReader(self.options["path"], schema.fieldNames(), box)


def grid_header(spark: SparkSession, folder: str) -> DataFrame:
    """One-row header of a grid (affine a to f, width, height, nodata, crs); the system comes from its prj.adf, if known."""
    g = read_grid(folder)
    store, root = _open(folder)
    crs = None
    if store.get_file_info(f"{root}/prj.adf").type != stores.FileType.NotFound:
        with store.open_input_stream(f"{root}/prj.adf") as f:
            code = crs_code(f.read().decode("latin-1"))
        crs = f"EPSG:{code}" if code else None
    return spark.createDataFrame([(folder, g.dx, 0.0, g.left, 0.0, -g.dy, g.top, g.width, g.height, None, crs)], HEADER)


def read_esri_grid(spark: SparkSession, folder: str, columns: tuple[str, ...] = ("raster_id", "row", "col", "value"), box: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, header) of a grid folder; missing cells have a null value, and raster_id is the folder.

    ``box`` (least x, least y, greatest x, greatest y) keeps the cells whose centre lies in it, borders included.
    ``columns`` are those that are built. Filters on row and col of the cells choose tiles as well.
    """
    spark.dataSource.register(EsriGrid)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    kinds = dict(part.split() for part in CELLS.split(", "))
    load = spark.read.format("esri_grid").schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    if box is not None:
        g = read_grid(folder)
        cut = ((box[0] - g.left) / g.dx - 0.5, (box[2] - g.left) / g.dx - 0.5, (g.top - box[3]) / g.dy - 0.5, (g.top - box[1]) / g.dy - 0.5)
        c0, c1, r0, r1 = (int(np.ceil(v - 1e-9)) if i % 2 == 0 else int(np.floor(v + 1e-9)) for i, v in enumerate(cut))
        load = load.options(first_row=max(0, r0), last_row=r1, first_col=max(0, c0), last_col=c1)
    return load.load(folder), grid_header(spark, folder)


def clip_esri_grid(spark: SparkSession, folder: str, polygons: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Cells of a grid whose centre lies in a polygon and the new header: only tiles under the layer's bounds are read."""
    from ..operators import raster, spatial

    b = spatial.total_bounds(polygons, key).first()
    if b["min_x"] is None:
        cells, header = read_esri_grid(spark, folder)
        return cells.limit(0), header.limit(0)
    cells, header = read_esri_grid(spark, folder, box=(b["min_x"], b["min_y"], b["max_x"], b["max_y"]))
    out, head = raster.clip(cells, header, polygons, key)
    return out, head.join(header.select("raster_id", "crs"), "raster_id")


def convert_and_clip(spark: SparkSession, folder: str, polygons: DataFrame, key: str, out: str) -> list[str]:
    """A grid folder clipped by a layer and written as GeoTIFF into the folder ``out``; the paths written, none where nothing meets."""
    from . import geotiff
    from .tables import _exists

    if not _exists(spark, folder):
        raise FileNotFoundError(folder)
    cells, head = clip_esri_grid(spark, folder, polygons, key)
    return geotiff.write_geotiffs(cells.select("raster_id", "row", "col", F.col("value")), head, out)
