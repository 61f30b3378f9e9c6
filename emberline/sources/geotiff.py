"""GeoTIFF rasters as cell tables: a reader and a writer from the public TIFF 6.0 and GeoTIFF formats.

Files are read whole by Spark (binaryFile), one task a file, so a folder of rasters is one job
on any store. Supported: strips or tiles, no compression, LZW or deflate, the horizontal
predictor, integer and float samples, the affine transform, nodata and the EPSG code.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the TIFF format: field types with their sizes and struct codes.
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
HEADER = "raster_id string, a double, b double, c double, d double, e double, f double, width int, height int, nodata double, crs string"
CELLS = "raster_id string, row int, col int, value double"


def _tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the tags of the first image."""
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(f"{order}I", data[4:8])[0]
    out = {}
    for i in range(struct.unpack(f"{order}H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, count = struct.unpack(f"{order}HHI", entry[:8])
        if kind not in _TYPES:
            continue
        size, code = _TYPES[kind]
        where = entry[8:12] if size * count <= 4 else None
        raw = where[: size * count] if where else data[(p := struct.unpack(f"{order}I", entry[8:12])[0]) : p + size * count]
        out[tag] = (raw,) if kind == 2 else struct.unpack(f"{order}{count}{code}", raw)
    return order, out


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's variable-width LZW, most significant bit first."""
    clear, end = 256, 257
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, bits, held, width, last = bytearray(), 0, 0, 9, b""
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        while held >= width:
            code = bits >> (held - width) & ((1 << width) - 1)
            held -= width
            bits &= (1 << held) - 1
            if code == end:
                return bytes(out)
            if code == clear:
                del table[258:]
                width, last = 9, b""
                continue
            word = table[code] if code < len(table) else last + last[:1]
            out += word
            if last:
                table.append(last + word[:1])
            last = word
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def decode(data: bytes, band: int = 1) -> tuple[np.ndarray, dict]:
    """One band as an array of floats, and its header (affine a to f, nodata, crs)."""
    order, t = _tags(data)
    width, height = t[256][0], t[257][0]
    samples, planar = t.get(277, (1,))[0], t.get(284, (1,))[0]
    kind = {1: "u", 2: "i", 3: "f"}[t.get(339, (1,))[0]]
    dtype = np.dtype(f"{order}{kind}{t.get(258, (8,))[0] // 8}")
    each = samples if planar == 1 else 1
    tiled = 322 in t
    tw, th = (t[322][0], t[323][0]) if tiled else (width, min(t.get(278, (height,))[0], height))
    offsets, counts = (t[324], t[325]) if tiled else (t[273], t[279])
    across = -(-width // tw)
    per_band = across * -(-height // th)
    out = np.zeros((-(-height // th) * th, across * tw), float)
    first = (band - 1) * per_band if planar == 2 else 0
    for k in range(per_band):
        raw = data[offsets[first + k] : offsets[first + k] + counts[first + k]]
        packing = t.get(259, (1,))[0]
        if packing == 5:
            raw = unpack_lzw(raw)
        elif packing in (8, 32946):
            raw = zlib.decompress(raw)
        elif packing != 1:
            raise ValueError(f"TIFF compression {packing} is not supported")
        rows = min(th, len(raw) // (tw * each * dtype.itemsize))
        block = np.frombuffer(raw, dtype, rows * tw * each).reshape(rows, tw, each)
        if t.get(317, (1,))[0] == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        y, x = k // across * th, k % across * tw
        out[y : y + rows, x : x + tw] = block[:, :, band - 1 if planar == 1 else 0]
    a, b, c, d, e, f = 1.0, 0.0, 0.0, 0.0, -1.0, 0.0
    if 34264 in t:
        m = t[34264]
        a, b, c, d, e, f = m[0], m[1], m[3], m[4], m[5], m[7]
    elif 33550 in t and 33922 in t:
        (sx, sy), (i, j, _, x, y) = t[33550][:2], t[33922][:5]
        a, e, c, f = sx, -sy, x - i * sx, y + j * sy
    text = t.get(42113, (b"",))[0].rstrip(b"\0 ").decode("latin-1")
    keys = t.get(34735, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    epsg = codes.get(3072, codes.get(2048))
    return out[:height, :width], {"a": a, "b": b, "c": c, "d": d, "e": e, "f": f, "nodata": float(text) if text else None, "crs": f"EPSG:{epsg}" if epsg else None}


def encode(values: np.ndarray, header: dict) -> bytes:
    """A one-band 64-bit float GeoTIFF with deflated strips; missing values are written as nodata."""
    nodata = header.get("nodata")
    fill = nodata if nodata is not None else float("nan")
    grid = np.where(np.isnan(values), fill, values).astype("<f8")
    height, width = grid.shape
    rows = max(1, 65536 // max(1, 8 * width))
    strips = [zlib.compress(grid[y : y + rows].tobytes()) for y in range(0, height, rows)]
    place, offsets = 8, []
    for s in strips:
        offsets.append(place)
        place += len(s)
    text = (f"{fill!r}" if nodata is not None else "nan").encode() + b"\0"
    code = int(str(header.get("crs") or "EPSG:4326").rsplit(":", 1)[-1])
    geographic = code == 4326
    keys = (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, code)
    matrix = (header["a"], header["b"], 0.0, header["c"], header["d"], header["e"], 0.0, header["f"], *[0.0] * 4, 0.0, 0.0, 0.0, 1.0)
    fields = [
        (256, 4, (width,)), (257, 4, (height,)), (258, 3, (64,)), (259, 3, (8,)), (262, 3, (1,)), (273, 4, tuple(offsets)), (277, 3, (1,)), (278, 4, (rows,)), (279, 4, tuple(map(len, strips))),
        (339, 3, (3,)), (34264, 12, matrix), (34735, 3, keys), (42113, 2, text),
    ]
    body = b"".join(strips)
    extra_at = place + 2 + 12 * len(fields) + 4
    entries, extra = b"", b""
    for tag, kind, v in fields:
        raw = v if kind == 2 else struct.pack(f"<{len(v)}{_TYPES[kind][1]}", *v)
        if len(raw) <= 4:
            entries += struct.pack("<HHI", tag, kind, len(v)) + raw.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", tag, kind, len(v), extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    return b"II*\0" + struct.pack("<I", place) + body + struct.pack("<H", len(fields)) + entries + b"\0" * 4 + extra


def _decoded(frame: pd.DataFrame, band: int, skip_broken: bool) -> Iterator[tuple[str, np.ndarray, dict]]:
    for path, data in zip(frame["path"], frame["content"], strict=True):
        try:
            yield path, *decode(bytes(data), band)
        except (ValueError, KeyError, IndexError, struct.error, zlib.error):
            if not skip_broken:
                raise


def read_geotiff(spark: SparkSession, paths: str | list[str], band: int = 1, skip_broken: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cells, headers) of all files of some paths or patterns; raster_id is the path.

    With ``skip_broken`` files that can't be decoded give no rows instead of an error.
    """
    files = spark.read.format("binaryFile").load(paths)

    def heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, grid, h in _decoded(frame, band, skip_broken):
                yield pd.DataFrame([{"raster_id": path, **h, "width": grid.shape[1], "height": grid.shape[0]}])[["raster_id", *"abcdef", "width", "height", "nodata", "crs"]]

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, grid, _ in _decoded(frame, band, skip_broken):
                for y in range(0, len(grid), 256):
                    part = grid[y : y + 256]
                    r, c = np.indices(part.shape, np.int32)
                    yield pd.DataFrame({"raster_id": path, "row": r.ravel() + np.int32(y), "col": c.ravel(), "value": part.ravel()})

    content = files.select("path", "content")
    d = content.mapInPandas(cells, CELLS).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    return d, content.mapInPandas(heads, HEADER)


def encode_rasters(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(raster_id, content): each raster of a cell table as the bytes of a GeoTIFF, one task a raster."""
    rows = cells.join(headers, "raster_id")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        h = frame.iloc[0]
        grid = np.full((int(h["height"]), int(h["width"])), np.nan)
        grid[frame["row"].to_numpy(int), frame["col"].to_numpy(int)] = frame["value"].to_numpy(float)
        head = {k: (None if pd.isna(h[k]) else h[k]) for k in (*"abcdef", "nodata", "crs")}
        return pd.DataFrame({"raster_id": [h["raster_id"]], "content": [encode(grid, head)]})

    return rows.groupBy("raster_id").applyInPandas(build, "raster_id string, content binary")


def write_geotiffs(cells: DataFrame, headers: DataFrame, folder: str) -> list[str]:
    """One .tif for each raster, on any file system that Spark writes; one raster at a time passes the driver."""
    jvm = cells.sparkSession.sparkContext._jvm
    conf = cells.sparkSession.sparkContext._jsc.hadoopConfiguration()
    out = []
    for r in encode_rasters(cells, headers).toLocalIterator():
        name = r["raster_id"].rsplit("/", 1)[-1]
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name if name.endswith('.tif') else name + '.tif'}")
        stream = path.getFileSystem(conf).create(path, True)
        stream.write(r["content"])
        stream.close()
        out.append(path.toString())
    return out
