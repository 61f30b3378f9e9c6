"""Spatial sources: ESRI shapefiles and band-interleaved (BIL) rasters, from their public formats.

Files are read by Spark (binaryFile), so any store will do; parsing runs on the executors.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POLYGONS = "shape_id int, rings array<array<struct<x:double,y:double>>>, attributes map<string,string>"


def parse_shp(data: bytes) -> Iterator[tuple[int, list[list[tuple[float, float]]]]]:
    """(record number, rings) of the polygons (types 5, 15, 25) and points (types 1, 11, 21) of a .shp file."""
    at = 100
    while at + 8 <= len(data):
        number, words = struct.unpack(">ii", data[at : at + 8])
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack("<i", body[:4])[0]
        if kind in (5, 15, 25, 3, 13, 23):
            parts, points = struct.unpack("<ii", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
            yield number, [[(float(x), float(y)) for x, y in xy[a:b]] for a, b in zip(starts, starts[1:], strict=False)]
        elif kind in (1, 11, 21):
            yield number, [[struct.unpack("<dd", body[4:20])]]
        else:
            yield number, []


def parse_dbf(data: bytes) -> list[dict[str, str | None]]:
    """Attribute rows of a .dbf file as texts; deleted rows stay, so that rows match shapes by position."""
    count, header, width = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    rows = []
    for i in range(count):
        record, at, row = data[header + i * width : header + (i + 1) * width], 1, {}
        for name, size in fields:
            row[name] = record[at : at + size].decode("latin-1").strip() or None
            at += size
        rows.append(row)
    return rows


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """(shape_id, rings, attributes, crs) of a .shp file with the .dbf and .prj beside it."""
    stem = path[:-4] if path.lower().endswith(".shp") else path
    files = spark.read.format("binaryFile").load([f"{stem}.shp", f"{stem}.dbf"]).select(F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("kind"), "content")
    one = files.groupBy(F.lit(1).alias("g")).pivot("kind", ["shp", "dbf"]).agg(F.first("content"))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shp, dbf in zip(frame["shp"], frame["dbf"], strict=True):
                rows = parse_dbf(bytes(dbf)) if dbf is not None else []
                shapes = list(parse_shp(bytes(shp)))
                yield pd.DataFrame(
                    {
                        "shape_id": [n for n, _ in shapes],
                        "rings": [[[{"x": x, "y": y} for x, y in ring] for ring in rings] for _, rings in shapes],
                        "attributes": [rows[n - 1] if n <= len(rows) else {} for n, _ in shapes],
                    }
                )

    from .tables import _exists

    crs = spark.read.text(f"{stem}.prj", wholetext=True).first()[0] if _exists(spark, f"{stem}.prj") else None
    return one.mapInPandas(parse, POLYGONS).withColumn("crs", F.lit(crs))


def crs_code(text: str | None) -> int | None:
    """EPSG code of a .prj side file, well-known text or the keyword lines of a grid's prj.adf; None where it is not known.

    The authority of the outermost system counts; without one, WGS 84 degrees, Web Mercator and
    the UTM zones of WGS 84 are known by name.
    """
    if not text or not text.strip():
        return None
    outer = re.search(r'(?:AUTHORITY\["EPSG",\s*"?(\d+)"?\]|ID\["EPSG",\s*(\d+)\])\s*\]\s*$', text.strip())
    if outer:
        return int(outer[1] or outer[2])
    flat = re.sub(r"[\s_]+", "", text).upper()
    if "WGS84" not in flat and "WGS1984" not in flat:
        return None
    name = re.match(r'(?:PROJCS|PROJCRS)\["([^"]*)"', flat)
    if name and ("MERCATORAUXILIARYSPHERE" in name[1] or "PSEUDO-MERCATOR" in name[1]):
        return 3857
    zone = re.search(r"UTMZONE(\d{1,2})([NS])", name[1]) if name else None
    lines = dict(p for line in text.upper().splitlines() if len(p := line.split(None, 1)) == 2)
    if lines.get("PROJECTION", "").strip() == "UTM" and lines.get("ZONE", "").strip().lstrip("-").isdecimal():
        number = int(lines["ZONE"])
        return (32700 if number < 0 else 32600) + abs(number)
    if zone:
        return (32600 if zone[2] == "N" else 32700) + int(zone[1])
    return 4326 if flat.startswith(("GEOGCS[", "GEOGCRS[")) or lines.get("PROJECTION", "").strip() == "GEOGRAPHIC" else None


def repair_crs(headers: DataFrame, prj: str | None) -> DataFrame:
    """Raster headers whose missing ``crs`` is taken from the text of a side file; a known one stays."""
    code = crs_code(prj)
    return headers.withColumn("crs", F.coalesce("crs", F.lit(f"EPSG:{code}" if code else None).cast("string")))


def encode_shapefile(shapes: list[tuple[list, dict]]) -> tuple[bytes, bytes, bytes]:
    """(.shp, .shx, .dbf) of polygons (rings of x and y, attributes); a shape without rings is a null shape.

    Attributes are texts of at most 254 bytes in Latin-1, and names are cut to ten bytes: values or names
    that do not fit, or that collide once cut, are refused.
    """
    at, index, whole, records = 100, b"", [], []
    for number, (rings, _) in enumerate(shapes, 1):
        xy = [p for ring in rings for p in ring]
        if xy:
            box = (min(p[0] for p in xy), min(p[1] for p in xy), max(p[0] for p in xy), max(p[1] for p in xy))
            whole.append(box)
            starts = [sum(len(r) for r in rings[:i]) for i in range(len(rings))]
            record = struct.pack("<i4d2i", 5, *box, len(rings), len(xy)) + struct.pack(f"<{len(starts)}i", *starts) + struct.pack(f"<{2 * len(xy)}d", *[v for p in xy for v in p])
        else:
            record = struct.pack("<i", 0)
        index += struct.pack(">ii", at // 2, len(record) // 2)
        records.append(struct.pack(">ii", number, len(record) // 2) + record)
        at += 8 + len(record)
    body = b"".join(records)
    bounds = (min(b[0] for b in whole), min(b[1] for b in whole), max(b[2] for b in whole), max(b[3] for b in whole)) if whole else (0.0,) * 4
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, 5, *bounds, *[0.0] * 4)
    names = sorted({n for _, a in shapes for n in a}) or ["id"]
    cut = [n.encode("latin-1")[:10] for n in names]
    if len(set(cut)) < len(cut):
        raise ValueError("attribute names collide in their first ten bytes")
    values = [[(a.get(n) or ("" if n != "id" or a else str(i))).encode("latin-1") for n in names] for i, (_, a) in enumerate(shapes, 1)]
    widths = [max([1, *[len(row[k]) for row in values]]) for k in range(len(names))]
    if max(widths) > 254:
        raise ValueError("an attribute is longer than 254 bytes")
    fields = b"".join(n.ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w, 0]) + b"\0" * 14 for n, w in zip(cut, widths, strict=True))
    dbf = bytes([3, 100, 1, 1]) + struct.pack("<IHH", len(shapes), 33 + len(fields), 1 + sum(widths)) + b"\0" * 20 + fields + b"\r"
    dbf += b"".join(b" " + b"".join(v.ljust(w) for v, w in zip(row, widths, strict=True)) for row in values) + b"\x1a"
    return head(100 + len(body)) + body, head(100 + len(index)) + index, dbf


def write_shapefile(polygons: DataFrame, path: str, most: int = 1_000_000) -> None:
    """A layer (rings, attributes, crs) as .shp, .shx, .dbf and .prj, rows by shape_id.

    The format is one file written in order, so its points pass the driver: layers of more than
    ``most`` points are refused; ``write_polygons`` has no such limit.
    """
    points = polygons.agg(F.sum(F.expr("aggregate(rings, 0L, (a, r) -> a + size(r))")), F.count("*")).first()
    if max(points[0] or 0, points[1]) > most:
        raise ValueError(f"more than {most} points; write the layer as Parquet")
    rows = polygons.orderBy("shape_id").collect()
    made = encode_shapefile([([[(p["x"], p["y"]) for p in ring] for ring in r["rings"] or []], r["attributes"] or {}) for r in rows])
    stem = path[:-4] if path.lower().endswith(".shp") else path
    files = dict(zip((".shp", ".shx", ".dbf"), made, strict=True))
    crs = next((r["crs"] for r in rows if r["crs"]), None) if "crs" in polygons.columns else None
    if crs:
        files[".prj"] = crs.encode()
    spark = polygons.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for ending, data in files.items():
        at = jvm.org.apache.hadoop.fs.Path(stem + ending)
        stream = at.getFileSystem(conf).create(at, True)
        stream.write(data)
        stream.close()


def write_polygons(polygons: DataFrame, path: str) -> None:
    """Polygon layers are stored as Parquet: rings, attributes and crs."""
    polygons.write.mode("overwrite").parquet(path)


def parse_header(text: str) -> dict[str, str]:
    return {p[0].upper(): p[1] for line in text.splitlines() if len(p := line.split()) >= 2}


def bil_header(spark: SparkSession, path: str, raster_id: str) -> DataFrame:
    """One-row header (affine a to f, width, height, nodata, crs) from a .hdr file."""
    h = parse_header(spark.read.text(path, wholetext=True).first()[0])
    width, height = int(h["NCOLS"]), int(h["NROWS"])
    dx, dy = float(h.get("XDIM", h.get("CELLSIZE", 1))), float(h.get("YDIM", h.get("CELLSIZE", 1)))
    left = float(h["ULXMAP"]) - dx / 2 if "ULXMAP" in h else float(h.get("XLLCORNER", 0))
    top = float(h["ULYMAP"]) + dy / 2 if "ULYMAP" in h else float(h.get("YLLCORNER", 0)) + height * dy
    nodata = float(h["NODATA"]) if "NODATA" in h else float(h["NODATA_VALUE"]) if "NODATA_VALUE" in h else None
    row = (raster_id, dx, 0.0, left, 0.0, -dy, top, width, height, nodata, None)
    return spark.createDataFrame([row], "raster_id string, a double, b double, c double, d double, e double, f double, width int, height int, nodata double, crs string")


def read_bil(spark: SparkSession, path: str, header_path: str, raster_id: str, band: int = 1) -> tuple[DataFrame, DataFrame]:
    """Cells of one band (raster_id, row, col, value) and the header.

    Rows of the raster are cut into byte ranges and read as fixed-length records, so a large
    file is read by many tasks.
    """
    h = parse_header(spark.read.text(header_path, wholetext=True).first()[0])
    bits, bands, width = int(h.get("NBITS", 8)), int(h.get("NBANDS", 1)), int(h["NCOLS"])
    kind = {"FLOAT": "f", "SIGNEDINT": "i"}.get(h.get("PIXELTYPE", "").upper(), "u")
    dtype = np.dtype(("<" if h.get("BYTEORDER", "I").upper() == "I" else ">") + kind + str(bits // 8))
    step = width * dtype.itemsize
    lines = spark.sparkContext.binaryRecords(path, step).zipWithIndex().filter(lambda r: r[1] % bands == band - 1).map(lambda r: (r[1] // bands, bytearray(r[0])))
    rows = spark.createDataFrame(lines, "row long, data binary")

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r, data in zip(frame["row"], frame["data"], strict=True):
                v = np.frombuffer(bytes(data), dtype).astype(float)
                yield pd.DataFrame({"raster_id": raster_id, "row": np.int32(r), "col": np.arange(len(v), dtype=np.int32), "value": v})

    return rows.mapInPandas(cells, "raster_id string, row int, col int, value double"), bil_header(spark, header_path, raster_id)


def raster_manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """(year, month, path) of the raster files that match a pattern."""
    from ..operators.raster import newest_by_month
    from .tables import list_files

    return newest_by_month(spark.createDataFrame([(p,) for p in list_files(spark, pattern)], "path string"))
