"""ESRI GRID folders written here by the published description: cells, boxes, tile kinds, clipping."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import spatial
from emberline.sources import esrigrid, geo, geotiff

NO = esrigrid.NO_INTEGER


def coded(cells, kind):
    """One integer tile: kind, least cell, body."""
    present = cells[cells != NO]
    least = int(present.min()) if len(present) else 0
    head = bytes([kind, 4]) + struct.pack(">i", least)
    gap = cells - least
    if kind == 0x00:
        return head
    if kind == 0x01:
        return head + np.packbits(gap.astype(np.uint8)).tobytes()
    if kind == 0x04:
        return head + (gap[::2] * 16 + gap[1::2]).astype(np.uint8).tobytes()
    if kind in (0x08, 0x10):
        return head + gap.astype(f">u{kind // 8}").tobytes()
    if kind == 0x20:
        return bytes([kind, 0]) + cells.astype(">i4").tobytes()
    body, i = b"", 0
    if kind in (0xE0, 0xF0, 0xF8, 0xFC):
        width = {0xE0: 4, 0xF0: 2, 0xF8: 1, 0xFC: 1}[kind]
        while i < len(cells):
            j = i
            while j < len(cells) and cells[j] == cells[i] and j - i < 255:
                j += 1
            body += bytes([j - i]) + int(gap[i]).to_bytes(width, "big")
            i = j
        return head + body
    width = {0xCF: 2, 0xD7: 1, 0xDF: 0}[kind]
    while i < len(cells):
        j, missing = i, cells[i] == NO
        while j < len(cells) and (cells[j] == NO) == missing and j - i < 127:
            j += 1
        body += bytes([256 - (j - i)]) if missing else bytes([j - i]) + b"".join(int(g).to_bytes(width, "big") for g in gap[i:j] if width)
        i = j
    return head + body


def write_grid(folder, values, integer, kind=0x20, tile=(8, 4), sheet=(3, 2), left=2.0, top=36.0, step=0.25, packed=True):
    """A grid of ``values`` (NaN: missing); ``kind`` is a tile kind or a function of (row, col) of a tile."""
    folder.mkdir()
    height, width = values.shape
    (tw, th), (across, down) = tile, sheet
    head = bytearray(308)
    head[:8] = b"GRID1.2\0"
    head[16:24] = struct.pack(">2i", 1 if integer else 2, 0 if integer and packed else 1)
    head[256:272] = struct.pack(">2d", step, step)
    head[288:308] = struct.pack(">5i", across, down, tw, 1, th)
    (folder / "hdr.adf").write_bytes(bytes(head))
    (folder / "dblbnd.adf").write_bytes(struct.pack(">4d", left, top - height * step, left + width * step, top))
    places = {}
    for sy in range(-(-height // (th * down))):
        for sx in range(-(-width // (tw * across))):
            data, index = bytearray(100), bytearray(100)
            for y in range(down):
                for x in range(across):
                    r, c = (sy * down + y) * th, (sx * across + x) * tw
                    part = values[r : r + th, c : c + tw]
                    if not part.size or np.isnan(part).all():
                        index += struct.pack(">2i", 0, 0)
                        continue
                    block = np.full((th, tw), np.nanmin(part))  # cells beyond the edge mean nothing
                    block[: part.shape[0], : part.shape[1]] = part
                    flat = block.ravel()
                    if not integer:
                        raw = np.where(np.isnan(flat), np.float32(esrigrid.NO_FLOAT), flat).astype(">f4").tobytes()
                    elif packed:
                        raw = coded(np.where(np.isnan(flat), NO, flat).astype(np.int64), kind(r // th, c // tw) if callable(kind) else kind)
                    else:
                        raw = np.where(np.isnan(flat), NO, flat).astype(">i4").tobytes()
                    raw += b"\0" * (len(raw) % 2)
                    index += struct.pack(">2i", len(data) // 2, len(raw) // 2)
                    places[r // th, c // tw] = (esrigrid.sheet_name(sx, sy), len(data) + 2, len(raw))
                    data += struct.pack(">H", len(raw) // 2) + raw
            name = esrigrid.sheet_name(sx, sy)
            (folder / f"{name}.adf").write_bytes(bytes(data))
            (folder / f"{name}x.adf").write_bytes(bytes(index))
    return places


def as_table(values):
    return {(r, c): (None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(values)}


def read_back(cells):
    rows = cells.collect()
    assert len({(r["row"], r["col"]) for r in rows}) == len(rows)
    return {(r["row"], r["col"]): r["value"] for r in rows}


@pytest.mark.parametrize("kind", [0x00, 0x01, 0x04, 0x08, 0x10, 0x20, 0xE0, 0xF0, 0xF8, 0xFC, 0xCF, 0xD7, 0xDF])
def test_tile_kinds(kind):
    rng = np.random.default_rng(kind)
    span = {0x00: 1, 0xDF: 1, 0x01: 2, 0x04: 16, 0x08: 256, 0xF8: 256, 0xFC: 256, 0xD7: 256}.get(kind, 60_000)
    cells = np.repeat(rng.integers(0, span, 64), rng.integers(1, 9, 64))[:256] - 77
    cells = np.resize(cells, 256)
    if kind in (0x20, 0xCF, 0xD7, 0xDF):
        cells[rng.random(256) < 0.3] = NO
    got = esrigrid.unpack_tile(coded(cells, kind), 256)
    assert np.array_equal(got, np.where(cells == NO, np.nan, cells), equal_nan=True)


def test_unknown_kind_is_refused():
    with pytest.raises(ValueError, match="0xff"):
        esrigrid.unpack_tile(bytes([0xFF, 0]), 4)


def test_same_cells_as_bil(spark, tmp_path):
    rng = np.random.default_rng(1)
    values = rng.integers(-50, 200, (23, 61)).astype(float)
    kinds = [0x08, 0x10, 0x20, 0xE0, 0xCF, 0xD7]
    write_grid(tmp_path / "grid", values, True, lambda r, c: kinds[(r + c) % len(kinds)])
    values.astype("<i2").tofile(tmp_path / "a.bil")
    (tmp_path / "a.hdr").write_text("NROWS 23\nNCOLS 61\nNBITS 16\nPIXELTYPE SIGNEDINT\nBYTEORDER I\nULXMAP 2.125\nULYMAP 35.875\nXDIM 0.25\nYDIM 0.25\n")
    cells, header = esrigrid.read_esri_grid(spark, str(tmp_path / "grid"))
    other, head = geo.read_bil(spark, str(tmp_path / "a.bil"), str(tmp_path / "a.hdr"), "a")
    assert read_back(cells) == read_back(other) == as_table(values)
    same = lambda h: {k: v for k, v in h.first().asDict().items() if k != "raster_id"}
    assert same(header) == same(head)


def test_floats_plain_integers_and_missing_tiles(spark, tmp_path):
    values = np.arange(11 * 30, dtype=float).reshape(11, 30) / 2
    values[2:9, 5:27] = np.nan
    write_grid(tmp_path / "f", values, False)
    write_grid(tmp_path / "i", np.floor(values), True, packed=False)
    assert read_back(esrigrid.read_esri_grid(spark, str(tmp_path / "f"))[0]) == as_table(values)
    assert read_back(esrigrid.read_esri_grid(spark, f"file://{tmp_path}/i")[0]) == as_table(np.floor(values))
    (tmp_path / "f" / "w001001.adf").unlink()
    gone = {k: (None if k[0] < 8 and k[1] < 24 else v) for k, v in as_table(values).items()}
    assert read_back(esrigrid.read_esri_grid(spark, str(tmp_path / "f"))[0]) == gone


def spoiled(folder, places, keep):
    """Overwrites all tiles but some with a kind that cannot be decoded."""
    for at, (name, offset, size) in places.items():
        if at not in keep:
            raw = bytearray((folder / f"{name}.adf").read_bytes())
            raw[offset : offset + size] = b"\x99" * size
            (folder / f"{name}.adf").write_bytes(bytes(raw))


def test_box_reads_only_its_tiles(spark, tmp_path):
    values = np.arange(24 * 64, dtype=float).reshape(24, 64)
    places = write_grid(tmp_path / "g", values, True)
    spoiled(tmp_path / "g", places, {(1, 2), (1, 3), (2, 2), (2, 3)})
    whole = as_table(values)
    cells, header = esrigrid.read_esri_grid(spark, str(tmp_path / "g"))
    by_filter = cells.where("row >= 5 AND row < 10 AND col > 17 AND col <= 30")
    assert read_back(by_filter) == {k: v for k, v in whole.items() if 5 <= k[0] < 10 and 17 < k[1] <= 30}
    assert read_back(cells.where("row = 6 AND col = 20 AND value > 0")) == {(6, 20): whole[6, 20]}
    assert read_back(cells.where("row > 9 AND row < 3")) == {}
    # centres at 2.125 + 0.25 * col and 35.875 - 0.25 * row
    boxed, _ = esrigrid.read_esri_grid(spark, str(tmp_path / "g"), box=(6.125, 33.125, 9.0, 34.625))
    assert read_back(boxed) == {k: v for k, v in whole.items() if 5 <= k[0] <= 11 and 16 <= k[1] <= 27}
    with pytest.raises(Exception, match="0x99"):
        cells.where("row < 3").collect()


def test_columns_that_are_not_asked_for(spark, tmp_path):
    values = np.ones((6, 20))
    places = write_grid(tmp_path / "g", values, True)
    spoiled(tmp_path / "g", places, set())
    cells, _ = esrigrid.read_esri_grid(spark, str(tmp_path / "g"), ("row", "col"))
    assert cells.columns == ["row", "col"] and cells.count() == 120


def test_many_partitions(spark, tmp_path, monkeypatch):
    values = np.random.default_rng(3).random((50, 40)).astype(np.float32).astype(float)
    write_grid(tmp_path / "g", values, False)
    reader = esrigrid.GridReader(str(tmp_path / "g"), ["row", "col", "value"], esrigrid.Box())
    monkeypatch.setattr(esrigrid, "PART", 200)
    parts = reader.partitions()
    assert len(parts) == 13
    got = {(r, c): v for p in parts for b in reader.read(p) for r, c, v in zip(*(x.to_pylist() for x in b.columns), strict=True)}
    assert got == as_table(values)


def test_convert_and_clip(spark, tmp_path):
    values = np.arange(24 * 64, dtype=float).reshape(24, 64)
    values[6, 20] = np.nan
    places = write_grid(tmp_path / "g", values, True)
    spoiled(tmp_path / "g", places, {(1, 2), (1, 3), (2, 2), (2, 3)})
    (tmp_path / "g" / "prj.adf").write_text("Projection    GEOGRAPHIC\nDatum         WGS84\nUnits         DD\n")
    ring = [(6.05, 33.2), (9.3, 33.2), (9.3, 34.7), (6.05, 34.7)]
    polygons = spark.createDataFrame([(1, [[{"x": x, "y": y} for x, y in ring]])], f"pid int, rings {spatial.RINGS}")
    (path,) = esrigrid.convert_and_clip(spark, str(tmp_path / "g"), polygons, "pid", str(tmp_path / "out"))
    cells, header = geotiff.read_geotiff(spark, path)
    x, y = 2.125 + 0.25 * np.arange(64), 35.875 - 0.25 * np.arange(24)
    cols, rows = np.flatnonzero((x > 6.05) & (x < 9.3)), np.flatnonzero((y > 33.2) & (y < 34.7))
    assert read_back(cells) == as_table(values[np.ix_(rows, cols)])
    h = header.first()
    assert (h["c"], h["f"], h["crs"], h["width"], h["height"]) == (2.0 + 0.25 * cols[0], 36.0 - 0.25 * rows[0], "EPSG:4326", len(cols), len(rows))
    far = polygons.withColumn("rings", F.expr("transform(rings, r -> transform(r, p -> named_struct('x', p.x + 100, 'y', p.y)))"))
    assert esrigrid.convert_and_clip(spark, str(tmp_path / "g"), far, "pid", str(tmp_path / "none")) == []
    with pytest.raises(FileNotFoundError):
        esrigrid.convert_and_clip(spark, str(tmp_path / "nowhere"), polygons, "pid", str(tmp_path / "none"))
