"""GeoTIFF round trips, and LZW against a small encoder."""

import numpy as np

from emberline.sources import geotiff


def pack_lzw(data: bytes) -> bytes:
    """Test encoder: codes of strings in first-seen order, widths as the format has them."""
    bits = ""
    table = {bytes([i]): i for i in range(256)}
    width, word = 9, b""
    put = lambda c: format(c, f"0{width}b")
    bits += put(256)
    for b in data:
        c = bytes([b])
        if word + c in table:
            word += c
            continue
        bits += put(table[word])
        table[word + c] = len(table) + 2
        width = 12 if len(table) + 2 >= 2047 + 1 else 11 if len(table) + 2 >= 1023 + 1 else 10 if len(table) + 2 >= 511 + 1 else 9
        if len(table) + 2 > 4093:
            bits += put(256)
            table, width = {bytes([i]): i for i in range(256)}, 9
        word = c
    if word:
        bits += put(table[word])
    bits += format(257, f"0{width}b")
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_lzw():
    for data in (b"", b"a", b"abababababab", bytes(range(256)) * 2):
        assert geotiff.unpack_lzw(pack_lzw(data)) == data


def test_bytes_round_trip():
    grid = np.arange(12.0).reshape(3, 4)
    grid[1, 2] = np.nan
    h = {"a": 0.5, "b": 0.0, "c": 2.0, "d": 0.0, "e": -0.5, "f": 36.0, "nodata": -9999.0, "crs": "EPSG:4326"}
    got, head = geotiff.decode(geotiff.encode(grid, h))
    assert head == h and got[1, 2] == -9999 and got[2, 3] == 11


def test_tables_round_trip(spark, tmp_path):
    cells = spark.range(600).selectExpr("'x' AS raster_id", "int(id div 20) AS row", "int(id % 20) AS col", "double(id) AS value")
    heads = spark.createDataFrame([("x", 1.0, 0.0, 0.0, 0.0, -1.0, 30.0, 20, 30, None, "EPSG:3857")], geotiff.HEADER)
    paths = geotiff.write_geotiffs(cells, heads, str(tmp_path))
    back, h = geotiff.read_geotiff(spark, paths)
    assert sorted((r["row"], r["col"], r["value"]) for r in back.collect()) == sorted((r["row"], r["col"], r["value"]) for r in cells.collect())
    head = h.first()
    assert (head["width"], head["height"], head["f"], head["crs"]) == (20, 30, 30.0, "EPSG:3857")
