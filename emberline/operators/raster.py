"""Rasters as cell tables (raster_id, row, col, value) with headers (a, b, c, d, e, f, width, height, nodata)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import row_mean, row_median
from .clean import null_constant_rows
from .spatial import point_in_polygon, reproject


def _located(points: DataFrame, headers: DataFrame, lat: str, lon: str) -> DataFrame:
    """Adds row and col of the cell that holds the point; NULL outside the raster."""
    col, row = F.floor((F.col(lon) - F.col("c")) / F.col("a")).cast("int"), F.floor((F.col(lat) - F.col("f")) / F.col("e")).cast("int")
    if "raster_id" in points.columns:
        d = points.join(headers, "raster_id", "left")
    elif headers.limit(2).count() == 1:
        d = points.crossJoin(F.broadcast(headers))  # one row
    else:
        raise ValueError("points without raster_id need exactly one raster")
    inside = col.between(0, F.col("width") - 1) & row.between(0, F.col("height") - 1)
    return d.withColumn("row", F.when(inside, row)).withColumn("col", F.when(inside, col))


def sample(points: DataFrame, cells: DataFrame, headers: DataFrame, out: str, lat: str = "latitude", lon: str = "longitude", nodata: bool = True) -> DataFrame:
    """Points with the value of the cell that holds them; nodata and outside give NULL (nodata only on request)."""
    d = _located(points, headers, lat, lon)
    d = d.join(cells.select("raster_id", "row", "col", "value"), ["raster_id", "row", "col"], "left")
    value = F.when(F.col("nodata").isNull() | (F.col("value") != F.col("nodata")), F.col("value")) if nodata else F.col("value")
    return d.select(*[c for c in points.columns if c != "raster_id"], value.alias(out))


def seasonal_climate(points: DataFrame, manifest: DataFrame, cells: DataFrame, headers: DataFrame, name: str, mode: str = "median", year: str = "year") -> DataFrame:
    """Four seasonal columns of each point, from the monthly rasters of its own year.

    Winter takes December of the same year. A missing raster, a nodata cell or a point outside
    leaves that month out; a season without any month is NULL. Any mode but median is the mean.
    """
    keys = ["latitude", "longitude", year]
    months = points.select(*keys).distinct().join(manifest.select(F.col("year").alias(year), "month", "raster_id"), year)
    d = _located(months, headers, "latitude", "longitude").join(cells, ["raster_id", "row", "col"])
    d = d.withColumn("v", F.when(F.col("nodata").isNull() | (F.col("value") != F.col("nodata")), F.col("value")))
    wide = d.groupBy(*keys).pivot("month", list(range(1, 13))).agg(F.first("v", ignorenulls=True))
    merge = row_median if mode == "median" else row_mean
    pick = lambda *m: merge(*[F.col(f"`{i}`") for i in m])
    seasons = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11)}
    got = wide.select(*keys, *[pick(*m).alias(f"{s}_{name}") for s, m in seasons.items()])
    return points.join(got, keys, "left")


def soil_attributes(points: DataFrame, cells: DataFrame, headers: DataFrame, attributes: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Points with the attributes of the soil unit under them; rows of one repeated value become NULL; the id goes."""
    ids = sample(points, cells, headers, key, nodata=False).withColumn(key, F.col(key).cast("int"))
    joined = ids.join(attributes.select(key, *features), key, "left")
    return null_constant_rows(joined, features).drop(key)


def to_points(cells: DataFrame, headers: DataFrame, name: str, keep_null: bool = False) -> DataFrame:
    """Cell centres with their values; rows without a value only on request."""
    d = cells.join(headers, "raster_id")
    value = F.when(F.col("nodata").isNull() | (F.col("value") != F.col("nodata")), F.col("value"))
    x = F.col("c") + F.col("a") * (F.col("col") + 0.5) + F.col("b") * (F.col("row") + 0.5)
    y = F.col("f") + F.col("d") * (F.col("col") + 0.5) + F.col("e") * (F.col("row") + 0.5)
    got = d.select("raster_id", "row", "col", x.alias("longitude"), y.alias("latitude"), value.alias(name))
    return got if keep_null else got.where(F.col(name).isNotNull())


def to_points_inside(cells: DataFrame, headers: DataFrame, polygons: DataFrame, key: str, name: str, source: int | None = None) -> DataFrame:
    """Cell centres in degrees that lie in a polygon, those without a value included; ``source`` is the rasters' EPSG code."""
    at = ["raster_id", "row", "col"]
    centres = reproject(to_points(cells, headers, name, keep_null=True), source)
    return centres.join(point_in_polygon(centres, polygons, at, key).select(*at).distinct(), at, "left_semi")


def clip(cells: DataFrame, headers: DataFrame, polygons: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Cells whose centre lies in a polygon, renumbered from the crop's corner, and the new headers.

    All rasters of the table are clipped in one job.
    """
    centres = to_points(cells, headers, "value", keep_null=True)
    inside = centres.join(point_in_polygon(centres, polygons, ["raster_id", "row", "col"], key).select("raster_id", "row", "col").distinct(), ["raster_id", "row", "col"], "left_semi")
    box = inside.groupBy("raster_id").agg(F.min("row").alias("r0"), F.min("col").alias("c0"), F.max("row").alias("r1"), F.max("col").alias("c1"))
    out = inside.join(box, "raster_id").select("raster_id", (F.col("row") - F.col("r0")).alias("row"), (F.col("col") - F.col("c0")).alias("col"), "value")
    head = headers.join(box, "raster_id").select(
        "raster_id", "a", "b", (F.col("c") + F.col("a") * F.col("c0") + F.col("b") * F.col("r0")).alias("c"), "d", "e", (F.col("f") + F.col("d") * F.col("c0") + F.col("e") * F.col("r0")).alias("f"),
        (F.col("c1") - F.col("c0") + 1).alias("width"), (F.col("r1") - F.col("r0") + 1).alias("height"), F.lit(None).cast("double").alias("nodata"),
    )
    return out, head


def recode(cells: DataFrame, attributes: DataFrame, key: str, column: str) -> DataFrame:
    """Cell ids replaced by an attribute; NULL where there is none."""
    a = attributes.select(F.col(key).alias("_k"), F.col(column).alias(column))
    return cells.join(a, F.col("value") == F.col("_k"), "left").select("raster_id", "row", "col", column)


def downsample(cells: DataFrame, factor: int) -> DataFrame:
    """Block means."""
    return cells.groupBy("raster_id", F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(F.avg("value").alias("value"))


def describe_raster(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Size, bounds and value statistics of each raster."""
    s = cells.groupBy("raster_id").agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))
    return headers.join(s, "raster_id", "left").select(
        "raster_id", "width", "height", F.col("c").alias("left"), F.col("f").alias("top"), (F.col("c") + F.col("a") * F.col("width")).alias("right"), (F.col("f") + F.col("e") * F.col("height")).alias("bottom"), "n", "min", "max", "mean",
    )


def mean_by_unit(layers: DataFrame, key: str) -> DataFrame:
    """Mean of every numeric column by integer key; other columns go."""
    from .profile import numeric_columns

    d = layers.withColumn(key, F.col(key).cast("int"))
    return d.groupBy(key).agg(*[F.avg(c).alias(c) for c in numeric_columns(d, exclude=(key,))])


def newest_by_month(files: DataFrame, path: str = "path") -> DataFrame:
    """(year, month, path) from names that end in _YYYY-MM (or are YYYY-MM); of several the last path wins."""
    name = F.regexp_extract(F.col(path), r"([^/]*?)(\.[^./]*)?$", 1)
    part = F.element_at(F.split(name, "_"), -1)
    d = files.select(F.col(path).alias("path"), part.alias("p")).where(F.col("p").rlike(r"^\d{4}-\d{2}$"))
    d = d.select(F.substring("p", 1, 4).cast("int").alias("year"), F.substring("p", 6, 2).cast("int").alias("month"), "path")
    return d.withColumn("_n", F.row_number().over(Window.partitionBy("year", "month").orderBy(F.desc("path")))).where("_n = 1").drop("_n")
