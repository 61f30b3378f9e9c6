"""Points, grids and polygons: bucketed equi-joins with exact residual tests.

A polygon layer is a table with an id and ``rings``: array of rings, each an array of struct
(x, y). Even-odd counting over all rings handles holes and multi-polygons alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"


def grid_points(spark: SparkSession, min_x: float, min_y: float, max_x: float, max_y: float, step: float, min_lat: float | None = None, max_lat: float | None = None) -> DataFrame:
    """(longitude, latitude) of a regular grid, both ends included; an inclusive latitude band on request."""
    nx, ny = (int((b - a + 1e-12) / step) + 1 for a, b in ((min_x, max_x), (min_y, max_y)))
    cells = spark.range(nx * ny).select((F.col("id") % nx).alias("i"), F.floor(F.col("id") / nx).alias("j"))
    got = cells.select((F.lit(min_x) + F.col("i") * step).alias("longitude"), (F.lit(min_y) + F.col("j") * step).alias("latitude"))
    if min_lat is not None:
        got = got.where(F.col("latitude") >= min_lat)
    if max_lat is not None:
        got = got.where(F.col("latitude") <= max_lat)
    return got


def edges(polygons: DataFrame, key: str) -> DataFrame:
    """(key, x1, y1, x2, y2) of all ring edges; an open ring is closed."""
    ring = polygons.select(key, F.explode("rings").alias("r")).where("size(r) > 0")
    ring = ring.withColumn("r", F.expr("if(r[0] = r[size(r) - 1], r, concat(r, array(r[0])))"))
    pair = ring.select(key, F.explode(F.expr("transform(sequence(1, greatest(size(r) - 1, 1)), i -> struct(r[i - 1] as a, r[least(i, size(r) - 1)] as b))")).alias("e"))
    return pair.select(key, F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def bounds(polygons: DataFrame, key: str) -> DataFrame:
    """Bounding box of each polygon."""
    e = edges(polygons, key)
    return e.groupBy(key).agg(F.min(F.least("x1", "x2")).alias("min_x"), F.min(F.least("y1", "y2")).alias("min_y"), F.max(F.greatest("x1", "x2")).alias("max_x"), F.max(F.greatest("y1", "y2")).alias("max_y"))


def total_bounds(polygons: DataFrame, key: str) -> DataFrame:
    return bounds(polygons, key).agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


def _on_edge(x: Column, y: Column) -> Column:
    cross = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) - (F.col("y2") - F.col("y1")) * (x - F.col("x1"))
    return (cross == 0) & x.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & y.between(F.least("y1", "y2"), F.greatest("y1", "y2"))


def point_in_polygon(points: DataFrame, polygons: DataFrame, point: list[str], key: str, x: str = "longitude", y: str = "latitude", boundary: bool = True) -> DataFrame:
    """(point columns, key) for each point in each polygon; the boundary counts as inside if ``boundary``.

    Edges are dealt to horizontal strips (half the mean edge height at least), and a point meets
    only the edges of its own strip, which are all that its ray to the right can cross.
    ``point`` must identify a point.
    """
    e = edges(polygons, key)
    height = e.agg(F.avg(F.abs(F.col("y2") - F.col("y1"))).alias("h")).first()["h"] or 1.0
    strip = max(height, 1e-9)
    low, high = F.floor(F.least("y1", "y2") / strip), F.floor(F.greatest("y1", "y2") / strip)
    dealt = e.withColumn("_strip", F.explode(F.sequence(low, high)))
    p = points.select(*point, F.col(x).alias("_x"), F.col(y).alias("_y")).dropDuplicates(point).withColumn("_strip", F.floor(F.col("_y") / strip))
    px, py = F.col("_x"), F.col("_y")
    crosses = ((F.col("y1") > py) != (F.col("y2") > py)) & (px < (F.col("x2") - F.col("x1")) * (py - F.col("y1")) / F.when(F.col("y2") != F.col("y1"), F.col("y2") - F.col("y1")) + F.col("x1"))
    hits = p.join(dealt, "_strip").groupBy(*point, key).agg(F.sum(F.coalesce(crosses, F.lit(False)).cast("int")).alias("_n"), F.max(_on_edge(px, py)).alias("_edge"))
    inside = (F.col("_n") % 2 == 1) | F.col("_edge") if boundary else (F.col("_n") % 2 == 1) & ~F.col("_edge")
    return hits.where(inside).select(*point, key)


def spatial_join(points: DataFrame, polygons: DataFrame, point: list[str], key: str, attributes: list[str], how: str = "left", **where) -> DataFrame:
    """Points with the attributes of the polygons that hold them; a point in two polygons appears twice."""
    hits = point_in_polygon(points, polygons, point, key, **where)
    named = hits.join(polygons.select(key, *[a for a in attributes if a != key]), key).select(*point, *attributes)
    return points.join(named, point, how)


def within_union(points: DataFrame, polygons: DataFrame, point: list[str], key: str, **where) -> DataFrame:
    """Points strictly inside at least one polygon, each once."""
    return points.join(point_in_polygon(points, polygons, point, key, boundary=False, **where).select(*point).distinct(), point, "left_semi")


def nearest_point(points: DataFrame, grid: DataFrame, step: float, origin: tuple[float, float]) -> DataFrame:
    """``points`` with near_latitude, near_longitude: the nearest grid row, smaller latitude then longitude on ties.

    Search in square rings of grid buckets: a point whose best candidate lies within ring r is
    settled; the rest go on to a ring twice as wide, until all are settled.
    """
    spark = points.sparkSession
    y0, x0 = origin
    index = lambda lat, lon: (F.floor((F.col(lat) - y0) / step), F.floor((F.col(lon) - x0) / step))
    gi, gj = index("latitude", "longitude")
    cells = grid.select(F.col("latitude").alias("near_latitude"), F.col("longitude").alias("near_longitude"), gi.alias("gi"), gj.alias("gj"))
    open_ = points.select("latitude", "longitude").dropna().distinct()
    settled, reach = None, 1
    span = grid.agg(F.min("latitude"), F.max("latitude"), F.min("longitude"), F.max("longitude")).first()
    if span[0] is None:
        return points.withColumn("near_latitude", F.lit(None).cast("double")).withColumn("near_longitude", F.lit(None).cast("double"))
    box = points.agg(F.min("latitude"), F.max("latitude"), F.min("longitude"), F.max("longitude")).first()
    extent = max(abs(a - b) for a in (*span[:2], *(v for v in box[:2] if v is not None)) for b in span[:2]) + max(abs(a - b) for a in (*span[2:], *(v for v in box[2:] if v is not None)) for b in span[2:])
    while True:
        width = step * reach
        pi, pj = F.floor((F.col("latitude") - y0) / width), F.floor((F.col("longitude") - x0) / width)
        probe = open_.select("latitude", "longitude", pi.alias("bi"), pj.alias("bj"))
        probe = probe.withColumn("di", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dj", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
        probe = probe.select("latitude", "longitude", (F.col("bi") + F.col("di")).alias("bi"), (F.col("bj") + F.col("dj")).alias("bj"))
        placed = cells.withColumn("bi", F.floor((F.col("near_latitude") - y0) / width)).withColumn("bj", F.floor((F.col("near_longitude") - x0) / width))
        dy, dx = F.col("near_latitude") - F.col("latitude"), F.col("near_longitude") - F.col("longitude")
        d = dy * dy + dx * dx
        best = probe.join(placed, ["bi", "bj"]).groupBy("latitude", "longitude").agg(F.min(F.struct(d.alias("d"), "near_latitude", "near_longitude")).alias("b"))
        done = best.where(F.col("b.d") <= width * width).select("latitude", "longitude", "b.near_latitude", "b.near_longitude")
        settled = done if settled is None else settled.union(done)
        if width > extent:
            break
        open_ = open_.join(done, ["latitude", "longitude"], "left_anti")
        if open_.isEmpty():
            break
        reach *= 4
    return points.join(settled, ["latitude", "longitude"], "left")


def hexbin(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Rows by hexagon (axial coordinates q, r) of a flat grid of the given size."""
    q = F.col(x) * (3**0.5 / 3 / size) - F.col(y) / (3 * size)
    r = F.col(y) * (2 / 3 / size)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(q.alias("fq"), r.alias("fr")).withColumn("fs", -F.col("fq") - F.col("fr"))
    d = d.select("*", *[F.floor(F.col(f) + 0.5).alias(i) for f, i in (("fq", "q"), ("fr", "r"), ("fs", "s"))])
    d = d.select("*", *[F.abs(F.col(i) - F.col(f)).alias(e) for f, i, e in (("fq", "q", "eq"), ("fr", "r", "er"), ("fs", "s", "es"))])
    q2 = F.when((F.col("eq") > F.col("er")) & (F.col("eq") > F.col("es")), -F.col("r") - F.col("s")).otherwise(F.col("q"))
    r2 = F.when((F.col("eq") > F.col("er")) & (F.col("eq") > F.col("es")), F.col("r")).when(F.col("er") > F.col("es"), -F.col("q") - F.col("s")).otherwise(F.col("r"))
    return d.groupBy(q2.alias("q"), r2.alias("r")).agg(F.count("*").alias("n"))


def kde_2d(df: DataFrame, x: str, y: str, mesh: int = 20, adjust: float = 0.5) -> DataFrame:
    """Product Gaussian density on a mesh of fixed size (the broadcast side), Scott bandwidths."""
    ends = df.agg(*[f(c).alias(f"{n}{s}") for c, n in ((x, "x"), (y, "y")) for f, s in ((F.min, "lo"), (F.max, "hi"), (F.stddev_samp, "sd"))], F.count("*").alias("n"))
    ends = ends.withColumn("b", F.pow(F.col("n").cast("double"), F.lit(-1 / 6)) * adjust)
    cells = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(mesh - 1))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(mesh - 1))).alias("j"))
    cells = cells.select("i", "j", "n", F.expr("xsd * b").alias("hx"), F.expr("ysd * b").alias("hy"), F.expr(f"xlo + i * (xhi - xlo) / {mesh - 1}").alias("mx"), F.expr(f"ylo + j * (yhi - ylo) / {mesh - 1}").alias("my"))
    pairs = df.select(F.col(x).alias("px"), F.col(y).alias("py")).crossJoin(F.broadcast(cells))
    kernel = F.sum(F.expr("exp(-0.5 * (power((mx - px) / hx, 2) + power((my - py) / hy, 2)))"))
    return pairs.groupBy("i", "j").agg((kernel / F.first(F.expr("n * hx * hy * 6.283185307179586"))).alias("density"))


def concat_layers(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def north_of(polygons: DataFrame, key: str, latitude: float) -> DataFrame:
    """Polygons cut to the part at or north of a latitude (Sutherland-Hodgman against one line); empty ones go.

    Each ring is walked once by an aggregate over its closed vertex list.
    """
    y = f"{latitude}D"
    ring = f"""transform(filter(rings, r -> size(r) > 2), r -> aggregate(sequence(0, size(r) - 1), cast(array() as array<struct<x:double,y:double>>), (a, i) -> concat(a,
        if((r[i].y >= {y}) <> (r[if(i = 0, size(r) - 1, i - 1)].y >= {y}),
           array(struct(r[i].x + (r[if(i = 0, size(r) - 1, i - 1)].x - r[i].x) * ({y} - r[i].y) / (r[if(i = 0, size(r) - 1, i - 1)].y - r[i].y) as x, {y} as y)),
           cast(array() as array<struct<x:double,y:double>>)),
        if(r[i].y >= {y}, array(struct(r[i].x as x, r[i].y as y)), cast(array() as array<struct<x:double,y:double>>)))))"""
    open_ring = "transform(rings, r -> if(size(r) > 1 and r[0] = r[size(r) - 1], slice(r, 1, size(r) - 1), r))"
    d = polygons.withColumn("rings", F.expr(open_ring)).withColumn("rings", F.expr(ring)).withColumn("rings", F.expr("filter(rings, r -> size(r) > 2)"))
    return d.where("size(rings) > 0").select(*polygons.columns)


def web_mercator(x: Column, y: Column, inverse: bool = False) -> tuple[Column, Column]:
    """Degrees (EPSG 4326) to metres (EPSG 3857), or back."""
    radius = 6378137.0
    if inverse:
        return F.degrees(x / radius), F.degrees(2 * F.atan(F.exp(y / radius)) - F.lit(1.5707963267948966))
    return F.radians(x) * radius, F.log(F.tan(F.lit(0.7853981633974483) + F.radians(y) / 2)) * radius


def utm(x: Column, y: Column, code: int, inverse: bool = False) -> tuple[Column, Column]:
    """Degrees to metres of a UTM zone of WGS 84, or back: the transverse Mercator series in the third flattening, to its third power."""
    flat = 1 / 298.257223563
    n = flat / (2 - flat)
    scale = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    middle, north = math.radians(6 * (code % 100) - 183), 1e7 if code // 100 == 327 else 0.0
    k = 2 * math.sqrt(n) / (1 + n)
    if not inverse:
        s, far = F.sin(F.radians(y)), F.radians(x) - middle
        t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
        u, v = F.atan2(t, F.cos(far)), F.atanh(F.sin(far) / F.sqrt(1 + t * t))
        terms = list(enumerate((n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3), 1))
        east = v + sum(a * F.cos(2 * j * u) * F.sinh(2 * j * v) for j, a in terms)
        up = u + sum(a * F.sin(2 * j * u) * F.cosh(2 * j * v) for j, a in terms)
        return scale * east + 500000.0, scale * up + north
    u, v = (y - north) / scale, (x - 500000.0) / scale
    terms = list(enumerate((n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3, n**2 / 48 + n**3 / 15, 17 / 480 * n**3), 1))
    up = u - sum(b * F.sin(2 * j * u) * F.cosh(2 * j * v) for j, b in terms)
    east = v - sum(b * F.cos(2 * j * u) * F.sinh(2 * j * v) for j, b in terms)
    chi = F.asin(F.sin(up) / F.cosh(east))
    lat = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate((2 * n - 2 / 3 * n**2 - 2 * n**3, 7 / 3 * n**2 - 8 / 5 * n**3, 56 / 15 * n**3), 1))
    return F.degrees(F.atan2(F.sinh(east), F.cos(up)) + middle), F.degrees(lat)


def by_country(polygons: DataFrame, codes: list[str], column: str = "ISO3") -> DataFrame:
    """Polygons of some countries, by their ISO 3166 alpha-3 code in a column or among the attributes; letter case does not matter."""
    code = F.col(column) if column in polygons.columns else F.col("attributes")[column]
    return polygons.where(F.upper(F.trim(code)).isin([c.strip().upper() for c in codes]))


def reproject(df: DataFrame, source: int | None, target: int = 4326, x: str = "longitude", y: str = "latitude") -> DataFrame:
    """Coordinates from one EPSG code to another, by way of degrees; a missing code counts as 4326.

    Known are 4326, 3857 and the UTM zones of WGS 84 (32601 to 32660 and 32701 to 32760); others are refused.
    """
    source = source or 4326
    for code in (source, target):
        if code not in (4326, 3857) and not (code // 100 in (326, 327) and 1 <= code % 100 <= 60):
            raise ValueError(f"no conversion from {source} to {target}")
    if source == target:
        return df
    cx, cy = F.col(x), F.col(y)
    for code, inverse in ((source, True), (target, False)):
        if code == 3857:
            cx, cy = web_mercator(cx, cy, inverse)
        elif code != 4326:
            cx, cy = utm(cx, cy, code, inverse)
    return df.select(*[cx.alias(c) if c == x else cy.alias(c) if c == y else F.col(c) for c in df.columns])


def layer_summary(polygons: DataFrame, key: str) -> DataFrame:
    """Counts of polygons, rings and vertices, and the bounds, in one row."""
    counts = polygons.agg(F.count("*").alias("n_polygons"), F.sum(F.size("rings")).alias("n_rings"), F.sum(F.expr("aggregate(rings, 0, (a, r) -> a + size(r))")).alias("n_vertices"))
    return counts.crossJoin(total_bounds(polygons, key))


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
