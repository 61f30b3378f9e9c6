"""Relational cleaning: merges, repair of sensor errors, duplicates, zone imputation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import any_negative, constant_row, sentinel_to_null, to_number
from ..session import staged


def progressive_merge(tables: dict[str, DataFrame], on: list[str], how: str = "inner", collisions: str = "suffix") -> DataFrame:
    """Left-deep equi-join of named tables on shared keys.

    ``collisions`` says what becomes of a column that an earlier table already has: ``suffix``
    (renamed column_table), ``drop`` or ``error``. Fewer than two tables are refused.
    """
    if len(tables) < 2:
        raise ValueError("a merge needs two tables at least")
    if collisions not in ("suffix", "drop", "error"):
        raise ValueError(f"unknown collision policy {collisions}")

    def add(left: DataFrame, named: tuple[str, DataFrame]) -> DataFrame:
        name, right = named
        clash = [c for c in right.columns if c in left.columns and c not in on]
        if clash and collisions == "error":
            raise ValueError(f"columns {clash} of {name} exist already")
        for c in clash:
            right = right.drop(c) if collisions == "drop" else right.withColumnRenamed(c, f"{c}_{name}")
        return left.join(right, on, how)

    (_, first), *rest = tables.items()
    return reduce(add, rest, first)


def left_lookup(df: DataFrame, attributes: DataFrame, key: str) -> DataFrame:
    """Left join of attributes; Spark broadcasts them only where their size allows."""
    return df.join(attributes, key, "left")


def map_values(df: DataFrame, column: str, mapping: dict, default: str, out: str) -> DataFrame:
    """A literal dictionary with a default."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out, F.coalesce(F.try_element_at(pairs, F.col(column)), F.lit(default)))


def select_available(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def keep_referenced(df: DataFrame, key: str, ids: DataFrame, id_key: str) -> DataFrame:
    """Rows whose key occurs among ids (semi-join)."""
    return df.join(ids.select(F.col(id_key).alias("_id")).distinct(), F.col(key) == F.col("_id"), "left_semi")


def null_constant_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """Where all features of a row are equal (and not all NULL), all of them become NULL."""
    flat = constant_row(*[F.col(c) for c in features])
    return df.select(*[F.when(~flat, F.col(c)).alias(c) if c in features else F.col(c) for c in df.columns])


def repair_sensor_errors(df: DataFrame, numbers: list[str], key: list[str], drop: tuple[str, ...] = ("TEXTURE_SOTER",), sentinel: str = "-") -> DataFrame:
    """Sentinels and bad texts to NULL; rows with a negative number go if their key occurs more than
    once (even if all of the key's rows are negative), otherwise their negatives become NULL."""
    missing = [c for c in numbers if c not in df.columns]
    if missing:
        raise KeyError(f"columns {missing} are missing")
    df = df.drop(*drop)
    text = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    cast = lambda c: to_number(sentinel_to_null(F.col(c), sentinel)) if c in text else F.col(c).cast("double")
    df = df.select(*[cast(c).alias(c) if c in numbers else sentinel_to_null(F.col(c), sentinel).alias(c) if c in text else F.col(c) for c in df.columns])
    flagged = df.withColumn("_bad", any_negative(*[F.col(c) for c in numbers])).withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    kept = flagged.where(~(F.col("_bad") & (F.col("_n") > 1)))
    return kept.select(*[F.when(F.col(c) >= 0, F.col(c)).alias(c) if c in numbers else F.col(c) for c in df.columns])


def duplicate_flags(df: DataFrame, ignore: tuple[str, ...], order: list[str]) -> DataFrame:
    """Adds ``in_group`` (another row is equal but for ignored columns) and ``again`` (an earlier one is)."""
    keys = [c for c in df.columns if c not in ignore]
    w = Window.partitionBy(*keys)
    return df.withColumn("in_group", F.count("*").over(w) > 1).withColumn("again", F.row_number().over(w.orderBy(*order)) > 1)


def drop_duplicates(df: DataFrame, ignore: tuple[str, ...], order: list[str]) -> DataFrame:
    """First row, by ``order``, of each group of rows equal but for ignored columns (NULLs are equal).

    An aggregate, so groups of any size combine before the shuffle.
    """
    keys = [c for c in df.columns if c not in ignore]
    rest = [c for c in df.columns if c in ignore]
    if not rest:
        return df.distinct()
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_first")
    got = df.groupBy(*keys).agg(first)
    return got.select(*[F.col(f"_first.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def snap_detections(grid: DataFrame, detections: DataFrame, kind: int, step: float, origin: tuple[float, float], no_event_year: int = 2024) -> DataFrame:
    """Every grid cell with ``fire`` (0, 1) and the first year in which a detection of ``kind`` is nearest to it.

    Columns latitude, longitude (grid) and latitude, longitude, type, year (detections).
    """
    from .spatial import nearest_point

    hits = detections.where(F.col("type") == kind).select("latitude", "longitude", "year")
    near = nearest_point(hits, grid, step, origin)
    first = near.groupBy(F.col("near_latitude").alias("latitude"), F.col("near_longitude").alias("longitude")).agg(F.lit(1).alias("fire"), F.min("year").alias("year"))
    joined = grid.select("latitude", "longitude").join(first, ["latitude", "longitude"], "left")
    return joined.select("latitude", "longitude", F.coalesce("fire", F.lit(0)).cast("int").alias("fire"), F.coalesce("year", F.lit(no_event_year)).cast("int").alias("year"))


def zone_radii(base: float, most: float) -> list[float]:
    """base, base * 1.5, base * 1.5**2, ... up to ``most``."""
    if base <= 0 or base > most:
        raise ValueError("base must be over 0 and not over most")
    out = [base]
    while out[-1] * 1.5 <= most:
        out.append(out[-1] * 1.5)
    return out


def zone_fills(df: DataFrame, column: str, category: bool = False, lat: str = "latitude", lon: str = "longitude", base: float = 0.1, least: int = 10, most: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(lat, lon, fill) for the points where ``column`` is NULL, and the global value (one row).

    Level by level, only points not yet settled are joined, on square buckets as wide as the
    zone's radius, so a point meets nine buckets and no others. Levels are written to the shared
    folder, so plans don't grow, and stop as soon as every point is settled.
    """
    pick = F.mode(F.col("_v"), True) if category else F.median("_v")
    values = df.where(F.col(column).isNotNull()).select(F.col(lat).alias("_y"), F.col(lon).alias("_x"), F.col(column).alias("_v"))
    open_ = staged(df.where(F.col(column).isNull()).select(lat, lon).dropna().distinct(), "zones")
    radii = zone_radii(base, most)
    near = F.array(*map(F.lit, (-1, 0, 1)))
    settled: list[DataFrame] = []
    for i, r in enumerate(radii):
        probe = open_.select(lat, lon, *[F.floor(F.col(c) / r).alias(b) for c, b in ((lat, "_i"), (lon, "_j"))])
        probe = probe.withColumn("_di", F.explode(near)).withColumn("_dj", F.explode(near))
        probe = probe.withColumn("_i", F.col("_i") + F.col("_di")).withColumn("_j", F.col("_j") + F.col("_dj"))
        placed = values.withColumn("_i", F.floor(F.col("_y") / r)).withColumn("_j", F.floor(F.col("_x") / r))
        inside = probe.join(placed, ["_i", "_j"]).where(F.col("_y").between(F.col(lat) - r, F.col(lat) + r) & F.col("_x").between(F.col(lon) - r, F.col(lon) + r))
        got = inside.groupBy(lat, lon).agg(F.count("*").alias("_n"), pick.alias("_fill"))
        done = staged((got if i == len(radii) - 1 else got.where(F.col("_n") >= least)).select(lat, lon, "_fill"), "zones")
        settled.append(done)
        if i < len(radii) - 1:
            open_ = staged(open_.join(done, [lat, lon], "left_anti"), "zones")
            if open_.isEmpty():
                break
    fills = reduce(DataFrame.union, settled).select(F.col(lat).alias("_flat"), F.col(lon).alias("_flon"), "_fill")
    return fills, values.agg(pick.alias("_all"))


def impute_by_zones(df: DataFrame, column: str, category: bool = False, lat: str = "latitude", lon: str = "longitude", base: float = 0.1, least: int = 10, most: float = 5.0) -> DataFrame:
    """NULLs of ``column`` from the smallest square zone around the row that holds ``least`` values.

    The zone grows by half from ``base`` up to ``most``; the last one is used with fewer values
    too, and the global value where it holds none. Numbers take the median, categories the
    smallest most frequent value. Rows with a NULL coordinate take the global value.
    """
    fills, whole = zone_fills(df, column, category, lat, lon, base, least, most)
    joined = df.join(fills, (F.col(lat) == F.col("_flat")) & (F.col(lon) == F.col("_flon")) & F.col(column).isNull(), "left").crossJoin(F.broadcast(whole))
    return joined.select(*[F.coalesce(F.col(c), F.col("_fill"), F.col("_all")).alias(c) if c == column else F.col(c) for c in df.columns])


def impute_columns(df: DataFrame, numbers: list[str], classes: list[str] = (), lat: str = "latitude", lon: str = "longitude", **zone) -> DataFrame:
    """Several columns by zones, each from the table as it came, which is stored once."""
    df = staged(df, "gaps")
    out = df
    for c in (*numbers, *classes):
        fills, whole = zone_fills(df, c, c in classes, lat, lon, **zone)
        joined = out.join(fills, (F.col(lat) == F.col("_flat")) & (F.col(lon) == F.col("_flon")) & F.col(c).isNull(), "left").crossJoin(F.broadcast(whole))
        out = joined.select(*[F.coalesce(F.col(k), F.col("_fill"), F.col("_all")).alias(k) if k == c else F.col(k) for k in df.columns])
    return out
