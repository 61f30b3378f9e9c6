"""Running totals and exact ranks over a whole table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, order: str, weight: str, parts: int = 64) -> DataFrame:
    """Adds ``before``: the sum of ``weight`` over all rows with a smaller ``order`` value (values distinct).

    Rows fall into at most ``parts`` value ranges, cut at approximate quantiles; a window runs
    inside each range and the ranges' totals (at most parts + 1 rows) are summed once.
    """
    cuts = sorted({c for c in df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01) if c is not None})
    at = F.lit(0)
    if cuts:
        at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order)))
    placed = df.withColumn("_range", at)
    sums = placed.groupBy("_range").agg(F.sum(weight).alias("_sum"))
    first = sums.withColumn("_first", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    got = placed.withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(F.broadcast(first), "_range")
    return got.withColumn("before", (F.col("_first") + F.col("_in")).cast("long")).drop("_range", "_in", "_first")


def numbered(df: DataFrame, key: str, out: str = "_pos") -> DataFrame:
    """Rows numbered 0, 1, ... by a distinct numeric key."""
    return running_total(df.withColumn("_one", F.lit(1)), key, "_one").drop("_one").withColumnRenamed("before", out)


def smallest(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """Exactly the n rows with the smallest ``value``, ties by ``key``, without sorting the table in one task.

    Running totals over counts by value find the value at which the quota ends; only the rows of
    that value are put in order.
    """
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    edge = running_total(counts, "_v", "_n").where((F.col("before") < n) & (F.col("before") + F.col("_n") >= n)).select("_v", "before").first()
    if edge is None:
        return df if n > 0 else df.limit(0)
    below = df.where(F.col(value) < F.lit(edge["_v"]))
    at = df.where(F.col(value) == F.lit(edge["_v"])).orderBy(key).limit(n - edge["before"])
    return below.unionByName(at)
