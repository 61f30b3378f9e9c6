"""Splits, samples, folds and class rebalancing, all in the order of a seeded hash of a key."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import distance, seeded, seeded_unit
from .ranks import numbered, smallest
from .tiles import near_lists


def _order(seed: int, key: str) -> list[Column]:
    return [seeded(seed, F.col(key)), F.col(key)]


def random_fraction(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    return df.where(seeded_unit(seed, F.col(key)) < fraction)


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if there are fewer): the first n by hash.

    Rows over a hash threshold that leaves some more than n are dropped before the ordering, so
    partitions send about n rows in all, not n each.
    """
    total = df.count()
    if total > 4 * n:
        few = df.where(seeded_unit(seed, F.col(key)) < (n + 10 * math.sqrt(n) + 100) / total)
        if few.count() >= n:
            df = few
    return df.orderBy(*_order(seed, key)).limit(n)


def bootstrap(df: DataFrame, n: int, order: str, seed: int = 42) -> DataFrame:
    """Exactly n rows drawn with replacement: n seeded positions joined to numbered rows."""
    total = df.count()
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(seeded_unit(seed, F.col("id")) * total).cast("int").alias("_pos"))
    return draws.join(numbered(df, order), "_pos").drop("_pos")


def largest_remainder(counts: dict, share: float) -> dict:
    """Whole numbers near share * count that add up to ceil(share * total)."""
    want = math.ceil(share * sum(counts.values()) - 1e-9)
    exact = {k: share * n for k, n in counts.items()}
    out = {k: math.floor(v + 1e-9) for k, v in exact.items()}
    for k in sorted(counts, key=lambda k: (-(exact[k] - out[k]), str(k)))[: want - sum(out.values())]:
        out[k] += 1
    return out


def _ranked(df: DataFrame, by: str, key: str, seed: int) -> DataFrame:
    """Adds ``_rank``, 1, 2, ... in hash order inside each class.

    A class is cut into 4096 ranges of the hash, so a window task holds one range of a class; the
    counts of the ranges (a row each) say where a range begins. Both joins and windows use the
    same keys, so rows are shuffled once.
    """
    d = df.withColumn("_class", F.struct(F.col(by).alias("c"))).withColumn("_range", F.substring(seeded(seed, F.col(key)), 1, 3))
    earlier = Window.partitionBy("_class").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = d.groupBy("_class", "_range").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_class", "_range").orderBy(*_order(seed, key)))
    got = d.withColumn("_in", inside).join(first, ["_class", "_range"])
    return got.withColumn("_rank", F.col("_first") + F.col("_in")).select(*[F.col(f"`{c}`") for c in df.columns], "_rank")


def class_counts(df: DataFrame, by: str, most: int = 10_000) -> dict:
    rows = df.groupBy(by).count().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{by} has more than {most} values")
    return {r[0]: r["count"] for r in rows}


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: ceil(test_size * N) rows with the classes' shares, by hash order inside each class."""
    quota = largest_remainder(class_counts(df, label), test_size)
    size = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])
    return _ranked(df, label, key, seed).withColumn("is_test", F.col("_rank") <= F.try_element_at(size, F.col(label))).drop("_rank")


def stratified_sample(df: DataFrame, label: str, key: str, total: int, seed: int = 42) -> DataFrame:
    """max(floor(total * n_k / N), 1) rows of each class, or the whole class if it is smaller."""
    counts = class_counts(df, label)
    n = sum(counts.values())
    size = F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, max(total * c // n, 1))])
    return _ranked(df, label, key, seed).where(F.col("_rank") <= F.try_element_at(size, F.col(label))).drop("_rank")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold``, 0 to k - 1, dealt in hash order inside each class."""
    return _ranked(df, label, key, seed).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def balance_sizes(n_minority: int, n_majority: int, share: float) -> dict[str, int]:
    """Sizes of a hybrid rebalance: rows kept of the majority, and the minority's size after oversampling."""
    if not 0 < share < 1:
        raise ValueError("the share must lie between 0 and 1")
    if n_minority <= 0:
        raise ValueError("the minority class is absent")
    total = max(n_minority + n_majority, math.ceil(n_minority / share))
    majority = min(int(total * (1 - share)), n_majority)
    final = max(math.ceil(n_minority / share), n_minority + majority)
    return {"majority": majority, "minority": max(math.ceil(share * final), n_minority), "final": final}


def nearest(left: DataFrame, right: DataFrame, k: int, key: str = "id", vector: str = "features", exclude_self: bool = False, rows: int = 20_000) -> DataFrame:
    """(key, near, d, rank): the k nearest rows of ``right`` for each row of ``left``, ties by smaller key.

    All blocks of about ``rows`` rows meet (``tiles``); a task keeps k candidates a row.
    """
    found = near_lists(left, right, k, key, vector, exclude_self, rows)
    return found.select(key, F.posexplode(F.arrays_zip("near", "d")).alias("_at", "_one")).select(key, "_one.near", "_one.d", (F.col("_at") + 1).alias("rank"))


def near_miss(df: DataFrame, label: str, minority, keep: int, key: str = "id", vector: str = "features", k: int = 3) -> DataFrame:
    """All minority rows and the ``keep`` majority rows with the smallest mean distance to their k nearest minority rows."""
    small, large = df.where(F.col(label) == minority), df.where(F.col(label) != minority)
    mean = nearest(large, small, k, key, vector).groupBy(F.col(key).alias("_id")).agg(F.avg("d").alias("_d"))
    chosen = smallest(mean, "_d", "_id", keep)
    return small.unionByName(large.join(chosen, F.col(key) == F.col("_id"), "left_semi"))


def smote(df: DataFrame, label: str, minority, extra: int, key: str = "id", vector: str = "features", k: int = 5, seed: int = 42) -> DataFrame:
    """``extra`` synthetic minority rows x + u * (neighbour - x), with draw number, base, neighbour and u.

    Draw number i takes base, neighbour and u from the seeded hash of i. No rows where the
    minority has fewer than two.
    """
    small = df.where(F.col(label) == minority).select(key, vector)
    n = small.count()
    if n < 2 or extra <= 0:
        return df.sparkSession.createDataFrame([], "draw long, base long, near long, u double, features array<double>")
    pairs = nearest(small, small, min(k, n - 1), key, vector, exclude_self=True)
    bases = numbered(small, key)
    draws = df.sparkSession.range(extra).select(
        F.col("id").alias("draw"), F.floor(seeded_unit(seed, F.lit("base"), F.col("id")) * n).cast("int").alias("_pos"),
        (F.floor(seeded_unit(seed, F.lit("near"), F.col("id")) * min(k, n - 1)) + 1).cast("int").alias("rank"), seeded_unit(seed, F.lit("u"), F.col("id")).alias("u"),
    )
    d = draws.join(bases, "_pos").join(pairs.select(F.col(key).alias("_b"), "near", "rank").alias("p"), (F.col(key) == F.col("_b")) & (draws["rank"] == F.col("p.rank")))
    other = small.select(F.col(key).alias("_o"), F.col(vector).alias("_v"))
    d = d.join(other, F.col("near") == F.col("_o"))
    made = F.zip_with(F.zip_with(F.col(vector), F.col("_v"), lambda a, b: b - a), F.col(vector), lambda delta, a: a + F.col("u") * delta)
    return d.select("draw", F.col(key).alias("base"), "near", "u", made.alias("features"))


def hybrid_balance(df: DataFrame, label: str, minority=1, share: float = 0.3, key: str = "id", vector: str = "features", seed: int = 42) -> DataFrame:
    """(label, features, synthetic): NearMiss down to, and SMOTE up to, the sizes of ``balance_sizes``."""
    counts = class_counts(df, label)
    if minority not in counts:
        raise ValueError("the minority class is absent")
    sizes = balance_sizes(counts[minority], sum(counts.values()) - counts[minority], share)
    reduced = df if sizes["majority"] >= sum(counts.values()) - counts[minority] else near_miss(df, label, minority, sizes["majority"], key, vector)
    made = smote(df, label, minority, sizes["minority"] - counts[minority], key, vector, seed=seed)
    kind = dict(df.dtypes)[label]
    return reduced.select(label, F.col(vector).alias("features"), F.lit(False).alias("synthetic")).unionByName(made.select(F.lit(minority).cast(kind).alias(label), "features", F.lit(True).alias("synthetic")))


def pair_distances(df: DataFrame, others: DataFrame, key: str = "id", vector: str = "features") -> DataFrame:
    """Distances to each row of a small stated set."""
    b = others.select(F.col(key).alias("other"), F.col(vector).alias("_v"))
    return df.crossJoin(b).select(key, "other", distance(F.col(vector), F.col("_v")).alias("d"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
