"""Model and cluster metrics."""

from __future__ import annotations

import secrets

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import distance, squared_distance
from ..session import staged
from .pareto import SMALL, undominated
from .resample import sample_n, stratified_sample
from .tiles import distance_sums, whole


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.when(b != 0, b), F.lit(0.0))


def confusion(df: DataFrame, label: str = "label", predicted: str = "prediction") -> DataFrame:
    """tn, fp, fn, tp of a binary classifier, in one row."""
    n = lambda y, p: F.coalesce(F.sum(((F.col(label) == y) & (F.col(predicted) == p)).cast("long")), F.lit(0)).alias({(0, 0): "tn", (0, 1): "fp", (1, 0): "fn", (1, 1): "tp"}[y, p])
    return df.agg(n(0, 0), n(0, 1), n(1, 0), n(1, 1))


def binary_metrics(df: DataFrame, label: str = "label", predicted: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall and F1 with the confusion counts; a zero denominator gives 0."""
    c = confusion(df, label, predicted)
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return c.select(
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "tn", "fp", "fn", "tp",
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact area under the curve by average ranks; NULL with one class only.

    Scores are first counted by value, and ranks come from running totals over value ranges.
    """
    from .ranks import running_total

    by = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.count("*").alias("n"))
    ranked = running_total(by, "s", "n")
    got = ranked.agg(F.sum("pos").cast("double").alias("p"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("q"), F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2.0)).alias("r"))
    return got.select(F.expr("(r - p * (p + 1) / 2) / nullif(p * q, 0)").alias("auc"))


def class_report(df: DataFrame, label: str = "label", predicted: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of each class, with macro and weighted averages."""
    pairs = df.groupBy(F.col(label).cast("string").alias("y"), F.col(predicted).cast("string").alias("p")).agg(F.count("*").alias("n"))
    real = pairs.groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    said = pairs.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("said"))
    c = real.join(said, "class", "full").na.fill(0)
    c = c.select("class", _ratio(F.col("hit"), F.col("said")).alias("precision"), _ratio(F.col("hit"), F.col("support")).alias("recall"), _ratio(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support")
    macro = c.agg(F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    weighted = c.agg(F.lit("weighted avg").alias("class"), *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    return c.unionByName(macro).unionByName(weighted)


def centroids(df: DataFrame, cluster: str = "cluster", vector: str = "features", include_noise: bool = True) -> DataFrame:
    """(cluster, n, centre) of each cluster; sums by dimension, so clusters of any size combine early."""
    d = df if include_noise else df.where(F.col(cluster) != -1)
    tall = d.select(cluster, F.posexplode(vector).alias("i", "v"))
    mean = tall.groupBy(cluster, "i").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    return mean.groupBy(cluster).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centre"))


def _with_centres(df: DataFrame, cluster: str, vector: str, include_noise: bool) -> tuple[DataFrame, DataFrame]:
    c = centroids(df, cluster, vector, include_noise)
    return c, df.join(c.withColumnRenamed(cluster, "_c"), F.col(cluster) == F.col("_c"))


def calinski_harabasz(df: DataFrame, cluster: str = "cluster", vector: str = "features", include_noise: bool = True) -> DataFrame:
    """[B / (k - 1)] / [W / (n - k)]; 1 where W is 0; NULL with fewer than two clusters."""
    c, d = _with_centres(df, cluster, vector, include_noise)
    within = d.agg(F.sum(squared_distance(F.col(vector), F.col("centre"))).alias("w"))
    whole = centroids(d.select(F.lit(0).alias("one"), F.col(vector).alias("v")), "one", "v").select(F.col("centre").alias("_all"))
    between = c.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("n") * squared_distance(F.col("centre"), F.col("_all"))).alias("b"), F.count("*").alias("k"), F.sum("n").alias("n"))
    return between.crossJoin(within).select(F.expr("case when k < 2 then null when w = 0 then 1D else (b / (k - 1)) / (w / (n - k)) end").alias("ch"))


def davies_bouldin(df: DataFrame, cluster: str = "cluster", vector: str = "features", include_noise: bool = True) -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d_ij; NULL with fewer than two clusters."""
    c, d = _with_centres(df, cluster, vector, include_noise)
    spread = d.groupBy(F.col(cluster).alias("i")).agg(F.avg(distance(F.col(vector), F.col("centre"))).alias("s"), F.first("centre").alias("m"))
    other = spread.select(F.col("i").alias("j"), F.col("s").alias("t"), F.col("m").alias("o"))
    pairs = spread.join(other, F.col("i") != F.col("j")).withColumn("d", distance(F.col("m"), F.col("o")))
    worst = pairs.groupBy("i").agg(F.max(F.when(F.col("d") > 0, (F.col("s") + F.col("t")) / F.col("d")).otherwise(0.0)).alias("r"))
    return worst.agg(F.avg("r").alias("dbi"))


def wcss(df: DataFrame, cluster: str = "cluster", vector: str = "features") -> DataFrame:
    """Within-cluster sum of squares, in all and by point."""
    _, d = _with_centres(df, cluster, vector, True)
    return d.agg(F.sum(squared_distance(F.col(vector), F.col("centre"))).alias("wcss")).crossJoin(df.agg(F.count("*").alias("n"))).select("wcss", (F.col("wcss") / F.col("n")).alias("wcss_per_point"))


def silhouette(df: DataFrame, key: str = "id", cluster: str = "cluster", vector: str = "features", include_noise: bool = True, blocks: int = 8) -> DataFrame:
    """Mean Euclidean silhouette of all rows given (draw a sample first); a singleton or a row without cluster counts 0.

    Equal vectors of a cluster are one point that counts for all of them. Each two blocks of points meet in one
    task (``tiles.distance_sums``), which returns sums of distances by point and cluster for both; it holds no
    more than two blocks. Rows whose vector is null or holds a null take no part.
    """
    d = whole(df if include_noise else df.where(F.col(cluster) != -1), vector).select(F.col(cluster).alias("c"), F.col(vector).cast("array<double>").alias("v"))
    points = staged(d.groupBy("c", "v").agg(F.count("*").alias("w")).select(F.monotonically_increasing_id().alias("k"), "c", "v", "w"), "points")
    kind = dict(points.dtypes)["c"]
    clustered = points.where("c is not null")
    size = clustered.groupBy(F.col("c").alias("other")).agg(F.sum("w").alias("n"))
    mean = distance_sums(clustered, kind, blocks).groupBy("k", "c", "other").agg(F.sum("total").alias("total"), F.max("w").alias("w")).join(size, "other")
    own = F.max(F.when(F.col("c") == F.col("other"), F.when(F.col("n") > 1, F.col("total") / (F.col("n") - 1)))).alias("a")
    far = F.min(F.when(F.col("c") != F.col("other"), F.col("total") / F.col("n"))).alias("b")
    s = mean.groupBy("k").agg(own, far, F.max("w").alias("w")).select("w", F.when(F.col("a").isNull(), 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))).alias("s"))
    rows = points.agg(F.sum("w").alias("n"))
    total = s.agg(F.sum(F.col("w") * F.coalesce("s", F.lit(0.0))).alias("s"))
    return rows.crossJoin(total).select((F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("silhouette"))


def sampled_silhouette(df: DataFrame, key: str = "id", cluster: str = "cluster", vector: str = "features", size: int = 50_000, repeats: int = 5, seed: int = 42, include_noise: bool = True, sampling: str = "stratified") -> dict[str, float | None]:
    """Mean and population deviation of the silhouette over samples of at most ``size`` rows.

    ``sampling``: stratified by cluster, uniform by seed, or unseeded (uniform, other rows at each call).
    """
    if sampling not in ("stratified", "uniform", "unseeded"):
        raise ValueError(f"unknown sampling {sampling}")
    if sampling == "unseeded":
        seed = secrets.randbits(31)
    d = df if include_noise else df.where(F.col(cluster) != -1)
    total = d.count()
    if d.select(cluster).distinct().limit(2).count() < 2:
        return {"silhouette": None, "silhouette_std": None}
    n = min(size, total)
    draw = (lambda r: stratified_sample(d, cluster, key, n, seed + r)) if sampling == "stratified" else (lambda r: sample_n(d, key, n, seed + r))
    values = [silhouette(draw(r), key, cluster, vector).first()[0] for r in range(repeats if size < total else 1)]
    return {"silhouette": float(np.mean(values)), "silhouette_std": float(np.std(values))}


def noise_summary(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Clusters (noise, -1, left out), noise rows, and their share."""
    return df.agg(
        F.countDistinct(F.when(F.col(cluster) != -1, F.col(cluster))).alias("n_clusters"), F.coalesce(F.sum((F.col(cluster) == -1).cast("long")), F.lit(0)).alias("n_noise"),
        F.coalesce(F.avg((F.col(cluster) == -1).cast("double")), F.lit(0.0)).alias("noise_ratio"),
    )


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def pareto_front(results: DataFrame, directions: dict[str, str], small: int = SMALL) -> DataFrame:
    """Rows that no other row dominates: at least as good in all metrics and better in one.

    A NULL metric is never worse and never better; equal rows are all kept, NaN counts as the
    largest number. An empty table gives no rows; other columns stay. Up to ``small``
    distinct rows are broadcast; beyond, see ``pareto``: so are fronts of as many rows, and rows
    meet those of cells that can dominate them.
    """
    missing = [m for m in directions if m not in results.columns]
    if missing:
        raise ValueError(f"unknown metrics {missing}")
    bad = [d for d in directions.values() if d not in ("max", "min")]
    if bad:
        raise ValueError(f"unknown directions {bad}")
    rows = results.select(*[F.col(_name(m)).alias(f"_o{i}") for i, m in enumerate(directions)]).distinct()
    if rows.count() <= small:
        not_worse, better = F.lit(True), F.lit(False)
        for i, (m, way) in enumerate(directions.items()):
            mine, other = F.col(_name(m)), F.col(f"_o{i}")
            up, down = (other > mine, mine > other) if way == "max" else (other < mine, mine < other)
            not_worse, better = not_worse & F.coalesce(~down, F.lit(True)), better | F.coalesce(up, F.lit(False))
        return results.join(F.broadcast(rows), not_worse & better, "left_anti")
    # Rows by which metrics they hold: two rows are compared on those that both hold.
    held = F.expr("+".join(f"if({_name(m)} is null, 0, {1 << i})" for i, m in enumerate(directions)) or "0")
    kinds = sorted(r[0] for r in results.select(held.alias("held")).distinct().collect())  # at most 2 to the number of metrics
    names = lambda k: [m for i, m in enumerate(directions) if k >> i & 1]
    out = None
    for kind in kinds:
        kept = results.where(held == kind)
        for other in kinds:
            shared = names(kind & other)
            if shared:
                columns = [F.col(_name(m)).alias(f"_v{i}") for i, m in enumerate(shared)]
                ways = {f"_v{i}": directions[m] for i, m in enumerate(shared)}
                mine = results.where(held == kind).select(*columns)
                rivals = mine if kind == other else results.where(held == other).select(*columns)
                good = undominated(mine, rivals, ways, small)
                same = [kept[_name(m)] == good[f"_v{i}"] for i, m in enumerate(shared)]
                kept = kept.join(good, same, "left_semi")
        out = kept if out is None else out.unionByName(kept)
    return results.limit(0) if out is None else out


def filter_noise(results: DataFrame, max_noise_ratio: float) -> DataFrame:
    """Runs whose noise ratio is at most the limit."""
    if "noise_ratio" not in results.columns:
        raise ValueError("noise_ratio is missing")
    return results.where(F.col("noise_ratio") <= max_noise_ratio)


def latest_runs(results: DataFrame, parameters: list[str], order: str) -> DataFrame:
    """One row for each parameter set of an append-only results table: the last by ``order``."""
    w = Window.partitionBy(*parameters).orderBy(F.desc(order))
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
