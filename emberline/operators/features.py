"""Feature engineering: scaling, encoding, reduction."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import profile
from .compress import Autoencoder
from .information import neighbour_information

COORDINATES = ("latitude", "longitude")


def standard_scale(df: DataFrame, exclude: tuple[str, ...] = ("year",)) -> DataFrame:
    """(x - mean) / population deviation of every long, int and double column; a zero deviation divides by 1."""
    kinds = ("bigint", "int", "double")
    columns = [c for c, k in df.dtypes if k in kinds and c not in exclude]
    stats = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)])
    d = df.crossJoin(F.broadcast(stats))
    at = {c: i for i, c in enumerate(columns)}
    scaled = lambda c: ((F.col(c) - F.col(f"m_{at[c]}")) / F.when(F.col(f"s_{at[c]}") > 0, F.col(f"s_{at[c]}")).otherwise(1.0)).alias(c)
    return d.select(*[scaled(c) if c in at else F.col(c) for c in df.columns])


def one_hot(df: DataFrame, columns: list[str], label: str, most: int = 1000) -> DataFrame:
    """One 0/1 column column_value for each value, in sorted order; NULL gives all 0; the label goes last.

    A column with more than ``most`` values is refused, since each becomes a column.
    """
    out = [F.col(c) for c in df.columns if c not in columns and c != label]
    for c in columns:
        found = df.select(F.col(c).alias("v")).where("v is not null").distinct().orderBy("v").limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{c} has more than {most} values")
        out += [F.coalesce((F.col(c) == r["v"]).cast("int"), F.lit(0)).alias(f"{c}_{r['v']}") for r in found]
    return df.select(*out, F.col(label))


def target_encode(df: DataFrame, columns: list[str], target: str, smoothing: float = 10.0, min_samples_leaf: float = 20.0) -> DataFrame:
    """Category means of the target, shrunk to the overall mean by a sigmoid of the category's size.

    Means come from an aggregate joined back, so a frequent category is no single task.
    """
    prior = df.agg(F.avg(F.col(target).cast("double")).alias("_prior"))
    d = df.crossJoin(F.broadcast(prior))
    for i, c in enumerate(columns):
        n, m = F.count("*").cast("double").alias(f"_n{i}"), F.avg(F.col(target).cast("double")).alias(f"_m{i}")
        d = d.join(df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"_k{i}")).agg(n, m), F.col(c) == F.col(f"_k{i}"), "left")
        weight = 1 / (1 + F.exp(-(F.col(f"_n{i}") - min_samples_leaf) / smoothing))
        d = d.withColumn(f"_e{i}", F.coalesce(weight * F.col(f"_m{i}") + (1 - weight) * F.col("_prior"), F.col("_prior")))
    return d.select(*[F.col(f"_e{columns.index(c)}").alias(c) if c in columns else F.col(c) for c in df.columns])


def correlation_report(df: DataFrame, target: str = "fire", threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Feature pairs with |r| at or over the threshold, and features by ascending sample variance."""
    columns = profile.numeric_columns(df, exclude=(target, *COORDINATES))
    pairs = profile.correlations(df, columns).withColumn("corr", F.abs("corr")).where(F.col("corr") >= threshold)
    return pairs, profile.variances(df, columns).select("column_name", F.col("var_samp").alias("variance")).orderBy("variance", "column_name")


def drop_correlated(corr: dict[tuple[str, str], float], target: dict[str, float], columns: list[str], threshold: float) -> list[str]:
    """Columns left after dropping, of each pair over the threshold, the one less correlated with the target
    (the later one on a tie). Dropped columns still eliminate others."""
    gone = set()
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            if abs(corr.get((min(a, b), max(a, b)), 0) or 0) > threshold:
                gone.add(a if (target.get(a) or 0) < (target.get(b) or 0) else b)
    return [c for c in columns if c not in gone]


def binned_mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 16) -> DataFrame:
    """Mutual information (nats) of equal-width bins of each column with a class label.

    A quick look; ``information.neighbour_information`` needs no bins.
    """
    ends = profile.per_column(df, columns, {"lo": lambda c: F.min(c).cast("double"), "hi": lambda c: F.max(c).cast("double")})
    tall = df.select(F.col(target).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("r")).select("y", "r.*").dropna()
    d = tall.join(F.broadcast(ends), "column_name")
    x = F.least(F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).otherwise(0), F.lit(bins - 1))
    cells = d.groupBy("column_name", x.alias("x"), "y").agg(F.count("*").alias("n"))
    px = cells.groupBy("column_name", "x").agg(F.sum("n").alias("nx"))
    py = cells.groupBy("column_name", "y").agg(F.sum("n").alias("ny"))
    total = cells.groupBy("column_name").agg(F.sum("n").alias("t"))
    j = cells.join(px, ["column_name", "x"]).join(py, ["column_name", "y"]).join(total, "column_name")
    return j.groupBy("column_name").agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"))


def supervised_reduction(df: DataFrame, target: str, var_threshold: float = 0.01, corr_threshold: float = 0.9, method: str = "RF", top_k: int = 20) -> DataFrame:
    """The top features by forest importance (or mutual information) after the variance and correlation filters, with the target.

    Column statistics are one row; rows never leave the executors.
    """
    columns = profile.numeric_columns(df, exclude=(target, *COORDINATES))
    var = {r["column_name"]: r["var_samp"] for r in profile.variances(df, columns).collect()}
    columns = [c for c in columns if (var[c] or 0) > var_threshold]
    corr = {(r["col1"], r["col2"]): r["corr"] for r in profile.correlations(df, columns).collect()} if len(columns) > 1 else {}
    with_target = {r["column_name"]: r["abs_corr"] for r in profile.target_correlation(df, columns, target).collect()} if columns else {}
    columns = drop_correlated(corr, with_target, columns, corr_threshold)
    if method == "MI":
        rank = {r["column_name"]: r["mi"] for r in neighbour_information(df, columns, target).collect()}
    else:
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler

        data = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(df.select(*columns, F.col(target).cast("double").alias("label")))
        model = RandomForestClassifier(numTrees=200, seed=42, maxDepth=8).fit(data)
        rank = dict(zip(columns, model.featureImportances.toArray().tolist(), strict=True))
    best = sorted(columns, key=lambda c: (-(rank.get(c) or 0), c))[:top_k]
    return df.select(*best, target)


def cluster_features(corr: np.ndarray, names: list[str], limit: float = 0.3) -> list[str]:
    """Representatives of average-linkage clusters on 1 - |r|, merged while their distance is under ``limit``.

    A cluster's representative has the largest sum of |r| inside it, the first on a tie.
    """
    r = np.abs(np.nan_to_num(corr))
    np.fill_diagonal(r, 1.0)
    groups = [[i] for i in range(len(names))]
    while len(groups) > 1:
        best = min(((float(np.mean(1 - r[np.ix_(a, b)])), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), default=(math.inf, 0, 0))
        if best[0] >= limit:
            break
        groups[best[1]] += groups.pop(best[2])
    keep = [max(sorted(g), key=lambda i, g=g: (r[i, g].sum(), -i)) for g in groups]
    return [names[i] for i in sorted(keep)]


def unsupervised_reduction(df: DataFrame, drop: tuple[str, ...] = ("fire",), var_threshold: float = 0.01, cluster_distance: float = 0.3, components: int | None = None, compression: str = "autoencoder", **settings) -> DataFrame:
    """Coordinates and one representative of each cluster of correlated features, or ``components``
    numbers that compress them, named ae_feature_0, ...: codes of an autoencoder (with ``settings``) or, as
    ``compression`` "pca", principal components, whose rows need all features."""
    columns = profile.numeric_columns(df, exclude=(*drop, *COORDINATES))
    var = {r["column_name"]: r["var_pop"] for r in profile.variances(df, columns).collect()}
    columns = [c for c in columns if (var[c] or 0) > var_threshold]
    m = np.eye(len(columns))
    at = {c: i for i, c in enumerate(columns)}
    if len(columns) > 1:
        for r in profile.correlations(df, columns).collect():
            m[at[r["col1"]], at[r["col2"]]] = m[at[r["col2"]], at[r["col1"]]] = r["corr"] or 0
    keep = cluster_features(m, columns, cluster_distance)
    ids = [c for c in COORDINATES if c in df.columns]
    if components is None:
        return df.select(*ids, *keep)
    if compression == "autoencoder":
        model = Autoencoder(components, **settings).fit(df, keep)
        return model.encode(df.select(*ids, *keep)).select(*ids, *[f"ae_feature_{i}" for i in range(components)])
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = VectorAssembler(inputCols=keep, outputCol="_f", handleInvalid="skip").transform(df)
    k = min(components, len(keep))
    got = PCA(k=k, inputCol="_f", outputCol="_c").fit(data).transform(data).withColumn("_a", vector_to_array("_c"))
    return got.select(*ids, *[F.col("_a")[i].alias(f"ae_feature_{i}") for i in range(k)])
