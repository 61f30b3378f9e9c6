"""Statistics and data quality: aggregates only, one pass over the table wherever that suffices."""

from __future__ import annotations

import statistics as _st
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.expr import MISSING_TEXT, parse_date, percent_text, season, season_order
from .quantiles import quantiles


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def per_column(df: DataFrame, columns: list[str], measures: dict[str, callable]) -> DataFrame:
    """One row a column: each measure maps a column name to an aggregate; computed in one pass, then unpivoted."""
    row = df.agg(*[m(c).alias(f"{c}\x1f{k}") for c in columns for k, m in measures.items()])
    packed = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{c}\x1f{k}`").alias(k) for k in measures]) for c in columns])
    return row.select(F.explode(packed).alias("r")).select("r.*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def share_of_total(df: DataFrame, column: str) -> DataFrame:
    total = df.agg(F.count(column).alias("_total"))  # one row
    return value_counts(df, column).crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") * 100.0 / F.col("_total")).alias("pct"))


def top_categories(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values; ties go to the smaller value."""
    return value_counts(df, column).orderBy(F.desc("n"), "value").limit(n)


def seasonal_share(df: DataFrame, date: str) -> DataFrame:
    """Rows and share of rows by season in calendar order; bad dates are dropped, empty seasons absent."""
    m = F.month(parse_date(F.col(date)))
    counted = df.select(m.alias("month")).where("month is not null").groupBy(season(F.col("month")).alias("season")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over five rows at most
    return counted.select("season", "n", percent_text(F.col("n") * 100.0 / total).alias("percentage"), season_order(F.col("season")).alias("ord")).orderBy("ord")


def label_statistics(df: DataFrame, label: str) -> DataFrame:
    """Rows, features, and count and percentage of labels 0 and 1; percentages 0 for an empty table."""
    one, zero = (F.coalesce(F.sum(F.when(F.col(label) == v, 1).otherwise(0)), F.lit(0)) for v in (1, 0))
    got = df.agg(F.count("*").alias("total"), F.lit(len(df.columns) - 1).alias("features"), zero.alias("n_0"), one.alias("n_1"))
    pct = lambda c: F.coalesce(F.round(F.col(c) * 100.0 / F.expr("nullif(total, 0)"), 6), F.lit(0.0))
    return got.withColumn("pct_0", pct("n_0")).withColumn("pct_1", pct("n_1"))


def missing_share(df: DataFrame, all_columns: bool = False) -> DataFrame:
    """Percentage of missing values by column (NULL or a missing spelling), the ones with any first."""
    text = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    gone = lambda c: F.col(c).isNull() | F.col(c).isin(*MISSING_TEXT) if c in text else F.col(c).isNull()
    got = per_column(df, df.columns, {"missing_pct": lambda c: F.avg(gone(c).cast("double")) * 100})
    return (got if all_columns else got.where("missing_pct > 0")).orderBy(F.desc("missing_pct"), "column_name")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, min, exact linear quartiles, max."""
    measures = {
        "n": F.count,
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
    }
    got = per_column(df, columns, measures).join(quantiles(df, columns, [0.25, 0.5, 0.75]), "column_name")
    return got.select("column_name", "n", "mean", "std", "min", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "max")


def skew_kurtosis(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bias-corrected skewness (n > 2) and excess kurtosis (n > 3)."""
    got = per_column(df, columns, {"n": F.count, "g1": F.skewness, "g2": F.kurtosis})
    n = F.col("n").cast("double")
    return got.select(
        "column_name",
        F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurtosis"),
    )


def quality_report(df: DataFrame) -> DataFrame:
    """Type, missing share, distinct values, and shares of zeros and negatives (numbers only)."""
    kinds = dict(df.dtypes)
    numbers = set(numeric_columns(df))
    share = lambda test: F.avg(F.coalesce(test, F.lit(False)).cast("double")) * 100
    got = per_column(
        df,
        df.columns,
        {
            "missing_pct": lambda c: F.avg(F.col(c).isNull().cast("double")) * 100,
            "n_unique": F.countDistinct,
            "zeros_pct": lambda c: share(F.col(c) == 0) if c in numbers else F.lit(None).cast("double"),
            "negatives_pct": lambda c: share(F.col(c) < 0) if c in numbers else F.lit(None).cast("double"),
        },
    )
    return got.withColumn("dtype", F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("column_name")])


def constant_columns(df: DataFrame) -> DataFrame:
    return per_column(df, df.columns, {"n_unique": F.countDistinct}).where("n_unique <= 1")


def fences(df: DataFrame, column: str, factor: float = 1.5, by: list[str] | None = None) -> DataFrame:
    """Quartiles and the outlier fences below and above them."""
    got = quantiles(df, [column], [0.25, 0.5, 0.75], by).select(*(by or []), *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "q2", "q3"))])
    return got.withColumn("low", F.col("q1") - factor * (F.col("q3") - F.col("q1"))).withColumn("high", F.col("q3") + factor * (F.col("q3") - F.col("q1")))


def iqr_outliers(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Rows strictly outside the fences."""
    one = fences(df, column, factor).select("low", "high")
    return df.crossJoin(F.broadcast(one)).where((F.col(column) < F.col("low")) | (F.col(column) > F.col("high"))).drop("low", "high")


def iqr_outlier_share(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """Percentage of outliers by column; NULL rows count in the denominator."""
    quart = quantiles(df, columns, [0.25, 0.75]).select("column_name", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3"))
    tall = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("r")).select("r.*")
    low, high = F.expr(f"q1 - {factor} * (q3 - q1)"), F.expr(f"q3 + {factor} * (q3 - q1)")
    out = F.coalesce((F.col("v") < low) | (F.col("v") > high), F.lit(False))
    return tall.join(F.broadcast(quart), "column_name").groupBy("column_name").agg((F.avg(out.cast("double")) * 100).alias("outlier_pct"))


def boxplot_stats(df: DataFrame, column: str, by: str) -> DataFrame:
    """Quartiles and whiskers (the last points inside the fences) for each group."""
    f = fences(df, column, by=[by]).withColumnRenamed(by, "_by")
    inside = df.join(f, F.col(by).eqNullSafe(F.col("_by"))).where((F.col(column) >= F.col("low")) & (F.col(column) <= F.col("high")))
    return inside.groupBy(by).agg(*[F.first(c).alias(c) for c in ("q1", "q2", "q3")], F.min(column).cast("double").alias("whisker_low"), F.max(column).cast("double").alias("whisker_high"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Rows by equal-width bin between minimum and maximum; the last bin is closed."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.when(width > 0, F.floor((F.col(column) - F.col("lo")) / width)).otherwise(0), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def _products(means: np.ndarray):
    """Sums over a partition of all pairs of columns: rows where both are there, each one's values
    and squares (about its mean) there, and their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(means)
        n, s, q, p = (np.zeros((d, d)) for _ in range(4))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.float64)
            there = ~np.isnan(x)
            z, m = np.where(there, x - means, 0.0), there.astype(np.float64)
            n += m.T @ m
            s += z.T @ m
            q += (z * z).T @ m
            p += z.T @ z
        i, j = np.triu_indices(d, 1)
        parts = (i, j, n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j])
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in parts], ["i", "j", "n", "sa", "sb", "qa", "qb", "p"])

    return run


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair c1 < c2 (pairwise complete): NULL where either is constant.

    Matrix products inside each partition, so the plan does not grow with the pairs; a partition
    hands on one row a pair.
    """
    names = sorted(columns)
    spark = df.sparkSession
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    one = numbers.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in names]).first()
    means = np.array([one[c] if one[c] is not None else 0.0 for c in names])
    sums = numbers.mapInArrow(_products(means), "i long, j long, n double, sa double, sb double, qa double, qb double, p double")
    total = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "p")])
    va, vb = (F.col(f"q{k}") - F.col(f"s{k}") ** 2 / F.col("n") for k in "ab")
    varied = (F.col("n") > 0) & (va > 1e-12 * F.col("qa")) & (vb > 1e-12 * F.col("qb"))
    corr = F.when(varied, (F.col("p") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(va * vb))
    pairs = [(i, j, a, b) for (i, a), (j, b) in combinations(enumerate(names), 2)]
    named = spark.createDataFrame(pairs, "i long, j long, col1 string, col2 string")
    return named.join(total, ["i", "j"], "left").select("col1", "col2", corr.alias("corr"))


def mean_abs_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of the columns' mean absolute off-diagonal correlations."""
    c = correlations(df, columns)
    both = c.select("col1", "corr").union(c.select("col2", "corr"))
    return both.groupBy("col1").agg(F.avg(F.abs("corr")).alias("m")).agg(F.avg("m").alias("mean_abs_corr"))


def target_correlation(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    return per_column(df, columns, {"abs_corr": lambda c: F.abs(F.corr(c, target))})


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    return per_column(df, columns, {"var_samp": F.var_samp, "var_pop": F.var_pop})


def duplicate_summary(df: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Rows, rows in groups of equals, rows beyond the first of each group, and the share of the former (3 places)."""
    keys = [c for c in df.columns if c not in ignore]
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    got = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("in_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess"),
    )
    return got.withColumn("pct", F.coalesce(F.bround(F.col("in_groups") * 100.0 / F.expr("nullif(total, 0)"), 3), F.lit(0.0)))


def median_and_mode(df: DataFrame, number: str, category: str) -> DataFrame:
    """Global median of a number and smallest mode of a category."""
    return df.agg(F.median(number).alias("median"), F.mode(category, True).cast("string").alias("mode"))


def repeat_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and population deviation of repeated measurements."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def diagnostic(df: DataFrame) -> DataFrame:
    """Overview in one row: rows, columns, duplicate rows, constant columns, columns with missing values."""
    one = df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        reduce(lambda a, b: a + b, [(F.countDistinct(c) <= 1).cast("int") for c in df.columns]).alias("n_constant"),
        reduce(lambda a, b: a + b, [(F.count(c) < F.count("*")).cast("int") for c in df.columns]).alias("n_with_missing"),
    )
    return one.crossJoin(duplicate_summary(df).select(F.col("excess").alias("n_duplicates")))


def qq_points(df: DataFrame, column: str, id_column: str) -> DataFrame:
    """Ordered values against normal quantiles (Filliben positions).

    Ranks come from counts by value, so no single task sorts the column.
    """
    groups = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n"))
    from .ranks import running_total

    ranked = running_total(groups, "value", "n")
    total = ranked.agg(F.sum("n").alias("total"))
    rows = ranked.crossJoin(F.broadcast(total)).select("value", "total", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))).alias("rank"))
    last = F.pow(F.lit(0.5), 1 / F.col("total"))
    p = F.when(F.col("rank") == F.col("total"), last).when(F.col("rank") == 1, 1 - last).otherwise((F.col("rank") - 0.3175) / (F.col("total") + 0.365))
    inverse = F.pandas_udf(lambda s: s.map(_st.NormalDist().inv_cdf), "double")
    return rows.select("rank", "value", p.alias("p")).withColumn("theoretical", inverse("p"))


def kde_1d(df: DataFrame, column: str, points: int = 50, adjust: float = 1.0) -> DataFrame:
    """Gaussian density on an even mesh, Scott bandwidth; the mesh (a fixed number of points) is the broadcast side."""
    stats = df.agg(F.count(column).alias("n"), F.stddev_samp(column).alias("sd"), F.min(column).alias("lo"), F.max(column).alias("hi"))
    stats = stats.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)) * adjust)
    mesh = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("x", F.expr(f"lo + i * (hi - lo) / {points - 1}"))
    pairs = df.select(F.col(column).cast("double").alias("v")).where("v is not null").crossJoin(F.broadcast(mesh))
    return pairs.groupBy("i", "x").agg((F.sum(F.exp(F.expr("-0.5 * power((x - v) / h, 2)"))) / F.first(F.expr(f"n * h * 2.5066282746310002"))).alias("density"))


def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("corr"))


def histogram_by(df: DataFrame, column: str, by: str, bins: int = 30) -> DataFrame:
    """Histogram of a column for each group, on the bins of the whole table."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.when(width > 0, F.floor((F.col(column) - F.col("lo")) / width)).otherwise(0), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(by, at.alias("bin")).agg(F.count("*").alias("n"))


def missing_matrix(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys with a flag for each other column: is the value missing?"""
    return df.select(*key, *[F.col(c).isNull().alias(c) for c in df.columns if c not in key])
