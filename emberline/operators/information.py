"""Mutual information of numbers with a class by nearest neighbours in one dimension.

With k neighbours, a row whose k-th neighbour of its own class lies at distance d has m rows of any
class closer than d (itself included; where d is 0, the rows at 0). Over all N rows of classes with two rows at least,

    information = psi(N) + mean psi(k of the row's class) - mean psi(rows of the class) - mean psi(m).

Columns are first reduced to counts by class and value, so ties cost nothing, and cut into ranges at
approximate quantiles. What a range needs of others are the k nearest values of each class on
either side (halo rows), and how many rows lie below a place, which is asked of the range that
holds the place: prefix sums inside it and the sum of the ranges before. No task sees a whole
column; the driver holds the cuts and a count a range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged


def digamma(n: Column) -> Column:
    """psi of numbers of at least 1, to about 1e-14: eight steps of the recurrence, then the asymptotic series."""
    x = n.cast("double")
    y = x + 8
    steps = sum((1 / (x + i) for i in range(1, 8)), 1 / x)
    z = 1 / (y * y)
    return F.log(y) - 1 / (2 * y) - z * (F.lit(1 / 12) - z * (F.lit(1 / 120) - z * (F.lit(1 / 252) - z * (F.lit(1 / 240) - z * F.lit(1 / 132))))) - steps


def _boundary(values: np.ndarray, x: np.ndarray, d: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many of the sorted values lie before the end of each row's neighbourhood (right) or before its start.

    The comparison is that of distances themselves, which rounding keeps in order; x + d would not do.
    """
    low, high = np.zeros(len(x), np.int64), np.full(len(x), len(values), np.int64)
    while (open_ := low < high).any():
        mid = np.where(open_, (low + high) // 2, 0)
        v = values[mid]
        before = np.where(right, (v - x < d) | (v <= x), (x - v >= d) & (v < x))
        low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
    return low


def _kth(x: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Distance from one row at each of the distinct sorted values to the k-th other row, found among k values on either side."""
    size = len(x)
    at = np.arange(size)[:, None] + np.arange(-k, k + 1)[None, :]
    inside = (at >= 0) & (at < size)
    at = np.clip(at, 0, size - 1)
    far = np.where(inside, np.abs(x[at] - x[:, None]), np.inf)
    weight = np.where(inside, n[at], 0)
    weight[:, k] -= 1
    order = np.argsort(far, axis=1, kind="stable")
    enough = np.cumsum(np.take_along_axis(weight, order, 1), axis=1) >= k
    return np.take_along_axis(far, order, 1)[np.arange(size), enough.argmax(axis=1)]


_COUNTS = "c int, y string, v double, n long, total long, r int"


def neighbour_information(df: DataFrame, columns: list[str], target: str, k: int = 3, rows: int = 100_000) -> DataFrame:
    """(column_name, mi): information of each column about the class ``target`` in nats, at least 0.

    Rows without a class, and values that are null or not finite, are left out of their column; so are
    the rows of a class that has one row there. A class of fewer than k + 1 rows uses all its other
    rows. A column without rows has no information (0). ``rows`` is the number of rows of a range, about.
    """
    spark = df.sparkSession
    names = dict(enumerate(columns))
    d = df.select(F.col(target).cast("string").alias("y"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in names.items()]).where("y is not null")
    finite = d.select("y", *[F.when(F.abs(f"c{i}") < float("inf"), F.col(f"c{i}")).alias(f"c{i}") for i in names])
    parts = -(-max(1, finite.count()) // rows)
    probabilities = [i / parts for i in range(1, parts)]
    found = finite.approxQuantile([f"c{i}" for i in names], probabilities, 0.25 / parts) if probabilities else [[] for _ in names]
    cuts = {i: np.unique(np.array([x for x in q if x is not None], float)) for i, q in zip(names, found, strict=True)}

    tall = finite.select("y", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"c{i}").alias("v")) for i in names])).alias("x")).select("x.c", "y", "x.v").where("v is not null")
    counted = tall.groupBy("c", "y", "v").agg(F.count("*").alias("n"))

    def ranged(frames):
        for f in frames:
            c, v = f["c"].to_numpy(), f["v"].to_numpy()
            r = np.zeros(len(f), np.int32)
            for i in np.unique(c):
                r[c == i] = np.searchsorted(cuts[i], v[c == i], "right")
            yield f.assign(r=r)

    counts = staged(counted.mapInPandas(ranged, "c int, y string, v double, n long, r int"), "counts")
    classes = counts.groupBy("c", "y").agg(F.sum("n").alias("total")).where("total > 1")
    counts = staged(counts.join(F.broadcast(classes) if classes.count() <= 100_000 else classes, ["c", "y"]).select("c", "y", "v", "n", "total", "r"), "counts")
    before: dict[int, np.ndarray] = {i: np.zeros(len(q) + 2, np.int64) for i, q in cuts.items()}
    for row in counts.groupBy("c", "r").agg(F.sum("n").alias("n")).collect():  # a row a column and range
        before[row["c"]][row["r"] + 1] = row["n"]
    before = {i: np.cumsum(q) for i, q in before.items()}

    def ends(f: pd.DataFrame) -> pd.DataFrame:
        """The first and last k values of each class in a range."""
        f = f.sort_values(["y", "v"])
        g = f.groupby("y", sort=False)
        return f[(g.cumcount() < k) | (g.cumcount(ascending=False) < k)]

    def halos(f: pd.DataFrame) -> pd.DataFrame:
        """For each range of a class, the k values before and behind it."""
        f = f.sort_values("v")
        r, out = f["r"].to_numpy(), [f.iloc[:0]]
        for i in np.unique(r):
            lo, hi = np.searchsorted(r, i, "left"), np.searchsorted(r, i, "right")
            out += [f.iloc[max(0, lo - k) : lo].assign(r=i), f.iloc[hi : hi + k].assign(r=i)]
        return pd.concat(out)

    halo = counts.groupBy("c", "r").applyInPandas(ends, _COUNTS).groupBy("c", "y").applyInPandas(halos, _COUNTS)
    both = counts.withColumn("own", F.lit(True)).unionByName(halo.withColumn("own", F.lit(False)))

    def asks(f: pd.DataFrame) -> pd.DataFrame:
        """Two questions a value: rows up to the end of its neighbourhood, and rows before its start."""
        out = []
        for _, g in f.sort_values("v").groupby("y"):
            x, n, own = g["v"].to_numpy(), g["n"].to_numpy(), g["own"].to_numpy()
            far = _kth(x, n, min(k, int(g["total"].iloc[0]) - 1))
            out.append(g[own].assign(d=far[own]))
        f = pd.concat(out)
        sides = []
        for right in (True, False):
            at = _boundary(cuts[int(f["c"].iloc[0])], f["v"].to_numpy(), f["d"].to_numpy(), np.full(len(f), right))
            sides.append(f[["c", "y", "v", "n", "d"]].assign(r=at.astype(np.int32), right=right))
        return pd.concat(sides)

    questions = both.groupBy("c", "r").applyInPandas(asks, "c int, y string, v double, n long, d double, r int, right boolean")

    def answers(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.groupby("v", sort=True)["n"].sum()
        sums = np.concatenate([[0], np.cumsum(held.to_numpy())]).astype(np.int64)
        right = asked["right"].to_numpy(bool)
        at = _boundary(held.index.to_numpy(float), asked["v"].to_numpy(), asked["d"].to_numpy(), right)
        rows = before[int(key[0])][int(key[1])] + sums[at]
        return asked[["c", "y", "v", "n"]].assign(m=np.where(right, rows, -rows))

    met = questions.groupBy("c", "r").cogroup(counts.groupBy("c", "r")).applyInPandas(answers, "c int, y string, v double, n long, m long")
    near = met.groupBy("c", "y", "v").agg(F.sum("m").alias("m"), F.max("n").alias("n"))
    mean_m = near.groupBy("c").agg((F.sum(F.col("n") * digamma(F.col("m"))) / F.sum("n")).alias("m"))
    ks = F.least(F.lit(k), F.col("total") - 1)
    terms = counts.groupBy("c", "y").agg(F.max("total").alias("total")).groupBy("c").agg(
        F.sum("total").alias("all"), (F.sum(F.col("total") * (digamma(ks) - digamma(F.col("total")))) / F.sum("total")).alias("k")
    )
    got = terms.join(mean_m, "c").select("c", F.greatest(F.lit(0.0), digamma(F.col("all")) + F.col("k") - F.col("m")).alias("mi"))
    named = spark.createDataFrame(list(names.items()), "i int, column_name string")
    return named.join(got, F.col("i") == F.col("c"), "left").select("column_name", F.coalesce("mi", F.lit(0.0)).alias("mi"))
