"""Clustering: k-means, CLARA, density clustering by hierarchy, parameter grids."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import distance, seeded, seeded_unit, squared_distance
from ..session import staged
from . import metrics
from .hierarchy import condensed_labels, positions, spanning_tree, spread
from .ranks import numbered
from .resample import sample_n
from .tiles import copy_number, exact, has_whole, near_lists, run_position, squares, tiled, whole


def _points(df: DataFrame, rows: list[list[float]]) -> DataFrame:
    """A small table of numbered points: a fitted model's centres, k rows."""
    return df.sparkSession.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "c int, m array<double>")


def assign(df: DataFrame, centres: list[list[float]], key: str = "id", vector: str = "features", squared: bool = True) -> DataFrame:
    """(key, vector, cluster, d): nearest centre, the first on ties. Centres are a literal, k x dimensions."""
    measure = squared_distance if squared else distance
    literal = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    far = F.transform(literal, lambda m: measure(F.col(vector), m))
    d = df.select(key, vector, far.alias("_d"))
    return d.select(key, vector, (F.array_position("_d", F.array_min("_d")) - 1).cast("int").alias("cluster"), F.array_min("_d").alias("d"))


def kmeans_step(df: DataFrame, centres: list[list[float]], key: str = "id", vector: str = "features") -> list[list[float]]:
    """Means of the rows nearest to each centre; an empty cluster takes the row that is farthest from its own.

    A partition gives k sums and counts, so what is shuffled does not grow with the rows.
    """
    import pyarrow as pa

    at = np.array(centres, float)

    def task(batches):
        n, sums = np.zeros(len(at), np.int64), np.zeros(at.shape)
        with np.errstate(all="ignore"):
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, at.shape[1])
                down = np.ascontiguousarray(x.T)
                far = np.zeros((len(at), len(x)))
                for c, centre in enumerate(at):  # component by component, as ``assign`` adds them
                    for i, m in enumerate(centre):
                        apart = down[i] - m
                        far[c] += apart * apart
                label = np.where(np.isnan(far), np.inf, far).argmin(axis=0)
                for c in np.unique(label):
                    n[c] += (label == c).sum()
                    sums[c] += x[label == c].sum(axis=0)
        got = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(got.astype(np.int32)), pa.array(n[got]), pa.array(sums[got].tolist(), pa.list_(pa.float64()))], ["cluster", "n", "sums"])

    parts = whole(df, vector).select(F.col(vector).cast("array<double>")).mapInArrow(task, "cluster int, n long, sums array<double>")
    means = parts.select("cluster", "n", F.posexplode("sums").alias("i", "v")).groupBy("cluster", "i").agg((F.sum("v") / F.sum("n")).alias("m")).collect()  # k x dimensions rows
    new = [[None] * len(centres[0]) for _ in centres]
    for r in means:
        new[r["cluster"]][r["i"]] = r["m"]
    empty = [k for k, c in enumerate(new) if c[0] is None]
    if empty:
        for k, r in zip(empty, assign(whole(df, vector), centres, key, vector).orderBy(F.desc("d"), key).limit(len(empty)).collect(), strict=False):
            new[k] = list(r[vector])
    return [c if c[0] is not None else centres[k] for k, c in enumerate(new)]


def nearest(df: DataFrame, centres: list[list[float]], key: str = "id", vector: str = "features") -> DataFrame:
    """(key, cluster, d): nearest of many centres (squared distance), the first on ties; centres go to the tasks as one matrix."""
    import pandas as pd

    at = np.array(centres, float)

    def task(frames):
        for f in frames:
            for s in range(0, len(f), 1024):
                part = f.iloc[s : s + 1024]
                x = np.stack(part[vector].to_numpy()).astype(float)
                d = np.stack([((x - c) ** 2).sum(axis=1) for c in at], axis=1)
                yield pd.DataFrame({key: part[key], "cluster": d.argmin(axis=1).astype(np.int32), "d": d.min(axis=1)})

    return df.select(key, vector).mapInPandas(task, f"{key} {dict(df.dtypes)[key]}, cluster int, d double")


def weighted_starts(x: np.ndarray, weight: np.ndarray, k: int, seed: int, tries: int = 8) -> np.ndarray:
    """k centres of weighted points: drawn one by one by weight and squared distance, then moved to their means; the best of some tries."""
    rng, best = np.random.default_rng(seed), (math.inf, x[:k])
    for _ in range(tries):
        chosen = [int(rng.choice(len(x), p=weight / weight.sum()))]
        far = ((x - x[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < k:
            p = far * weight
            chosen.append(int(rng.choice(len(x), p=p / p.sum())) if p.sum() > 0 else next(i for i in range(len(x)) if i not in chosen))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        at = x[chosen].copy()
        for _ in range(20):
            label = ((x[:, None, :] - at[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
            for c in range(k):
                if (label == c).any():
                    at[c] = np.average(x[label == c], axis=0, weights=weight[label == c])
        cost = float((((x[:, None, :] - at[None, :, :]) ** 2).sum(axis=2).min(axis=1) * weight).sum())
        if cost < best[0]:
            best = (cost, at)
    return best[1]


def oversampled_starts(d: DataFrame, k: int, seed: int = 42, key: str = "id", vector: str = "features", rounds: int = 5, factor: int = 2) -> list[list[float]]:
    """k starting centres, far apart in proportion to cost, by parallel oversampling.

    From one row on, each round draws every row with probability ``factor * k * d / cost``, where d is its
    squared distance to the rows drawn so far and cost the sum of d: about ``factor * k`` rows a round reach
    the driver. All rows then count for the drawn row that is nearest, and the drawn rows, weighted so, are
    clustered in one place. Draws follow the hash of the key.
    """
    drawn = [[float(x) for x in r[vector]] for r in sample_n(d, key, 1, seed).collect()]
    for i in range(rounds):
        far = nearest(d, drawn, key, vector).select(F.col(key).alias("_k"), "d")
        cost = far.agg(F.sum("d")).first()[0] or 0.0
        if cost <= 0:
            break
        lucky = far.where(seeded_unit(seed * 1000 + i + 1, F.col("_k")) * cost < F.col("d") * (factor * k))
        drawn += [[float(x) for x in r[vector]] for r in d.join(lucky, F.col(key) == F.col("_k")).orderBy(key).select(vector).collect()]
    counts = {r["cluster"]: r["n"] for r in nearest(d, drawn, key, vector).groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    points = np.array([drawn[c] for c in sorted(counts)])
    if len(points) < k:  # fewer different rows than clusters
        points = np.array([r[vector] for r in sample_n(d, key, k, seed).orderBy(key).collect()], float)
        return points.tolist()
    return weighted_starts(points, np.array([counts[c] for c in sorted(counts)], float), k, seed).tolist()


class KMeans:
    """Lloyd's algorithm until it settles; the best of ``n_init`` starts by inertia.

    ``init`` is "k-means++" (``oversampled_starts``) or "random" (rows in hash order). Rows whose vector
    is null or holds a null take no part.
    """

    def __init__(self, n_clusters: int = 8, max_iter: int = 300, n_init: int = 10, random_state: int = 42, key: str = "id", vector: str = "features", init: str = "k-means++") -> None:
        self.n_clusters, self.max_iter, self.n_init, self.random_state, self.key, self.vector, self.init = n_clusters, max_iter, n_init, random_state, key, vector, init

    def _start(self, d: DataFrame, seed: int) -> list[list[float]]:
        if self.init not in ("k-means++", "random"):
            raise ValueError(f"unknown init {self.init}")
        if self.init == "k-means++":
            return oversampled_starts(d, self.n_clusters, seed, self.key, self.vector)
        return [list(r[self.vector]) for r in sample_n(d, self.key, self.n_clusters, seed).orderBy(self.key).collect()]

    def fit(self, df: DataFrame) -> KMeans:
        d = whole(df, self.vector).select(self.key, self.vector).cache()
        best = math.inf
        for i in range(self.n_init):
            centres = self._start(d, self.random_state + i)
            if len(centres) < self.n_clusters:
                raise ValueError("fewer rows than clusters")
            for _ in range(self.max_iter):
                new = kmeans_step(d, centres, self.key, self.vector)
                if np.allclose(new, centres, rtol=1e-6, atol=1e-8):
                    break
                centres = new
            inertia = assign(d, centres, self.key, self.vector).agg(F.sum("d")).first()[0]
            if inertia < best:
                best, self.centres, self.inertia = inertia, centres, inertia
        d.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return assign(df, self.centres, self.key, self.vector).select(self.key, "cluster")


class MiniBatchKMeans:
    """Mini-batch k-means over all rows; the best of ``n_init`` starts by inertia.

    In an epoch each partition moves its own copy of the centres batch by batch, by the share of
    a batch in the rows seen so far; the copies are then averaged by their rows. What leaves a
    partition is k x dimensions numbers, and every row counts in every epoch. Rows without a
    vector are ignored; an empty cluster keeps its centre.
    """

    def __init__(self, n_clusters: int = 8, batch_size: int = 1024, max_iter: int = 100, n_init: int = 3, random_state: int = 42, key: str = "id", vector: str = "features") -> None:
        self.n_clusters, self.batch_size, self.max_iter, self.n_init, self.random_state, self.key, self.vector = n_clusters, batch_size, max_iter, n_init, random_state, key, vector

    def _epoch(self, d: DataFrame, centres: list[list[float]]) -> list[list[float]]:
        import pandas as pd

        size, vector = self.batch_size, self.vector

        def task(frames):
            at, seen = np.array(centres, float), np.zeros(len(centres))
            for frame in frames:
                for s in range(0, len(frame), size):
                    x = np.stack(frame[vector].iloc[s : s + size].to_numpy()).astype(float)
                    label = ((x[:, None, :] - at[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
                    for c in np.unique(label):
                        mine = x[label == c]
                        seen[c] += len(mine)
                        at[c] += (mine.sum(axis=0) - len(mine) * at[c]) / seen[c]
            c, i = (v.ravel() for v in np.indices(at.shape, np.int32))
            got = pd.DataFrame({"c": c, "i": i, "v": at.ravel(), "n": np.repeat(seen, at.shape[1])})
            yield got[got["n"] > 0]

        rows = d.select(vector).mapInPandas(task, "c int, i int, v double, n double").groupBy("c", "i").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"))
        new = [list(c) for c in centres]
        for r in rows.collect():  # k x dimensions rows
            new[r["c"]][r["i"]] = r["v"]
        return new

    def fit(self, df: DataFrame) -> MiniBatchKMeans:
        d = df.select(self.key, self.vector).where(F.col(self.vector).isNotNull()).cache()
        best = math.inf
        for i in range(self.n_init):
            centres = [[float(x) for x in r[self.vector]] for r in sample_n(d, self.key, self.n_clusters, self.random_state + i).orderBy(self.key).collect()]
            if len(centres) < self.n_clusters:
                raise ValueError("fewer rows than clusters")
            for _ in range(self.max_iter):
                new = self._epoch(d, centres)
                done = np.allclose(new, centres, rtol=1e-4, atol=1e-6)
                centres = new
                if done:
                    break
            inertia = assign(d, centres, self.key, self.vector).agg(F.sum("d")).first()[0]
            if inertia < best:
                best, self.centres, self.inertia = inertia, centres, inertia
        d.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return assign(df, self.centres, self.key, self.vector).select(self.key, "cluster")


def library_kmeans(df: DataFrame, k: int, seed: int = 42, vector: str = "features"):
    """MLlib k-means|| over all rows."""
    from pyspark.ml.clustering import KMeans as Library
    from pyspark.ml.functions import array_to_vector

    d = df.select(array_to_vector(vector).alias("features"))
    return Library(k=k, maxIter=300, seed=seed).fit(d)


def pam(x: np.ndarray, k: int, rounds: int = 100) -> list[int]:
    """Partitioning around medoids on a small sample: the first swap that lowers the cost is taken, then the search restarts."""
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    medoids = list(range(k))
    cost = d[:, medoids].min(axis=1).sum()
    for _ in range(rounds):
        found = None
        for m in range(k):
            rest = d[:, medoids[:m] + medoids[m + 1 :]].min(axis=1) if k > 1 else np.full(len(x), np.inf)
            costs = np.minimum(rest[:, None], d).sum(axis=0)
            costs[medoids] = np.inf
            better = np.flatnonzero(costs < cost - 1e-12)
            if len(better):
                found = (m, int(better[0]), float(costs[better[0]]))
                break
        if found is None:
            break
        medoids[found[0]], cost = found[1], found[2]
    return medoids


def alternate(x: np.ndarray, k: int, rounds: int = 300, seed: int = 42) -> list[int]:
    """Alternating k-medoids from a k-means++ start."""
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    rng = np.random.default_rng(seed)
    medoids = [int(rng.integers(len(x)))]
    while len(medoids) < k:
        w = d[:, medoids].min(axis=1) ** 2
        medoids.append(int(rng.choice(len(x), p=w / w.sum())) if w.sum() > 0 else next(i for i in range(len(x)) if i not in medoids))
    for _ in range(rounds):
        label = d[:, medoids].argmin(axis=1)
        new = [int(np.flatnonzero(label == c)[d[np.ix_(label == c, label == c)].sum(axis=1).argmin()]) if (label == c).any() else medoids[c] for c in range(k)]
        if new == medoids:
            break
        medoids = new
    return medoids


class Clara:
    """Medoids of seeded samples; the sample whose medoids cost least on all rows wins.

    Samples have ``n_sampling`` rows (plus 2k for the alternate method), so the driver's part is fixed.
    """

    def __init__(self, n_clusters: int = 3, n_sampling: int = 40, n_sampling_iter: int = 5, random_state: int = 42, method: str = "pam", key: str = "id", vector: str = "features") -> None:
        self.n_clusters, self.n_sampling, self.n_sampling_iter, self.random_state, self.method, self.key, self.vector = n_clusters, n_sampling, n_sampling_iter, random_state, method, key, vector

    def fit(self, df: DataFrame) -> Clara:
        d = df.select(self.key, self.vector)
        size = self.n_sampling + (2 * self.n_clusters if self.method == "alternate" else 0)
        best = math.inf
        for i in range(self.n_sampling_iter):
            rows = sample_n(d, self.key, size, self.random_state + i).orderBy(self.key).collect()
            if self.n_clusters > len(rows):
                raise ValueError("more clusters than sampled rows")
            x = np.array([r[self.vector] for r in rows], float)
            chosen = pam(x, self.n_clusters) if self.method == "pam" else alternate(x, self.n_clusters, seed=self.random_state + i)
            medoids = x[chosen].tolist()
            cost = medoid_cost(d, medoids, self.key, self.vector).first()[0]
            if cost < best:
                best, self.medoids, self.cost, self.medoid_ids = cost, medoids, cost, [rows[c][self.key] for c in chosen]
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return assign(df, self.medoids, self.key, self.vector, squared=False).select(self.key, "cluster")


def medoid_cost(df: DataFrame, medoids: list[list[float]], key: str = "id", vector: str = "features") -> DataFrame:
    """Sum and mean of the (unsquared) distances to the nearest medoid."""
    return assign(df, medoids, key, vector, squared=False).agg(F.sum("d").alias("medoid_cost"), F.avg("d").alias("avg_medoid_dist"))


def core_distances(df: DataFrame, min_samples: int, key: str = "id", vector: str = "features") -> DataFrame:
    """(key, core): distance to the min_samples-th neighbour, the row itself not counted; none for rows without a whole vector."""
    return _core(staged(near_lists(df, df, min_samples, key, vector, exclude_self=True), "neighbours"), whole(df, vector).count(), min_samples, key)


def _core(lists: DataFrame, rows: int, min_samples: int, key: str) -> DataFrame:
    """Core distances from the lists of nearest rows (``tiles.near_lists``) of ``rows`` rows."""
    got = lists.where(F.size("d") >= min_samples).select(key, F.col("d")[min_samples - 1].alias("core"))
    if got.count() < rows:
        raise ValueError("min_samples must be smaller than the number of rows")
    return got


def mutual_reachability(df: DataFrame, core: DataFrame, pairs: DataFrame, key: str = "id") -> DataFrame:
    """(a, b, w) for pairs (a, b, d): the largest of the distance and both core distances."""
    ca, cb = (core.select(F.col(key).alias(f"_{s}"), F.col("core").alias(f"core_{s}")) for s in "ab")
    return pairs.join(ca, F.col("a") == F.col("_a")).join(cb, F.col("b") == F.col("_b")).select("a", "b", F.greatest("d", "core_a", "core_b").alias("w"))


def reachability_range(df: DataFrame, core: DataFrame, key: str = "id", vector: str = "features") -> DataFrame:
    """(key, least, most): smallest and largest mutual reachability of each row, over all other rows."""
    import pandas as pd

    d = staged(df.select(key, vector).join(core.select(F.col(key).alias("_k"), "core"), F.col(key) == F.col("_k")).select(key, vector, "core"), "reachability")

    def kernel(ak, x, ac, bk, y, bc):
        most = np.maximum(ac, bc.max())
        order = np.lexsort((bk, bc))
        order = order[copy_number(y[order]) < 2]  # the row itself and another
        bk, y, bc = bk[order], y[order], bc[order]
        by_key = np.argsort(bk, kind="stable")
        own = by_key[np.minimum(np.searchsorted(bk[by_key], ak), len(bk) - 1)]
        least, far = np.full(len(x), np.inf), np.zeros(len(x))
        for at, sq, error in squares(x, y):
            r, c = np.nonzero(sq >= sq.max(axis=1)[:, None] - 2 * error)
            np.maximum.at(far, at + r, exact(x[at + r], y[c]))
            np.maximum(sq, (bc * bc)[None, :], out=sq)
            error += 4 * np.finfo(float).eps * float((bc * bc).max())
            here = np.arange(len(sq))
            me = own[at : at + len(sq)]
            sq[here[bk[me] == ak[at : at + len(sq)]], me[bk[me] == ak[at : at + len(sq)]]] = np.inf
            r, c = np.nonzero((sq <= sq.min(axis=1)[:, None] + 2 * error) & np.isfinite(sq))
            np.minimum.at(least, at + r, np.maximum(exact(x[at + r], y[c]), bc[c]))
        return pd.DataFrame({"k": ak, "least": np.maximum(least, ac), "most": np.maximum(most, far)})

    kind = dict(df.dtypes)[key]
    return tiled(d, d, kernel, f"k {kind}, least double, most double", key, vector, "core").groupBy(F.col("k").alias(key)).agg(F.min("least").alias("least"), F.max("most").alias("most"))


def links_within(df: DataFrame, eps: float, key: str = "id", vector: str = "features") -> DataFrame:
    """(a, b, w): links between rows at most ``eps`` apart, enough of them to join all rows that links join.

    A tile returns a spanning forest of its links, at most one a row, not all pairs.
    """
    import pandas as pd

    def kernel(ak, x, _, bk, y, __):
        found = [(np.empty(0, int), np.empty(0, int))]
        root = np.arange(len(y))  # of the rows of one side, as the links so far join them
        for at, sq, error in squares(x, y):
            error += 4 * np.finfo(float).eps * eps * eps
            r, c = np.nonzero((sq <= eps * eps + error) & (eps >= 0))
            close = np.flatnonzero(sq[r, c] >= eps * eps - error)
            keep = np.ones(len(r), bool)
            keep[close] = exact(x[at + r[close]], y[c[close]]) <= eps
            r, c = r[keep], c[keep]
            first = np.flatnonzero(run_position(r) == 0)
            for i, linked in zip(r[first], np.split(c, first[1:]), strict=False):
                top = root[linked]
                while (root[top] != top).any():
                    top = root[top]
                root[linked] = top
                tops, one = np.unique(top, return_index=True)
                root[tops] = tops[0]
                found.append((np.full(len(one), at + i), linked[one]))
        r, c = (np.concatenate(t) for t in zip(*found, strict=True))
        r, c = (t[ak[r] != bk[c]] for t in (r, c))
        return pd.DataFrame({"a": ak[r], "b": bk[c], "w": exact(x[r], y[c])})

    kind = dict(df.dtypes)[key]
    return tiled(df, df, kernel, f"a {kind}, b {kind}, w double", key, vector, mirrored=True)


def components_at(edges: DataFrame, nodes: DataFrame, eps: float, min_size: int = 1, key: str = "id") -> DataFrame:
    """(key, cluster) by links of weight at most eps: 0, 1, ... by smallest member, -1 under min_size.

    See ``hierarchy.spread``.
    """
    label = spread(edges.where(F.col("w") <= eps), nodes.select(F.col(key).alias("n")))
    size = label.groupBy("l").agg(F.count("*").alias("s")).where(F.col("s") >= min_size)
    named = numbered(size, "l", "cluster").select(F.col("l").alias("_l"), "cluster")
    return label.join(named, F.col("l") == F.col("_l"), "left").select(F.col("n").alias(key), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def _numbered(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(i, key, v): rows with a whole vector, numbered by key."""
    return staged(positions(whole(df, vector).select(key, F.col(vector).cast("array<double>").alias("v")), [key], "i"), "rows")


def minimum_spanning_tree(df: DataFrame, core: DataFrame, key: str = "id", vector: str = "features", k: int = 16) -> DataFrame:
    """(a, b, w): edges of the spanning tree that is least by mutual reachability, then by keys; a < b. See ``hierarchy.spanning_tree``."""
    rows = _numbered(df, key, vector)
    lists = staged(near_lists(rows, rows, k, "i", "v", exclude_self=True), "neighbours")
    known = staged(rows.join(core.select(F.col(key).alias("_k"), "core"), F.col(key) == F.col("_k")).select("i", "v", "core"), "rows")
    tree = spanning_tree(known, lists, k)
    name = lambda c: rows.select(F.col("i").alias(f"_{c}"), F.col(key).alias(c))
    return tree.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "w").join(name("a"), "_a").join(name("b"), "_b").select("a", "b", "w")


class Hdbscan:
    """Density clustering by hierarchy: spanning tree, condensed tree and labels are tables (``hierarchy``).

    Rows whose vector is null or holds a null are noise. Ties between edges go by keys, so that the
    result does not depend on partitions.
    """

    def __init__(self, min_cluster_size: int = 5, min_samples: int | None = None, key: str = "id", vector: str = "features", most_clusters: int = 1_000_000) -> None:
        self.min_cluster_size, self.min_samples, self.key, self.vector, self.most_clusters = min_cluster_size, min_samples or min_cluster_size, key, vector, most_clusters

    def fit_predict(self, df: DataFrame) -> DataFrame:
        rows = _numbered(df, self.key, self.vector)
        n, k = rows.count(), max(16, self.min_samples)
        lists = staged(near_lists(rows, rows, k, "i", "v", exclude_self=True), "neighbours")
        core = _core(lists, n, self.min_samples, "i").select(F.col("i").alias("_i"), "core")
        tree = spanning_tree(staged(rows.join(core, F.col("i") == F.col("_i")).select("i", "v", "core"), "rows"), lists, k)
        labels = condensed_labels(tree, n, self.min_cluster_size, most_clusters=self.most_clusters)
        made = rows.join(labels, "i").select(self.key, "cluster")
        odd = df.where(~has_whole(self.vector)).select(self.key, F.lit(-1).alias("cluster"))
        return made.unionByName(odd).withColumn("probability", F.when(F.col("cluster") < 0, 0.0).otherwise(1.0))


def cluster(df: DataFrame, algorithm: str, key: str = "id", vector: str = "features", evaluate: bool = True, sampling: str = "stratified", silhouette_size: int = 50_000, silhouette_repeats: int = 5, **params) -> tuple[DataFrame, dict]:
    """Rows with their cluster, and the metrics: the drivers of maps and grids.

    The silhouette is that of samples (``metrics.sampled_silhouette``); medoid clusters also get
    the mean distance to their medoid.
    """
    distances = None
    if algorithm == "kmeans":
        model = KMeans(key=key, vector=vector, **params).fit(df)
        labels = model.predict(df)
    elif algorithm == "minibatch":
        labels = MiniBatchKMeans(key=key, vector=vector, **params).fit(df).predict(df)
    elif algorithm == "clara":
        medoids = Clara(key=key, vector=vector, **params).fit(df)
        labels, distances = medoids.predict(df), medoid_cost(df, medoids.medoids, key, vector)
    elif algorithm == "hdbscan":
        labels = Hdbscan(key=key, vector=vector, **params).fit_predict(df).select(key, "cluster")
    else:
        raise ValueError(f"unknown algorithm {algorithm}")
    out = df.join(labels.withColumnRenamed(key, "_k"), F.col(key) == F.col("_k")).drop("_k")
    if not evaluate:
        return out, {}
    rows = staged(out.select(key, "cluster", vector), "clustered")
    scored = rows if algorithm != "hdbscan" else rows.where("cluster <> -1")
    got = {"ch": metrics.calinski_harabasz(scored, "cluster", vector).first()[0], "dbi": metrics.davies_bouldin(scored, "cluster", vector).first()[0]}
    got |= metrics.sampled_silhouette(scored, key, "cluster", vector, silhouette_size, silhouette_repeats, sampling=sampling)
    got["avg_medoid_dist"] = distances.first()["avg_medoid_dist"] if distances is not None else None
    got |= metrics.noise_summary(rows).first().asDict()
    if got["n_clusters"] < 2:
        got |= {"ch": None, "dbi": None}
    return out, got | metrics.wcss(rows, "cluster", vector).first().asDict()


def run_grid(df: DataFrame, algorithm: str, grid: dict[str, list], path: str | None = None, **fixed) -> DataFrame:
    """One row of metrics for each parameter set of a grid; with ``path``, all rows of the file, earlier runs included."""
    got = run_list(df, algorithm, [dict(zip(grid, values, strict=True)) for values in product(*grid.values())], path, **fixed)
    return df.sparkSession.read.schema(GRID_SCHEMA).parquet(path) if path else got


def run_list(df: DataFrame, algorithm: str, sets: list[dict], path: str | None = None, **fixed) -> DataFrame:
    """One row of metrics for each of the given parameter sets, those of this run only; with ``path`` each is appended as it is done."""
    spark = df.sparkSession
    rows = []
    for params in sets:
        _, m = cluster(df, algorithm, **params, **fixed)
        rows.append((algorithm, str(params), *[float(m[k]) if m.get(k) is not None else None for k in GRID_METRICS]))
        if path:
            spark.createDataFrame(rows[-1:], GRID_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.createDataFrame(rows, GRID_SCHEMA)


def map_rows(df: DataFrame, x: str = "longitude", y: str = "latitude", cluster: str = "cluster") -> DataFrame:
    """(x, y, label) of a cluster map; noise is named so, rows without a place are left out."""
    label = F.when(F.col(cluster) == -1, "Noise").otherwise(F.concat(F.lit("Cluster "), F.col(cluster).cast("string")))
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"), label.alias("label"))


GRID_METRICS = ("ch", "dbi", "silhouette", "silhouette_std", "avg_medoid_dist", "n_clusters", "n_noise", "noise_ratio", "wcss_per_point")
GRID_SCHEMA = "algorithm string, params string, " + ", ".join(f"{m} double" for m in GRID_METRICS)


def seeded_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(seeded(seed, F.col(key)), key)
