"""Operators on all pairs, against brute force on copies, ties and groups larger than a list of neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline import session
from emberline.operators import cluster, resample, tiles


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def brute(x: np.ndarray) -> np.ndarray:
    """All distances, added component by component in order."""
    total = np.zeros((len(x), len(x)))
    for i in range(x.shape[1]):
        total += (x[:, None, i] - x[None, :, i]) ** 2
    return np.sqrt(total)


@pytest.fixture(scope="module")
def awkward(spark):
    """Far from the origin: copies, tight groups larger than a list of neighbours, lattice points at equal distances, strays."""
    rng = np.random.default_rng(7)
    groups = [np.repeat(rng.normal(0, 5, (1, 3)), 25, axis=0)] + [c + rng.normal(0, 1e-3, (30, 3)) for c in rng.normal(0, 5, (3, 3))]
    lattice = np.stack(np.meshgrid(*[np.arange(3.0)] * 3), axis=-1).reshape(-1, 3) + 40
    x = rng.permutation(np.concatenate([*groups, lattice, rng.normal(0, 20, (20, 3))]) + 1e5)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").cache()


@pytest.mark.parametrize("eps", [-1.0, 0.004, 8.0, 1e3])
def test_links_join_what_all_pairs_join(spark, awkward, eps):
    x, d = awkward
    links = cluster.links_within(d, eps)
    got = rows(cluster.components_at(links, d, eps, 3), "id")
    dist = brute(x)
    a, b = np.nonzero(np.triu(dist <= eps, 1))
    pairs = spark.createDataFrame([(int(i), int(j), float(dist[i, j])) for i, j in zip(a, b)], "a long, b long, w double")
    assert got == rows(cluster.components_at(pairs, d, eps, 3), "id")
    assert all(r["w"] == dist[r["a"], r["b"]] <= eps for r in links.collect())
    assert links.count() <= 10 * 2 * len(x) and (eps < 1e3 or len(a) > 10_000)  # 10 tiles, a forest each


def test_links_do_not_grow_with_pairs(spark):
    d = spark.range(3000).select("id", F.array(F.col("id") / 1e4).alias("features"))
    links = cluster.links_within(d, 1.0)  # links all 4.5 million pairs
    assert links.count() <= 10 * 2 * 3000
    assert {r["cluster"] for r in cluster.components_at(links, d, 1.0).collect()} == {0}


@pytest.mark.parametrize("k, own", [(1, True), (5, True), (40, True), (3, False)])
def test_nearest_in_tiles(awkward, k, own):
    x, d = awkward
    dist = brute(x)
    if own:
        np.fill_diagonal(dist, np.inf)
    got = {}
    for r in resample.nearest(d, d, k, exclude_self=own, rows=30).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["near"], r["d"]))
    for i, row in enumerate(dist):
        order = np.lexsort((np.arange(len(x)), row))[:k]
        assert sorted(got[i]) == [(n + 1, j, row[j]) for n, j in enumerate(order)]


def test_squares_of_odd_vectors():
    x = np.array([[1e200, 0.0], [1e200, 3.0], [np.nan, 0.0], [np.inf, 0.0], [0.0, 4.0]])
    (at, sq, error), = tiles.squares(x, x)
    assert (at, error, sq[0, 1], sq[4, 4]) == (0, 0.0, 9.0, 0.0) and np.isinf(sq[2]).all() and np.isinf(sq[0, 4])


def test_core_distances_meet_rows_once(spark, awkward, monkeypatch):
    x, d = awkward
    made = []
    monkeypatch.setattr(cluster, "staged", lambda df, name: made.append(name) or session.staged(df, name))
    got = {r["id"]: r["core"] for r in cluster.core_distances(d, 4).collect()}
    assert made == ["neighbours"] and all(got[i] == v for i, v in enumerate(np.sort(brute(x), axis=1)[:, 4]))


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").cache()


@pytest.mark.parametrize("k", [2, 5, 40])
def test_spanning_tree_is_the_first_by_weight_and_ids(awkward, k, min_samples=2):
    x, d = awkward
    dist = brute(x)
    core = np.sort(dist, axis=1)[:, min_samples]
    w = np.maximum(np.maximum(dist, core[:, None]), core[None, :])
    root, want = list(range(len(x))), []

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for v, a, b in sorted((w[a, b], a, b) for a in range(len(x)) for b in range(a + 1, len(x))):  # Kruskal
        if find(a) != find(b):
            root[find(b)] = find(a)
            want.append((a, b, v))
    assert edges(cluster.minimum_spanning_tree(d, cluster.core_distances(d, min_samples), k=k)) == want


def edges(tree):
    return sorted((tuple(r) for r in tree.collect()), key=lambda e: (e[2], e[0], e[1]))


def test_spanning_tree_of_named_rows(spark, blobs):
    named = blobs.limit(40).select(F.format_string("k%03d", "id").alias("id"), "features")
    plain = edges(cluster.minimum_spanning_tree(blobs.limit(40), cluster.core_distances(blobs.limit(40), 3)))
    assert edges(cluster.minimum_spanning_tree(named, cluster.core_distances(named, 3))) == [(f"k{a:03d}", f"k{b:03d}", w) for a, b, w in plain]


def test_reachability_range_is_that_of_all_pairs(spark, awkward):
    x, d = awkward
    n = len(x)
    dist, core = brute(x), cluster.core_distances(d, 5)
    pairs = spark.createDataFrame([(i, j, float(dist[i, j])) for i in range(n) for j in range(n) if i != j], "a long, b long, d double")
    want = cluster.mutual_reachability(d, core, pairs).groupBy(F.col("a").alias("id")).agg(F.min("w").alias("least"), F.max("w").alias("most"))
    assert rows(cluster.reachability_range(d, core), "id") == rows(want, "id")


def test_null_vectors_are_near_nothing(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [0.0, 2.0])]
    d = spark.createDataFrame(rows, "id long, features array<double>")
    near = {r["id"]: r["near"] for r in tiles.near_lists(d, d, 4, exclude_self=True).collect()}
    assert near == {1: [2, 5], 2: [1, 5], 5: [1, 2]}
    assert {(r["a"], r["b"]) for r in cluster.links_within(d, 1.5).collect()} in ({(1, 2)}, {(2, 1)})
    assert {r["id"] for r in cluster.core_distances(d, 2).collect()} == {1, 2, 5}
    got = {r["id"]: (r["cluster"], r["probability"]) for r in cluster.Hdbscan(2, 1).fit_predict(d).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[3] == got[4] == (-1, 0.0)
