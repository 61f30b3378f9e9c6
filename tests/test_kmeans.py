"""Starts by parallel oversampling, and k-means from them."""

import numpy as np
import pytest

from emberline.operators import cluster, metrics


@pytest.fixture(scope="module")
def parted(spark):
    rng = np.random.default_rng(4)
    at = rng.uniform(-100, 100, (9, 3))
    x = np.concatenate([c + rng.normal(0, 0.7, (40 if i else 400, 3)) for i, c in enumerate(at)])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>").repartition(3).cache()
    return df, x


def test_cost_is_that_of_the_best_random_start(spark, parted):
    df, x = parted
    one = cluster.KMeans(9, n_init=1).fit(df)
    best = np.inf
    for seed in range(10):  # ten random starts, in one process
        at = x[np.random.default_rng(seed).choice(len(x), 9, replace=False)]
        for _ in range(100):
            label = ((x[:, None] - at[None]) ** 2).sum(axis=2).argmin(axis=1)
            at = np.stack([x[label == c].mean(axis=0) if (label == c).any() else at[c] for c in range(9)])
        best = min(best, ((x[:, None] - at[None]) ** 2).sum(axis=2).min(axis=1).sum())
    assert one.inertia <= 1.01 * best
    labels = one.predict(df)
    assert labels.select("cluster").distinct().count() == 9
    again = cluster.KMeans(9, n_init=1).fit(df.repartition(5))
    assert np.allclose(again.centres, one.centres)


def test_one_start_a_cluster(parted):
    df, x = parted
    starts = np.array(cluster.oversampled_starts(df, 9))
    near = ((x[:, None] - starts[None]) ** 2).sum(axis=2).min(axis=1)
    assert near.max() < 10**2 and len(starts) == 9


def test_few_different_rows(spark):
    rows = [(i, [float(i % 2)]) for i in range(10)] + [(20, None), (21, [None])]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    model = cluster.KMeans(3, n_init=1, max_iter=5).fit(df)
    assert len(model.centres) == 3 and model.inertia == 0.0
    with pytest.raises(ValueError, match="fewer rows"):
        cluster.KMeans(11, n_init=1).fit(df)
    with pytest.raises(ValueError, match="init"):
        cluster.KMeans(2, init="other").fit(df)
    assert cluster.KMeans(2, n_init=2, init="random").fit(df).inertia == 0.0


def test_silhouette_leaves_out_null_vectors(spark):
    rows = [(1, 0, [0.0]), (2, 0, [1.0]), (3, 1, [9.0]), (4, 1, [8.0])]
    more = [(5, 1, None), (6, 0, [None])]
    make = lambda r: spark.createDataFrame(r, "id long, cluster int, features array<double>")
    got, want = (metrics.silhouette(make(r)).first() for r in (rows + more, rows))
    assert tuple(got) == tuple(want)


def test_step_shuffles_sums_and_takes_null_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (300, 3))
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(900, None), (901, [1.0, None, 2.0])]
    df = spark.createDataFrame(rows, "id long, features array<double>").repartition(3)
    centres = [[1.0, 0.0, 0.0], [-1.0, 0.0, 0.0], [1.0, 0.0, 0.0]]  # the third ties with the first and stays empty
    label = ((x[:, None] - np.array(centres)[None]) ** 2).sum(axis=2).argmin(axis=1)
    far = ((x[:, None] - np.array(centres)[None]) ** 2).sum(axis=2).min(axis=1)
    got = cluster.kmeans_step(df, centres)
    for c in (0, 1):
        assert np.allclose(got[c], x[label == c].mean(axis=0), rtol=1e-12)
    assert got[2] == x[far.argmax()].tolist()
