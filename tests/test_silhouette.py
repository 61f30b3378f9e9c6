"""Silhouette from sums of distances by point and cluster, each two blocks once."""

import numpy as np
import pytest

from emberline.operators import metrics, tiles


def brute(x, c):
    """Mean silhouette by differences; rows without cluster and singletons count 0."""
    total = 0.0
    for i, mine in enumerate(c):
        if mine is None or c.count(mine) == 1:
            continue
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        mean = {o: d[[j for j, k in enumerate(c) if k == o]].sum() / (c.count(o) - (o == mine)) for o in set(c) - {None}}
        a, b = mean[mine], min(v for o, v in mean.items() if o != mine)
        total += (b - a) / max(a, b) if max(a, b) else 0.0
    return total / len(c)


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_sums_of_either_side_are_those_of_differences(offset):
    rng = np.random.default_rng(1)
    x, y = rng.normal(offset, 1, (300, 5)), rng.normal(offset, 1, (500, 5))
    y[:40] = x[:40] + rng.normal(0, 1e-7, (40, 5))  # close ones, where a product alone is wrong
    cx, cy = np.sort(rng.integers(0, 4, 300)), np.sort(rng.integers(0, 60, 500))
    wx, wy = rng.integers(1, 5, 300).astype(float), rng.integers(1, 5, 500).astype(float)
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    left, right = np.zeros((300, 60)), np.zeros((500, 4))
    for of_left, rows, c, sums in tiles.cluster_sums(x, cx, wx, y, cy, wy, True, (37, 101)):
        got = left if of_left else right
        assert not got[rows, c].any()
        got[rows, c] = sums
    for o in range(60):
        assert np.allclose(left[:, o], d[:, cy == o] @ wy[cy == o], rtol=1e-9)
    for o in range(4):
        assert np.allclose(right[:, o], wx[cx == o] @ d[cx == o], rtol=1e-9)


@pytest.mark.parametrize("names", [int, str])
def test_copies_singletons_and_rows_without_cluster(spark, names):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (60, 4)), rng.normal(3, 1, (50, 4)), rng.normal(9, 1, (2, 4))])
    x[10:30] = x[5]  # many copies, also in another cluster
    x[70:90] = x[5]
    c = [names(0)] * 60 + [names(1)] * 50 + [names(2), None]
    rows = [(i, k, r.tolist()) for i, (k, r) in enumerate(zip(c, x, strict=True))]
    df = spark.createDataFrame(rows, f"id long, cluster {'int' if names is int else 'string'}, features array<double>")
    for blocks in (1, 8):
        assert metrics.silhouette(df, blocks=blocks).first()[0] == pytest.approx(brute(x, c), abs=1e-12)


def test_nan_stays_in_its_cluster(spark):
    rows = [(0, 0, [0.0]), (1, 0, [1.0]), (2, 1, [5.0]), (3, 1, [7.0]), (4, 2, [float("nan")])]
    df = spark.createDataFrame(rows, "id long, cluster int, features array<double>")
    x = np.array([[0.0], [1.0], [5.0], [7.0]])
    assert metrics.silhouette(df).first()[0] == pytest.approx(brute(x, [0, 0, 1, 1]) * 4 / 5)


def test_all_rows_equal(spark):
    df = spark.createDataFrame([(i, i % 2, [1.0, 2.0]) for i in range(6)], "id long, cluster int, features array<double>")
    assert metrics.silhouette(df).first()[0] == 0.0
    assert metrics.silhouette(df.limit(0)).first()[0] is None
