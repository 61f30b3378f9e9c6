"""Nearest rows by balls against all pairs in tiles."""

import numpy as np
import pytest

from emberline.operators import balls, tiles


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, None if r is None else [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>").repartition(3)


def lists(df):
    return {r["id"]: (r["near"], r["d"]) for r in df.collect()}


@pytest.fixture(scope="module")
def awkward():
    rng = np.random.default_rng(2)
    blobs = np.concatenate([rng.uniform(-50, 50, 4) + rng.normal(0, 1, (40, 4)) for _ in range(8)])
    grid = rng.integers(0, 3, (60, 4)).astype(float)  # ties
    same = np.tile(rng.normal(size=4), (90, 1))  # a group of copies larger than a part
    far = np.array([[1e6, 0, 0, 0], [-1e6, 1, 1, 1]])
    return [*np.concatenate([blobs, grid, same, far]), None]


@pytest.mark.parametrize(("k", "itself"), [(5, True), (1, False), (100, True)])
def test_as_all_pairs(spark, awkward, monkeypatch, k, itself):
    monkeypatch.setattr(balls, "DENSE", 2.0)  # always by balls
    d = table(spark, awkward)
    assert lists(balls.near_lists(d, d, k, exclude_self=itself, rows=30)) == lists(tiles.near_lists(d, d, k, exclude_self=itself))


def test_two_tables_and_choice(spark, awkward, monkeypatch):
    left, right = table(spark, awkward[::7], 10_000), table(spark, awkward)
    want = lists(tiles.near_lists(left, right, 3))
    assert lists(balls.near_lists(left, right, 3, rows=40)) == want == lists(tiles.near_lists(left, right, 3, rows=40))
    monkeypatch.setattr(balls, "DENSE", -1.0)  # never by balls
    assert lists(balls.near_lists(left, right, 3, rows=40)) == want
    assert lists(balls.near_lists(left, right.limit(0), 3)) == {} == lists(balls.near_lists(left.limit(0), right, 3, rows=40))


def test_rows_in_clusters_visit_few_balls(spark, monkeypatch):
    rng = np.random.default_rng(0)
    at = rng.uniform(-1000, 1000, (40, 3))
    seen = {}
    for n in (1, 5):
        x = np.concatenate([c + rng.normal(0, 1, (25 * n, 3)) for c in at])
        d = table(spark, x)
        counts, met = [], balls._met

        def counted(lefts, *args, counts=counts, met=met):
            counts.append(lefts.count())
            return met(lefts, *args)

        monkeypatch.setattr(balls, "_met", counted)
        got = lists(balls.near_lists(d, d, 3, exclude_self=True, rows=100))
        monkeypatch.setattr(balls, "_met", met)
        seen[n] = sum(counts) / len(x)
        assert len(got) == len(x)
    assert seen[5] < 12 and seen[5] < 2 * seen[1] + 2
