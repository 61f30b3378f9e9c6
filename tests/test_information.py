"""Nearest-neighbour information against all pairs."""

import math

import numpy as np
import pytest

from emberline.operators import features, information


def psi(n):
    return -0.57721566490153286061 + sum(1 / i for i in range(1, int(n)))


def slow(x, y, k=3):
    keep = [i for i in range(len(x)) if x[i] is not None and math.isfinite(x[i]) and y[i] is not None]
    size = {c: sum(y[i] == c for i in keep) for c in {y[i] for i in keep}}
    keep = [i for i in keep if size[y[i]] > 1]
    if not keep:
        return 0.0
    total = 0.0
    for i in keep:
        ki = min(k, size[y[i]] - 1)
        d = sorted(abs(x[j] - x[i]) for j in keep if j != i and y[j] == y[i])[ki - 1]
        m = sum(abs(x[j] - x[i]) < d or x[j] == x[i] for j in keep)
        total += psi(ki) - psi(size[y[i]]) - psi(m)
    return max(0.0, psi(len(keep)) + total / len(keep))


def rows_of(seed):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(260):
        y = int(rng.integers(0, 3)) if i else 9  # a class of one row
        y = 7 if 5 < i < 8 else y  # one of two
        out.append((y if i % 41 else None, float(rng.normal(y)), float(rng.integers(0, 6)), float(rng.integers(0, 3)) * 1e-9 - 1e9, None if i % 7 == 0 else float(rng.random()), float("nan") if i % 50 == 0 else math.inf if i % 51 == 0 else float(rng.normal() * 10.0 ** rng.integers(-9, 9))))
    return out


@pytest.mark.parametrize(("seed", "k", "rows"), [(0, 3, 10_000), (1, 3, 40), (2, 1, 25), (3, 5, 12), (4, 300, 100)])
def test_all_pairs(spark, seed, k, rows):
    data = rows_of(seed)
    df = spark.createDataFrame(data, "y int, a double, b double, c double, d double, e double").repartition(3)
    got = {r["column_name"]: r["mi"] for r in information.neighbour_information(df, list("abcde"), "y", k, rows).collect()}
    for i, c in enumerate("abcde"):
        assert got[c] == pytest.approx(slow([r[i + 1] for r in data], [r[0] for r in data], k), abs=1e-9), c


def test_distances_that_rounding_ties(spark):
    data = [(i % 2, -1e9 + j * 1e-7 + i) for i in range(40) for j in range(5)]
    df = spark.createDataFrame(data, "y int, x double")
    got = information.neighbour_information(df, ["x"], "y", 3, 20).first()["mi"]
    assert got == pytest.approx(slow([r[1] for r in data], [r[0] for r in data]), abs=1e-9)


def test_empty_and_lonely(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "y int, x double")
    assert information.neighbour_information(df, ["x"], "y").first()["mi"] == 0.0
    assert information.neighbour_information(df.limit(0), ["x"], "y").first()["mi"] == 0.0


def test_informative_column_leads(spark):
    rng = np.random.default_rng(0)
    data = [(int(i % 2), float(rng.normal()), float(rng.normal(3 * (i % 2))), float(rng.normal())) for i in range(600)]
    df = spark.createDataFrame(data, "fire int, a double, b double, c double")
    mi = {r["column_name"]: r["mi"] for r in information.neighbour_information(df, ["a", "b", "c"], "fire").collect()}
    assert mi["b"] > 0.3 > 0.1 > max(mi["a"], mi["c"])
    assert features.supervised_reduction(df, "fire", method="MI", top_k=1).columns == ["b", "fire"]


def test_ranges_of_the_default_size_are_small():
    import inspect

    assert inspect.signature(information.neighbour_information).parameters["rows"].default <= 100_000
