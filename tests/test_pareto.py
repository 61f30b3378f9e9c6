"""Pareto fronts against all pairs: ties, nulls, NaN, other types, and rows that do not dominate each other."""

import math
import random

import numpy as np

from emberline.operators import metrics, pareto


def _above(a, b):
    return (not math.isnan(b) and math.isnan(a)) or a > b


def _brute(rows, ways):
    def beats(o, r):
        both = [(x, y, w) for x, y, w in zip(o, r, ways, strict=True) if x is not None and y is not None]
        better = [_above(x, y) if w == "max" else _above(y, x) for x, y, w in both]
        worse = [_above(y, x) if w == "max" else _above(x, y) for x, y, w in both]
        return any(better) and not any(worse)

    return sorted(i for i, r in enumerate(rows) if not any(beats(o, r) for o in rows))


def _check(spark, rows, ways, types="double"):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, " + ", ".join(f"`m.{i}` {types}" for i in range(len(ways)))).repartition(4)
    for small in (0, 30, 1000):
        got = metrics.pareto_front(d, {f"m.{i}": w for i, w in enumerate(ways)}, small)
        assert got.columns == d.columns
        assert sorted(r.id for r in got.collect()) == _brute(rows, ways)


def test_nulls_ties_and_nan(spark):
    rng = random.Random(0)
    value = lambda: rng.choice([None, float("nan"), *map(float, range(9))]) if rng.random() < 0.3 else float(rng.randint(0, 12))
    _check(spark, [(value(), value()) for _ in range(120)], ["max", "min"])
    full = lambda: float(rng.randint(0, 12))
    _check(spark, [(full(), full(), rng.choice([None, full()])) for _ in range(200)], ["max", "min", "max"])


def test_a_wide_front(spark):
    """On a line of trade-offs no row goes; points under it go."""
    rng = random.Random(4)
    line = [(x, 1000.0 - x) for x in (float(rng.randint(0, 1000)) for _ in range(400))]
    _check(spark, line + [(x - rng.random(), y) for x, y in line], ["max", "max"])
    _check(spark, [(i, i % 7) for i in range(200)], ["min", "max"], "long")


def test_one_metric_and_no_rows(spark):
    _check(spark, [(3.0,), (3.0,), (None,), (1.0,)], ["max"])
    _check(spark, [], ["max", "min"])


def test_beaten_by_blocks():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 30, (300, 3)).astype(float), rng.integers(0, 20, (9000, 3)).astype(float)
    expected = [bool(((b >= r).all(1) & (b > r).any(1)).any()) for r in a]
    assert pareto.beaten(a, b).tolist() == expected
