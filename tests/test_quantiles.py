"""Exact quantiles by brackets against numpy."""

import numpy as np
import pytest

from emberline.operators import profile, quantiles

P = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(4000):
        g = None if i % 11 == 0 else "ab"[i % 2] if i else "one"
        rows.append((g, float(rng.normal()), float(rng.integers(0, 3)), None if i % 3 else float(rng.normal() * 10.0 ** rng.integers(-12, 12)), None, 5.0 if i % 500 else float(i), int(rng.integers(-(10**9), 10**9))))
    return spark.createDataFrame(rows, "g string, x double, ties double, wild double, none double, flat double, whole long").repartition(4), rows


@pytest.mark.parametrize(("mapped", "inside"), [(10**6, 20), (0, 40), (0, 10**6)])
def test_columns(table, mapped, inside):
    df, rows = table
    got = {r["column_name"]: r["q"] for r in quantiles.quantiles(df, ["x", "ties", "wild", "none", "flat", "whole"], P, mapped=mapped, inside=inside).collect()}
    for i, c in enumerate(["x", "ties", "wild", "none", "flat", "whole"], 1):
        v = [r[i] for r in rows if r[i] is not None]
        assert got[c] is None if not v else got[c] == pytest.approx(np.quantile(v, P).tolist(), rel=1e-12), c


def test_groups(table):
    df, rows = table
    got = {(r["g"], r["column_name"]): r["q"] for r in quantiles.quantiles(df, ["x", "flat"], [0.25, 0.5], ["g"], mapped=0, inside=30).collect()}
    for g in {r[0] for r in rows}:
        for i, c in ((1, "x"), (5, "flat")):
            assert got[g, c] == pytest.approx(np.quantile([r[i] for r in rows if r[0] == g], [0.25, 0.5]).tolist(), rel=1e-12)
    assert len(got) == 6


def test_users_of_quantiles(table, monkeypatch):
    df, _ = table
    run = lambda: [sorted(map(str, f.collect())) for f in (profile.describe(df, ["x", "whole"]), profile.fences(df, "x"), profile.fences(df, "x", by=["g"]), profile.iqr_outlier_share(df, ["x", "flat"]), profile.boxplot_stats(df, "x", "g"))]
    plain = run()
    monkeypatch.setattr(quantiles, "MAPPED", 0)
    monkeypatch.setattr(quantiles, "INSIDE", 100)
    assert run() == plain
