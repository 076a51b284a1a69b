"""Tests of causality and unit roots from lagged moments, and coordinate descent, against direct solvers."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from veta.operators import linear, stats


def panel(spark, seed=2, sizes=(160, 40, 14, 5)):
    rng, rows = np.random.default_rng(seed), []
    for s, n in enumerate(sizes):
        x, e = rng.normal(size=n), rng.normal(size=n)
        y = np.convolve(x, [0, 0.8, 0.3])[:n] + e + 5
        walk = 300 + np.cumsum(rng.normal(size=n))
        for t in range(n):
            gap = rng.random() < 0.05
            rows.append((f"s{s}", datetime.date(1950 + t // 12, t % 12 + 1, 1), float(y[t]), None if gap else float(x[t]), float(walk[t]), 1.0))
    return spark.createDataFrame(rows, "serie string, mes date, y double, x double, w double, c double").repartition(5), rows


def test_granger_equals_the_direct_solver_at_every_lag(spark):
    df, rows = panel(spark)
    got = {(r.serie, r.causa, r.efecto, r.rezago): (r.f, r.p) for r in stats.granger(df, "serie", "mes", [("x", "y"), ("y", "x"), ("w", "y")], 12).collect()}
    want = {}
    column = {"y": 2, "x": 3, "w": 4}
    for s in sorted({r[0] for r in rows}):
        own = sorted(r for r in rows if r[0] == s)
        for c, e in (("x", "y"), ("y", "x"), ("w", "y")):
            t = np.array([(r[column[e]], r[column[c]]) for r in own if r[column[e]] is not None and r[column[c]] is not None])
            for lag, f, p in stats.granger_table(t[:, 0], t[:, 1], 12):
                want[s, c, e, lag] = (f, p)
    assert got.keys() == want.keys() and len(want) > 30
    for k, (f, p) in want.items():
        assert got[k] == (pytest.approx(f, rel=1e-6, abs=1e-8), pytest.approx(p, rel=1e-6, abs=1e-9))


def test_unit_root_test_equals_the_direct_solver(spark):
    df, rows = panel(spark)
    got = {(r.serie, r.variable): tuple(r)[2:] for r in stats.adf(df, "serie", "mes", ["y", "x", "w", "c"]).collect()}
    want = {}
    for s in sorted({r[0] for r in rows}):
        own = sorted(r for r in rows if r[0] == s)
        for name, k in (("y", 2), ("x", 3), ("w", 4)):
            x = np.array([r[k] for r in own if r[k] is not None])
            if len(x) >= 12:
                want[s, name] = (len(x), *stats.adf_statistic(x))
    assert got.keys() == want.keys()
    for k, (n, stat, lag, p) in want.items():
        assert got[k] == (n, pytest.approx(stat, rel=1e-6), lag, pytest.approx(p, rel=1e-5, abs=1e-9))
    assert stats.adf(df.limit(0), "serie", "mes", ["y"]).count() == 0


def test_a_long_series_is_cut_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n = 30_000
    x = np.cumsum(rng.normal(size=n))
    rows = [("a", i, float(v), float(v + rng.normal())) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "serie string, t int, x double, y double").repartition(4)
    direct = stats.adf_statistic(x)
    real = stats.framed
    monkeypatch.setattr(stats, "framed", lambda *a, **k: real(*a, **{**k, "limit": 4000, "crowd": True}))
    got = stats.adf(df, "serie", "t", ["x"]).first()
    assert (got.n, got.rezago) == (n, direct[1]) and got.adf == pytest.approx(direct[0], rel=1e-6)
    table = stats.granger_table(np.array([r[3] for r in rows]), x, 2)
    for r in stats.granger(df, "serie", "t", [("x", "y")], 2).collect():
        assert r.f == pytest.approx(table[r.rezago - 1][1], rel=1e-6)


# ------------------------------------------------------------------ coordinate descent
def sparse_data(spark, n=200, p=8, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) @ (np.eye(p) + 0.4 * rng.normal(size=(p, p)))
    y = x[:, 0] * 2 - x[:, 3] + rng.normal(size=n) * 0.5 + 3
    names = [f"f{i}" for i in range(p)]
    df = spark.createDataFrame([(*map(float, r), 1.0, float(v)) for r, v in zip(x, y, strict=True)], ", ".join(f"{n} double" for n in [*names, "flat", "y"]))
    return df, np.column_stack([x, np.ones(n)]), y, [*names, "flat"]


@pytest.mark.parametrize("mix", [1.0, 0.5])
def test_weights_satisfy_the_conditions_of_the_optimum(spark, mix):
    df, x, y, names = sparse_data(spark)
    grid = [(mix, float(p)) for p in np.logspace(-4, 0.5, 15)]
    found = linear.sparse_weights(linear.moments(df, [*names, "y"]), names, "y", grid)
    scale = x.std(axis=0)
    scale[scale < 1e-12] = 1
    z = (x - x.mean(axis=0)) / scale
    for (_, penalty), (w, b) in found.items():
        assert b == pytest.approx(y.mean() - x.mean(axis=0) @ w, abs=1e-6)
        u = w * scale
        slope = z.T @ (y - y.mean() - z @ u) / len(y) - penalty * (1 - mix) * u
        active = np.abs(u) > 1e-9
        assert np.allclose(slope[active], penalty * mix * np.sign(u[active]), atol=1e-5) and (np.abs(slope[~active]) <= penalty * mix + 1e-5).all()
    sizes = [int((np.abs(found[g][0]) > 1e-9).sum()) for g in grid]
    assert sizes[0] > sizes[-1] and found[grid[0]][0][-1] == 0


def test_descent_equals_slow_gradient_steps():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5))
    q, c = x.T @ x / 60, x.T @ (x @ np.array([1, 0, -2, 0, 0.5])) / 60
    w = np.zeros(5)
    for _ in range(20_000):
        w = w - 0.1 * (q @ w - c + 0.05 * w)
        w = np.sign(w) * np.maximum(np.abs(w) - 0.1 * 0.1, 0)
    assert np.allclose(linear.descend(q, c, 0.1, 0.05, np.zeros(5), 1e-12), w, atol=1e-8)


def test_constant_rows_and_columns(spark):
    df, _, _, names = sparse_data(spark, 30)
    w, b = linear.sparse_weights(linear.moments(df.withColumn("y", F.lit(2.0)), [*names, "y"]), names, "y", [(1.0, 0.1)])[1.0, 0.1]
    assert not w.any() and b == pytest.approx(2.0)


def test_rank_correlation_by_group_with_ties_and_a_constant(spark):
    import pandas as pd

    from veta.operators.stats import rank_correlation

    rng = np.random.default_rng(8)
    d = pd.DataFrame({"g": ["a"] * 40 + ["b"] * 30 + ["c"] * 5, "x": [*rng.integers(0, 9, 70) * 1.0, *[2.0] * 5], "y": [*rng.integers(0, 7, 70) * 1.0, *range(5)]})
    got = {r["g"]: (r["n"], r["rho"]) for r in rank_correlation(spark.createDataFrame(d), "x", "y", ["g"]).collect()}
    for g, rows in d.groupby("g"):
        n, rho = got[g]
        assert n == len(rows)
        if g == "c":
            assert rho is None
        else:
            assert np.isclose(rho, rows.x.rank().corr(rows.y.rank()))
