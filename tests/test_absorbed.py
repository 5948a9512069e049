"""Crossed effects and absorbed factors against dense algebra and dummies."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelstats.models import absorbed, glm, linear, mixed as mx
from panelstats.models.crossed import Crossed


@pytest.fixture(scope="module")
def nested(spark):
    """Firms nested in industries, and a year that splits the panel into two unconnected halves."""
    rng = np.random.default_rng(8)
    n = 400
    firm = rng.integers(0, 40, n)
    t = np.where(firm % 2 == 0, rng.integers(0, 4, n), rng.integers(4, 8, n))
    z = rng.normal(size=n)
    y = 2 * z + firm % 7 + 0.3 * t + rng.normal(size=n)
    c = rng.poisson(np.exp(0.4 * z + 0.1 * (firm % 5) + 0.05 * t))
    p = pd.DataFrame({"y": y, "c": c, "z": z, "firm": firm, "industry": firm % 10, "t": t, "k": firm % 6})
    return spark.createDataFrame(p).repartition(3), p


def dummies(*columns):
    return np.hstack([(np.asarray(c)[:, None] == np.unique(c)).astype(float) for c in columns])


@pytest.mark.parametrize("groups", [["firm", "industry"], ["firm", "t"], ["t", "industry"], ["firm", "industry", "t"]])
def test_rank_of_nested_and_unconnected_factors(nested, groups):
    df, p = nested
    assert absorbed.rank(df, groups) == np.linalg.matrix_rank(dummies(*[p[g] for g in groups]))


def test_components_of_a_long_chain_and_of_null(spark):
    chain = spark.range(600).selectExpr("id as a", "explode(array(id, id + 1)) as b").where("not (a % 200 = 199 and b = a + 1)")
    assert absorbed.components(chain, "a", "b") == 3
    rows = spark.createDataFrame([(None, 1), (None, 2), (5, 2), (6, None), (6, None)], "a int, b int")
    assert absorbed.components(rows, "a", "b") == 2


@pytest.mark.parametrize("groups", [["firm", "industry"], ["firm", "t"]])
def test_least_squares_equal_dummies(nested, groups):
    df, p = nested
    fit = linear.ols(df, "y ~ z", cluster=["k"], absorb=groups)
    d = dummies(*[p[g] for g in groups])
    rank = np.linalg.matrix_rank(d)
    free = lambda v: v - d @ np.linalg.lstsq(d, v, rcond=None)[0]
    z, y = free(p.z.to_numpy()), free(p.y.to_numpy())
    b = z @ y / (z @ z)
    e = y - b * z
    assert fit.df_resid == len(p) - rank - 1 and fit.param("z") == pytest.approx(b)
    assert fit.table()["std_error"][0] == pytest.approx(math.sqrt(e @ e / fit.df_resid / (z @ z)))


@pytest.mark.parametrize("groups", [["firm", "t"], ["industry", "firm"]])
def test_count_models_equal_dummies(nested, groups):
    df, p = nested
    a = glm.quasi_poisson(df, "c ~ z", cluster=["k"], absorb=groups)
    used = np.ones(len(p), bool)
    for _ in range(9):  # levels without a count
        for g in groups:
            used &= p[g].map(p[used].groupby(g).c.sum()).fillna(0).to_numpy() > 0
    q = p[used]
    x = np.column_stack([q.z, dummies(*[q[g] for g in groups])])
    rank = np.linalg.matrix_rank(x)
    eta = np.log(q.c.to_numpy() + 0.5)
    for _ in range(60):
        mu = np.exp(eta)
        b = np.linalg.lstsq(x * np.sqrt(mu)[:, None], np.sqrt(mu) * (eta + (q.c - mu) / mu), rcond=None)[0]
        eta = x @ b
    mu = np.exp(eta)
    phi = ((q.c - mu) ** 2 / mu).sum() / (len(q) - rank)
    cov = np.linalg.pinv(x.T @ (x * mu[:, None]))
    assert a.n == len(q) and a.df_resid == len(q) - rank and a.param("z") == pytest.approx(b[0], abs=1e-7)
    assert a.sigma2 == pytest.approx(phi) and a.table()["std_error"][0] == pytest.approx(math.sqrt(phi * cov[0, 0]), rel=1e-5)
    s = (cov @ (x * (q.c - mu).to_numpy()[:, None]).T)[0]
    meat = sum(s[(q.k == v).to_numpy()].sum() ** 2 for v in q.k.unique())
    g = q.k.nunique()
    assert a.cluster("k").table()["std_error"][0] == pytest.approx(math.sqrt(g / (g - 1) * meat), rel=1e-5)


def test_count_model_with_two_factors_of_20000_levels(spark):
    df = spark.range(120000).selectExpr("cast(id % 20000 as int) as a", "cast(pmod(hash(id), 20000) as int) as b", "sin(id * 1.7) as x").selectExpr(
        "*", "exp(0.5 * x + (a % 7) * 0.1 + (b % 5) * 0.1) + 0.5 * (1 + cos(a * 1.3 + b)) as n")
    fit = glm.quasi_poisson(df, "n ~ x", absorb=["a", "b"])
    assert fit.param("x") == pytest.approx(0.5, abs=0.15) and 70000 < fit.df_resid < 81000


def cells_of(p, cols):
    g = p.assign(size=1.0).groupby(["g", "h"], as_index=False)[[*cols, "size"]].sum()
    return g


def test_moments_of_crossed_effects_equal_dense_algebra(spark):
    rng = np.random.default_rng(2)
    n = 160
    p = pd.DataFrame({"g": rng.integers(0, 9, n), "h": rng.integers(0, 6, n), "s0": 1.0, "s1": rng.normal(size=n)})
    p["s2"] = 1 + p.s1 + rng.normal(size=9)[p.g] + rng.normal(size=6)[p.h] + rng.normal(size=n)
    m = p[["s0", "s1", "s2"]].to_numpy()
    found = Crossed(spark.createDataFrame(cells_of(p, ["s0", "s1", "s2"])), "g", "h", ["s0", "s1", "s2"], 16).moments(m.T @ m, np.array([0.7, 0.4]))
    za, zb = dummies(p.g), dummies(p.h)
    v = np.eye(n) + 0.7 * za @ za.T + 0.4 * zb @ zb.T
    vi, x, y = np.linalg.inv(v), m[:, :2], m[:, 2]
    proj = vi - vi @ x @ np.linalg.inv(x.T @ vi @ x) @ x.T @ vi
    parts = [za @ za.T, zb @ zb.T]
    assert found.a == pytest.approx(m.T @ vi @ m, rel=1e-6) and found.rss == pytest.approx(y @ proj @ y)
    assert found.squares == pytest.approx([y @ proj @ w @ proj @ y for w in parts], rel=1e-6)
    assert found.traces == pytest.approx([np.trace(proj @ w) for w in parts], rel=1e-6)
    assert found.curvature == pytest.approx(np.array([[y @ proj @ w @ proj @ u @ proj @ y for u in parts] for w in parts]), rel=1e-5)


def test_crossed_intercepts_of_a_balanced_table_equal_its_analysis_of_variance(spark):
    rng = np.random.default_rng(5)
    i, j = 30, 8
    y = 50 + 3 * rng.normal(size=i)[:, None] + 2 * rng.normal(size=j) + rng.normal(size=(i, j))
    df = spark.createDataFrame([(r, c, float(y[r, c])) for r in range(i) for c in range(j)], "a int, b int, y double")
    rest = y - y.mean(1, keepdims=True) - y.mean(0) + y.mean()
    e = (rest**2).sum() / ((i - 1) * (j - 1))
    want = [(j * y.mean(1).var(ddof=1) - e) / j, (i * y.mean(0).var(ddof=1) - e) / i, e]
    for groups, values in ((["a", "b"], want), (["b", "a"], [want[1], want[0], want[2]])):
        fit = mx.mixed(df, "y ~ 1", groups)
        assert list(fit.variances.values()) == pytest.approx(values, rel=1e-5) and fit.param("(Intercept)") == pytest.approx(y.mean())


def test_a_factor_of_any_number_of_levels_crosses_a_small_one(spark):
    df = spark.range(90000).selectExpr("cast(id % 30000 as int) as a", "cast(pmod(hash(id), 12) as int) as b", "randn(3) as e", "sin(id) as x").selectExpr(
        "*", "x + 2 * sin(a * 12.9898) * 1.41421356 + sin(b * 7.3) * 1.41421356 + e as y")
    fit = mx.mixed(df, "y ~ x", ["a", "b"])
    assert fit.variances["a"] == pytest.approx(4, rel=0.1) and fit.variances["residual"] == pytest.approx(1, rel=0.05) and fit.param("x") == pytest.approx(1, abs=0.05)
