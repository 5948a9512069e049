import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelstats.models import did as dd, dist, effects, glm, linear, mixed as mx, ordinal, sensitivity as sens, sweep
from panelstats.models.design import Formula
from panelstats.operators.agg import quantiles  # noqa: F401


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 600
    g, h = rng.integers(0, 12, n), rng.integers(0, 9, n)
    x, z = rng.normal(2000, 5, n), rng.normal(size=n)
    f = rng.integers(0, 2, n).astype(bool)
    u = rng.normal(size=12) * 2
    y = 0.3 * x + 2 * z - f + u[g] + rng.normal(size=n)
    c = rng.poisson(np.exp(0.5 + 0.4 * z - 0.3 * f))
    lat = 0.8 * z + 0.5 * f + rng.logistic(size=n)
    o = np.array(["low", "mid", "high"])[(lat > -0.5).astype(int) + (lat > 1.0)]
    w = rng.uniform(0.5, 2, n)
    rows = [(float(y[i]), int(c[i]), str(o[i]), float(x[i]), float(z[i]), bool(f[i]), int(g[i]), int(h[i]), float(w[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "y double, c int, o string, x double, z double, f boolean, g int, h int, w double").repartition(4).cache()
    return df, df.toPandas()


def design(p, *cols):
    return np.column_stack([np.ones(len(p)), *cols]).astype(float)


def test_formula_expansion():
    f = Formula("y ~ a*(b + c) + I(a^2) + d:e")
    assert f.terms == [("a",), ("b",), ("c",), ("I(a^2)",), ("a", "b"), ("a", "c"), ("d", "e")]
    assert not Formula("y ~ 0 + a").intercept


def test_a_factor_of_very_many_levels_is_absorbed_or_refused_not_gathered(spark):
    df = spark.range(20000).selectExpr("id", "cast(id % 7 as double) y", "cast(id as string) k", "cast(id % 3 as double) z")
    assert linear.level_table(linear.ols(df, "y ~ k")).count() == 20000
    with pytest.raises(ValueError, match="levels"):
        linear.ols(df, "y ~ z*k")
    with pytest.raises(ValueError, match="levels"):
        glm.logit(df.withColumn("y", F.col("y") % 2), "y ~ k")


def test_distributions():
    assert dist.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert dist.norm_quantile(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert dist.t_sf2(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert dist.chi2_sf(5.991464547, 2) == pytest.approx(0.05, abs=1e-9)
    assert dist.chi2_sf(1.0, 1) == pytest.approx(math.erfc(math.sqrt(0.5)), abs=1e-12)


def test_ols_with_polynomial_and_robust_errors(data):
    df, p = data
    fit = linear.ols(df, "y ~ x + I(x^2) + z*f", cluster=["g", "h", "x"])
    X = design(p, p.x, p.x**2, p.z, p.f, p.z * p.f)
    Xc = design(p, p.x - 2000, (p.x - 2000) ** 2, p.z, p.f, p.z * p.f)
    b = np.linalg.lstsq(Xc, p.y, rcond=None)[0]
    assert fit.names == ["(Intercept)", "x", "I(x^2)", "z", "fTRUE", "z:fTRUE"]
    assert fit.param("I(x^2)") == pytest.approx(b[2], rel=1e-6)
    assert fit.param("x") == pytest.approx(b[1] - 4000 * b[2], rel=1e-5)
    e = p.y.to_numpy() - Xc @ b
    A = np.linalg.inv(Xc.T @ Xc)
    n, k = X.shape
    at = fit.names.index("z")
    assert fit.table()["std_error"][at] == pytest.approx(math.sqrt(e @ e / (n - k) * A[3, 3]))

    def sandwich(*keys):
        total = np.zeros((k, k))
        combos = [[keys[0]]] if len(keys) == 1 else [[keys[0]], [keys[1]], list(keys)]
        for combo in combos:
            s = (Xc * e[:, None])
            import pandas as pd
            sums = pd.DataFrame(s).groupby([p[c].to_numpy() for c in combo]).sum().to_numpy()
            m = len(sums)
            total += (-1) ** (len(combo) + 1) * m / (m - 1) * sums.T @ sums
        return A @ total @ A * (n - 1) / (n - k)

    assert fit.cluster("g").table()["std_error"][at] == pytest.approx(math.sqrt(sandwich("g")[3, 3]))
    assert fit.cluster("g", "h").table()["std_error"][at] == pytest.approx(math.sqrt(sandwich("g", "h")[3, 3]))
    hc = (A @ ((Xc * e[:, None]).T @ (Xc * e[:, None])) @ A)[3, 3] * n / (n - k)
    assert fit.cluster("x").table()["std_error"][at] == pytest.approx(math.sqrt(hc))


def test_weights_factors_absorb_and_compression_agree(data):
    df, p = data
    plain = linear.ols(df, "y ~ z + factor(g)", weights="w")
    packed = linear.ols(df, "y ~ z + factor(g)", weights="w", compress=True)
    absorbed = linear.ols(df, "y ~ z", weights="w", absorb="g")
    X = design(p, p.z, *[p.g == v for v in range(1, 12)])
    W = p.w.to_numpy()
    b = np.linalg.solve(X.T @ (X * W[:, None]), X.T @ (W * p.y))
    for fit in (plain, packed, absorbed):
        assert fit.param("z") == pytest.approx(b[1])
    assert absorbed.table()["std_error"][0] == pytest.approx(plain.table()["std_error"][1])


def test_aliased_columns_are_dropped_from_the_right(data):
    df, _ = data
    fit = linear.ols(df.withColumn("z2", 3 * F.col("z") + 1), "y ~ z + z2 + f")
    t = fit.table()
    assert t["estimate"].isna().tolist() == [False, False, True, False]
    assert fit.tidy().where("estimate is null").first()["term"] == "z2"


def test_poisson_matches_the_library_model(spark, data):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    df, p = data
    fit = glm.quasi_poisson(df, "c ~ z + f", cluster=["g"])
    v = VectorAssembler(inputCols=["z", "fi"], outputCol="v").transform(df.withColumn("fi", F.col("f").cast("double")))
    m = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="v", labelCol="c", tol=1e-12, maxIter=60).fit(v)
    assert [fit.param("z"), fit.param("fTRUE"), fit.param("(Intercept)")] == pytest.approx([*m.coefficients, m.intercept], abs=1e-7)
    assert fit.deviance == pytest.approx(m.summary.deviance, rel=1e-8)
    X = design(p, p.z, p.f)
    mu = np.exp(X @ [fit.param("(Intercept)"), fit.param("z"), fit.param("fTRUE")])
    phi = ((p.c - mu) ** 2 / mu).sum() / (len(p) - 3)
    assert fit.sigma2 == pytest.approx(phi)
    A = np.linalg.inv(X.T @ (X * mu[:, None]))
    assert fit.table()["std_error"].to_numpy() == pytest.approx(np.sqrt(phi * np.diag(A)))
    import pandas as pd
    s = pd.DataFrame(X * (p.c.to_numpy() - mu)[:, None]).groupby(p.g.to_numpy()).sum().to_numpy()
    V = len(s) / (len(s) - 1) * A @ s.T @ s @ A
    assert fit.cluster("g").table()["std_error"].to_numpy() == pytest.approx(np.sqrt(np.diag(V)))


def test_logit_matches_the_library_model(data):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    df, _ = data
    d = df.withColumn("b", (F.col("c") > 1).cast("double"))
    fit = glm.logit(d, "b ~ z + x")
    v = VectorAssembler(inputCols=["z", "x"], outputCol="v").transform(d)
    m = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="v", labelCol="b", tol=1e-12, maxIter=60).fit(v)
    assert [fit.param("z"), fit.param("x")] == pytest.approx(list(m.coefficients), abs=1e-6)


def _panel(spark):
    rng = np.random.default_rng(9)
    rows = []
    for s in range(8):
        for y in range(2008, 2020):
            for a in (False, True):
                for b in (False, True):
                    mu = math.exp(3 + 0.1 * s + 0.5 * a + 0.2 * b + 0.02 * (y - 2008) + (0.4 if y > 2013 and a and b else 0))
                    rows.append((s, y, a, b, float(rng.poisson(mu)), y > 2013, f"{s}_{a}_{b}"))
    return spark.createDataFrame(rows, "state int, year int, ss boolean, mx boolean, n double, post boolean, unit string")


def test_difference_designs(spark):
    p = _panel(spark).cache()
    sat = glm.quasi_poisson(p, "n ~ post*ss*mx")
    cells = {(r["post"], r["ss"], r["mx"]): math.log(r["m"]) for r in p.groupBy("post", "ss", "mx").agg(F.avg("n").alias("m")).collect()}
    sign = lambda *fs: (-1) ** (3 - sum(fs))
    assert sat.param("postTRUE:ssTRUE:mxTRUE") == pytest.approx(sum(sign(*k) * v for k, v in cells.items()), abs=1e-9)
    fit = dd.did(p, "n", "post", ["ss", "mx"], "unit", "year")
    assert fit.names[1:5] == ["I(post*ss*mx)", "I(post*ss)", "I(post*mx)", "postTRUE"]
    est = fit.param("I(post*ss*mx)")
    assert 0.1 < est < 0.7
    assert fit.table().set_index("term")["estimate"].isna().sum() == 1
    prods = p.withColumns({"p_sm": F.expr("double(post) * double(ss) * double(mx)"), "p_s": F.expr("double(post) * double(ss)"),
                           "p_m": F.expr("double(post) * double(mx)"), "p": F.expr("double(post)"), "k": F.lit(1)})
    swept = sweep.sweep(prods, ["k"], "n ~ p_sm + p_s + p_m + p + unit + year", "n", ["unit", "year"], "unit", ["p_sm"]).first()
    assert swept["estimate"] == pytest.approx(est, abs=1e-8)
    assert swept["std_error"] == pytest.approx(fit.table().set_index("term")["std_error"]["I(post*ss*mx)"], rel=1e-6)


def test_event_study_and_wald(spark):
    p = _panel(spark).cache()
    fit, terms = dd.event_study(p, "n", "year", ["ss", "mx"], "unit", 2)
    t = dd.event_table(fit, terms, "unit").collect()
    assert sorted(r["period"] for r in t if r["estimate"] is not None) == [2010, 2012, 2014, 2016, 2018]
    assert [r["period"] for r in t if r["estimate"] is None] == [2008]
    w = fit.wald([x for x in terms if "2012" in x or "2010" in x]).first()
    assert w["df"] == 2 and 0 <= w["p_value"] <= 1


def test_ordered_logit_is_the_maximum(data):
    df, p = data
    fit = ordinal.ordered_logit(df, "o ~ z + f", ["low", "mid", "high"], weights="w", cluster=["g"])
    code = p.o.map({"low": 0, "mid": 1, "high": 2}).to_numpy()
    X = np.column_stack([p.z, p.f]).astype(float)

    def ll(t):
        eta = X @ t[:2]
        cum = np.column_stack([np.zeros(len(p)), 1 / (1 + np.exp(-(t[2] - eta))), 1 / (1 + np.exp(-(t[3] - eta))), np.ones(len(p))])
        return (p.w * np.log(cum[np.arange(len(p)), code + 1] - cum[np.arange(len(p)), code])).sum()

    t = fit.coef
    assert fit.names == ["z", "fTRUE", "low|mid", "mid|high"] and fit.loglik == pytest.approx(ll(t))
    h = 1e-4
    H = np.zeros((4, 4))
    I = np.eye(4) * h
    for i in range(4):
        assert abs((ll(t + I[i]) - ll(t - I[i])) / (2 * h)) < 1e-3
        for j in range(4):
            H[i, j] = (ll(t + I[i] + I[j]) - ll(t + I[i] - I[j]) - ll(t - I[i] + I[j]) + ll(t - I[i] - I[j])) / (4 * h * h)
    assert fit.vcov == pytest.approx(np.linalg.inv(-H), rel=1e-3, abs=1e-6)
    assert (fit.cluster("g").table()["std_error"] > 0).all()
    probs = fit.probs(df).select((F.col("low") + F.col("mid") + F.col("high")).alias("s"), "low", "z", "f").first()
    assert probs["s"] == pytest.approx(1.0)
    assert probs["low"] == pytest.approx(1 / (1 + math.exp(-(t[2] - t[0] * probs["z"] - t[1] * probs["f"]))))
    sim = effects.simulate(fit, df, {"f": [False, True]}, 100, 1).collect()
    assert len(sim) == 6 and all(r["fit_low"] < r["fit"] < r["fit_high"] for r in sim)


def test_cumulative_logits_equal_single_fits(data):
    df, _ = data
    d = df.withColumn("k", F.when(F.col("o") == "low", 1).when(F.col("o") == "mid", 2).otherwise(3))
    many = {(r["cut"], r["term"]): r["estimate"] for r in ordinal.cumulative_logits(d, "k ~ z + f", [1, 2]).collect()}
    one = glm.logit(d.withColumn("b", (F.col("k") > 2).cast("int")), "b ~ z + f")
    assert many[(2, "z")] == pytest.approx(one.param("z"), abs=1e-7)


def _reml(p, thetas, groups):
    n = len(p)
    V = np.eye(n)
    for t, g in zip(thetas, groups):
        Z = (p[g].to_numpy()[:, None] == np.unique(p[g])[None, :]).astype(float)
        V += t * Z @ Z.T
    X = design(p, p.z)
    Vi = np.linalg.inv(V)
    A = X.T @ Vi @ X
    b = np.linalg.solve(A, X.T @ Vi @ p.y)
    r = p.y.to_numpy() - X @ b
    s2 = r @ Vi @ r / (n - 2)
    return -0.5 * ((n - 2) * (math.log(2 * math.pi * s2) + 1) + np.linalg.slogdet(V)[1] + np.linalg.slogdet(A)[1]), b, s2


def test_mixed_models_maximise_the_restricted_likelihood(data):
    df, p = data
    fit = mx.mixed(df, "y ~ z", "g")
    s2 = fit.variances["residual"]
    theta = fit.variances["g"] / s2
    ll, b, sigma2 = _reml(p, [theta], ["g"])
    assert fit.loglik == pytest.approx(ll, abs=1e-6) and fit.param("z") == pytest.approx(b[1]) and s2 == pytest.approx(sigma2)
    assert all(_reml(p, [theta * f], ["g"])[0] < ll for f in (0.97, 1.03))
    two = mx.mixed(df, "y ~ z", ["g", "h"])
    th = [two.variances["g"] / two.variances["residual"], two.variances["h"] / two.variances["residual"]]
    assert two.loglik == pytest.approx(_reml(p, th, ["g", "h"])[0], abs=1e-6)
    assert two.loglik >= ll - 1e-6


def test_predictions_and_counterfactuals(data):
    df, p = data
    fit = linear.ols(df, "y ~ z*f + factor(h)")
    X = design(p, p.z, p.f, *[p.h == v for v in range(1, 9)], p.z * p.f)
    A = np.linalg.inv(X.T @ X)
    b = A @ X.T @ p.y
    e = p.y - X @ b
    V = e @ e / (len(p) - X.shape[1]) * A
    got = fit.predict(df, se=True).toPandas().sort_values(["y"])
    want = (X @ b)[np.argsort(p.y.to_numpy())]
    assert got["fit"].to_numpy() == pytest.approx(want)
    assert got["fit_se"].to_numpy() == pytest.approx(np.sqrt(((X @ V) * X).sum(1))[np.argsort(p.y.to_numpy())])
    assert fit.predict(df).agg(F.avg("fit")).first()[0] == pytest.approx((X @ b).mean())
    cf = effects.counterfactual(fit, df, {"f": [True]}).first()
    X1 = design(p, p.z, np.ones(len(p)), *[p.h == v for v in range(1, 9)], p.z)
    assert cf["fit"] == pytest.approx((X1 @ b).mean())
    assert cf["se_fit"] == pytest.approx(math.sqrt(((X1 @ V) * X1).sum(1).mean()))
    sim = effects.simulate(fit, df, {"f": [True]}, 4000, 1).first()
    m = X1.mean(0)
    assert sim["fit"] == pytest.approx(m @ b, abs=4 * math.sqrt(m @ V @ m / 4000)) and sim["sd"] == pytest.approx(math.sqrt(m @ V @ m), rel=0.06)


def test_contrast_is_the_average_change(data):
    df, p = data
    fit = glm.quasi_poisson(df, "c ~ z + f")
    r = effects.contrast(fit, df, ["z"], "f").where("f").first()
    q = p[p.f]
    b = [fit.param(t) for t in ("(Intercept)", "z", "fTRUE")]
    lo = np.exp(b[0] + b[1] * q.z + b[2])
    assert r["estimate"] == pytest.approx((lo * (math.exp(b[1]) - 1)).mean()) and r["predicted_lo"] == pytest.approx(lo.mean())


def test_variants_equal_single_fits(data):
    df, _ = data
    out = sweep.placebo_cutoffs(df.withColumn("t", F.col("x").cast("int")), "y ~ late*z", "t", [1998, 2001], ["g"], post="late")
    one = linear.ols(df.withColumn("late", (F.col("x").cast("int") > 2001).cast("double")), "y ~ late*z", cluster=["g"]).cluster("g").table()
    for _, r in one.iterrows():
        got = out.where((F.col("cutoff") == 2001) & (F.col("term") == r["term"])).first()
        assert (got["estimate"], got["std_error"]) == (pytest.approx(r["estimate"]), pytest.approx(r["std_error"]))


def test_sensitivity_formulas(data):
    df, p = data
    fit = linear.ols(df, "y ~ z + x + f")
    out = sens.ovb_sensitivity(fit, "z", ["x"], [1, 2]).collect()
    base = out[0]
    t = base["statistic"]
    assert base["r2yd_x"] == pytest.approx(t * t / (t * t + fit.df_resid))
    f2 = base["r2yd_x"] / (1 - base["r2yd_x"])
    assert base["rv"] == pytest.approx(0.5 * (math.sqrt(f2**2 + 4 * f2) - f2))
    rest = np.column_stack([np.ones(len(p)), p.f]).astype(float)
    res = lambda v: v - rest @ np.linalg.lstsq(rest, v, rcond=None)[0]
    rz, rx = res(p.z.to_numpy()), res(p.x.to_numpy())
    r2 = (rz @ rx) ** 2 / (rz @ rz) / (rx @ rx)
    assert out[1]["r2dz_x"] == pytest.approx(r2 / (1 - r2), rel=1e-5)


def test_misreport_moves_counts_and_pooling(spark):
    df = spark.createDataFrame([(1, True, 10.0), (1, False, 5.0), (2, False, 3.0)], "k int, f boolean, n double")
    out = {(r["k"], r["rate"], r["f"]): r["n"] for r in sens.misreport(df, "f", "n", [0.0, 0.25], ["k"]).collect()}
    assert out[(1, 0.0, True)] == 10.0 and out[(1, 0.25, True)] == 8.0 and out[(1, 0.25, False)] == 8.0 and out[(2, 0.25, False)] == 3.0
    est = spark.createDataFrame([(1, 1.0, 0.5), (1, 3.0, 1.0), (0, 2.0, 1.0)], "flag int, estimate double, std_error double")
    pooled = {r["flag"]: (r["estimate"], r["std_error"]) for r in sens.pool_inverse_variance(est, "flag").collect()}
    assert pooled[1] == (pytest.approx(7 / 5), pytest.approx(math.sqrt(1 / 5)))
    d = sens.pooled_difference(est, ["flag"]).first()
    assert d["est_dif"] == pytest.approx(-0.6) and d["est_dif_se"] == pytest.approx(math.sqrt(1.2))


def test_executors_get_the_package_wherever_the_driver_started(tmp_path):
    """A session started in another folder, with the package on the driver's path only."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "from panelstats.session import local_session\n"
            "from panelstats.models.linear import ols\n"
            "spark = local_session('elsewhere', 2)\n"
            "df = spark.range(50).selectExpr('cast(id as double) x', '2.0 * id + 1 y')\n"
            "print('slope', round(ols(df, 'y ~ x').param('x'), 6))\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "slope 2.0" in out.stdout, out.stderr[-2000:]


def test_set_values_reach_computed_terms(data):
    """A term I(...) follows the columns that it reads."""
    df, p = data
    fit = linear.ols(df, "y ~ z + I(z^2)", compress=False)
    x = design(p, p.z, p.z ** 2)
    b = np.linalg.lstsq(x, p.y, rcond=None)[0]
    got = {r.z: r.fit for r in effects.counterfactual(fit, df, {"z": [0.0, 3.0]}).collect()}
    assert got[0.0] == pytest.approx(b[0], rel=1e-8) and got[3.0] == pytest.approx(b @ [1, 3, 9], rel=1e-8)
    moved = design(p, p.z + 1, (p.z + 1) ** 2) @ b - x @ b
    for r in effects.contrast(fit, df, ["z"], "f").collect():
        assert r.estimate == pytest.approx(moved[p.f == r.f].mean(), rel=1e-7)
    sim = {r.z: r for r in effects.simulate(fit, df, {"z": [0.0, 3.0]}, draws=400, seed=1).collect()}
    assert all(abs(sim[z].fit - got[z]) < 4 * sim[z].sd for z in got)
    count = glm.quasi_poisson(df, "c ~ z + f + I(z*f)", compress=False)
    b = count.full_coef()
    for r in effects.response_means(count, df, {"f": [False, True]}, ["h"]).collect():
        q = p[p.h == r.h]
        want = np.exp(design(q, q.z, np.full(len(q), r.f), q.z * r.f) @ b[[count.names.index(n) for n in ("(Intercept)", "z", "fTRUE", "I(z*f)")]])
        assert r.fit == pytest.approx(want.mean(), rel=1e-8)


def test_unknown_levels_are_refused(data):
    df, _ = data
    fit = linear.ols(df, "y ~ z + factor(g)")
    for act in (lambda: effects.counterfactual(fit, df, {"factor(g)": [99]}), lambda: effects.response_means(fit, df, {"factor(g)": [99]}, ["f"]),
                lambda: effects.simulate(fit, df, {"factor(g)": [99]})):
        with pytest.raises(ValueError):
            act()


def test_ordered_counterfactuals(data):
    df, p = data
    fit = ordinal.ordered_logit(df, "o ~ z + f", ["low", "mid", "high"], compress=False)
    b, cuts = fit.full_coef()[:2], fit.full_coef()[2:]
    rows = effects.counterfactual(fit, df, {"f": [True]}).collect()
    eta = p.z.to_numpy() * b[0] + b[1]
    cum = [np.zeros(len(p)), *[1 / (1 + np.exp(eta - c)) for c in cuts], np.ones(len(p))]
    assert {r.level: r.fit for r in rows} == pytest.approx({c: (cum[j + 1] - cum[j]).mean() for j, c in enumerate(["low", "mid", "high"])}, rel=1e-8)
    assert all(0 < r.se_fit < 0.1 for r in rows)


def test_weighted_fits_agree_whether_rows_merge_or_not(data):
    df, _ = data
    work = df.withColumn("v", F.when(F.col("h") == 0, 0.0).otherwise(F.col("h") + 0.5))
    a, b = (linear.ols(work, "y ~ f + factor(g)", weights="v", compress=c) for c in (True, False))
    s, t = a.stats().first(), b.stats().first()
    assert s.n == t.n == work.where("v > 0").count()
    for name in ("sigma2", "loglik", "aic", "bic", "r2"):
        assert s[name] == pytest.approx(t[name], rel=1e-9)


def test_absorbed_and_dummy_fits_cluster_alike(data):
    df, _ = data
    a = linear.ols(df, "y ~ z + f", cluster=["h"], absorb="g").cluster("h").table().set_index("term")
    b = linear.ols(df, "y ~ z + f + factor(g)", cluster=["h"], compress=False).cluster("h").table().set_index("term")
    for t in ("z", "fTRUE"):
        assert a.loc[t].to_list() == pytest.approx(b.loc[t].to_list(), rel=1e-6)


def test_fits_that_do_not_converge_say_so(data):
    df, _ = data
    with pytest.raises(RuntimeError):
        ordinal.ordered_logit(df, "o ~ z + f", ["low", "mid", "high"], max_iter=1)
    with pytest.raises(RuntimeError):
        ordinal.cumulative_logits(df, "h ~ z", [2, 4], max_iter=1)


def test_a_panel_without_a_fit_keeps_its_row(spark):
    rows = [("good", u, t, int(5 + u + t + 3 * (u > 2 and t > 2))) for u in range(5) for t in range(5)] + [("empty", u, t, 0) for u in range(3) for t in range(3)]
    df = spark.createDataFrame(rows, "k string, u int, t int, n int").withColumn("p", ((F.col("u") > 2) & (F.col("t") > 2)).cast("double"))
    got = {r.k: r for r in sweep.sweep(df, ["k"], "n ~ p + u + t", "n", ["u", "t"], "u", ["p"]).collect()}
    assert got["good"].estimate is not None and got["good"].problem is None and got["good"].cells == 25
    assert got["empty"].term == "p" and got["empty"].estimate is None and got["empty"].cells == 9


def test_several_factors_of_many_levels_are_absorbed(spark, data):
    df, p = data
    a = linear.ols(df, "y ~ z + f", weights="w", cluster=["h"], absorb=["g", "h"])
    b = linear.ols(df, "y ~ z + f + factor(g) + factor(h)", weights="w", cluster=["h"], compress=False)
    assert a.df_resid == b.df_resid
    for x, y in ((a, b), (a.cluster("h"), b.cluster("h"))):
        x, y = x.table().set_index("term"), y.table().set_index("term")
        for t in ("z", "fTRUE"):
            assert x.loc[t].to_list() == pytest.approx(y.loc[t].to_list(), rel=1e-5)
    wide = spark.range(60000).selectExpr("id % 20000 as unit", "cast(id / 20000 as int) as t", "sin(id * 1.7) as x", "cos(id * 2.3) as e").selectExpr("*", "2 * x + unit % 7 + t + e as y")
    fit = linear.ols(wide, "y ~ x", absorb=["unit", "t"])
    assert fit.df_resid == 60000 - 20002 - 1 and fit.param("x") == pytest.approx(2, abs=0.05)


def test_count_model_with_an_absorbed_factor(spark, data):
    df, _ = data
    a = glm.quasi_poisson(df, "c ~ z + f + factor(h)", cluster=["h"], compress=False, absorb="g")
    b = glm.quasi_poisson(df, "c ~ z + f + factor(h) + factor(g)", cluster=["h"], compress=False)
    assert a.df_resid == b.df_resid and a.deviance == pytest.approx(b.deviance, rel=1e-8)
    for x, y in ((a, b), (a.cluster("h"), b.cluster("h"))):
        x, y = x.table().set_index("term"), y.table().set_index("term")
        for t in ("z", "fTRUE", "factor(h)3"):
            assert x.loc[t].to_list() == pytest.approx(y.loc[t].to_list(), rel=1e-5)
    wide = spark.range(40000).selectExpr("id % 8000 as unit", "cast(id % 3 as double) as x", "cast(3 + 2 * (id % 3) + (id * 7919) % 5 as int) as y")
    fit = glm.quasi_poisson(wide, "y ~ x", absorb="unit")
    assert len(fit.names) == 1 and 0.2 < fit.param("x") < 0.6


def test_two_way_clusters_leave_no_negative_variance(spark):
    from panelstats.models.fit import nonnegative
    bad = np.array([[4.0, 0.0, 1.0], [0.0, -0.5, 0.0], [1.0, 0.0, 9.0]])
    mended = nonnegative(bad)
    assert np.linalg.eigvalsh(mended).min() > -1e-12 and mended[np.ix_([0, 2], [0, 2])] == pytest.approx(bad[np.ix_([0, 2], [0, 2])])
    scale = np.diag([1e6, 1.0, 1e-3])
    assert nonnegative(scale @ bad @ scale) == pytest.approx(scale @ mended @ scale)
    good = np.array([[2.0, 1.0], [1.0, 2.0]])
    assert nonnegative(good) is good
    rows = [(i, j, float(1 + (i == j)), float((3 if (i + j) % 2 else -3) + 0.1 * ((i * 7 + j * 3) % 5))) for i in range(6) for j in range(6)]
    df = spark.createDataFrame(rows, "a int, b int, x double, y double")
    x = np.column_stack([np.ones(36), [r[2] for r in rows]])
    y = np.array([r[3] for r in rows])
    bread = np.linalg.inv(x.T @ x)
    u = y - x @ (bread @ x.T @ y)

    def meat(label):
        s = np.array([(x * u[:, None])[[k for k, r in enumerate(rows) if label(r) == g]].sum(0) for g in sorted({label(r) for r in rows})])
        return len(s) / (len(s) - 1) * s.T @ s

    plain = bread @ (meat(lambda r: r[0]) + meat(lambda r: r[1]) - meat(lambda r: (r[0], r[1]))) @ bread * 35 / 34
    assert np.diag(plain).min() < 0  # signs alternate, so rows and columns of the square cancel
    fit = linear.ols(df, "y ~ x", cluster=["a", "b"])
    assert fit.cluster("a", "b").vcov == pytest.approx(plain, abs=1e-9)
    errors = fit.cluster("a", "b").table()["std_error"]
    assert list(errors.isna()) == list(np.diag(plain) < 0)
    mended = fit.cluster("a", "b", repair=True)
    assert mended.vcov == pytest.approx(nonnegative(plain), abs=1e-9) and np.linalg.eigvalsh(mended.vcov).min() > -1e-12
    assert mended.table()["std_error"].notna().all()


def test_simulated_means_of_a_linear_fit_are_the_draws_at_the_mean_row(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"x": rng.normal(size=400), "z": rng.normal(size=400), "g": rng.integers(0, 3, 400)})
    pdf["y"] = 1 + pdf.x - pdf.z * pdf.x + pdf.g + rng.normal(size=400)
    df = spark.createDataFrame(pdf)
    grid = {"x": [-1.0, 0.5]}
    plain = linear.ols(df, "y ~ x*z + factor(g)")
    squared = linear.ols(df, "y ~ x + I(x*x) + z + factor(g)")
    for fit in (plain, squared):
        out = effects.simulate(fit, df, grid, 400, 3).orderBy("x").toPandas()
        at = effects.counterfactual(fit, df, grid).orderBy("x").toPandas()
        assert np.abs(out.fit - at.fit).max() < 5 * out.sd.max() / math.sqrt(400)
        assert (out.fit_low < out.fit).all() and (out.fit < out.fit_high).all()


def test_a_factor_of_too_many_levels_is_absorbed_by_itself(data, monkeypatch):
    from panelstats.models import design as frames
    df, p = data
    dense = linear.ols(df, "y ~ z + f + factor(g) + factor(h)", weights="w")
    count = glm.quasi_poisson(df, "c ~ z + f + factor(g)")
    one = linear.ols(df, "y ~ z + f + factor(g)", weights="w")
    with pytest.raises(ValueError, match="one absorbed factor"):
        linear.level_table(one)
    monkeypatch.setattr(frames, "MAX_LEVELS", 5)
    for wide, fit in ((dense, linear.ols(df, "y ~ z + f + factor(g) + factor(h)", weights="w")), (one, linear.ols(df, "y ~ z + f + factor(g)", weights="w")),
                      (count, glm.quasi_poisson(df, "c ~ z + f + factor(g)"))):
        assert fit.df_resid == wide.df_resid
        a, b = fit.table().set_index("term"), wide.table().set_index("term")
        assert list(a.index) == ["z", "fTRUE"]
        for t in a.index:
            assert a.loc[t].to_list() == pytest.approx(b.loc[t].to_list(), rel=1e-5)
    fit = linear.ols(df, "y ~ z + f + factor(g)", weights="w", cluster=["h"])
    got = {r["level"]: r for r in linear.level_table(fit).collect()}
    known = one.table().set_index("term")
    assert sorted(got) == sorted(p.g.unique()) and got[0]["estimate"] == got[0]["std_error"] == 0
    assert got[0]["effect"] == pytest.approx(known.loc["(Intercept)", "estimate"])
    for g in sorted(got)[1:]:
        row = known.loc[f"factor(g){g}"]
        for c in ("estimate", "std_error", "conf_low", "conf_high"):
            assert got[g][c] == pytest.approx(row[c], rel=1e-6), (g, c)
    with pytest.raises(ValueError, match="before clustering"):
        linear.level_table(fit.cluster("h"))
    with pytest.raises(ValueError, match="too many"):
        linear.ols(df, "y ~ z*factor(g)")
    bare = linear.ols(df, "y ~ factor(g)")
    assert {r["level"]: r["effect"] for r in linear.level_table(bare).collect()} == pytest.approx(p.groupby("g").y.mean().to_dict())


def test_long_panels_of_a_sweep_step_together(spark, monkeypatch):
    from panelstats.models import batched
    rng = np.random.default_rng(6)
    rows = [(k, u, t, float(rng.poisson(np.exp(1 + 0.1 * u - 0.05 * t + (0.5 if u > 3 and t > 4 else 0)))), float(rng.normal()))
            for k, units in (("a", 8), ("b", 6), (None, 7)) for u in range(units) for t in range(9)]
    rows += [("empty", u, t, 0.0, 0.1 * t) for u in range(3) for t in range(3)] + [("unknown", u, t, None if u == t else 1.0, 0.1 * t) for u in range(3) for t in range(3)]
    rows += [("tiny", 0, 0, 3.0, 0.0), *rows[:40]]  # some cells repeat
    df = spark.createDataFrame(rows, "k string, u int, t int, n double, z double").withColumn("p", ((F.col("u") > 3) & (F.col("t") > 4)).cast("double"))
    args = (["k"], "n ~ p + z + u + t", "n", ["u", "t"])

    def got(cluster, terms):
        return {(r.k, r.term): r for r in sweep.sweep(df, *args, cluster, terms).collect()}

    plain = [got("u", ["p", "z"]), got(None, ["p", "z"]), got("u", None)]
    monkeypatch.setattr(sweep, "PANEL_CELLS", 0)
    monkeypatch.setattr(batched, "CHUNK", 10)
    for known, found in zip(plain, [got("u", ["p", "z"]), got(None, ["p", "z"]), got("u", None)]):
        assert {k for k, _ in found} == {"a", "b", None, "empty", "unknown", "tiny"}
        for k, term in found:
            if term in ("p", "z") and k in ("a", "b", None):
                a, b = known[k, term], found[k, term]
                assert (b.estimate, b.std_error) == (pytest.approx(a.estimate, rel=1e-7), pytest.approx(a.std_error, rel=1e-6))
                assert b.cells == a.cells and b.problem is None
            elif k in ("empty", "unknown") and known.get((k, term)) is not None and known[k, term].estimate is None:
                assert found[k, term].estimate is None
    monkeypatch.setattr(sweep, "PANEL_CELLS", 60)  # some panels in one task, some in rounds
    mixed_ways = got("u", ["p"])
    assert len(mixed_ways) == 6 and mixed_ways["a", "p"].estimate == pytest.approx(plain[0]["a", "p"].estimate)
