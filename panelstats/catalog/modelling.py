"""Regressions, difference designs, predictions, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paste, pct_effect
from ..models import did as dd, effects, glm, linear, mixed as mx, ordinal, sensitivity as sens, sweep as sw
from ..operators import reshape
from ..session import stage
from .base import LINES_SQL, lines, q, query, r, rounded, table


def coef(df, digits=6, *extra):
    return rounded(df.select(*extra, "term", "estimate", "std_error"), "estimate", "std_error", digits=digits)


# -- least squares -----------------------------------------------------------------------------

_MONTH = "o AS (SELECT o_totalprice AS y, CAST(month(o_orderdate) AS DOUBLE) AS x, o_orderstatus FROM orders)"


def by_month(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_totalprice").alias("y"), F.month("o_orderdate").alias("x"), "o_orderstatus")


@query("q_ols_simple", f"""WITH {_MONTH},
s AS (SELECT count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM o),
e AS (SELECT *, (syy - b * sxy) / (n - 2) AS s2 FROM s)
SELECT '(Intercept)' AS term, {q('a', 3)} AS estimate, {q('sqrt(s2 * (1.0 / n + mx * mx / sxx))', 3)} AS std_error FROM e
UNION ALL SELECT 'x', {q('b', 3)}, {q('sqrt(s2 / sxx)', 3)} FROM e""")
def ols_simple(spark, sf):
    return coef(linear.ols(by_month(spark, sf), "y ~ x").tidy(), 3)


@query("q_ols_stats", f"""WITH {_MONTH},
s AS (SELECT count(*) AS n, regr_r2(y, x) AS r2, regr_syy(y, x) * (1 - regr_r2(y, x)) AS rss FROM o),
l AS (SELECT *, -0.5 * n * (ln(2 * pi()) + ln(rss / n) + 1) AS ll FROM s)
SELECT n, {q('r2')} AS r2, {q('ll', 3)} AS loglik, {q('-2 * ll + 6', 3)} AS aic, {q('-2 * ll + 3 * ln(n)', 3)} AS bic FROM l""")
def ols_stats(spark, sf):
    out = linear.ols(by_month(spark, sf), "y ~ x").stats()
    return rounded(rounded(out, "r2"), "loglik", "aic", "bic", digits=3).select("n", "r2", "loglik", "aic", "bic")


@query("q_std_effect", f"""WITH {_MONTH}
SELECT 'x' AS term, {q('regr_slope(y, x)', 3)} AS estimate, {q('stddev_samp(x)')} AS sd, {q('regr_slope(y, x) * stddev_samp(x)', 3)} AS effect FROM o""")
def std_effect(spark, sf):
    o = by_month(spark, sf)
    out = effects.standardised_effect(linear.ols(o, "y ~ x"), o, ["x"])
    return rounded(rounded(out, "estimate", "effect", digits=3), "sd")


def _within_sql(clusters: list[str]) -> str:
    """Slope of one regressor under state effects, sandwich by inclusion-exclusion over the clusters."""
    combos = [[c] for c in clusters] + ([clusters] if len(clusters) > 1 else [])
    meat = " + ".join(
        f"({'-1' if len(c) > 1 else '1'}) * (SELECT (count(*) / (count(*) - 1.0)) * sum(s * s) FROM (SELECT sum(xt * e) AS s FROM e GROUP BY {', '.join(c)}))"
        for c in combos)
    return f"""WITH {LINES_SQL},
d AS (SELECT *, l_quantity - avg(l_quantity) OVER w AS xt, l_extendedprice - avg(l_extendedprice) OVER w AS yt FROM li WINDOW w AS (PARTITION BY state)),
b AS (SELECT sum(xt * yt) / sum(xt * xt) AS b, sum(xt * xt) AS sxx, count(*) AS n, count(DISTINCT state) + 1 AS k FROM d),
e AS (SELECT d.*, yt - b * xt AS e FROM d, b)
SELECT 'l_quantity' AS term, {q('b', 5)} AS estimate, {q(f'sqrt(({meat}) * (n - 1.0) / (n - k)) / sxx', 5)} AS std_error FROM b"""


@query("q_ols_fe_cluster", _within_sql(["l_suppkey"]))
def ols_fe_cluster(spark, sf):
    fit = linear.ols(lines(spark, sf), "l_extendedprice ~ l_quantity + factor(state)", cluster=["l_suppkey"], compress=True)
    return coef(fit.cluster("l_suppkey").tidy(), 5).where("term = 'l_quantity'")


@query("q_ols_twoway", _within_sql(["l_suppkey", "l_linenumber"]))
def ols_twoway(spark, sf):
    fit = linear.ols(lines(spark, sf), "l_extendedprice ~ l_quantity + factor(state)", cluster=["l_suppkey", "l_linenumber"], compress=True)
    return coef(fit.cluster("l_suppkey", "l_linenumber").tidy(), 5).where("term = 'l_quantity'")


@query("q_ols_absorb", _within_sql(["l_suppkey"]))
def ols_absorb(spark, sf):
    """The same effect with the states taken out by their means."""
    fit = linear.ols(lines(spark, sf), "l_extendedprice ~ l_quantity", cluster=["l_suppkey"], absorb="state")
    return coef(fit.cluster("l_suppkey").tidy(), 5)


@query("q_ols_levels", f"""WITH l AS (SELECT l_partkey AS level, count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem GROUP BY ALL),
b AS (SELECT sum((l_quantity - mx) * (l_extendedprice - my)) / sum(pow(l_quantity - mx, 2)) AS b, sum(pow(l_quantity - mx, 2)) AS sxx FROM lineitem JOIN l ON l_partkey = level),
e AS (SELECT sum(pow(l_extendedprice - my - b * (l_quantity - mx), 2)) / (count(*) - count(DISTINCT level) - 1) AS s2 FROM lineitem JOIN l ON l_partkey = level, b),
z AS (SELECT level AS l0, n AS n0, mx AS mx0, my AS my0 FROM l ORDER BY level LIMIT 1)
SELECT level, CAST(n AS DOUBLE) AS n, {q('my - b * mx', 3)} AS effect, {q('CASE WHEN level = l0 THEN 0 ELSE my - my0 - b * (mx - mx0) END', 3)} AS estimate,
       {q('CASE WHEN level = l0 THEN 0 ELSE sqrt(s2 * (1.0 / n + 1.0 / n0 + pow(mx - mx0, 2) / sxx)) END', 3)} AS std_error FROM l, b, e, z""")
def ols_levels(spark, sf):
    """Coefficients of a factor of any number of levels, a row each."""
    fit = linear.ols(table(spark, sf, "lineitem"), "l_extendedprice ~ l_quantity", absorb="l_partkey")
    return rounded(linear.level_table(fit), "effect", "estimate", "std_error", digits=3).drop("conf_low", "conf_high")


@query("q_wls", f"""WITH w AS (SELECT l_quantity AS w, l_discount AS x, l_extendedprice AS y FROM lineitem),
m AS (SELECT sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, count(*) AS n FROM w),
b AS (SELECT sum(w * (x - mx) * (y - my)) / sum(w * pow(x - mx, 2)) AS b, sum(w * pow(x - mx, 2)) AS sxx, any_value(mx) AS mx, any_value(my) AS my, any_value(n) AS n FROM w, m),
e AS (SELECT any_value(b) AS b, any_value(sxx) AS sxx, sum(w * pow(y - my - b * (x - mx), 2)) / (any_value(n) - 2) AS s2 FROM w, b)
SELECT 'l_discount' AS term, {q('b', 3)} AS estimate, {q('sqrt(s2 / sxx)', 3)} AS std_error FROM e""")
def wls(spark, sf):
    fit = linear.ols(table(spark, sf, "lineitem"), "l_extendedprice ~ l_discount", weights="l_quantity", compress=True)
    return coef(fit.tidy(), 3).where("term = 'l_discount'")


@query("q_ols_interactions")
def ols_interactions(spark, sf):
    """Polynomial, crossed and nested terms with factors; clustered table with stars."""
    fit = linear.ols(lines(spark, sf), "l_extendedprice ~ same_sex*(l_quantity + l_tax) + I(l_quantity^2) + factor(year)",
                     cluster=["state"])
    return fit.cluster("state").stars()


@query("q_nested_specs")
def nested_specs(spark, sf):
    """Basic, state effects, state and year effects, clustered."""
    li = lines(spark, sf)
    out = []
    for name, fe in (("basic", ""), ("state FE", " + factor(state)"), ("state+year FE", " + factor(state) + factor(year)")):
        fit = linear.ols(li, f"l_extendedprice ~ l_quantity + l_discount{fe}", cluster=["l_suppkey"])
        out.append(fit.cluster("l_suppkey").tidy().withColumn("model", F.lit(name)))
    return reshape.bind_rows(*out)


# -- count models --------------------------------------------------------------------------------

_PANEL = """
pn AS (SELECT state, year, same_sex, mixed, year > 1997 AS post, sum(l_quantity) AS n FROM li GROUP BY ALL)"""


def panel(spark, sf):
    """State x year x flag x flag counts, staged: the fits read it many times."""
    p = lines(spark, sf).groupBy("state", "year", "same_sex", "mixed").agg(F.sum("l_quantity").alias("n"))
    p = reshape.complete(stage(p), ["state", "year", "same_sex", "mixed"])
    return p.withColumns({"post": F.col("year") > 1997, "group_fe": paste("state", "same_sex", "mixed"),
                          "policy": (F.col("state") % 5 + F.col("year") % 3).cast("int")})


@query("q_ddd_saturated", f"""WITH {LINES_SQL}, {_PANEL},
c AS (SELECT post, same_sex, mixed, ln(avg(n)) AS l FROM pn GROUP BY ALL),
t AS (SELECT sum(l * CASE WHEN post THEN 1 ELSE -1 END * CASE WHEN same_sex THEN 1 ELSE -1 END * CASE WHEN mixed THEN 1 ELSE -1 END) AS b FROM c)
SELECT 'postTRUE:same_sexTRUE:mixedTRUE' AS term, {q('b')} AS estimate, {q('100 * (exp(b) - 1)', 4)} AS effect FROM t""")
def ddd_saturated(spark, sf):
    fit = glm.quasi_poisson(panel(spark, sf), "n ~ post*same_sex*mixed", cluster=["group_fe"])
    out = fit.tidy().where("term = 'postTRUE:same_sexTRUE:mixedTRUE'")
    return out.select("term", r("estimate").alias("estimate"), r(pct_effect("estimate"), 4).alias("effect"))


@query("q_poisson_dispersion", f"""WITH {LINES_SQL}, {_PANEL},
c AS (SELECT *, avg(n) OVER (PARTITION BY post, same_sex, mixed) AS mu, count(*) OVER () AS k FROM pn)
SELECT any_value(k) AS n, {q('sum((n - mu) * (n - mu) / mu) / (any_value(k) - 8)', 4)} AS sigma2 FROM c""")
def poisson_dispersion(spark, sf):
    fit = glm.quasi_poisson(panel(spark, sf), "n ~ post*same_sex*mixed")
    return rounded(fit.stats().select("n", "sigma2"), "sigma2", digits=4)


@query("q_logit", f"""WITH {LINES_SQL},
c AS (SELECT count(*) FILTER (WHERE same_sex AND mixed) AS a, count(*) FILTER (WHERE same_sex AND NOT mixed) AS b,
             count(*) FILTER (WHERE NOT same_sex AND mixed) AS c, count(*) FILTER (WHERE NOT same_sex AND NOT mixed) AS d FROM li)
SELECT '(Intercept)' AS term, {q('ln(c * 1.0 / d)')} AS estimate, {q('sqrt(1.0 / c + 1.0 / d)')} AS std_error FROM c
UNION ALL SELECT 'same_sexTRUE', {q('ln(a * d * 1.0 / (b * c))')}, {q('sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d)')} FROM c""")
def logit(spark, sf):
    li = lines(spark, sf).withColumn("y", F.col("mixed").cast("int"))
    return coef(glm.logit(li, "y ~ same_sex").tidy())


@query("q_did_specs")
def did_specs(spark, sf):
    """Simple, double and triple difference with unit and year effects, clustered on the unit."""
    p = panel(spark, sf)
    specs = {"D": (p.where("same_sex and mixed"), []), "DD": (p.where("same_sex"), ["mixed"]), "DDD": (p, ["same_sex", "mixed"])}
    out = []
    for name, (d, flags) in specs.items():
        t = dd.did(d, "n", "post", flags, "group_fe", "year").tidy()
        out.append(t.where(F.col("term") == dd.did_term("post", flags)).withColumn("model", F.lit(name)))
    return reshape.bind_rows(*out)


@query("q_dd_controls")
def dd_controls(spark, sf):
    fit = dd.did(panel(spark, sf), "n", "post", ["same_sex", "mixed"], "group_fe", "year", ["policy"])
    return fit.tidy().where(~F.col("term").startswith("factor("))


@query("q_stratified")
def stratified(spark, sf):
    """Re-estimation on subsets named by a condition."""
    fits = dd.stratified(panel(spark, sf), {"high": "state >= 12", "low": "state < 12"},
                         lambda d: dd.did(d, "n", "post", ["same_sex", "mixed"], "group_fe", "year"))
    term = dd.did_term("post", ["same_sex", "mixed"])
    return reshape.bind_rows(*[f.tidy().where(F.col("term") == term).withColumn("sample", F.lit(k)) for k, f in fits.items()])


@query("q_event_study")
def event_study(spark, sf):
    fit, terms = dd.event_study(panel(spark, sf), "n", "year", ["same_sex", "mixed"], "group_fe", 2, ["policy"])
    return dd.event_table(fit, terms, "group_fe")


@query("q_pretrend_wald")
def pretrend_wald(spark, sf):
    fit, terms = dd.event_study(panel(spark, sf), "n", "year", ["same_sex", "mixed"], "group_fe", 2)
    return fit.wald([t for t in terms if "1996" in t or "1994" in t])


# -- predictions -------------------------------------------------------------------------------


@query("q_predict", f"""WITH {_MONTH}, f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM o)
SELECT o_orderstatus, {q('avg(a + b * x)', 3)} AS fit FROM o, f GROUP BY ALL""")
def predict(spark, sf):
    o = by_month(spark, sf)
    return linear.ols(o, "y ~ x").predict(o).groupBy("o_orderstatus").agg(r(F.avg("fit"), 3).alias("fit"))


_LINE_ERR = f"""WITH {_MONTH},
s AS (SELECT count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx,
             (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) AS s2 FROM o)"""


@query("q_predict_se", f"""{_LINE_ERR}
SELECT CAST(x AS INTEGER) AS x, {q('any_value(a + b * x)', 3)} AS fit, {q('any_value(sqrt(s2 * (1.0 / n + pow(x - mx, 2) / sxx)))', 3)} AS fit_se FROM o, s GROUP BY x""")
def predict_se(spark, sf):
    o = by_month(spark, sf)
    out = linear.ols(o, "y ~ x").predict(o, se=True).groupBy("x").agg(F.max("fit").alias("fit"), F.max("fit_se").alias("fit_se"))
    return rounded(out, "fit", "fit_se", digits=3)


@query("q_counterfactual_mean", f"""{_LINE_ERR}
SELECT v AS x, {q('a + b * v', 3)} AS fit, {q('sqrt(s2 * (1.0 / n + pow(v - mx, 2) / sxx))', 3)} AS se_fit FROM s, (SELECT unnest([1.0, 6.0, 12.0])::DOUBLE AS v)""")
def counterfactual_mean(spark, sf):
    o = by_month(spark, sf)
    out = effects.counterfactual(linear.ols(o, "y ~ x"), o, {"x": [1.0, 6.0, 12.0]})
    return rounded(out.select("x", "fit", "se_fit"), "fit", "se_fit", digits=3)


@query("q_counterfactual_grid")
def counterfactual_grid(spark, sf):
    """One variable over its range, the other at its least and greatest value."""
    li = lines(spark, sf)
    fit = linear.ols(li, "l_extendedprice ~ l_quantity*l_discount + factor(state)", cluster=["l_suppkey"], compress=True)
    return effects.counterfactual(fit.cluster("l_suppkey"), li, {
        "l_quantity": effects.value_grid(li, "l_quantity", 10), "l_discount": effects.value_grid(li, "l_discount", 2)})


@query("q_response_means", f"""WITH {LINES_SQL}, {_PANEL},
m AS (SELECT post, avg(n) FILTER (WHERE same_sex) AS a, avg(n) FILTER (WHERE NOT same_sex) AS b FROM pn GROUP BY post)
SELECT year, s AS same_sex, {q('avg(CASE WHEN s THEN a ELSE b END)', 4)} AS fit
FROM pn JOIN m USING (post), (SELECT unnest([TRUE, FALSE]) AS s) GROUP BY ALL""")
def response_means(spark, sf):
    p = panel(spark, sf)
    fit = glm.quasi_poisson(p, "n ~ post*same_sex")
    return rounded(effects.response_means(fit, p, {"same_sex": [True, False]}, ["year"]), "fit", digits=4)


_SQUARE = """
z AS (SELECT l_quantity AS x, l_quantity * l_quantity AS x2, l_extendedprice AS y, l_returnflag FROM lineitem),
m AS (SELECT avg(x) AS mx, avg(x2) AS mz, avg(y) AS my, covar_pop(x, x) AS a, covar_pop(x, x2) AS b, covar_pop(x2, x2) AS c, covar_pop(x, y) AS d, covar_pop(x2, y) AS e FROM z),
b AS (SELECT mx, mz, my, (d * c - b * e) / (a * c - b * b) AS b1, (a * e - b * d) / (a * c - b * b) AS b2 FROM m)"""


def _square(spark, sf):
    li = table(spark, sf, "lineitem")
    return li, linear.ols(li, "l_extendedprice ~ l_quantity + I(l_quantity^2)", compress=True)


@query("q_counterfactual_square", f"""WITH {_SQUARE}
SELECT v AS l_quantity, {q('my + b1 * (v - mx) + b2 * (v * v - mz)', 2)} AS fit FROM b, (SELECT unnest([1.0, 25.0, 50.0])::DOUBLE AS v)""")
def counterfactual_square(spark, sf):
    """A set value reaches the squared term too."""
    li, fit = _square(spark, sf)
    return rounded(effects.counterfactual(fit, li, {"l_quantity": [1.0, 25.0, 50.0]}).select("l_quantity", "fit"), "fit", digits=2)


@query("q_contrast_square", f"""WITH {_SQUARE}
SELECT l_returnflag, {q('any_value(b1) + any_value(b2) * (2 * avg(x) + 1)', 2)} AS estimate FROM z, b GROUP BY l_returnflag""")
def contrast_square(spark, sf):
    li, fit = _square(spark, sf)
    return rounded(effects.contrast(fit, li, ["l_quantity"], "l_returnflag").select("l_returnflag", "estimate"), "estimate", digits=2)


@query("q_response_means_product", f"""WITH {LINES_SQL}, {_PANEL},
m AS (SELECT post, same_sex, avg(n) AS a FROM pn GROUP BY ALL)
SELECT year, m.post, {q('ln(avg(a))')} AS log_fit FROM pn JOIN m ON m.same_sex = pn.same_sex GROUP BY ALL""")
def response_means_product(spark, sf):
    """A set flag reaches the product term of a count model."""
    p = panel(spark, sf)
    fit = glm.quasi_poisson(p, "n ~ post + same_sex + I(post*same_sex)")
    return rounded(effects.response_means(fit, p, {"post": [False, True]}, ["year"]).select("year", "post", F.ln("fit").alias("log_fit")), "log_fit")


@query("q_contrast")
def contrast(spark, sf):
    p = panel(spark, sf).withColumn("policy_score", F.col("policy").cast("double"))
    fit = glm.quasi_poisson(p, "n ~ policy_score + same_sex + factor(year)", cluster=["group_fe"])
    return effects.contrast(fit.cluster("group_fe"), p, ["policy_score"], "same_sex")


@query("q_sim_ci")
def sim_ci(spark, sf):
    li = lines(spark, sf).withColumn("post", F.col("year") > 1997)
    fit = linear.ols(li, "l_extendedprice ~ post*l_quantity + factor(state)", cluster=["state"], compress=True).cluster("state")
    return effects.simulate(fit, li, {"post": [False, True], "l_quantity": effects.value_grid(li, "l_quantity", 10)}, 250, 185)


@query("q_profile_grid", f"""
SELECT {q('(SELECT avg(c_acctbal) FROM customer)', 4)} AS c_acctbal, (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS c_mktsegment,
       CAST(v AS INTEGER) AS c_nationkey FROM (SELECT unnest(range(0, 5)) AS v)""")
def profile_grid(spark, sf):
    c = table(spark, sf, "customer")
    return rounded(effects.profile_grid(c, ["c_acctbal"], ["c_mktsegment"], {"c_nationkey": list(range(5))}), "c_acctbal", digits=4)


# -- ordinal and mixed -------------------------------------------------------------------------


def ordered_rows(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    size = F.when(F.col("o_totalprice") <= 150000, "low").when(F.col("o_totalprice") <= 350000, "mid").otherwise("high")
    return j.select(size.alias("size"), (F.col("c_nationkey") % 5).alias("score"), (F.col("o_orderstatus") == "P").alias("open"),
                    "c_mktsegment", "c_nationkey", (F.month("o_orderdate") % 4 + 1).cast("double").alias("w"),
                    F.when(F.col("o_totalprice") <= 150000, 1).when(F.col("o_totalprice") <= 350000, 2).otherwise(3).alias("code"))


@query("q_ordered_logit")
def ordered_logit(spark, sf):
    fit = ordinal.ordered_logit(ordered_rows(spark, sf), "size ~ open*score + c_mktsegment", ["low", "mid", "high"], weights="w",
                                cluster=["c_nationkey"])
    return fit.cluster("c_nationkey").tidy()


@query("q_ordered_probs")
def ordered_probs(spark, sf):
    rows = ordered_rows(spark, sf)
    fit = ordinal.ordered_logit(rows, "size ~ open*score", ["low", "mid", "high"])
    wide = fit.mean_probs(rows, ["open"])
    return reshape.gather(wide, ["open"], ["low", "mid", "high"], "size", "phat")


@query("q_ordered_sim")
def ordered_sim(spark, sf):
    rows = ordered_rows(spark, sf)
    fit = ordinal.ordered_logit(rows, "size ~ open*score", ["low", "mid", "high"], cluster=["c_nationkey"]).cluster("c_nationkey")
    return effects.simulate(fit, rows, {"open": [False, True], "score": [0.0, 2.0, 4.0]}, 250, 185)


@query("q_cum_logits", f"""WITH o AS (SELECT o_orderstatus = 'P' AS open, o_totalprice FROM orders),
c AS (SELECT k AS cut, count(*) FILTER (WHERE open AND o_totalprice > t) AS a, count(*) FILTER (WHERE open AND o_totalprice <= t) AS b,
  count(*) FILTER (WHERE NOT open AND o_totalprice > t) AS c, count(*) FILTER (WHERE NOT open AND o_totalprice <= t) AS d
  FROM o, (VALUES (1, 150000), (2, 350000)) v(k, t) GROUP BY k)
SELECT CAST(cut AS BIGINT) AS cut, '(Intercept)' AS term, {q('ln(c * 1.0 / d)')} AS estimate, {q('sqrt(1.0 / c + 1.0 / d)')} AS std_error FROM c
UNION ALL SELECT CAST(cut AS BIGINT), 'openTRUE', {q('ln(a * d * 1.0 / (b * c))')}, {q('sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d)')} FROM c""")
def cum_logits(spark, sf):
    return coef(ordinal.cumulative_logits(ordered_rows(spark, sf), "code ~ open", [1, 2]), 6, "cut")


@query("q_mixed")
def mixed(spark, sf):
    fit = mx.mixed(lines(spark, sf), "l_extendedprice ~ l_quantity + l_discount", "l_suppkey")
    return fit.tidy()


@query("q_mixed_crossed")
def mixed_crossed(spark, sf):
    li = lines(spark, sf).groupBy("state", "year", "l_suppkey").agg(F.sum("l_quantity").alias("n"), F.avg("l_discount").alias("score"))
    return mx.variance_table(mx.mixed(li, "n ~ score", ["state", "year"]))


@query("q_mixed_balanced", f"""WITH {LINES_SQL},
g AS (SELECT state, year, coalesce(n, 0) AS y FROM (SELECT DISTINCT state FROM li) CROSS JOIN (SELECT DISTINCT year FROM li)
      LEFT JOIN (SELECT state, year, sum(l_quantity) AS n FROM li GROUP BY ALL) USING (state, year)),
m AS (SELECT *, avg(y) OVER (PARTITION BY state) AS ms, avg(y) OVER (PARTITION BY year) AS my, avg(y) OVER () AS mm FROM g),
c AS (SELECT count(DISTINCT state) AS i, count(DISTINCT year) AS j, sum((y - ms - my + mm) ** 2) AS se, sum((ms - mm) ** 2) AS sa, sum((my - mm) ** 2) AS sb, any_value(mm) AS mm FROM m),
v AS (SELECT *, se / ((i - 1) * (j - 1)) AS e0, sa / (i - 1) AS a, sb / (j - 1) AS b FROM c),
u AS (SELECT *, CASE WHEN a <= e0 THEN (se + sa) / ((i - 1) * j) WHEN b <= e0 THEN (se + sb) / ((j - 1) * i) ELSE e0 END AS e FROM v)
SELECT 'state' AS component, {q('greatest((a - e) / j / e, 0)', 3)} AS ratio FROM u UNION ALL SELECT 'year', {q('greatest((b - e) / i / e, 0)', 3)} FROM u UNION ALL SELECT 'residual', 1.0 FROM u""")
def mixed_balanced(spark, sf):
    """Crossed intercepts of a complete table, whose estimates are those of its analysis of variance."""
    n = lines(spark, sf).groupBy("state", "year").agg(F.sum("l_quantity").alias("n"))
    fit = mx.mixed(reshape.complete(stage(n), ["state", "year"]).withColumn("n", F.coalesce("n", F.lit(0.0))), "n ~ 1", ["state", "year"])
    return mx.variance_table(fit).select("component", r(F.col("variance") / F.lit(float(fit.variances["residual"])), 3).alias("ratio"))


@query("q_ols_nested", f"""WITH {LINES_SQL},
w AS (SELECT l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS y, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS x, l_suppkey FROM li),
b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy, count(*) - count(DISTINCT l_suppkey) - 1 AS df FROM w)
SELECT 'l_quantity' AS term, {q('b', 5)} AS estimate, {q('sqrt((syy - b * sxy) / df / sxx)', 5)} AS std_error, CAST(df AS DOUBLE) AS df FROM b""")
def ols_nested(spark, sf):
    """Suppliers lie in one state each, so taking out both takes out no more than the suppliers."""
    fit = linear.ols(lines(spark, sf), "l_extendedprice ~ l_quantity", absorb=["l_suppkey", "state"])
    return coef(fit.tidy(), 5).withColumn("df", F.lit(float(fit.df_resid)))


@query("q_count_two_effects", f"""WITH {LINES_SQL},
t AS (SELECT state % 2 = 1 AS treated, year > 1997 AS late, sum(l_quantity) AS n FROM li GROUP BY ALL)
SELECT 'cut' AS term, {q("sum(ln(n) * CASE WHEN late THEN 1 ELSE -1 END * CASE WHEN treated THEN 1 ELSE -1 END)")} AS estimate FROM t""")
def count_two_effects(spark, sf):
    """Difference in differences of counts with supplier and period effects taken out; two periods make it a ratio of totals."""
    n = lines(spark, sf).groupBy("l_suppkey", "state", (F.col("year") > 1997).alias("late")).agg(F.sum("l_quantity").alias("n"))
    n = n.withColumn("cut", (F.col("late") & (F.col("state") % 2 == 1)).cast("int"))
    fit = glm.quasi_poisson(n, "n ~ cut", absorb=["l_suppkey", "late"])
    return fit.tidy().select("term", r("estimate").alias("estimate"))


# -- sweeps ------------------------------------------------------------------------------------


@query("q_pool_inverse_variance", f"""WITH g AS (SELECT l_suppkey, l_suppkey % 2 = 0 AS flag, avg(l_extendedprice) AS est, stddev_samp(l_extendedprice) / sqrt(count(*)) AS se
  FROM lineitem GROUP BY ALL)
SELECT flag, {q('sum(est / (se * se)) / sum(1 / (se * se))', 3)} AS estimate, {q('sqrt(1 / sum(1 / (se * se)))', 3)} AS std_error FROM g GROUP BY flag""")
def pool_inverse_variance(spark, sf):
    return rounded(sens.pool_inverse_variance(_supplier_means(spark, sf), "flag"), "estimate", "std_error", digits=3)


def _supplier_means(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.avg("l_extendedprice").alias("estimate"), (F.stddev_samp("l_extendedprice") / F.sqrt(F.count("*"))).alias("std_error")
    ).withColumns({"flag": F.col("l_suppkey") % 2 == 0, "third": F.col("l_suppkey") % 3 == 0})


@query("q_pooled_difference", f"""WITH g AS (SELECT l_suppkey, avg(l_extendedprice) AS est, stddev_samp(l_extendedprice) / sqrt(count(*)) AS se FROM lineitem GROUP BY ALL),
l AS (SELECT 'flag' AS policy, l_suppkey % 2 = 0 AS f, est, 1 / (se * se) AS w FROM g UNION ALL SELECT 'third', l_suppkey % 3 = 0, est, 1 / (se * se) FROM g),
p AS (SELECT policy, f, sum(est * w) / sum(w) AS e, 1 / sum(w) AS v FROM l GROUP BY ALL)
SELECT a.policy, {q('a.e - b.e', 3)} AS est_dif, {q('sqrt(a.v + b.v)', 3)} AS est_dif_se FROM p a JOIN p b ON a.policy = b.policy AND a.f AND NOT b.f""")
def pooled_difference(spark, sf):
    return rounded(sens.pooled_difference(_supplier_means(spark, sf), ["flag", "third"]), "est_dif", "est_dif_se", digits=3)


@query("q_misreport", f"""WITH {LINES_SQL}, {_PANEL},
w AS (SELECT state, year, mixed, sum(CASE WHEN same_sex THEN n ELSE 0 END) AS t, sum(CASE WHEN NOT same_sex THEN n ELSE 0 END) AS f FROM pn GROUP BY ALL),
x AS (SELECT *, r FROM w, (SELECT unnest([0.0, 0.25, 0.5])::DOUBLE AS r))
SELECT state, year, mixed, r AS rate, TRUE AS same_sex, {q('round_even((1 - r) * t, 0)', 2)} AS n FROM x
UNION ALL SELECT state, year, mixed, r, FALSE, {q('round_even(r * t + f, 0)', 2)} FROM x""")
def misreport(spark, sf):
    out = sens.misreport(panel(spark, sf), "same_sex", "n", [0.0, 0.25, 0.5], ["state", "year", "mixed"])
    return rounded(out, "n", digits=2)


def _products(df):
    one = lambda *c: F.expr(" * ".join(f"cast({x} as double)" for x in c))
    return df.withColumns({"p_sm": one("post", "same_sex", "mixed"), "p_s": one("post", "same_sex"), "p_m": one("post", "mixed"),
                           "p": one("post")})


_SWEEP = "n ~ p_sm + p_s + p_m + p + group_fe + year"


@query("q_misreport_sweep")
def misreport_sweep(spark, sf):
    """Seven misreporting rates, three samples, with and without the control."""
    samples = {"Full sample": "true", "High": "state >= 12", "Low": "state < 12"}
    parts = []
    base = panel(spark, sf)
    for name, cond in samples.items():
        moved = sens.misreport(base.where(cond), "same_sex", "n", [i / 10 for i in range(7)], ["state", "year", "mixed", "post", "policy"])
        parts.append(moved.withColumn("sample", F.lit(name)))
    panels = _products(reshape.bind_rows(*parts)).withColumn("group_fe", paste("state", "same_sex", "mixed"))
    out = []
    for model, formula in (("Main effects", _SWEEP), ("With controls", _SWEEP + " + policy")):
        fit = sw.sweep(panels, ["sample", "rate"], formula, "n", ["group_fe", "year"], "group_fe", ["p_sm"])
        out.append(fit.withColumn("model", F.lit(model)))
    return reshape.bind_rows(*out)


_COMBO = """
cb AS (SELECT state, year, same_sex, mixed, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE
         concat(CAST(l_discount > 0.05 AS INTEGER), CAST(l_tax > 0.04 AS INTEGER), CAST(l_quantity > 25 AS INTEGER)) END AS combo,
         sum(l_quantity) AS n, count(*) AS k FROM li GROUP BY ALL)"""


def combos(spark, sf):
    from ..plans.counts import combo_panels
    li = lines(spark, sf).withColumns({"f1": F.col("l_discount") > 0.05, "f2": F.col("l_tax") > 0.04, "f3": F.col("l_quantity") > 25})
    return combo_panels(li, ["f1", "f2", "f3"], F.col("l_partkey") % 10 != 0, w="l_quantity", cutoff=1997)


@query("q_combo_panels", f"""WITH {LINES_SQL}, {_COMBO}, ids AS (SELECT DISTINCT combo FROM cb WHERE combo IS NOT NULL),
b AS (SELECT combo, state, year, same_sex, mixed, n, k FROM cb WHERE combo IS NOT NULL
      UNION ALL SELECT ids.combo, state, year, same_sex, mixed, n, k FROM cb, ids WHERE cb.combo IS NULL)
SELECT combo, state, year, same_sex, mixed, {q('sum(n)', 2)} AS n, CAST(sum(k) AS BIGINT) AS n_unweighted FROM b GROUP BY ALL""")
def combo_panels(spark, sf):
    out = combos(spark, sf).where("n_unweighted > 0").select("combo", "state", "year", "same_sex", "mixed", "n", "n_unweighted")
    return rounded(out, "n", digits=2)


@query("q_combo_sweep")
def combo_sweep(spark, sf):
    """One triple difference per flag combination, all panels side by side."""
    return sw.sweep(_products(combos(spark, sf)), ["combo"], _SWEEP, "n", ["group_fe", "year"], "group_fe", ["p_sm"])


@query("q_placebo_sweep", f"""WITH {LINES_SQL},
d AS (SELECT c AS cutoff, l_suppkey, l_extendedprice AS y, CASE WHEN year > c THEN 1.0 ELSE 0.0 END AS x FROM li, (SELECT unnest([1996, 1997, 1998, 1999])::INTEGER AS c)),
m AS (SELECT cutoff, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, count(*) AS n FROM d GROUP BY cutoff),
s AS (SELECT cutoff, l_suppkey, sum((x - mx) * (y - my - b * (x - mx))) AS s FROM d JOIN m USING (cutoff) GROUP BY ALL),
v AS (SELECT cutoff, count(*) / (count(*) - 1.0) * sum(s * s) AS meat FROM s GROUP BY cutoff)
SELECT cutoff, 'post_year' AS term, {q('b', 4)} AS estimate, {q('sqrt(meat * (n - 1.0) / (n - 2)) / sxx', 4)} AS std_error FROM m JOIN v USING (cutoff)""")
def placebo_sweep(spark, sf):
    out = sw.placebo_cutoffs(lines(spark, sf), "l_extendedprice ~ post_year", "year", [1996, 1997, 1998, 1999], ["l_suppkey"], terms=["post_year"])
    return coef(out, 4, "cutoff")


@query("q_misreport_ols_sweep")
def misreport_ols_sweep(spark, sf):
    """Percent outcome rebuilt for every spouse misreporting rate, two-way clustered."""
    li = lines(spark, sf)
    s = lambda c: F.sum(F.when(c, F.col("l_quantity")).otherwise(0.0))
    flag, f = F.col("same_sex"), F.col("mixed")
    p = li.groupBy("state", "l_suppkey", "year").agg(
        s(flag & f).alias("spouse"), s(flag & ~f).alias("partner"), F.sum("l_quantity").alias("total"),
        F.avg("l_discount").alias("score"))
    # Published (spouse, partner) mismatch rates.
    curve = sens.rate_curve({0.0: 0.0, 0.573: 0.07, 0.35: 0.034})
    rates = [0.573, 0.35, *[0.9 * i / 19 for i in range(20)]]
    variants = sens.misreport_variants("adj", {"spouse": "spouse", "partner": "partner"}, [], "total", rates, curve)
    p = p.withColumn("adj", F.lit(0.0))
    return linear.ols_variants(p, "adj ~ score + factor(state)", variants, cluster=["state", "year"]).where("term = 'score'")


@query("q_ovb")
def ovb(spark, sf):
    fit = linear.ols(lines(spark, sf), "l_extendedprice ~ l_quantity + l_discount + l_tax + factor(state)")
    return sens.ovb_sensitivity(fit, "l_quantity", ["l_discount"], [1, 2, 3])
