"""Fits held against the equations that define them: a fit with effects reproduces the totals of its levels, a saturated one has a closed form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..models import did as dd, glm, linear, sensitivity as sens, sweep as sw
from ..models.dist import t_quantile
from ..operators import panel as series, reshape
from ..plans import rankings
from ..session import stage
from .base import LINES_SQL, lines, q, query, r, rounded
from .modelling import _COMBO, _PANEL, combos, panel
from .studies import _IND, MEMBERS_SQL, _ranked


def _totals(df: DataFrame, model: str, kinds: Mapping[str, Sequence[str]], moments: Sequence[str] = (), mean: bool = False) -> DataFrame:
    """Sums of ``fit`` per level of several groupings, and of its products with ``moments``, from one pass."""
    items = [F.struct(F.lit(k).alias("kind"), F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("level"), F.col("fit").alias("v"))
             for k, cols in kinds.items()]
    items += [F.struct(F.lit("product").alias("kind"), F.lit(m).alias("level"), (F.col("fit") * F.col(m)).alias("v")) for m in moments]
    out = df.select(F.inline(F.array(*items))).groupBy("kind", "level").agg(r(F.avg("v") if mean else F.sum("v"), 2).alias("total"))
    return out.where("total > 0").select(F.lit(model).alias("model"), "kind", "level", "total")


def _totals_sql(src: str, y: str, model: str, where: str, kinds: Mapping[str, Sequence[str]], moments: Sequence[str] = (), fn: str = "sum") -> str:
    parts = [f"""SELECT '{model}' AS model, '{k}' AS kind, concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)}) AS level, {q(f'{fn}({y})', 2)} AS total
FROM {src} WHERE {where} GROUP BY ALL HAVING sum({y}) > 0""" for k, cols in kinds.items()]
    parts += [f"SELECT '{model}' AS model, 'product' AS kind, '{m}' AS level, {q(f'{fn}({y} * {m})', 2)} AS total FROM {src} WHERE {where}" for m in moments]
    return "\nUNION ALL ".join(parts)


_CELL, _UNIT, _YEAR = {"cell": ["post", "same_sex", "mixed"]}, {"unit": ["state", "same_sex", "mixed"]}, {"year": ["year"]}
_DESIGNS = {"D": ("same_sex AND mixed", []), "DD": ("same_sex", ["mixed"]), "DDD": ("TRUE", ["same_sex", "mixed"]),
            "DDD, high": ("state >= 12", ["same_sex", "mixed"]), "DDD, low": ("state < 12", ["same_sex", "mixed"])}


@query("q_did_scores", f"WITH {LINES_SQL}, {_PANEL}, pp AS (SELECT *, state % 5 + year % 3 AS policy FROM pn)\n" + "\nUNION ALL ".join(
    [_totals_sql("pp", "n", name, where, _UNIT | _YEAR | (_CELL if flags else {})) for name, (where, flags) in _DESIGNS.items()]
    + [_totals_sql("pp", "n", "DDD, control", "TRUE", _UNIT | _YEAR | _CELL, ["policy"])]))
def did_scores(spark, sf):
    """Simple, double and triple differences, two strata and a control: fitted totals by unit, year, cell and control."""
    p, out = panel(spark, sf), []
    for name, (where, flags) in _DESIGNS.items():
        d = p.where(where)
        out.append(_totals(dd.did(d, "n", "post", flags, "group_fe", "year").predict(d), name, _UNIT | _YEAR | (_CELL if flags else {})))
    fit = dd.did(p, "n", "post", ["same_sex", "mixed"], "group_fe", "year", ["policy"])
    out.append(_totals(fit.predict(p), "DDD, control", _UNIT | _YEAR | _CELL, ["policy"]))
    return reshape.bind_rows(*out)


_WIDE = {"unit": ["state", "same_sex", "mixed"], "cell": ["year", "same_sex", "mixed"]}


@query("q_event_scores", f"WITH {LINES_SQL}, {_PANEL}, w AS (SELECT state, same_sex, mixed, CAST(year // 2 * 2 AS INTEGER) AS year, n FROM pn)\n"
       + _totals_sql("w", "n", "event study", "TRUE", _WIDE))
def event_scores(spark, sf):
    """Event study on two-year periods: fitted totals by unit and by period and flags."""
    p = panel(spark, sf)
    fit, _ = dd.event_study(p, "n", "year", ["same_sex", "mixed"], "group_fe", 2)
    wide = series.rebin(p, ["state", "same_sex", "mixed", "group_fe"], "year", 2, ["n"])
    return _totals(fit.predict(wide), "event study", _WIDE)


_NESTED = {"basic": ("", {}), "state": (" + factor(state)", {"state": ["state"]}),
           "state and year": (" + factor(state) + factor(year)", {"state": ["state"], "year": ["year"]})}


@query("q_nested_scores", f"WITH {LINES_SQL}\n" + "\nUNION ALL ".join(
    _totals_sql("li", "l_extendedprice", name, "TRUE", kinds, ["l_quantity", "l_discount"], "avg") for name, (_, kinds) in _NESTED.items()))
def nested_scores(spark, sf):
    """Nested least-squares fits: fitted means by effect, and of the products with the regressors."""
    li = lines(spark, sf)
    return reshape.bind_rows(*[
        _totals(linear.ols(li, f"l_extendedprice ~ l_quantity + l_discount{more}").predict(li), name, kinds, ["l_quantity", "l_discount"], True)
        for name, (more, kinds) in _NESTED.items()])


@query("q_wald_saturated", f"""WITH {LINES_SQL}, {_PANEL},
d AS (SELECT count(DISTINCT state) * count(DISTINCT mixed) AS c FROM pn),
u AS (SELECT year, same_sex, sum(n) AS s, sum(n * n) AS ss, any_value(c) AS c FROM pn, d GROUP BY year, same_sex),
f AS (SELECT sum((ss - s * s / c) / (s / c)) / sum(c - 1) AS phi FROM u),
g AS (SELECT year, max(CASE WHEN same_sex THEN ln(s) END) - max(CASE WHEN NOT same_sex THEN ln(s) END) AS l, any_value(phi) * sum(1 / s) AS v FROM u, f GROUP BY year),
z AS (SELECT l AS l0, v AS v0 FROM g WHERE year = 1995),
t AS (SELECT l - l0 AS b, v, v0 FROM g, z WHERE year IN (1996, 1997, 1998))
SELECT count(*) AS df, {q('sum(b * b / v) - any_value(v0) * pow(sum(b / v), 2) / (1 + any_value(v0) * sum(1 / v))', 4)} AS chisq FROM t""")
def wald_saturated(spark, sf):
    """Several early periods tested together; in a saturated model log cell totals are independent."""
    fit = glm.quasi_poisson(panel(spark, sf), "n ~ factor(year)*same_sex")
    return rounded(fit.wald([f"factor(year){y}:same_sexTRUE" for y in (1996, 1997, 1998)]).select("df", "chisq"), "chisq", digits=4)


@query("q_ovb_bounds", f"""WITH {LINES_SQL},
s AS (SELECT count(*) AS n, regr_sxx(l_quantity, l_quantity) AS dd, regr_sxx(l_discount, l_discount) AS xx, regr_sxy(l_quantity, l_discount) AS dx,
             regr_sxy(l_quantity, l_extendedprice) AS dy, regr_sxy(l_discount, l_extendedprice) AS xy, regr_sxx(l_extendedprice, l_extendedprice) AS yy FROM li),
b AS (SELECT *, n - 3.0 AS dof, dd * xx - dx * dx AS det, (xx * dy - dx * xy) / (dd * xx - dx * dx) AS b, (dd * xy - dx * dy) / (dd * xx - dx * dx) AS c FROM s),
e AS (SELECT *, sqrt((yy - b * dy - c * xy) / dof * xx / det) AS se, c / sqrt((yy - b * dy - c * xy) / dof * dd / det) AS tx, dx * dx / (dd * xx) AS rd FROM b),
p AS (SELECT *, b * b / (b * b + se * se * dof) AS r2yd, b * b / (se * se * dof) AS f2, tx * tx / (tx * tx + dof) AS ry FROM e),
k AS (SELECT *, kd * rd / (1 - rd) AS rz, kd * rd * rd / ((1 - kd * rd) * (1 - rd)) AS rj FROM p, (SELECT unnest([1.0, 2.0, 3.0])::DOUBLE AS kd)),
j AS (SELECT *, least(pow((sqrt(kd) + sqrt(rj)) / sqrt(1 - rj), 2) * ry / (1 - ry), 1) AS rq FROM k)
SELECT 'estimate' AS kind, CAST(NULL AS VARCHAR) AS benchmark, CAST(NULL AS DOUBLE) AS kd, {q('b', 4)} AS estimate, {q('se', 4)} AS std_error, {q('r2yd')} AS r2yd_x,
       {q('0.5 * (sqrt(f2 * f2 + 4 * f2) - f2)')} AS rv, CAST(NULL AS DOUBLE) AS r2dz_x, CAST(NULL AS DOUBLE) AS r2yz_dx FROM p
UNION ALL SELECT 'bound', 'l_discount', kd, {q('sign(b) * (abs(b) - se * sqrt(dof) * sqrt(rq * rz / (1 - rz)))', 4)}, {q('se * sqrt((1 - rq) / (1 - rz)) * sqrt(dof / (dof - 1))', 4)},
       {q('r2yd')}, {q('0.5 * (sqrt(f2 * f2 + 4 * f2) - f2)')}, {q('rz')}, {q('rq')} FROM j""")
def ovb_bounds(spark, sf):
    """Sensitivity of a slope to a confounder one, two and three times as strong as a covariate."""
    fit = linear.ols(lines(spark, sf), "l_extendedprice ~ l_quantity + l_discount")
    out = sens.ovb_sensitivity(fit, "l_quantity", ["l_discount"], [1, 2, 3])
    out = out.select("kind", "benchmark", "kd", "estimate", "std_error", "r2yd_x", "rv", "r2dz_x", "r2yz_dx")
    return rounded(rounded(out, "estimate", "std_error", digits=4), "r2yd_x", "rv", "r2dz_x", "r2yz_dx")


# A saturated triple difference is the log of a ratio of ratios; the panel's balance cancels.
_RATIO = """sum(ln(s) * CASE WHEN post THEN 1 ELSE -1 END * CASE WHEN same_sex THEN 1 ELSE -1 END * CASE WHEN mixed THEN 1 ELSE -1 END)"""
_FULL = "n ~ p_sm + p_s + p_m + sm + p + s + m"


def _saturated(df: DataFrame) -> DataFrame:
    p, s, m = (F.col(c).cast("double") for c in ("post", "same_sex", "mixed"))
    return df.withColumns({"p_sm": p * s * m, "p_s": p * s, "p_m": p * m, "sm": s * m, "p": p, "s": s, "m": m})


@query("q_combo_saturated", f"""WITH {LINES_SQL}, {_COMBO}, ids AS (SELECT DISTINCT combo FROM cb WHERE combo IS NOT NULL),
b AS (SELECT combo, year > 1997 AS post, same_sex, mixed, n FROM cb WHERE combo IS NOT NULL
      UNION ALL SELECT ids.combo, year > 1997, same_sex, mixed, n FROM cb, ids WHERE cb.combo IS NULL),
c AS (SELECT combo, post, same_sex, mixed, sum(n) AS s FROM b GROUP BY ALL)
SELECT combo, 'p_sm' AS term, {q(_RATIO)} AS estimate FROM c GROUP BY combo""")
def combo_saturated(spark, sf):
    out = sw.sweep(_saturated(combos(spark, sf)), ["combo"], _FULL, "n", [], "state", ["p_sm"])
    return rounded(out.select("combo", "term", "estimate"), "estimate")


_SAMPLES = {"all": "TRUE", "high": "state >= 12", "low": "state < 12"}


@query("q_misreport_saturated", f"""WITH {LINES_SQL}, {_PANEL},
w AS (SELECT state, year, mixed, post, coalesce(sum(CASE WHEN same_sex THEN n END), 0) AS t, coalesce(sum(CASE WHEN NOT same_sex THEN n END), 0) AS f FROM pn GROUP BY ALL),
v AS (SELECT *, i / 10.0::DOUBLE AS rate FROM w, (SELECT unnest(range(7)) AS i)),
x AS (SELECT state, rate, post, mixed, TRUE AS same_sex, round_even((1 - rate) * t, 0) AS n FROM v
      UNION ALL SELECT state, rate, post, mixed, FALSE, round_even(rate * t + f, 0) FROM v),
y AS ({' UNION ALL '.join(f"SELECT '{k}' AS sample, * FROM x WHERE {c}" for k, c in _SAMPLES.items())}),
c AS (SELECT sample, rate, post, same_sex, mixed, sum(n) AS s FROM y GROUP BY ALL)
SELECT sample, rate, 'p_sm' AS term, {q(_RATIO)} AS estimate FROM c GROUP BY sample, rate""")
def misreport_saturated(spark, sf):
    """Counts moved at seven rates in three samples, a saturated fit each."""
    p, parts = panel(spark, sf), []
    for name, cond in _SAMPLES.items():
        moved = sens.misreport(p.where(cond), "same_sex", "n", [i / 10 for i in range(7)], ["state", "year", "mixed", "post"])
        parts.append(moved.withColumn("sample", F.lit(name)))
    out = sw.sweep(_saturated(reshape.bind_rows(*parts)), ["sample", "rate"], _FULL, "n", [], "state", ["p_sm"])
    return rounded(out.select("sample", "rate", "term", "estimate"), "estimate")


@query("q_origin_ranking_ci", f"""WITH {MEMBERS_SQL}, {_IND}, u AS (SELECT * FROM ind WHERE NOT allocated AND yrimmig >= 1991),
m AS (SELECT bpld, sum(CASE WHEN same_sex THEN perwt ELSE 0 END) / sum(perwt) AS p, sum(perwt) AS w FROM u GROUP BY bpld),
z AS (SELECT u.bpld, u.cluster, sum(u.perwt * (CASE WHEN u.same_sex THEN 1 ELSE 0 END - m.p)) / any_value(m.w) AS z FROM u JOIN m ON u.bpld IS NOT DISTINCT FROM m.bpld GROUP BY ALL),
e AS (SELECT bpld, sqrt((SELECT count(DISTINCT cluster) / (count(DISTINCT cluster) - 1.0) FROM u) * sum(z * z)) AS se FROM z GROUP BY bpld)
SELECT m.bpld, {q('100 * p', 4)} AS middle, {q('100 * se', 4)} AS se FROM m JOIN e ON m.bpld IS NOT DISTINCT FROM e.bpld""")
def origin_ranking_ci(spark, sf):
    """The ranking's interval: its middle, and its half in t quantiles of the design's degrees of freedom."""
    rows = stage(_ranked(spark, sf, "bpld"))
    tab = rankings.survey_ranking(rows, "bpld", "same_sex", "perwt", "cluster", "origin_score")
    crit = t_quantile(0.975, rows.select("cluster").distinct().count() - 1)
    low, upp = F.col("coef_low"), F.col("coef_upp")
    return rounded(tab.select("bpld", ((low + upp) / 2).alias("middle"), ((upp - low) / (2 * crit)).alias("se")), "middle", "se", digits=4)
