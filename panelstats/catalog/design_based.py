"""Survey estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.survey import SurveyDesign, clip_interval
from .base import LINES_SQL, lines, q, query, rounded


def design(spark, sf, clustered=True):
    return SurveyDesign(lines(spark, sf), "l_quantity", "l_orderkey" if clustered else None)


def _mean_sql(x: str, by: str, psu: str | None, src: str = "li") -> str:
    """Mean and linearised error: residual sums per PSU, squared."""
    unit = psu or "rid"
    return f"""
b{x} AS (SELECT {by}, sum(l_quantity * {x}) / sum(l_quantity) AS m, sum(l_quantity) AS w FROM {src} WHERE {x} IS NOT NULL GROUP BY {by}),
z{x} AS (SELECT {', '.join('s.' + b.strip() for b in by.split(','))}, sum(l_quantity * ({x} - m)) / any_value(w) AS z
         FROM {src} s JOIN b{x} USING ({by}) WHERE {x} IS NOT NULL GROUP BY {', '.join('s.' + b.strip() for b in by.split(','))}, {unit}),
e{x} AS (SELECT {by}, m, sqrt((SELECT g / (g - 1.0) FROM total) * ss) AS se FROM b{x} JOIN (SELECT {by}, sum(z * z) AS ss FROM z{x} GROUP BY {by}) USING ({by}))"""


_NUMBERED = LINES_SQL + """,
num AS (SELECT *, row_number() OVER () AS rid FROM li)"""
_G = "total AS (SELECT count(DISTINCT l_orderkey) AS g FROM li)"
_GN = "total AS (SELECT count(*) AS g FROM li)"


@query("q_survey_mean", f"""WITH {LINES_SQL}, {_G}, {_mean_sql('l_extendedprice', 'year, same_sex', 'l_orderkey')}
SELECT year, same_sex, {q('m', 3)} AS l_extendedprice, {q('se', 3)} AS l_extendedprice_se FROM el_extendedprice""")
def survey_mean(spark, sf):
    out = design(spark, sf).mean("l_extendedprice", ["year", "same_sex"])
    return rounded(out, "l_extendedprice", "l_extendedprice_se", digits=3)


@query("q_survey_mean_ci", f"""WITH {LINES_SQL}, {_G}, {_mean_sql('l_extendedprice', 'year, same_sex', 'l_orderkey')}
SELECT year, same_sex, {q('m', 3)} AS middle, {q('se', 3)} AS l_extendedprice_se, CAST(3.92 AS DOUBLE) AS width FROM el_extendedprice""")
def survey_mean_ci(spark, sf):
    """The interval's middle, and its width in standard errors: twice the t quantile, which is 1.96 to two digits for this many orders."""
    out = design(spark, sf).mean("l_extendedprice", ["year", "same_sex"], vartype=("se", "ci"))
    low, upp, se = (F.col(f"l_extendedprice_{x}") for x in ("low", "upp", "se"))
    out = out.select("year", "same_sex", ((low + upp) / 2).alias("middle"), se.alias("l_extendedprice_se"), F.round((upp - low) / se, 2).alias("width"))
    return rounded(out, "middle", "l_extendedprice_se", digits=3)


@query("q_survey_mean_weights", f"""WITH {_NUMBERED}, {_GN}, {_mean_sql('l_discount', 'state', None, 'num')}
SELECT state, {q('m')} AS l_discount, {q('se')} AS l_discount_se FROM el_discount""")
def survey_mean_weights(spark, sf):
    return rounded(design(spark, sf, False).mean("l_discount", ["state"]), "l_discount", "l_discount_se")


@query("q_survey_many", f"""WITH {LINES_SQL}, {_G},
n AS (SELECT *, CASE WHEN l_partkey % 9 <> 0 THEN l_tax END AS tax FROM li),
{_mean_sql('l_discount', 'year', 'l_orderkey', 'n')}, {_mean_sql('tax', 'year', 'l_orderkey', 'n')}
SELECT year, 'l_discount' AS variable, {q('m')} AS mean, {q('se')} AS mean_se FROM el_discount
UNION ALL SELECT year, 'tax', {q('m')}, {q('se')} FROM etax""")
def survey_many(spark, sf):
    d = design(spark, sf).mutate(tax=F.when(F.col("l_partkey") % 9 != 0, F.col("l_tax")))
    return rounded(d.mean_long(["l_discount", "tax"], ["year"]), "mean", "mean_se")


@query("q_survey_total", f"""WITH {LINES_SQL}, {_G},
t AS (SELECT year, same_sex, l_orderkey, sum(l_quantity) AS t FROM li GROUP BY ALL),
s AS (SELECT year, same_sex, sum(t) AS t, sum(t * t) AS tt FROM t GROUP BY ALL)
SELECT year, same_sex, {q('t', 2)} AS n, {q('sqrt((SELECT g / (g - 1.0) FROM total) * (tt - t * t / (SELECT g FROM total)))', 3)} AS n_se FROM s""")
def survey_total(spark, sf):
    out = design(spark, sf).total(["year", "same_sex"], vartype=("se",))
    return rounded(rounded(out, "n_se", digits=3), "n", digits=2)


# t quantile by its expansion in 1/df, exact to rounding at these df
_T = """tq AS (SELECT z + (pow(z, 3) + z) / (4 * v) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * v * v)
  + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * pow(v, 3)) AS t FROM (SELECT 1.959963984540054::DOUBLE AS z, g - 1.0 AS v FROM total))"""


@query("q_survey_total_ci", f"""WITH {LINES_SQL}, {_G}, {_T},
p AS (SELECT year, same_sex, l_orderkey, sum(l_quantity) AS t FROM li GROUP BY ALL),
s AS (SELECT year, same_sex, sum(t) AS n, sqrt((SELECT g / (g - 1.0) FROM total) * (sum(t * t) - pow(sum(t), 2) / (SELECT g FROM total))) AS se FROM p GROUP BY ALL)
SELECT year, same_sex, {q('n', 2)} AS n, {q('n - (SELECT t FROM tq) * se', 3)} AS n_low, {q('n + (SELECT t FROM tq) * se', 3)} AS n_upp FROM s""")
def survey_total_ci(spark, sf):
    out = design(spark, sf).total(["year", "same_sex"], vartype=("ci",))
    return rounded(rounded(out, "n_low", "n_upp", digits=3), "n", digits=2)


@query("q_survey_prop", f"""WITH {LINES_SQL}, {_G},
b AS (SELECT state, sum(l_quantity) AS w FROM li GROUP BY ALL),
p AS (SELECT state, l_returnflag, sum(l_quantity) / any_value(w) AS p, any_value(w) AS w, count(*) AS n FROM li JOIN b USING (state) GROUP BY ALL),
z AS (SELECT li.state, p.l_returnflag, sum(l_quantity * (CASE WHEN li.l_returnflag = p.l_returnflag THEN 1 ELSE 0 END - p)) / any_value(w) AS z
      FROM li JOIN p ON li.state = p.state GROUP BY li.state, p.l_returnflag, l_orderkey),
e AS (SELECT state, l_returnflag, sqrt((SELECT g / (g - 1.0) FROM total) * sum(z * z)) AS se FROM z GROUP BY ALL)
SELECT state, l_returnflag, n, {q('p')} AS coef, {q('se')} AS coef_se FROM p JOIN e USING (state, l_returnflag)""")
def survey_prop(spark, sf):
    return rounded(design(spark, sf).prop("l_returnflag", ["state"], ("se",), unweighted="n"), "coef", "coef_se")


@query("q_survey_prop_ci", f"""WITH {LINES_SQL}, {_G}, {_T}, n AS (SELECT *, CASE WHEN l_partkey % 97 = 0 THEN 1.0 ELSE 0.0 END AS rare FROM li),
{_mean_sql('rare', 'l_suppkey', 'l_orderkey', 'n')}
SELECT l_suppkey, {q('m')} AS coef, {q('greatest(m - (SELECT t FROM tq) * se, 0)')} AS coef_low, {q('m + (SELECT t FROM tq) * se')} AS coef_upp FROM erare WHERE m > 0""")
def survey_prop_ci(spark, sf):
    """Interval clipped at 0, for a rare level."""
    d = design(spark, sf).mutate(rare=(F.col("l_partkey") % 97 == 0))
    out = clip_interval(d.prop("rare", ["l_suppkey"], ("ci",)).where("rare"), "coef_low").drop("rare")
    return rounded(out, "coef", "coef_low", "coef_upp")


@query("q_survey_dev", f"""WITH {LINES_SQL}, {_G},
gm AS (SELECT state, year, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS gm FROM li GROUP BY ALL),
d AS (SELECT li.*, l_extendedprice - gm AS dev FROM li JOIN gm USING (state, year)),
{_mean_sql('dev', 'year, same_sex', 'l_orderkey', 'd')}
SELECT year, same_sex, {q('m', 3)} AS l_extendedprice_dev, {q('se', 3)} AS l_extendedprice_dev_se FROM edev""")
def survey_dev(spark, sf):
    out = design(spark, sf).deviation("l_extendedprice", ["state", "year"], ["year", "same_sex"])
    return rounded(out, "l_extendedprice_dev", "l_extendedprice_dev_se", digits=3)


@query("q_survey_domain", f"""WITH {LINES_SQL}, {_G}, n AS (SELECT * FROM li WHERE state < 5),
{_mean_sql('l_tax', 'state', 'l_orderkey', 'n')}
SELECT state, {q('m')} AS l_tax, {q('se')} AS l_tax_se FROM el_tax""")
def survey_domain(spark, sf):
    """PSUs outside the domain still count."""
    return rounded(design(spark, sf).domain(F.col("state") < 5).mean("l_tax", ["state"]), "l_tax", "l_tax_se")
