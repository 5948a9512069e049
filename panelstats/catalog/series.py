"""Windows over panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel, reshape
from .base import LINES_SQL, lines, q, query, r, rounded, table

_DAILY = """daily AS (SELECT event_type, CAST(dayofyear(ts) AS INTEGER) AS day, sum(value) AS v, count(*) AS n FROM events GROUP BY ALL)"""


def daily(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type", F.dayofyear("ts").alias("day")).agg(F.sum("value").alias("v"), F.count("*").alias("n"))


@query("q_lead_k", f"""WITH {_DAILY}
SELECT event_type, day, {', '.join(q(f'lead(v, {k}) OVER (PARTITION BY event_type ORDER BY day)', 4) + f' AS v{k}' for k in (1, 2, 5))} FROM daily""")
def lead_k(spark, sf):
    d = daily(spark, sf)
    for k in (1, 2, 5):
        d = panel.shift(d, ["event_type"], "day", "v", k, f"v{k}")
    return rounded(d, "v1", "v2", "v5", digits=4).drop("v", "n")


@query("q_lag_default", f"""WITH {_DAILY}
SELECT event_type, day, {q('lag(v, 1, 1e10) OVER (PARTITION BY event_type ORDER BY day)', 4)} AS upper FROM daily""")
def lag_default(spark, sf):
    d = panel.shift(daily(spark, sf), ["event_type"], "day", "v", -1, "upper", 1e10)
    return rounded(d, "upper", digits=4).drop("v", "n")


@query("q_cumsum", f"""WITH {_DAILY}
SELECT event_type, day, {q('sum(v) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING)', 4)} AS cum FROM daily""")
def cumsum(spark, sf):
    return rounded(panel.cumsum(daily(spark, sf), ["event_type"], ["day"], "v"), "cum", digits=4).drop("v", "n")


_GAPS = """
g AS (SELECT k, year, CASE WHEN (k + year) % 3 <> 0 AND NOT (k % 7 = 0 AND year <> 1998) THEN v END AS v FROM (
  SELECT o_custkey % 60 AS k, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS v FROM orders GROUP BY ALL))"""


def gaps(spark, sf):
    o = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 60).alias("k"), F.year("o_orderdate").alias("year")).agg(
        F.sum("o_totalprice").alias("v"))
    keep = ((F.col("k") + F.col("year")) % 3 != 0) & ~((F.col("k") % 7 == 0) & (F.col("year") != 1998))
    return o.withColumn("v", F.when(keep, F.col("v")))


@query("q_interpolate", f"""WITH {_GAPS},
w AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN year END) OVER (PARTITION BY k ORDER BY year ROWS UNBOUNDED PRECEDING) AS y0,
             min(CASE WHEN v IS NOT NULL THEN year END) OVER (PARTITION BY k ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y1,
             count(v) OVER (PARTITION BY k) AS known FROM g)
SELECT w.k, w.year, {q('''CASE WHEN known < 2 OR w.v IS NOT NULL THEN w.v WHEN y0 IS NULL THEN b.v WHEN y1 IS NULL THEN a.v
  ELSE a.v + (b.v - a.v) / (y1 - y0) * (w.year - y0) END''', 4)} AS filled
FROM w LEFT JOIN g a ON a.k = w.k AND a.year = y0 LEFT JOIN g b ON b.k = w.k AND b.year = y1""")
def interpolate(spark, sf):
    return rounded(panel.interpolate(gaps(spark, sf), ["k"], "year", "v", "filled"), "filled", digits=4).drop("v")


@query("q_locf", f"""WITH {_GAPS}
SELECT k, year, {q('last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY year ROWS UNBOUNDED PRECEDING)', 4)} AS filled FROM g""")
def locf(spark, sf):
    return rounded(panel.locf(gaps(spark, sf), ["k"], "year", "v", "filled"), "filled", digits=4).drop("v")


@query("q_zscore", f"""
SELECT c_custkey, {q('(c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer)')} AS c_acctbal_std,
       c_acctbal > (SELECT avg(c_acctbal) FROM customer) AS high,
       CASE WHEN c_acctbal = (SELECT min(c_acctbal) FROM customer) THEN 'Min.' ELSE 'Max.' END AS ends FROM customer""")
def zscore(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    c = panel.at_extreme(panel.above_mean(panel.zscore(c, ["c_acctbal"]), "c_acctbal", "high"), "c_acctbal", "Min.", "Max.", "ends")
    return rounded(c, "c_acctbal_std").drop("c_acctbal")


@query("q_zscore_group", f"""
SELECT c_custkey, {q('(c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w')} AS c_acctbal_std FROM customer
WINDOW w AS (PARTITION BY c_mktsegment)""")
def zscore_group(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return rounded(panel.zscore(c, ["c_acctbal"], ["c_mktsegment"]), "c_acctbal_std").select("c_custkey", "c_acctbal_std")


@query("q_rebin", f"""WITH {LINES_SQL}, y AS (SELECT state, year, sum(l_quantity) AS n, avg(l_discount) AS score FROM li GROUP BY ALL)
SELECT state, CAST(floor(year / 2) * 2 AS INTEGER) AS year, {q('sum(n)', 2)} AS n, {q('avg(score)')} AS score FROM y GROUP BY ALL""")
def rebin(spark, sf):
    y = lines(spark, sf).groupBy("state", "year").agg(F.sum("l_quantity").alias("n"), F.avg("l_discount").alias("score"))
    return rounded(rounded(panel.rebin(y, ["state"], "year", 2, ["n"], ["score"]), "score"), "n", digits=2)


@query("q_row_id", """
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS id FROM orders""")
def row_id(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return panel.row_id(o, [F.col("o_totalprice").desc(), "o_orderkey"]).select("o_orderkey", F.col("id").cast("long").alias("id"))
