"""Joins, crosswalks and comparisons with a reference entity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import first_match
from ..operators import joins, topk
from .base import LINES_SQL, lines, q, query, r, rounded, table


@query("q_nullsafe_join", """
WITH a AS (SELECT c_custkey, CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey END AS k FROM customer),
     b AS (SELECT CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey END AS k, max(n_name) AS n_name FROM nation GROUP BY 1)
SELECT n_name, count(*) AS n FROM a LEFT JOIN b ON a.k IS NOT DISTINCT FROM b.k GROUP BY ALL""")
def nullsafe_join(spark, sf):
    a = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey")).alias("k"))
    b = table(spark, sf, "nation").groupBy(F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey")).alias("k")).agg(
        F.max("n_name").alias("n_name"))
    return joins.rjoin(a, b).groupBy("n_name").agg(F.count("*").alias("n"))


@query("q_lag_join", f"""
WITH y AS (SELECT o_custkey % 25 AS state, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT a.state, a.year, {q('a.v', 2)} AS v, {q('b.v', 2)} AS v_lag FROM y a LEFT JOIN y b ON a.state = b.state AND a.year = b.year + 1""")
def lag_join(spark, sf):
    o = table(spark, sf, "orders")
    y = o.groupBy((F.col("o_custkey") % 25).alias("state"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    return rounded(joins.lag_join(y, y, ["state"], "year", 1), "v", "v_lag", digits=2)


@query("q_event_time_join", f"""
WITH pol AS (SELECT l_suppkey AS k, CAST(year(l_shipdate) AS INTEGER) AS year, avg(l_discount) AS score FROM lineitem GROUP BY ALL)
SELECT o.year AS order_year, count(*) AS n, count(score) AS matched, {q('avg(score)')} AS mean_score FROM (
  SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS entry, CAST(year(o_orderdate) AS INTEGER) AS year
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) o
LEFT JOIN pol ON pol.k = o.l_suppkey AND pol.year = o.entry GROUP BY ALL""")
def event_time_join(spark, sf):
    """Score of the shipping year, not of the order year."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    pol = li.groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("year")).agg(F.avg("l_discount").alias("score"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_suppkey", F.year("l_shipdate").alias("entry"), F.year("o_orderdate").alias("order_year"))
    out = joins.event_join(rows, pol, {"l_suppkey": "k"}, "entry", "year")
    return out.groupBy("order_year").agg(F.count("*").alias("n"), F.count("score").alias("matched"),
                                         r(F.avg("score")).alias("mean_score"))


_CROSSWALK = """
fine AS (SELECT p_partkey AS zip, p_partkey % 40 AS tract, 0.6 AS ratio FROM part
         UNION ALL SELECT p_partkey, p_partkey % 37 + 3, 0.4 FROM part),
coarse AS (SELECT DISTINCT tract, tract % 7 AS puma FROM fine)"""


@query("q_crosswalk", f"""
WITH {_CROSSWALK},
src AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_partkey AS zip, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
cw AS (SELECT zip, puma, sum(ratio) AS ratio FROM fine JOIN coarse USING (tract) GROUP BY ALL)
SELECT year, puma, {q('sum(v * ratio)', 4)} AS v FROM src JOIN cw USING (zip) GROUP BY ALL""")
def crosswalk(spark, sf):
    p = table(spark, sf, "part")
    fine = p.select(F.col("p_partkey").alias("zip"), F.inline(F.array(
        F.struct((F.col("p_partkey") % 40).alias("tract"), F.lit(0.6).alias("ratio")),
        F.struct((F.col("p_partkey") % 37 + 3).alias("tract"), F.lit(0.4).alias("ratio")))))
    coarse = fine.select("tract", (F.col("tract") % 7).alias("puma")).distinct()
    cw = joins.chain_crosswalk(fine, coarse, ["tract"], ["zip"], ["puma"], "ratio")
    li = table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("year"), F.col("l_partkey").alias("zip"), F.col("l_quantity").alias("v"))
    return rounded(joins.allocate(li, cw, ["zip"], ["puma"], "ratio", ["v"], keep=["year"]), "v", digits=4)


@query("q_code_lookup", """
SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def code_lookup(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation").select("n_nationkey", "n_name")
    return joins.rjoin(s, n, {"s_nationkey": "n_nationkey"}).groupBy("n_name").agg(F.count("*").alias("n"))


@query("q_lookup_fallback", """
WITH d AS (SELECT c_custkey, CASE WHEN c_nationkey % 3 <> 0 THEN c_nationkey END AS code, 'NATION_' || (c_nationkey % 20) AS name,
                  c_nationkey FROM customer)
SELECT coalesce(a.n_regionkey, b.n_regionkey) AS found, count(*) AS n FROM d
LEFT JOIN nation a ON d.code = a.n_nationkey LEFT JOIN nation b ON d.name = b.n_name GROUP BY ALL""")
def lookup_fallback(spark, sf):
    n = table(spark, sf, "nation")
    d = table(spark, sf, "customer").select(
        F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey")).alias("code"),
        F.concat(F.lit("NATION_"), (F.col("c_nationkey") % 20).cast("string")).alias("name"))
    out = joins.lookup_first(d, [("code", n.select("n_nationkey", "n_regionkey")), ("name", n.select("n_name", "n_regionkey"))], "found")
    return out.groupBy("found").agg(F.count("*").alias("n"))


_BY_NATION = f"""
WITH {LINES_SQL},
v AS (SELECT state, year, sum(l_extendedprice) AS v FROM li GROUP BY ALL)"""


@query("q_baseline_diff", f"""{_BY_NATION}
SELECT v.state, v.year, {q('v.v - b.v', 2)} AS dif FROM v LEFT JOIN (SELECT year, v FROM v WHERE state = 3) b USING (year)""")
def baseline_diff(spark, sf):
    v = lines(spark, sf).groupBy("state", "year").agg(F.sum("l_extendedprice").alias("v"))
    return rounded(joins.baseline_diff(v, "year", "state", 3, "v", "dif"), "dif", digits=2).select("state", "year", "dif")


@query("q_share_reference_row", f"""{_BY_NATION},
t AS (SELECT CAST(state AS VARCHAR) AS name, year, v FROM v UNION ALL SELECT 'Total', year, sum(v) FROM v GROUP BY year)
SELECT t.name, t.year, {q('t.v / b.v')} AS prop FROM t JOIN (SELECT year, v FROM t WHERE name = 'Total') b USING (year)""")
def share_reference_row(spark, sf):
    v = lines(spark, sf).groupBy(F.col("state").cast("string").alias("name"), "year").agg(F.sum("l_extendedprice").alias("v"))
    total = v.groupBy("year").agg(F.sum("v").alias("v")).withColumn("name", F.lit("Total"))
    out = joins.share_of_row(v.unionByName(total), "year", "name", "Total", "v")
    return rounded(out, "prop").select("name", "year", "prop")


@query("q_group_stat_back", f"""
WITH {LINES_SQL},
m AS (SELECT state, year, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS gm FROM li GROUP BY ALL)
SELECT same_sex, count(*) AS n, {q('avg(l_extendedprice - gm)', 4)} AS mean_dev FROM li JOIN m USING (state, year) GROUP BY ALL""")
def group_stat_back(spark, sf):
    from ..functions import wmean
    out = joins.group_stat(lines(spark, sf), ["state", "year"], gm=wmean("l_extendedprice", "l_quantity"))
    return out.groupBy("same_sex").agg(F.count("*").alias("n"), r(F.avg(F.col("l_extendedprice") - F.col("gm")), 4).alias("mean_dev"))


@query("q_anti", """
SELECT p_type, count(*) AS n FROM part
WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0.1 AND l_returnflag = 'R') GROUP BY ALL""")
def anti(spark, sf):
    used = table(spark, sf, "lineitem").where("l_discount = 0.1 and l_returnflag = 'R'").select("l_partkey")
    return joins.anti_in(table(spark, sf, "part"), used, {"p_partkey": "l_partkey"}).groupBy("p_type").agg(F.count("*").alias("n"))


@query("q_topn_semi", f"""
WITH top AS (SELECT c_nationkey FROM customer GROUP BY 1 ORDER BY sum(c_acctbal) DESC, c_nationkey LIMIT 10)
SELECT c_nationkey, c_mktsegment, count(*) AS n, {q('sum(c_acctbal)', 2)} AS balance FROM customer
WHERE c_nationkey IN (SELECT * FROM top) GROUP BY ALL""")
def topn_semi(spark, sf):
    c = table(spark, sf, "customer")
    ranked = c.groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("b"))
    kept = topk.keep_first_members(c, "c_nationkey", ranked, ["-b", "c_nationkey"], 10)
    return kept.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), r(F.sum("c_acctbal"), 2).alias("balance"))


@query("q_full_outer", """
WITH a AS (SELECT l_suppkey + 3 AS k, CAST(count(*) AS BIGINT) AS n_a FROM lineitem GROUP BY 1),
     b AS (SELECT s_suppkey AS k, CAST(1 AS BIGINT) AS n_b FROM supplier)
SELECT coalesce(a.k, b.k) AS k, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL JOIN b ON a.k = b.k""")
def full_outer(spark, sf):
    a = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") + 3).alias("k")).agg(F.count("*").alias("n_a"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.lit(1).cast("long").alias("n_b"))
    return joins.outer_fill(a, b, "k")


@query("q_left_plus_unmatched", """
WITH a AS (SELECT n_nationkey AS code, n_name, n_regionkey FROM nation),
     b AS (SELECT c_nationkey + 5 AS code, count(*) AS n FROM customer GROUP BY 1)
SELECT coalesce(a.code, b.code) AS code, n_name, n_regionkey, n FROM a FULL JOIN b ON a.code = b.code""")
def left_plus_unmatched(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), "n_name", "n_regionkey")
    b = table(spark, sf, "customer").groupBy((F.col("c_nationkey") + 5).alias("code")).agg(F.count("*").alias("n"))
    return joins.left_plus_unmatched(a, b, "code")


@query("q_deflate", f"""
WITH idx AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, avg(l_extendedprice) AS level FROM lineitem GROUP BY 1),
o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT o.year, {q('v * (SELECT level FROM idx WHERE year = 1999) / level / 1000', 4)} AS v FROM o LEFT JOIN idx USING (year)""")
def deflate(spark, sf):
    idx = table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("iy")).agg(F.avg("l_extendedprice").alias("level"))
    o = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    return rounded(joins.deflate(o, idx, "year", ["v"], 1999, 1 / 1000), "v", digits=4)


@query("q_series_codes", f"""
SELECT code, count(*) AS n, {q('avg(value)')} AS value FROM (
  SELECT CAST(regexp_extract(concat('LAS', lpad(CAST(user_id % 60 AS VARCHAR), 2, '0'), '00003'), '[0-9][0-9]') AS INTEGER) AS code, value
  FROM events) GROUP BY ALL""")
def series_codes(spark, sf):
    e = table(spark, sf, "events").select(
        F.concat(F.lit("LAS"), F.lpad((F.col("user_id") % 60).cast("string"), 2, "0"), F.lit("00003")).alias("series"), "value")
    e = e.where(F.col("series").contains("00003")).withColumn("code", first_match("series", r"\d\d").cast("int"))
    return e.groupBy("code").agg(F.count("*").alias("n"), r(F.avg("value")).alias("value"))
