"""Reshaping and aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import centers, cochran_var, log_se, mean_ci, paste, percent_label, ratio_pct, wmean, wpct
from ..operators import agg, panel, reshape, topk
from ..session import stage
from .base import LINES_SQL, lines, q, query, r, rounded, table

_PAIR_VALUES = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"]
_DEDUPED = """
d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus) AS rn
      FROM lineitem WHERE l_linenumber IN (1, 2)),
pairs AS (SELECT a.l_orderkey, a.l_quantity AS l_quantity_main, b.l_quantity AS l_quantity_partner,
        a.l_suppkey AS l_suppkey_main, b.l_suppkey AS l_suppkey_partner,
        a.l_returnflag AS l_returnflag_main, b.l_returnflag AS l_returnflag_partner,
        a.l_linestatus AS l_linestatus_main, b.l_linestatus AS l_linestatus_partner
      FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2
        AND a.rn = 1 AND b.rn = 1)"""


def pairs(spark, sf):
    """Lines 1 and 2 of an order as the two members of a household, copies resolved by value order."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_PAIR_VALUES)
    wide = reshape.pair_wide(li, ["l_orderkey"], "l_linenumber", [1, 2], _PAIR_VALUES, ["main", "partner"],
                             first_by=_PAIR_VALUES[:4])
    keep = ["l_quantity", "l_suppkey", "l_returnflag", "l_linestatus"]
    return wide.select("l_orderkey", *[f"{c}_{m}" for c in keep for m in ("main", "partner")])


@query("q_pair_wide", f"WITH {_DEDUPED} SELECT * FROM pairs")
def pair_wide(spark, sf):
    return pairs(spark, sf)


@query("q_pair_flags", f"""WITH {_DEDUPED}
SELECT l_orderkey, l_returnflag_main = l_returnflag_partner AS same_sex,
       (l_linestatus_main = 'F') <> (l_linestatus_partner = 'F') AS mixed,
       l_linestatus_main = 'F' OR l_linestatus_partner = 'F' AS either,
       coalesce(CASE WHEN l_quantity_main > 25 THEN l_suppkey_main END, CASE WHEN l_quantity_partner > 25 THEN l_suppkey_partner END) AS origin,
       concat(coalesce(CASE WHEN l_quantity_main > 25 THEN CAST(l_suppkey_main AS VARCHAR) END, 'NA'), '_', l_returnflag_main) AS unit
FROM pairs""")
def pair_flags(spark, sf):
    p = pairs(spark, sf)
    known = lambda s: F.when(F.col(f"l_quantity_{s}") > 25, F.col(f"l_suppkey_{s}"))
    f = lambda s: F.col(f"l_linestatus_{s}") == "F"
    return p.select(
        "l_orderkey", (F.col("l_returnflag_main") == F.col("l_returnflag_partner")).alias("same_sex"),
        ((f("main") & ~f("partner")) | (~f("main") & f("partner"))).alias("mixed"),
        (f("main") | f("partner")).alias("either"), F.coalesce(known("main"), known("partner")).alias("origin"),
        paste(known("main"), "l_returnflag_main").alias("unit"))


@query("q_pair_long", f"""WITH {_DEDUPED},
r AS (SELECT l_orderkey, 'main' AS position, l_quantity_main AS l_quantity, l_suppkey_main AS l_suppkey FROM pairs
      UNION ALL SELECT l_orderkey, 'partner', l_quantity_partner, l_suppkey_partner FROM pairs)
SELECT l_suppkey, position, count(*) AS n, {q('sum(l_quantity)', 2)} AS w FROM r GROUP BY ALL""")
def pair_long(spark, sf):
    rows = reshape.pair_long(pairs(spark, sf), ["main", "partner"])
    return rows.groupBy("l_suppkey", "position").agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("w"))


@query("q_stack_members", f"""WITH {_DEDUPED},
s AS (SELECT l_suppkey_main AS l_suppkey, l_quantity_main AS w FROM pairs WHERE l_quantity_main > 10
      UNION ALL SELECT l_suppkey_partner, l_quantity_partner FROM pairs WHERE l_quantity_partner > 10
      UNION ALL SELECT l_suppkey_main, l_quantity_main FROM pairs WHERE l_returnflag_main = l_returnflag_partner)
SELECT l_suppkey, count(*) AS n, {q('sum(w)', 2)} AS w FROM s GROUP BY ALL""")
def stack_members(spark, sf):
    p = pairs(spark, sf)
    rows = reshape.stack_members(p, [
        ("main", ["partner"], F.col("l_quantity_main") > 10), ("partner", ["main"], F.col("l_quantity_partner") > 10),
        ("main", ["partner"], F.col("l_returnflag_main") == F.col("l_returnflag_partner"))])
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("w"))


@query("q_role_pivot", """
SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN 1 END) AS BIGINT) AS n_user,
       CAST(sum(CASE WHEN role = 'assistant' THEN 1 END) AS BIGINT) AS n_assistant,
       CAST(sum(CASE WHEN role = 'user' THEN length(text) END) AS BIGINT) AS chars_user,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) END) AS BIGINT) AS chars_assistant
FROM conversations GROUP BY conv_id""")
def role_pivot(spark, sf):
    c = table(spark, sf, "conversations").select(
        "conv_id", "role", F.lit(1).cast("long").alias("n"), F.length("text").cast("long").alias("chars"))
    return reshape.pivot_measures(c, ["conv_id"], "role", ["user", "assistant"], ["n", "chars"])


@query("q_pivot_measures", f"""WITH {LINES_SQL}
SELECT state, year, {q("coalesce(sum(CASE WHEN same_sex THEN l_quantity END), 0)", 2)} AS n_same,
       {q("coalesce(sum(CASE WHEN NOT same_sex THEN l_quantity END), 0)", 2)} AS n_dif FROM li GROUP BY ALL""")
def pivot_measures(spark, sf):
    li = lines(spark, sf).withColumnRenamed("l_quantity", "n")
    out = reshape.pivot_measures(li, ["state", "year"], "same_sex", {True: "same", False: "dif"}, ["n"], 0)
    return rounded(out, "n_same", "n_dif", digits=2)


_YEARS = list(range(1995, 2002))


@query("q_year_columns", f"""WITH {LINES_SQL}
SELECT y.state, g.year, {q('sum(CASE WHEN li.year = g.year THEN l_quantity END)', 2)} AS n
FROM (SELECT DISTINCT state FROM li) y CROSS JOIN (SELECT unnest(range(1995, 2002))::INTEGER AS year) g
JOIN li ON li.state = y.state GROUP BY ALL""")
def year_columns(spark, sf):
    """Years to columns and back to rows."""
    li = lines(spark, sf)
    wide = li.groupBy("state").agg(*[F.sum(F.when(F.col("year") == y, F.col("l_quantity"))).alias(f"{y} [{y}]") for y in _YEARS])
    return rounded(reshape.years_to_rows(wide, ["state"], "n"), "n", digits=2)


@query("q_gather_spread", f"""
SELECT p_type, {q('avg(p_size)')} AS est_size, {q('stddev_samp(p_size)')} AS se_size,
       {q('avg(p_retailprice)')} AS est_price, {q('stddev_samp(p_retailprice)')} AS se_price FROM part GROUP BY ALL""")
def gather_spread(spark, sf):
    """Columns named type.coef to rows, split, and spread over the types again."""
    p = table(spark, sf, "part").groupBy("p_type").agg(
        F.avg("p_size").alias("est.size"), F.stddev_samp("p_size").alias("se.size"),
        F.avg("p_retailprice").alias("est.price"), F.stddev_samp("p_retailprice").alias("se.price"))
    cols = [c for c in p.columns if c != "p_type"]
    p = p.withColumnsRenamed({c: c.replace(".", "__") for c in cols})
    long = reshape.gather(p, ["p_type"], [c.replace(".", "__") for c in cols], "coef", "value")
    long = reshape.separate(long, "coef", ["type", "coef"], "__")
    both = reshape.spread(long, ["p_type", "coef"], "type", ["est", "se"], "value")
    out = reshape.pivot_measures(both, ["p_type"], "coef", ["size", "price"], ["est", "se"])
    return rounded(out, *[c for c in out.columns if c != "p_type"])


@query("q_transpose", f"""
SELECT variable, {q("max(CASE WHEN r = 'A' THEN v END)", 4)} AS "A", {q("max(CASE WHEN r = 'N' THEN v END)", 4)} AS "N",
       {q("max(CASE WHEN r = 'R' THEN v END)", 4)} AS "R" FROM (
  SELECT l_returnflag AS r, 'quantity' AS variable, avg(l_quantity) AS v FROM lineitem GROUP BY ALL
  UNION ALL SELECT l_returnflag, 'price', avg(l_extendedprice) FROM lineitem GROUP BY ALL) GROUP BY variable""")
def transpose(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.avg("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"))
    return rounded(reshape.transpose(g, "l_returnflag", ["A", "N", "R"]), "A", "N", "R", digits=4)


@query("q_est_se_long", f"""
WITH g AS (SELECT l_returnflag AS "group", avg(l_quantity) AS e1, stddev_samp(l_quantity) / sqrt(count(*)) AS s1,
                  avg(l_discount) AS e2, stddev_samp(l_discount) / sqrt(count(*)) AS s2 FROM lineitem GROUP BY ALL),
l AS (SELECT "group", 'quantity' AS variable, e1 AS e, s1 AS s FROM g UNION ALL SELECT "group", 'discount', e2, s2 FROM g)
SELECT "group", variable, {q('e')} AS estimate, {q('s')} AS se, {q('e - 1.96 * s')} AS lower, {q('e + 1.96 * s')} AS upper FROM l""")
def est_se_long(spark, sf):
    se = lambda c: F.stddev_samp(c) / F.sqrt(F.count("*"))
    g = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("group")).agg(
        F.avg("l_quantity").alias("quantity"), se("l_quantity").alias("quantity_se"),
        F.avg("l_discount").alias("discount"), se("l_discount").alias("discount_se"))
    return rounded(reshape.estimate_long(g, ["group"], ["quantity", "discount"]), "estimate", "se", "lower", "upper")


@query("q_complete_panel", f"""WITH {LINES_SQL},
c AS (SELECT l_partkey, year, same_sex, sum(l_quantity) AS n, count(*) AS k FROM li GROUP BY ALL)
SELECT s.l_partkey, y.year, f.same_sex, {q('coalesce(n, 0)', 2)} AS n, coalesce(k, 0) AS k
FROM (SELECT DISTINCT l_partkey FROM c) s CROSS JOIN (SELECT DISTINCT year FROM c) y CROSS JOIN (SELECT DISTINCT same_sex FROM c) f
LEFT JOIN c ON c.l_partkey = s.l_partkey AND c.year = y.year AND c.same_sex = f.same_sex""")
def complete_panel(spark, sf):
    cells = stage(lines(spark, sf).groupBy("l_partkey", "year", "same_sex").agg(F.sum("l_quantity").alias("n"), F.count("*").alias("k")))
    return rounded(reshape.complete(cells, ["l_partkey", "year", "same_sex"]), "n", digits=2)


@query("q_calendar", f"""
SELECT s.k, g.year, {q('sum(o_totalprice)', 2)} AS v FROM (SELECT DISTINCT o_custkey % 50 AS k FROM orders) s
CROSS JOIN (SELECT unnest(range(1993, 2004))::INTEGER AS year) g
LEFT JOIN orders ON o_custkey % 50 = s.k AND year(o_orderdate) = g.year GROUP BY ALL""")
def calendar(spark, sf):
    from ..operators.joins import rjoin
    o = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("k"), F.year("o_orderdate").alias("year")).agg(
        F.sum("o_totalprice").alias("v"))
    return rounded(rjoin(reshape.calendar(o, ["k"], 1993, 2003), o, ["k", "year"]), "v", digits=2)


@query("q_carry_forward", f"""
WITH v AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority, sum(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT year, o_orderpriority, {q('v', 2)} AS v FROM v UNION ALL
SELECT y, o_orderpriority, {q('v', 2)} FROM v CROSS JOIN (SELECT unnest([2002, 2003])::INTEGER AS y) WHERE year = 2001""")
def carry_forward(spark, sf):
    v = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), "o_orderpriority").agg(F.sum("o_totalprice").alias("v"))
    return rounded(reshape.carry_forward(v, "year", 2001, [2002, 2003]), "v", digits=2)


@query("q_scaffold", f"""
WITH c AS (SELECT s_nationkey, l_returnflag AS grp, sum(l_quantity) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT n_nationkey AS s_nationkey, g.grp, {q('coalesce(n, 0)', 2)} AS n FROM nation CROSS JOIN (SELECT unnest(['A', 'N', 'R', 'X']) AS grp) g
LEFT JOIN c ON c.s_nationkey = n_nationkey AND c.grp = g.grp""")
def scaffold(spark, sf):
    c = lines(spark, sf).groupBy(F.col("state").alias("s_nationkey"), F.col("l_returnflag").alias("grp")).agg(F.sum("l_quantity").alias("n"))
    keys = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"))
    return rounded(reshape.scaffold(keys, "grp", ["A", "N", "R", "X"], c), "n", digits=2)


# -- aggregation -----------------------------------------------------------------------------


@query("q_weighted_count", f"WITH {LINES_SQL} SELECT state, year, {q('sum(l_quantity)', 2)} AS n FROM li GROUP BY ALL")
def weighted_count(spark, sf):
    return rounded(agg.wcount(lines(spark, sf), ["state", "year"], "l_quantity"), "n", digits=2)


_ODD = "CASE WHEN l_partkey % 7 <> 0 THEN l_linestatus = 'F' END"


@query("q_cond_sums", f"""WITH {LINES_SQL}
SELECT state, year, same_sex, {q("coalesce(sum(CASE WHEN mixed THEN l_quantity END), 0)", 2)} AS n_mixed,
  {q("coalesce(sum(CASE WHEN NOT mixed AND year = 1999 THEN l_quantity END), 0)", 2)} AS n_1999,
  {q("coalesce(sum(CASE WHEN NOT mixed AND year < 1999 THEN l_quantity END), 0)", 2)} AS n_pre,
  {q(f"coalesce(sum(CASE WHEN {_ODD} THEN l_quantity END), 0)", 2)} AS n_skip FROM li GROUP BY ALL""")
def cond_sums(spark, sf):
    li = lines(spark, sf)
    odd = F.when(F.col("l_partkey") % 7 != 0, F.col("l_linestatus") == "F")
    out = agg.cond_sums(li, ["state", "year", "same_sex"], "l_quantity", {
        "n_mixed": F.col("mixed"), "n_1999": ~F.col("mixed") & (F.col("year") == 1999),
        "n_pre": ~F.col("mixed") & (F.col("year") < 1999), "n_skip": odd})
    return rounded(out, "n_mixed", "n_1999", "n_pre", "n_skip", digits=2)


@query("q_cond_sums_propagate", f"""WITH {LINES_SQL}
SELECT l_suppkey, year, same_sex, CASE WHEN NOT bool_or(({_ODD}) IS NULL) THEN
  {q(f"coalesce(sum(CASE WHEN {_ODD} THEN l_quantity END), 0)", 2)} END AS n FROM li GROUP BY ALL""")
def cond_sums_propagate(spark, sf):
    odd = F.when(F.col("l_partkey") % 7 != 0, F.col("l_linestatus") == "F")
    out = agg.cond_sums(lines(spark, sf), ["l_suppkey", "year", "same_sex"], "l_quantity", {"n": odd}, na="propagate")
    return rounded(out, "n", digits=2)


@query("q_adjusted_sums", f"""WITH {LINES_SQL}
SELECT state, year, {q('''sum(CASE WHEN mixed THEN l_quantity * CASE WHEN year >= 2000 THEN 1
   WHEN l_returnflag = 'A' THEN 0.468 WHEN l_returnflag = 'N' THEN 0.54 ELSE 0.775 END ELSE 0 END)''', 4)} AS n_adj FROM li GROUP BY ALL""")
def adjusted_sums(spark, sf):
    adj = agg.adjusted_sum("l_quantity", F.col("mixed"), F.col("year") >= 2000, "l_returnflag",
                           {"A": 0.532, "N": 0.46, "R": 0.225})
    return lines(spark, sf).groupBy("state", "year").agg(r(adj, 4).alias("n_adj"))


_WX = "CASE WHEN l_partkey % 9 <> 0 THEN l_extendedprice END"


@query("q_weighted_mean", f"""WITH {LINES_SQL}, x AS (SELECT *, {_WX} AS x FROM li)
SELECT state, year, {q('sum(x * l_quantity) / sum(CASE WHEN x IS NOT NULL THEN l_quantity END)', 4)} AS m FROM x GROUP BY ALL""")
def weighted_mean(spark, sf):
    li = lines(spark, sf).withColumn("x", F.when(F.col("l_partkey") % 9 != 0, F.col("l_extendedprice")))
    return li.groupBy("state", "year").agg(r(wmean("x", "l_quantity"), 4).alias("m"))


@query("q_weighted_pct", f"""WITH {LINES_SQL}, x AS (SELECT *, ({_WX}) > 50000 AS b FROM li)
SELECT state, year, {q('100 * sum(CASE WHEN b THEN l_quantity ELSE 0 END) / sum(CASE WHEN b IS NOT NULL THEN l_quantity END)')} AS pct
FROM x GROUP BY ALL""")
def weighted_pct(spark, sf):
    li = lines(spark, sf).withColumn("x", F.when(F.col("l_partkey") % 9 != 0, F.col("l_extendedprice")))
    return li.groupBy("state", "year").agg(r(wpct(F.col("x") > 50000, "l_quantity")).alias("pct"))


@query("q_ratio_top10", f"""WITH c AS (
  SELECT c_nationkey, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS a, sum(l_quantity) AS t
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
p AS (SELECT n_name AS origin, {q('100 * a / t')} AS prop FROM c JOIN nation ON c_nationkey = n_nationkey)
SELECT CAST(row_number() OVER (ORDER BY prop DESC, origin) AS INTEGER) AS rank, origin, prop FROM p QUALIFY rank <= 10""")
def ratio_top10(spark, sf):
    return ratio_ranking(spark, sf)


def ratio_ranking(spark, sf):
    """Origins by percent of flagged weight: order lines carry the weight, the customer's nation is the origin."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    per_order = li.groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("a"), F.sum("l_quantity").alias("t"))
    joined = (per_order.join(o, per_order.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
              .groupBy("c_nationkey").agg(F.sum("a").alias("a"), F.sum("t").alias("t")))
    named = joined.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return topk.top_k(named.select(F.col("n_name").alias("origin"), r(ratio_pct("a", "t")).alias("prop")), ["-prop", "origin"], 10)


@query("q_two_top10", f"""WITH {LINES_SQL}, s AS (SELECT same_sex, state, sum(l_quantity) AS n FROM li GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY same_sex ORDER BY n DESC, state) AS INTEGER) AS rank FROM s)
SELECT rank, max(CASE WHEN same_sex THEN state END) AS state_same, max(CASE WHEN NOT same_sex THEN state END) AS state_dif
FROM k WHERE rank <= 10 GROUP BY rank""")
def two_top10(spark, sf):
    s = agg.wcount(lines(spark, sf), ["same_sex", "state"], "l_quantity")
    return topk.top_k_side_by_side(s, ["-n", "state"], 10, "same_sex", {True: "same", False: "dif"}, ["state"])


@query("q_bind_by_rank", f"""
WITH a AS (SELECT CAST(row_number() OVER (ORDER BY sum(l_quantity) DESC, l_suppkey) AS INTEGER) AS rank, l_suppkey AS by_quantity FROM lineitem GROUP BY l_suppkey),
     b AS (SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS INTEGER) AS rank, l_suppkey AS by_count FROM lineitem GROUP BY l_suppkey)
SELECT rank, by_quantity, by_count FROM a JOIN b USING (rank) WHERE rank <= 10""")
def bind_by_rank(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    a = topk.top_k(li, ["-q", "l_suppkey"], 10).select("rank", F.col("l_suppkey").alias("by_quantity"))
    b = topk.top_k(li, ["-n", "l_suppkey"], 10).select("rank", F.col("l_suppkey").alias("by_count"))
    return reshape.bind_by_rank([a, b])


@query("q_min_cell", f"""
SELECT l_suppkey, count(*) AS n, {q('sum(l_quantity)', 2)} AS w FROM lineitem
WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 32) GROUP BY ALL""")
def min_cell(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    return topk.min_cell(li, ["l_partkey"], 32).groupBy("l_suppkey").agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("w"))


@query("q_share_total", f"""WITH c AS (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, {q('n', 2)} AS n, {q('100 * n / (SELECT sum(n) FROM c)')} AS pct FROM c""")
def share_total(spark, sf):
    c = agg.wcount(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")
    return rounded(rounded(agg.share(c, "n", out="pct", scale=100.0), "pct"), "n", digits=2)


@query("q_share_group", f"""WITH {LINES_SQL}, c AS (SELECT year, same_sex, l_linenumber, sum(l_quantity) AS n FROM li GROUP BY ALL)
SELECT year, same_sex, l_linenumber, {q('n / sum(n) OVER (PARTITION BY year, same_sex)')} AS share FROM c""")
def share_group(spark, sf):
    c = agg.wcount(lines(spark, sf), ["year", "same_sex", "l_linenumber"], "l_quantity")
    return rounded(agg.share(c, "n", ["year", "same_sex"]), "share").drop("n")


@query("q_grouping_overall", f"""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN grouping(o_orderstatus) = 1 THEN 'Full sample' ELSE o_orderstatus END AS o_orderstatus,
       count(*) AS n, {q('sum(o_totalprice)', 2)} AS v FROM orders
GROUP BY GROUPING SETS ((year(o_orderdate), o_orderstatus), (year(o_orderdate)))""")
def grouping_overall(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), "o_orderstatus", "o_totalprice")
    out = agg.with_overall(o, ["year"], "o_orderstatus", {"n": F.count("*"), "v": F.sum("o_totalprice")}, "Full sample")
    return rounded(out, "v", digits=2)


@query("q_crosstab_pct", f"""WITH {LINES_SQL}, c AS (
  SELECT same_sex, l_linenumber, {', '.join(f'count(*) FILTER (WHERE year = {y}) AS y{y}' for y in _YEARS)} FROM li GROUP BY ALL)
SELECT same_sex, l_linenumber, {', '.join(q(f'100.0 * y{y} / sum(y{y}) OVER (PARTITION BY same_sex)') + f' AS y{y}' for y in _YEARS)} FROM c""")
def crosstab_pct(spark, sf):
    out = agg.crosstab_pct(lines(spark, sf), "l_linenumber", "year", ["same_sex"], _YEARS, "y")
    return rounded(out, *[f"y{y}" for y in _YEARS])


@query("q_summary_mean_sd", f"""
SELECT 'c_acctbal' AS variable, CAST(NULL AS VARCHAR) AS level, {q('avg(c_acctbal)', 4)} AS stat_1, {q('stddev_samp(c_acctbal)', 4)} AS stat_2 FROM customer
UNION ALL SELECT 'c_nationkey', NULL, {q('avg(c_nationkey)', 4)}, {q('stddev_samp(c_nationkey)', 4)} FROM customer
UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*), {q('100.0 * count(*) / (SELECT count(*) FROM customer)', 4)} FROM customer GROUP BY ALL""")
def summary_mean_sd(spark, sf):
    out = agg.summary_table(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], ["c_mktsegment"])
    return rounded(out, "stat_1", "stat_2", digits=4).drop("stat_3")


@query("q_summary_median", f"""WITH o AS (SELECT o_orderstatus, o_totalprice, o_orderpriority FROM orders UNION ALL SELECT 'Overall', o_totalprice, o_orderpriority FROM orders)
SELECT o_orderstatus, 'o_totalprice' AS variable, CAST(NULL AS VARCHAR) AS level, {q('quantile_cont(o_totalprice, 0.5)', 4)} AS stat_1,
       {q('quantile_cont(o_totalprice, 0.25)', 4)} AS stat_2, {q('quantile_cont(o_totalprice, 0.75)', 4)} AS stat_3 FROM o GROUP BY ALL
UNION ALL SELECT o_orderstatus, 'o_orderpriority', o_orderpriority, count(*), {q('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus)', 4)}, NULL
FROM o GROUP BY o_orderstatus, o_orderpriority""")
def summary_median(spark, sf):
    out = agg.summary_table(table(spark, sf, "orders"), ["o_totalprice"], ["o_orderpriority"], by="o_orderstatus",
                            stat="median_iqr", overall=True)
    return rounded(out, "stat_1", "stat_2", "stat_3", digits=4)


@query("q_summary_weighted", f"""WITH m AS (
  SELECT l_returnflag, sum(l_quantity) AS w, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS m, count(*) AS n,
         sum(l_quantity * l_extendedprice * l_extendedprice) / sum(l_quantity) AS mm FROM lineitem GROUP BY ALL)
SELECT l_returnflag, 'l_extendedprice' AS variable, CAST(NULL AS VARCHAR) AS level, {q('m', 3)} AS stat_1, {q('sqrt((mm - m * m) * n / (n - 1))', 3)} AS stat_2 FROM m
UNION ALL SELECT l_returnflag, 'l_linestatus', l_linestatus, {q('sum(l_quantity)', 3)}, {q('100 * sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag)', 3)}
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def summary_weighted(spark, sf):
    out = agg.summary_table(table(spark, sf, "lineitem"), ["l_extendedprice"], ["l_linestatus"], by="l_returnflag", w="l_quantity")
    return rounded(out, "stat_1", "stat_2", digits=3).drop("stat_3")


@query("q_quantiles", f"""
SELECT l_returnflag, {', '.join(q(f'quantile_cont(l_extendedprice, {p})', 6) + f' AS {n}' for p, n in
       ((0.025, 'q2_5'), (0.5, 'q50'), (0.975, 'q97_5')))} FROM lineitem GROUP BY ALL""")
def quantiles(spark, sf):
    out = agg.quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.025, 0.5, 0.975])
    return rounded(out, "q2_5", "q50", "q97_5")


@query("q_simple_stats", f"""
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, {q('avg(value)', 5)} AS mean, {q('stddev_samp(value)', 5)} AS sd,
       {q('min(value)', 2)} AS lo, {q('max(value)', 2)} AS hi, {q('quantile_cont(value, 0.5)', 5)} AS median,
       {q('avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*))', 5)} AS lower FROM events GROUP BY ALL""")
def simple_stats(spark, sf):
    from ..operators.joins import rjoin
    e = table(spark, sf, "events")
    m, se, low, _ = mean_ci("value")
    one = e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), r(F.avg("value"), 5).alias("mean"),
        r(F.stddev_samp("value"), 5).alias("sd"), r(F.min("value"), 2).alias("lo"), r(F.max("value"), 2).alias("hi"),
        r(low, 5).alias("lower"))
    med = agg.quantiles(e, ["event_type"], "value", [0.5])
    return rounded(rjoin(one, med, "event_type").withColumnRenamed("q50", "median"), "median", digits=5)


@query("q_period_diff", f"""WITH {LINES_SQL}, c AS (SELECT state, year, sum(l_quantity) AS n FROM li GROUP BY ALL)
SELECT state, {q('max(CASE WHEN year = 2000 THEN n END) - max(CASE WHEN year = 1996 THEN n END)', 2)} AS dif,
  {q('100 * (max(CASE WHEN year = 2000 THEN n END) / max(CASE WHEN year = 1996 THEN n END) - 1)')} AS growth FROM c GROUP BY state""")
def period_diff(spark, sf):
    from ..operators.joins import rjoin
    c = agg.wcount(lines(spark, sf), ["state", "year"], "l_quantity")
    a = agg.period_diff(c, ["state"], "year", 2000, 1996, "n")
    b = agg.period_diff(c, ["state"], "year", 2000, 1996, "n", "growth", growth=True)
    return rounded(rounded(rjoin(a, b, "state"), "growth"), "dif", digits=2)


@query("q_period_order", f"""WITH {LINES_SQL}, c AS (SELECT state, state % 2 = 0 AS progressive, year, sum(l_quantity) AS n FROM li GROUP BY ALL),
d AS (SELECT state, progressive, max(CASE WHEN year = 2000 THEN n END) - max(CASE WHEN year = 1996 THEN n END) AS dif FROM c GROUP BY ALL)
SELECT state, progressive, {q('dif', 2)} AS dif, CAST(row_number() OVER (ORDER BY progressive DESC, round(dif, 2) DESC, state) AS INTEGER) AS level_order FROM d""")
def period_order(spark, sf):
    """Factor levels ordered by a measure computed from the data."""
    c = lines(spark, sf).groupBy("state", (F.col("state") % 2 == 0).alias("progressive"), "year").agg(F.sum("l_quantity").alias("n"))
    d = rounded(agg.period_diff(c, ["state", "progressive"], "year", 2000, 1996, "n"), "dif", digits=2)
    return topk.factor_order(d, "state", ["-progressive", "-dif"])


@query("q_combo_counts", """
SELECT *, CAST(row_number() OVER (ORDER BY f1, f2, f3, f4) AS BIGINT) AS id FROM (
  SELECT l_returnflag = 'R' AS f1, l_linestatus = 'F' AS f2, l_discount > 0.05 AS f3, l_quantity > 25 AS f4, count(*) AS n FROM lineitem GROUP BY ALL)""")
def combo_counts(spark, sf):
    li = table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").alias("f1"), (F.col("l_linestatus") == "F").alias("f2"),
        (F.col("l_discount") > 0.05).alias("f3"), (F.col("l_quantity") > 25).alias("f4"))
    return panel.row_id(agg.combos(li, ["f1", "f2", "f3", "f4"]), ["f1", "f2", "f3", "f4"]).withColumn("id", F.col("id").cast("long"))


@query("q_freq_null", """
SELECT CASE WHEN p_size > 40 THEN NULL ELSE p_type END AS kind, count(*) AS n FROM part GROUP BY ALL""")
def freq_null(spark, sf):
    p = table(spark, sf, "part").select(F.when(~(F.col("p_size") > 40), F.col("p_type")).alias("kind"))
    return agg.freq_table(p, "kind")


@query("q_col_means", f"""
SELECT {q('avg(c_custkey)')} AS c_custkey, {q('avg(c_nationkey)')} AS c_nationkey, {q('avg(c_acctbal)', 4)} AS c_acctbal FROM customer""")
def col_means(spark, sf):
    return rounded(rounded(agg.col_means(table(spark, sf, "customer")), "c_acctbal", digits=4), "c_custkey", "c_nationkey")


@query("q_hist", """
SELECT event_type, CAST(least(floor(value / 5), 19) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value >= 0 AND value <= 100 GROUP BY ALL""")
def hist(spark, sf):
    return agg.histogram(table(spark, sf, "events"), "value", 0, 100, 20, ["event_type"])


@query("q_mode", """
WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_linenumber AS mode FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_linenumber) = 1""")
def mode(spark, sf):
    return agg.mode_first(table(spark, sf, "lineitem"), ["l_suppkey"], "l_linenumber", out="mode")


@query("q_correlation", f"""
SELECT l_returnflag, {q('corr(l_quantity, ln(l_extendedprice))')} AS r FROM lineitem GROUP BY ALL""")
def correlation(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_returnflag").agg(r(F.corr(F.col("l_quantity"), F.ln("l_extendedprice"))).alias("r"))


@query("q_trend_line", f"""
SELECT o_orderstatus, {q('regr_slope(o_totalprice, month(o_orderdate))', 4)} AS slope, {q('regr_intercept(o_totalprice, month(o_orderdate))', 4)} AS intercept,
       count(*) AS n FROM orders GROUP BY ALL""")
def trend_line(spark, sf):
    o = table(spark, sf, "orders").select("o_orderstatus", "o_totalprice", F.month("o_orderdate").alias("m"))
    return rounded(agg.trend(o, "o_totalprice", "m", ["o_orderstatus"]), "slope", "intercept", digits=4)


@query("q_subgroup_sweep", f"""WITH {LINES_SQL},
l AS (SELECT state, 'flag' AS variable, l_returnflag AS value, l_quantity AS w FROM li
      UNION ALL SELECT state, 'line', CAST(l_linenumber AS VARCHAR), l_quantity FROM li WHERE l_linenumber < 6
      UNION ALL SELECT state, 'status', l_linestatus, l_quantity FROM li)
SELECT state, variable, value, {q('100 * sum(w) / sum(sum(w)) OVER (PARTITION BY state, variable)')} AS prop FROM l GROUP BY state, variable, value""")
def subgroup_sweep(spark, sf):
    li = lines(spark, sf).select("state", "l_quantity", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
                                 F.when(F.col("l_linenumber") < 6, F.col("l_linenumber")).alias("line"))
    return rounded(agg.subgroup_shares(li, ["flag", "line", "status"], ["state"], "l_quantity"), "prop")


@query("q_scalar_pulls", f"""WITH {LINES_SQL}
SELECT year, {q("sum(CASE WHEN same_sex THEN l_quantity END) / (SELECT sum(l_quantity) FROM li WHERE year = 1999 AND same_sex)")} AS vs_1999
FROM li GROUP BY year""")
def scalar_pulls(spark, sf):
    """A single number of one query inside the expressions of another."""
    li = lines(spark, sf)
    base = li.where("year = 1999 and same_sex").agg(F.sum("l_quantity")).scalar()
    sums = li.groupBy("year").agg(F.sum(F.when(F.col("same_sex"), F.col("l_quantity"))).alias("s"))
    return sums.select("year", r(F.col("s") / base).alias("vs_1999"))


@query("q_period_class_means", f"""WITH {LINES_SQL}, y AS (SELECT state, year, 100 * sum(CASE WHEN same_sex THEN l_quantity ELSE 0 END) / sum(l_quantity) AS p FROM li GROUP BY ALL)
SELECT CASE WHEN year < 1997 THEN 'early' WHEN year <= 1999 THEN 'middle' ELSE 'late' END AS period, state, {q('avg(p)')} AS prop FROM y GROUP BY ALL""")
def period_class_means(spark, sf):
    y = lines(spark, sf).groupBy("state", "year").agg(wpct(F.col("same_sex"), "l_quantity").alias("p"))
    period = F.when(F.col("year") < 1997, "early").when(F.col("year") <= 1999, "middle").otherwise("late")
    return y.groupBy(period.alias("period"), "state").agg(r(F.avg("p")).alias("prop"))


@query("q_cochran_var", f"""WITH {LINES_SQL},
m AS (SELECT l_suppkey AS k, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS m, count(*) AS n, sum(l_quantity) AS sw, avg(l_quantity) AS wb FROM li GROUP BY ALL)
SELECT k, {q('any_value(n) / ((any_value(n) - 1) * pow(any_value(sw), 2)) * (sum(pow(l_quantity * l_extendedprice - wb * m, 2)) - 2 * any_value(m) * sum((l_quantity - wb) * (l_quantity * l_extendedprice - wb * m)) + pow(any_value(m), 2) * sum(pow(l_quantity - wb, 2)))', 1)} AS var
FROM li JOIN m ON l_suppkey = k GROUP BY k""")
def cochran(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("k")).agg(
        r(cochran_var("l_extendedprice", "l_quantity", centers(li, "l_extendedprice")[0]), 1).alias("var"))


@query("q_delta_log_se", f"""
SELECT o_orderpriority, {q('ln(avg(o_totalprice))')} AS log_mean, {q('stddev_samp(o_totalprice) / sqrt(count(*)) / avg(o_totalprice)')} AS log_mean_se
FROM orders GROUP BY ALL""")
def delta_log_se(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.avg("o_totalprice").alias("m"), (F.stddev_samp("o_totalprice") / F.sqrt(F.count("*"))).alias("se"))
    return o.select("o_orderpriority", r(F.ln("m")).alias("log_mean"), r(log_se("m", "se")).alias("log_mean_se"))


@query("q_bind_rows", f"""
SELECT c_nationkey AS nation, 'customer' AS kind, {q('sum(c_acctbal)', 2)} AS balance, CAST(NULL AS BIGINT) AS n FROM customer GROUP BY ALL
UNION ALL SELECT s_nationkey, 'supplier', NULL, count(*) FROM supplier GROUP BY ALL""")
def bind_rows(spark, sf):
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(r(F.sum("c_acctbal"), 2).alias("balance"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    return reshape.bind_rows(a.withColumn("kind", F.lit("customer")), b.withColumn("kind", F.lit("supplier")))


@query("q_distinct_keys", """
SELECT k FROM (SELECT c_nationkey + CASE WHEN c_acctbal < 0 THEN 0 ELSE 100 END AS k FROM customer UNION SELECT s_nationkey FROM supplier)""")
def distinct_keys(spark, sf):
    a = table(spark, sf, "customer").select((F.col("c_nationkey") + F.when(F.col("c_acctbal") < 0, 0).otherwise(100)).alias("k"))
    return reshape.bind_rows(a, table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@query("q_percent_labels", f"""
SELECT l_returnflag, printf('%.2f%%', 100 * sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem)) AS label,
       format('{{:,}}', CAST(count(*) AS BIGINT)) AS count_label FROM lineitem GROUP BY ALL""")
def percent_labels(spark, sf):
    from ..functions import comma
    c = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("w"), F.count("*").alias("n"))
    return agg.share(c, "w", out="p", scale=100.0).select("l_returnflag", percent_label("p").alias("label"), comma("n").alias("count_label"))


@query("q_sample_n", "SELECT * FROM orders ORDER BY md5(concat('7:', o_orderkey)), o_orderkey LIMIT 100")
def sample_n(spark, sf):
    """Sampling operator: a fixed-size seeded sample is its feature."""
    return topk.sample_n(table(spark, sf, "orders"), 100, 7, ["o_orderkey"])


@query("q_case_control", """SELECT * FROM orders WHERE o_orderstatus = 'P'
UNION ALL (SELECT * FROM orders WHERE o_orderstatus <> 'P' ORDER BY md5(concat('7:', o_orderkey)), o_orderkey LIMIT 500)""")
def case_control(spark, sf):
    o = table(spark, sf, "orders")
    return topk.case_control(o, F.col("o_orderstatus") == "P", 500, 7, ["o_orderkey"])
