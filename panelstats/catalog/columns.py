"""Recoding, predicates, text functions, sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import reshape
from ..session import shared_folder
from ..sources import io
from .base import q, query, r, table


@query("q_recode", f"""
SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'Industry' WHEN 'AUTOMOBILE' THEN 'Industry'
         WHEN 'HOUSEHOLD' THEN 'Home' ELSE c_mktsegment END AS sector,
       CASE WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN 'heavy' WHEN c_mktsegment = 'BUILDING' THEN 'site'
            ELSE 'light' END AS class,
       CAST(CASE WHEN c_nationkey IN (3, 4, 5) THEN 100 ELSE c_nationkey END AS INTEGER) AS merged,
       CASE WHEN c_nationkey NOT IN (7, 8) AND c_nationkey < 20 THEN c_nationkey END AS valid_nation,
       {q('CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END', 2)} AS clamped
FROM customer""")
def recode(spark, sf):
    c = table(spark, sf, "customer")
    cls = F.when(fn.isin("c_mktsegment", ["MACHINERY", "AUTOMOBILE"]), "heavy").when(
        F.col("c_mktsegment") == "BUILDING", "site").otherwise("light")
    return c.select(
        "c_custkey",
        fn.recode("c_mktsegment", {"MACHINERY": "Industry", "AUTOMOBILE": "Industry", "HOUSEHOLD": "Home"}).alias("sector"),
        cls.alias("class"), fn.harmonise("c_nationkey", {100: [3, 4, 5]}).cast("int").alias("merged"),
        fn.sentinel_null("c_nationkey", 7, 8, ge=20).alias("valid_nation"),
        r(fn.clamp_low("c_acctbal", 0.0), 2).alias("clamped"))


@query("q_cut_bins", """
SELECT p_type, bin, count(*) AS n FROM (
  SELECT p_type, CASE WHEN p_size > 0 AND p_size <= 10 THEN 'small' WHEN p_size > 10 AND p_size <= 30 THEN 'mid'
                      WHEN p_size > 30 THEN 'large' END AS bin FROM part) GROUP BY ALL""")
def cut_bins(spark, sf):
    p = table(spark, sf, "part")
    b = fn.cut("p_size", [0, 10, 30, float("inf")], ["small", "mid", "large"])
    return p.groupBy("p_type", b.alias("bin")).agg(F.count("*").alias("n"))


@query("q_zero_to_null", "SELECT p_partkey, nullif(p_size % 5, 0) AS size5, nullif(p_partkey % 2, 0) AS odd FROM part")
def zero_to_null(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 5).alias("size5"), (F.col("p_partkey") % 2).alias("odd"))
    return reshape.across(p, ["size5", "odd"], fn.zero_to_null)


@query("q_floor_bins", f"""
SELECT CAST(floor(year(o_orderdate) / 2) * 2 AS INTEGER) AS year_bin, count(*) AS n,
       {q('sum(o_totalprice)', 2)} AS total FROM orders GROUP BY ALL""")
def floor_bins(spark, sf):
    o = table(spark, sf, "orders").select(fn.floor_bin(F.year("o_orderdate"), 2).alias("year_bin"), "o_totalprice")
    return o.groupBy("year_bin").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("q_policy_index", """
SELECT idx, count(*) AS n FROM (
  SELECT CAST(coalesce(CASE WHEN p_size <> 1 THEN p_size % 2 END, 0) + CASE WHEN p_brand = 'Brand#2' THEN 1 ELSE 0 END
         - CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS INTEGER) AS idx FROM part) GROUP BY ALL""")
def policy_index(spark, sf):
    p = table(spark, sf, "part").select(
        F.when(F.col("p_size") != 1, F.col("p_size") % 2).alias("a"),
        (F.col("p_brand") == "Brand#2").cast("int").alias("b"), (F.col("p_type") == "PROMO").cast("int").alias("c"))
    return p.groupBy(fn.signed_sum(["a", "b"], ["c"]).cast("int").alias("idx")).agg(F.count("*").alias("n"))


@query("q_ihs", f"""
SELECT c_custkey, {q('asinh(greatest(c_acctbal, 0))')} AS ihs, {q('ln(1 + greatest(c_acctbal, 0))')} AS log1p,
       c_acctbal <= 0 AS no_income, {q('c_acctbal * (0.5 + c_nationkey / 50.0) / 1000')} AS deflated FROM customer""")
def ihs(spark, sf):
    c = table(spark, sf, "customer").withColumn("index", F.lit(0.5) + F.col("c_nationkey") / 50.0)
    return c.select("c_custkey", r(fn.ihs("c_acctbal")).alias("ihs"), r(fn.log1p_income("c_acctbal")).alias("log1p"),
                    fn.no_income("c_acctbal").alias("no_income"),
                    r(fn.deflated("c_acctbal", "index", 1 / 1000)).alias("deflated"))


@query("q_dynamic_filter", """
SELECT o_orderpriority, count(*) AS n FROM orders
WHERE o_totalprice > 250000 OR o_orderstatus = 'P' GROUP BY ALL""")
def dynamic_filter(spark, sf):
    condition = "o_totalprice > 250000 or o_orderstatus = 'P'"
    column = "o_orderpriority"
    return table(spark, sf, "orders").where(F.expr(condition)).groupBy(F.col(column)).agg(F.count("*").alias("n"))


@query("q_strings", f"""
SELECT c_custkey, lower(c_mktsegment) AS low, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS padded,
       substring(c_name, 1, 4) AS head, c_mktsegment LIKE '%IN%' AS has_in,
       nullif(regexp_extract(c_name, '[1-9][0-9]*'), '') AS digits, replace(c_name, 'Customer', 'C') AS short,
       concat_ws('_', coalesce(CASE WHEN c_nationkey <> 3 THEN CAST(c_nationkey AS VARCHAR) END, 'NA'), c_mktsegment) AS pasted,
       concat(upper(substring(c_mktsegment, 1, 1)), lower(substring(c_mktsegment, 2))) AS sentence,
       starts_with(c_mktsegment, 'B') AS is_b, {q('1 / (1 + exp(-c_acctbal / 1000))')} AS logistic,
       {q('exp(c_acctbal / 10000) + sqrt(abs(c_acctbal)) + ln(1 + abs(c_acctbal)) + pow(c_acctbal / 1000, 2)', 4)} AS maths,
       {q('round_even(c_nationkey / 2.0, 0)', 0)} AS half_even
FROM customer""")
def strings(spark, sf):
    c = table(spark, sf, "customer")
    x = F.col("c_acctbal")
    maths = F.exp(x / 10000) + F.sqrt(F.abs(x)) + F.ln(1 + F.abs(x)) + F.pow(x / 1000, F.lit(2))
    return c.select(
        "c_custkey", F.lower("c_mktsegment").alias("low"), fn.pad0("c_nationkey", 3).alias("padded"),
        fn.slice_code("c_name", 1, 4).alias("head"), F.col("c_mktsegment").rlike("IN").alias("has_in"),
        fn.first_match("c_name", "[1-9][0-9]*").alias("digits"), F.regexp_replace("c_name", "Customer", "C").alias("short"),
        fn.paste(F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")), "c_mktsegment").alias("pasted"),
        fn.sentence_case("c_mktsegment").alias("sentence"), F.col("c_mktsegment").startswith("B").alias("is_b"),
        r(fn.logistic(x / 1000)).alias("logistic"), r(maths, 4).alias("maths"),
        r(fn.bround(F.col("c_nationkey") / 2.0), 0).alias("half_even"))


@query("q_labels", """
SELECT upper(r_name) AS region, CAST(count(*) AS BIGINT) AS n, lower(trim(n_name)) AS n_nationkey_label
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def labels(spark, sf):
    """Coded column labelled through a codebook built from the dimension tables."""
    n, g = table(spark, sf, "nation"), table(spark, sf, "region")
    book = n.select(F.lit("n_nationkey").alias("var"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    book = book.unionByName(g.select(F.lit("n_regionkey").alias("var"), F.col("r_regionkey").alias("code"), F.col("r_name").alias("label")))
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    c = c.join(n.select("n_nationkey", "n_regionkey"), "n_nationkey")
    out = io.add_labels(c, book, ["n_nationkey", "n_regionkey"])
    return out.groupBy(F.upper("n_regionkey_label").alias("region"), "n_nationkey_label").agg(F.count("*").alias("n"))


@query("q_file_roundtrip", f"""
SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment, count(*) AS n, {q('sum(c_acctbal)', 2)} AS balance
FROM customer GROUP BY ALL""")
def file_roundtrip(spark, sf):
    """CSV out and in again with a stated schema and a null token, then through a Parquet stage."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    base = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    io.save_csv(c, f"{base}/csv")
    back = io.load_csv(spark, f"{base}/csv", "c_custkey long, c_mktsegment string, c_acctbal double",
                       nulls=["BUILDING"], key="c_custkey")
    back = io.write_stage(back, f"{base}/parquet")
    return back.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count("*").alias("n"), r(F.sum("c_acctbal"), 2).alias("balance"))


@query("q_footer_csv", """
SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS c_name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer""")
def footer_csv(spark, sf):
    """Files that start with a byte-order mark and hold null tokens, notes and blank rows."""
    c = table(spark, sf, "customer")
    token = F.lit("(NA)")
    rows = c.select(F.col("c_custkey").cast("string").alias("\ufeffc_custkey"), F.when(F.col("c_mktsegment") == "BUILDING", token).otherwise(F.col("c_name")).alias("c_name"),
                    F.when(F.col("c_acctbal") < 0, token).otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"))
    none = F.lit(None).cast("string")
    notes = table(spark, sf, "region").select(F.concat(F.lit("Note on "), "r_name"), none, none).union(table(spark, sf, "region").select(none, none, none))
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    io.save_csv(rows.union(notes), path)
    return io.load_csv(spark, path, "c_custkey long, c_name string, c_acctbal double", nulls=["(NA)"], key="c_custkey")


@query("q_valid_window", f"""
SELECT o_orderstatus, count(*) AS n, count(v) AS kept, {q('sum(v)', 2)} AS total FROM (
  SELECT o.o_orderstatus, CASE WHEN year(o_orderdate) BETWEEN first AND last THEN o_totalprice END AS v
  FROM orders o LEFT JOIN (VALUES ('F', 1995, 1997), ('O', 1996, 2000)) w(status, first, last) ON o_orderstatus = status) GROUP BY ALL""")
def valid_window(spark, sf):
    """Values outside the window that a literal table states are blanked; a status without one keeps none."""
    from ..operators.joins import rjoin
    windows = io.literal_table(spark, "status string, first int, last int", [("F", 1995, 1997), ("O", 1996, 2000)])
    o = rjoin(table(spark, sf, "orders"), windows, {"o_orderstatus": "status"})
    o = o.withColumn("v", fn.valid_when("o_totalprice", F.year("o_orderdate").between(F.col("first"), F.col("last"))))
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("v").alias("kept"), r(F.sum("v"), 2).alias("total"))


@query("q_ragged_text", f"""
SELECT o_orderpriority, count(*) AS n, count(v) AS known, {q('sum(v)', 2)} AS total FROM (
  SELECT split_part(o_orderpriority, '-', 1) AS o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders)
GROUP BY ALL""")
def ragged_text(spark, sf):
    """Whitespace text whose last cell may be missing."""
    o = table(spark, sf, "orders")
    path = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}"
    cells = [F.col("o_orderkey").cast("string"), F.split("o_orderpriority", "-")[0],
             F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("string"))]
    o.select(F.concat_ws("   ", *cells).alias("value")).write.text(path)
    back = io.load_ragged(spark, path, "id long, o_orderpriority string, v double")
    return back.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count("v").alias("known"),
                                               r(F.sum("v"), 2).alias("total"))


@query("q_drop_report", """
SELECT imputed, count(*) AS n FROM (SELECT l_tax = 0.0 OR l_discount = 0.0 AS imputed FROM lineitem) GROUP BY ALL""")
def drop_report(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(((F.col("l_tax") == 0.0) | (F.col("l_discount") == 0.0)).alias("imputed")).agg(F.count("*").alias("n"))


@query("q_selectors", f"""
SELECT {q('avg(l_quantity)')} AS mean_quantity, {q('avg(l_extendedprice)', 4)} AS mean_extendedprice,
       {q('avg(l_discount)')} AS mean_discount, {q('avg(l_tax)')} AS mean_tax FROM lineitem""")
def selectors(spark, sf):
    """A column range, renamed by rule, one function across it."""
    li = table(spark, sf, "lineitem")
    cols = reshape.select_cols(li, between=("l_quantity", "l_tax"))
    li = reshape.rename_with(li.select(*cols), lambda c: c.replace("l_", "mean_"))
    return li.agg(*[r(F.avg(c), 4 if c == "mean_extendedprice" else 6).alias(c) for c in li.columns])
