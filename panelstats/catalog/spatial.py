"""Segregation indices: unit = (supplier nation, brand), groups = return flag."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segregation as seg
from .base import q, query, rounded, table

UNIT = ["s_nationkey", "p_brand"]
_ROWS = """
rows_ AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, s_nationkey, p_brand, l_returnflag AS grp, l_linestatus AS status,
         CAST(l_linenumber AS VARCHAR) AS line, l_quantity AS w
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


def rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_shipdate", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.year("l_shipdate").alias("year"), *UNIT, F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("status"),
                    F.col("l_linenumber").cast("string").alias("line"), F.col("l_quantity").alias("w"))


def _d_sql(by: str, where: str = "TRUE", src: str = "rows_") -> str:
    on = by + ", " if by else ""
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    return f"""
u AS (SELECT {on}s_nationkey, p_brand, coalesce(sum(CASE WHEN grp = 'R' THEN w END), 0) AS a, coalesce(sum(CASE WHEN grp = 'A' THEN w END), 0) AS b
      FROM {src} WHERE grp IN ('R', 'A') AND {where} GROUP BY ALL),
t AS (SELECT *, sum(a) {over} AS ta, sum(b) {over} AS tb FROM u)"""


@query("q_dissimilarity", f"""WITH {_ROWS}, {_d_sql('year')}
SELECT year, {q('0.5 * sum(abs(a / ta - b / tb))')} AS "D" FROM t GROUP BY year""")
def dissimilarity(spark, sf):
    return rounded(seg.dissimilarity(rows(spark, sf), "grp", ("R", "A"), UNIT, "w", ["year"]), "D")


@query("q_dissimilarity_boot")
def dissimilarity_boot(spark, sf):
    return seg.dissimilarity(rows(spark, sf), "grp", ("R", "A"), UNIT, "w", ["year"], boot=50, seed=11)


@query("q_boot_totals", f"""WITH {_ROWS}
SELECT year, CAST(rep AS INTEGER) AS rep, CAST(round(sum(w)) AS BIGINT) AS total
FROM rows_ CROSS JOIN (SELECT unnest(range(50)) AS rep) WHERE grp IN ('R', 'A') GROUP BY ALL""")
def boot_totals(spark, sf):
    reps = seg.replicates(rows(spark, sf), "grp", ("R", "A"), UNIT, "w", ["year"], boot=50, seed=11)
    return reps.select("year", "rep", (F.col("a") + F.col("b")).alias("total"))


# Moments of a multinomial: Pearson's distance has mean K - 1 over K cells, a group's total has the variance of a binomial.
@query("q_boot_moments", f"""WITH {_ROWS},
c AS (SELECT year, s_nationkey, p_brand, grp, sum(w) AS n FROM rows_ WHERE grp IN ('R', 'A') GROUP BY ALL HAVING sum(w) > 0)
SELECT year, count(*) - 1 AS chi2_mean, true AS chi2_near, {q("sum(CASE WHEN grp = 'R' THEN n ELSE 0 END) / sum(n)")} AS share, true AS share_near, true AS share_sd_near
FROM c GROUP BY year""")
def boot_moments(spark, sf):
    from ..operators.joins import rjoin
    df, boot = rows(spark, sf), 50
    reps = seg.replicates(df, "grp", ("R", "A"), UNIT, "w", ["year"], boot=boot, seed=11)
    found = reps.groupBy("year").agg(F.avg("chi2").alias("chi2"), F.avg(F.col("a") / (F.col("a") + F.col("b"))).alias("p"),
                                     F.stddev_samp(F.col("a") / (F.col("a") + F.col("b"))).alias("sd"))
    cells = df.where(F.col("grp").isin("R", "A")).groupBy("year", *UNIT, "grp").agg(F.sum("w").alias("n")).where(F.col("n") > 0)
    known = cells.groupBy("year").agg((F.count("*") - 1).alias("chi2_mean"), F.sum("n").alias("all"),
                                      (F.sum(F.when(F.col("grp") == "R", F.col("n")).otherwise(0.0)) / F.sum("n")).alias("share"))
    sd = F.sqrt(F.col("share") * (1 - F.col("share")) / F.col("all"))
    return rounded(rjoin(known, found, ["year"]).select(
        "year", "chi2_mean", (F.abs(F.col("chi2") / F.greatest("chi2_mean", F.lit(1)) - 1) < 0.15).alias("chi2_near"), "share",
        (F.abs(F.col("p") - F.col("share")) <= 5 * sd / boot ** 0.5).alias("share_near"),
        (F.col("sd").between(0.5 * sd, 1.5 * sd)).alias("share_sd_near")), "share")


@query("q_index_subgroups", f"""WITH {_ROWS},
l AS (SELECT year // 5 * 5 AS bin, s_nationkey, p_brand, grp, w, 'status' AS variable, status AS value FROM rows_
      UNION ALL SELECT year // 5 * 5, s_nationkey, p_brand, grp, w, 'line', line FROM rows_), {_d_sql('bin, variable, value', src='l')}
SELECT CAST(bin AS INTEGER) AS bin, variable, value, {q('0.5 * sum(abs(a / ta - b / tb))')} AS "D" FROM t GROUP BY ALL""")
def index_subgroups(spark, sf):
    from ..functions import floor_bin
    df = rows(spark, sf).withColumn("bin", floor_bin("year", 5))
    return rounded(seg.index_by_subgroup(df, "grp", ("R", "A"), UNIT, "w", ["status", "line"], ["bin"]), "D")


@query("q_theil_h", f"""WITH {_ROWS},
c AS (SELECT year, s_nationkey, p_brand, grp, sum(w) AS n FROM rows_ GROUP BY ALL),
p AS (SELECT *, n / sum(n) OVER y AS pug, sum(n) OVER (PARTITION BY year, s_nationkey, p_brand) / sum(n) OVER y AS pu,
             sum(n) OVER (PARTITION BY year, grp) / sum(n) OVER y AS pg FROM c WINDOW y AS (PARTITION BY year)),
m AS (SELECT year, sum(pug * ln(pug / (pu * pg))) AS m FROM p GROUP BY year),
h AS (SELECT year, -sum(pg * ln(pg)) AS h FROM (SELECT DISTINCT year, grp, pg FROM p) GROUP BY year)
SELECT year, {q('m')} AS "M", {q('m / h')} AS "H" FROM m JOIN h USING (year)""")
def theil_h(spark, sf):
    return rounded(seg.mutual_information(rows(spark, sf), "grp", ["A", "N", "R"], UNIT, "w", ["year"]), "M", "H")


_SHARES = """
c AS (SELECT year, s_nationkey, p_brand, grp, sum(w) AS n FROM rows_ GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY year, s_nationkey, p_brand) AS t, sum(n) OVER (PARTITION BY year, grp) AS x FROM c)"""


@query("q_exposure", f"""WITH {_ROWS}, {_SHARES}
SELECT a.year, a.grp AS "of", b.grp AS "to", {q('sum(a.n / a.x * b.n / a.t)')} AS exposure
FROM s a JOIN s b USING (year, s_nationkey, p_brand) GROUP BY ALL""")
def exposure(spark, sf):
    return rounded(seg.exposure(rows(spark, sf), "grp", ["A", "N", "R"], UNIT, "w", ["year"]), "exposure")


@query("q_isolation", f"""WITH {_ROWS}, {_SHARES}
SELECT year, grp, {q('sum(n / x * n / t)')} AS isolation FROM s GROUP BY ALL""")
def isolation(spark, sf):
    return rounded(seg.isolation(rows(spark, sf), "grp", ["A", "N", "R"], UNIT, "w", ["year"]), "isolation")


@query("q_separation", f"""WITH {_ROWS}, {_d_sql('year')}
SELECT year, {q('sum(a / ta * a / (a + b)) - sum(b / tb * a / (a + b))')} AS "S" FROM t WHERE a + b > 0 GROUP BY year""")
def separation(spark, sf):
    return rounded(seg.separation(rows(spark, sf), "grp", ("R", "A"), UNIT, "w", ["year"]), "S")


@query("q_group_prop", f"""WITH {_ROWS}, {_d_sql('')}
SELECT s_nationkey, p_brand, {q('100 * a / (a + b)')} AS prop FROM t WHERE a + b > 0""")
def group_prop(spark, sf):
    frame = rows(spark, sf).select(*UNIT)
    return rounded(seg.group_share(rows(spark, sf), "grp", ("R", "A"), UNIT, "w", frame), "prop")


@query("q_group_prop_year", f"""WITH {_ROWS}, {_d_sql('year')}
SELECT year, s_nationkey, p_brand, {q('100 * a / (a + b)')} AS prop FROM t WHERE a + b > 0""")
def group_prop_year(spark, sf):
    return rounded(seg.group_share(rows(spark, sf), "grp", ("R", "A"), ["year", *UNIT], "w"), "prop")
