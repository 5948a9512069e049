"""Analysis tables from person records; the records are order lines in survey columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import wmean
from ..plans import areas, counts, couples as cp, covariates as cv, dyads, rankings
from ..session import stage, stage_table
from .base import (
    CLEAN_SQL, COUPLE_IDS, COUPLES_SQL, HOUSEHOLD, MEMBERS_SQL, PERSONS_SQL, clean_persons, couple_rows, immigrant_members,
    person_records, q, query, r, rounded, table,
)

_M = lambda cond, w="perwt": f"coalesce(sum(CASE WHEN {cond} THEN {w} END), 0)"


@query("q_clean_microdata", f"""WITH {CLEAN_SQL}
SELECT year, position, educ, count(*) AS n, count(yrimmig) AS movers, count(inctot) AS incomes, {q('avg(inctot)', 5)} AS inctot,
       {q('avg(ftotinc)', 5)} AS ftotinc, {q('avg(valueh)', 5)} AS valueh, count(hwsei) AS scored, count(DISTINCT bpldid) AS origins FROM clean GROUP BY ALL""")
def clean_microdata(spark, sf):
    return clean_persons(spark, sf).groupBy("year", "position", "educ").agg(
        F.count("*").alias("n"), F.count("yrimmig").alias("movers"), F.count("inctot").alias("incomes"),
        r(F.avg("inctot"), 5).alias("inctot"), r(F.avg("ftotinc"), 5).alias("ftotinc"), r(F.avg("valueh"), 5).alias("valueh"),
        F.count("hwsei").alias("scored"), F.countDistinct("bpldid").alias("origins"))


_COUPLE_OUT = ["year", "serial", "state", "sex_main", "sex_partner", "bpld_main", "bpld_partner", "same_sex", "imm_couple",
               "married", "allocated"]


@query("q_couples", f"WITH {COUPLES_SQL} SELECT {', '.join(_COUPLE_OUT)} FROM couples")
def couples(spark, sf):
    return couple_rows(spark, sf).select(*_COUPLE_OUT)


@query("q_one_immigrant", f"""WITH {COUPLES_SQL}
SELECT year, serial, CASE WHEN citizen_main >= 2 THEN bpld_main ELSE bpld_partner END AS bpld_immigrant,
       CASE WHEN citizen_main >= 2 THEN educ_partner ELSE educ_main END AS educ_nonimmigrant,
       CASE WHEN citizen_main >= 2 THEN 'main' ELSE 'partner' END AS position_immigrant, related_partner AS relation
FROM couples WHERE imm_couple = 'one'""")
def one_immigrant(spark, sf):
    out = cp.one_immigrant(couple_rows(spark, sf), ["year", "serial"], ["bpld", "educ", "age"])
    return out.select("year", "serial", "bpld_immigrant", "educ_nonimmigrant", "position_immigrant", "relation")


@query("q_couple_persons", f"""WITH {MEMBERS_SQL}
SELECT year, imm_couple, position, same_sex, count(*) AS n, {q('avg(years_in_us)')} AS years_in_us, {q('sum(perwt)', 2)} AS w FROM imm GROUP BY ALL""")
def couple_persons(spark, sf):
    return immigrant_members(spark, sf).groupBy("year", "imm_couple", "position", "same_sex").agg(
        F.count("*").alias("n"), r(F.avg("years_in_us")).alias("years_in_us"), r(F.sum("perwt"), 2).alias("w"))


_ADJ = """(CASE WHEN year = 2019 THEN 1 WHEN year > 2019 THEN 0 WHEN respmode = 'Mail' THEN {m} WHEN respmode = 'CATI/CAPI' THEN {c} ELSE {i} END)"""
_SP = _ADJ.format(m="(1 - (0.59 + 0.474) / 2)", c="(1 - 0.46)", i="(1 - 0.225)")
_PA = _ADJ.format(m="(1 - (0.07 + 0.056) / 2)", c="(1 - 0.13)", i="(1 - 0.024)")


def _cells_sql(by: str) -> str:
    s, d = "same_sex", "NOT same_sex"
    return f"""
u AS (SELECT * FROM imm WHERE yrimmig >= 1991 AND NOT allocated),
cells AS (SELECT {by}, {_M(s)} AS n_same_sex, {_M(d)} AS n_dif_sex,
  {_M(f'{s} AND married')} AS n_spouse_same_sex, {_M(f'{s} AND NOT married')} AS n_partner_same_sex,
  {_M(f"{s} AND married AND imm_couple = 'one'")} AS n_spouse_oneimm_same_sex, {_M(f"{s} AND NOT married AND imm_couple = 'one'")} AS n_partner_oneimm_same_sex,
  {_M(f"{d} AND married AND imm_couple = 'two'")} AS n_spouse_twoimm_dif_sex, {_M(f"{s} AND married AND year = yrimmig + 1")} AS n_spouse_recent_same_sex,
  {_M(f'{s} AND married', f'perwt * {_SP}')} AS n_spouse_adj_same_sex, {_M(f'{s} AND NOT married', f'perwt * {_PA}')} AS n_partner_adj_same_sex,
  {_M(f'{d} AND married AND year < 2019')} AS n_spouse_pre_2019_dif_sex FROM u GROUP BY ALL),
stock AS (SELECT bpld, state, year, sum(perwt) AS state_stock_year FROM clean WHERE citizen >= 2 AND yrimmig >= 1991 GROUP BY ALL),
entry AS (SELECT bpld, year, sum(perwt * yrimmig) / sum(perwt) AS mean_year_immig FROM imm WHERE yrimmig >= 1991 GROUP BY ALL)"""


_DYAD_OUT = ["n_same_sex", "n_dif_sex", "n_spouse_same_sex", "n_partner_same_sex", "n_spouse_oneimm_same_sex", "n_partner_oneimm_same_sex",
             "n_spouse_twoimm_dif_sex", "n_spouse_recent_same_sex", "n_spouse_adj_same_sex", "n_partner_adj_same_sex",
             "n_spouse_pre_2019_dif_sex", "state_stock_year", "mean_year_immig"]


def dyads_of(spark, sf):
    members = stage_table(immigrant_members(spark, sf))
    return dyads.dyad_panel(members, clean_persons(spark, sf))


@query("q_dyad_panel", f"""WITH {MEMBERS_SQL}, {_cells_sql('bpld, state, year')}
SELECT bpld, state, year, {', '.join(f'{q(c, 4)} AS {c}' for c in _DYAD_OUT)} FROM cells
LEFT JOIN stock USING (bpld, state, year) LEFT JOIN entry USING (bpld, year)""")
def dyad_panel(spark, sf):
    return rounded(dyads_of(spark, sf).select("bpld", "state", "year", *_DYAD_OUT), *_DYAD_OUT, digits=4)


_TOTALS = f"""totals AS (SELECT bpld, yrimmig, sum(perwt) AS n_total, {_M('related = 201')} AS n_spouse, {_M('related = 1114')} AS n_partner,
  {_M('year = yrimmig + 1')} AS n_total_recent FROM clean WHERE citizen >= 2 AND yrimmig >= 1991 GROUP BY ALL)"""


@query("q_entry_totals", f"""WITH {CLEAN_SQL}, {_TOTALS}
SELECT bpld, yrimmig, {q('n_total', 2)} AS n_total, {q('n_spouse', 2)} AS n_spouse, {q('n_partner', 2)} AS n_partner, {q('n_total_recent', 2)} AS n_total_recent FROM totals""")
def entry_totals(spark, sf):
    return rounded(dyads.entry_totals(clean_persons(spark, sf)), "n_total", "n_spouse", "n_partner", "n_total_recent", digits=2)


@query("q_entry_cohorts", f"""WITH {MEMBERS_SQL}, {_cells_sql('yrimmig, bpld')}, {_TOTALS}
SELECT yrimmig, bpld, {q('100 * (n_spouse_same_sex + n_partner_same_sex) / n_total')} AS prop_same_sex,
  {q('100 * (n_spouse_adj_same_sex + n_partner_adj_same_sex) / n_total')} AS prop_same_sex_adj, {q('100 * n_dif_sex / n_total')} AS prop_dif_sex
FROM cells LEFT JOIN (SELECT bpld, yrimmig, n_total FROM totals) USING (bpld, yrimmig)""")
def entry_cohorts(spark, sf):
    out = dyads.entry_cohorts(immigrant_members(spark, sf), dyads.entry_totals(clean_persons(spark, sf)))
    return rounded(out.select("yrimmig", "bpld", "prop_same_sex", "prop_same_sex_adj", "prop_dif_sex"),
                   "prop_same_sex", "prop_same_sex_adj", "prop_dif_sex")


@query("q_recent_dyads", f"""WITH {MEMBERS_SQL}
SELECT bpld, state, year, {q(_M('same_sex'), 2)} AS same_sex_stock, {q(_M('NOT same_sex'), 2)} AS opp_sex_stock,
       {q('sum(perwt * yrimmig) / sum(perwt)', 4)} AS mean_year_immig
FROM imm WHERE yrimmig >= 1991 AND NOT allocated AND year - yrimmig <= 3 GROUP BY ALL""")
def recent_dyads(spark, sf):
    out = dyads.recent_dyads(immigrant_members(spark, sf), 3)
    return rounded(rounded(out, "same_sex_stock", "opp_sex_stock", digits=2), "mean_year_immig", digits=4)


# -- side tables derived from the dimension tables ---------------------------------------------

_ORIGIN = """
origin AS (SELECT concat('ORIGIN_', n_nationkey) AS bpld, n_nationkey AS bpldid, CAST(y AS INTEGER) AS year,
  CAST(n_nationkey % 12 - 3 + y % 3 AS INTEGER) AS origin_score, CAST(n_nationkey % 2 AS INTEGER) AS equal_age,
  CAST(CASE WHEN y > 1990 + n_nationkey THEN 1 ELSE 0 END AS INTEGER) AS legal, CAST(n_nationkey % 3 % 2 AS INTEGER) AS marriage_ban
  FROM nation, (SELECT unnest(range(1980, 2022)) AS y))"""
_STATE = """
policy0 AS (SELECT concat('STATE_', n_nationkey) AS state, CAST(y AS INTEGER) AS year,
  CASE WHEN n_nationkey % 4 <> 3 THEN CASE WHEN y > 2010 THEN 1 ELSE 0 END END AS marriage_equality, n_nationkey % 3 % 2 AS civil_union,
  CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END AS sodomy_illega, CASE WHEN y < 2012 AND n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS marriage_ban
  FROM nation, (SELECT unnest(range(2007, 2019)) AS y)),
policy AS (SELECT state, year, CAST(coalesce(marriage_equality, 0) + civil_union - sodomy_illega - marriage_ban AS INTEGER) AS state_policy FROM policy0)"""


def origin_table(spark, sf):
    n = table(spark, sf, "nation").withColumn("year", F.explode(F.sequence(F.lit(1980), F.lit(2021))))
    k, y = F.col("n_nationkey"), F.col("year")
    return n.select(F.concat(F.lit("ORIGIN_"), k.cast("string")).alias("bpld"), k.alias("bpldid"), "year",
                    (k % 12 - 3 + y % 3).cast("int").alias("origin_score"), (k % 2).cast("int").alias("equal_age"),
                    (y > 1990 + k).cast("int").alias("legal"), (k % 3 % 2).cast("int").alias("marriage_ban"))


def policy_components(spark, sf):
    n = table(spark, sf, "nation").withColumn("year", F.explode(F.sequence(F.lit(2007), F.lit(2018))))
    k, y = F.col("n_nationkey"), F.col("year")
    return n.select(F.concat(F.lit("STATE_"), k.cast("string")).alias("state"), "year",
                    F.when(k % 4 != 3, (y > 2010).cast("int")).alias("marriage_equality"), (k % 3 % 2).alias("civil_union"),
                    (k % 5 == 0).cast("int").alias("sodomy_illega"), ((y < 2012) & (k % 2 == 0)).cast("int").alias("marriage_ban"))


def policy_table(spark, sf, carry=False):
    return cv.policy_index(policy_components(spark, sf), 2018 if carry else None, [2019, 2020] if carry else (),
                           ["marriage_equality", "civil_union"], ["sodomy_illega", "marriage_ban"])


@query("q_state_policy_index", f"""WITH {_STATE}, c AS (SELECT * FROM policy UNION ALL SELECT state, CAST(y AS INTEGER), state_policy FROM policy, (SELECT unnest([2019, 2020]) AS y) WHERE year = 2018)
SELECT state, year, state_policy, CASE WHEN state_policy > -2 AND state_policy <= 0 THEN 'Repressive' WHEN state_policy > 0 AND state_policy <= 2 THEN 'Neutral'
  WHEN state_policy > 2 THEN 'Progressive' END AS state_policy_binned FROM c""")
def state_policy_index(spark, sf):
    return policy_table(spark, sf, carry=True)


_YEARLY = """
econ AS (SELECT c_nationkey AS k, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS rgdpe, count(DISTINCT c_custkey) AS pop
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def yearly_economy(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.groupBy(F.col("c_nationkey").alias("k"), F.year("o_orderdate").alias("year")).agg(
        F.sum("o_totalprice").alias("rgdpe"), F.countDistinct("c_custkey").alias("pop"))


@query("q_origin_covariates", f"""WITH {_YEARLY},
un AS (SELECT s_nationkey AS k, CAST(year(l_shipdate) AS INTEGER) AS year, avg(l_discount) AS u FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
b AS (SELECT year, rgdpe / pop AS base FROM econ WHERE k = 7), bu AS (SELECT year, u AS base FROM un WHERE k = 7)
SELECT concat('N', econ.k) AS iso, econ.year, {q('rgdpe / pop - b.base', 7)} AS wage_dif, {q('u - bu.base')} AS unemp_dif,
  CASE WHEN econ.k % 6 <> 5 THEN CAST(n_regionkey AS DOUBLE) END AS democracy, CAST(econ.k * 100 AS DOUBLE) AS distw
FROM econ LEFT JOIN b USING (year) LEFT JOIN un ON un.k = econ.k AND un.year = econ.year LEFT JOIN bu ON bu.year = econ.year JOIN nation ON n_nationkey = econ.k""")
def origin_covariates(spark, sf):
    iso = lambda c: F.concat(F.lit("N"), c.cast("string"))
    econ = yearly_economy(spark, sf).select(iso(F.col("k")).alias("iso"), "year", "rgdpe", "pop")
    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    un = li.join(s, li.l_suppkey == s.s_suppkey).groupBy(iso(F.col("s_nationkey")).alias("iso")).agg(
        *[F.avg(F.when(F.year("l_shipdate") == y, F.col("l_discount"))).alias(str(y)) for y in range(1995, 2002)])
    n = table(spark, sf, "nation")
    demo = n.withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(2001)))).select(
        F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).alias("code"), F.col("n_name").alias("name"), "year",
        F.col("n_regionkey").cast("double").alias("democracy")).where(F.col("n_nationkey") % 6 != 5)
    schemes = [("code", n.select("n_nationkey", iso(F.col("n_nationkey")))), ("name", n.select("n_name", iso(F.col("n_nationkey"))))]
    dist = n.select(iso(F.col("n_nationkey")).alias("iso"), (F.col("n_nationkey") * 100).cast("double").alias("distw"))
    out = cv.origin_covariates(econ, un, demo, dist, schemes, "N7")
    return rounded(rounded(out, "wage_dif", digits=7), "unemp_dif")


@query("q_stock_shares", f"""WITH
e AS (SELECT concat('N', c_nationkey) AS iso, y AS year, sum(CASE WHEN c_custkey % 3 <= (y - 1960) // 10 THEN 1 ELSE 0 END) AS n
      FROM customer, (SELECT unnest([1960, 1970, 1980]) AS y) GROUP BY ALL),
l AS (SELECT concat('N', s_nationkey) AS iso, CASE WHEN year(l_shipdate) < 1998 THEN 1995 ELSE 2000 END AS year, sum(l_quantity) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
      GROUP BY ALL),
known AS (SELECT iso, year, n * 1.0 / sum(n) OVER (PARTITION BY year) AS p FROM e UNION ALL SELECT iso, year, n / sum(n) OVER (PARTITION BY year) FROM l),
f AS (SELECT iso, CAST(y AS INTEGER) AS year FROM (SELECT DISTINCT iso FROM known), (SELECT unnest(range(1960, 2021)) AS y)),
w AS (SELECT f.iso, f.year, p, max(CASE WHEN p IS NOT NULL THEN f.year END) OVER (PARTITION BY f.iso ORDER BY f.year ROWS UNBOUNDED PRECEDING) AS y0,
  min(CASE WHEN p IS NOT NULL THEN f.year END) OVER (PARTITION BY f.iso ORDER BY f.year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y1
  FROM f LEFT JOIN known USING (iso, year))
SELECT w.iso, w.year, {q('''CASE WHEN y1 IS NULL THEN a.p WHEN y0 = y1 THEN w.p ELSE a.p + (b.p - a.p) / (y1 - y0) * (w.year - y0) END''')} AS stock_prop
FROM w LEFT JOIN known a ON a.iso = w.iso AND a.year = y0 LEFT JOIN known b ON b.iso = w.iso AND b.year = y1""")
def stock_shares(spark, sf):
    c = table(spark, sf, "customer")
    early = c.groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("iso")).agg(
        *[F.sum((F.col("c_custkey") % 3 <= i).cast("int")).alias(f"{1960 + 10 * i} [{1960 + 10 * i}]") for i in range(3)])
    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    late = (li.join(s, li.l_suppkey == s.s_suppkey)
            .groupBy(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("iso"), F.when(F.year("l_shipdate") < 1998, 1995).otherwise(2000).alias("year"))
            .agg(F.sum("l_quantity").alias("v")))
    total = late.groupBy("year").agg(F.sum("v").alias("v")).withColumn("iso", F.lit("Total"))
    late = late.unionByName(total).select("iso", "year", F.format_number("v", 2).alias("n"))
    out = cv.stock_shares(early, late, "Total", 1960, 2020).where("iso <> 'Total'")
    return rounded(out, "stock_prop")


_STATE_COV = f"""{_STATE},
ue AS (SELECT concat('STATE_', user_id % 25) AS state, CAST(2008 + day(ts) % 10 AS INTEGER) AS year, avg(value) AS state_unemploy FROM events GROUP BY ALL),
inc AS (SELECT concat('STATE_', c_nationkey) AS state, CAST(2008 + year(o_orderdate) - 1995 AS INTEGER) AS year, sum(o_totalprice) AS v
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
px AS (SELECT CAST(2008 + year(l_shipdate) - 1995 AS INTEGER) AS year, avg(l_extendedprice) AS level FROM lineitem GROUP BY ALL),
cov AS (SELECT state, year, state_policy, state_unemploy, v * (SELECT level FROM px WHERE year = 2010) / level / 1000 AS state_income
  FROM policy LEFT JOIN ue USING (state, year) LEFT JOIN (SELECT state, year, v, level FROM inc LEFT JOIN px USING (year)) USING (state, year))"""


def state_frame(spark, sf):
    e = table(spark, sf, "events").select(
        F.concat(F.lit("LAS"), F.lpad((F.col("user_id") % 25).cast("string"), 2, "0"), F.lit("0000003")).alias("series_id"),
        (2008 + F.dayofmonth("ts") % 10).cast("int").alias("year"), "value")
    states = table(spark, sf, "nation").select(F.concat(F.lit("STATE_"), F.col("n_nationkey").cast("string")).alias("state"),
                                               F.col("n_nationkey").alias("state_num"))
    ue = cv.series_means(e, "00003", states)
    inc = yearly_economy(spark, sf).select(F.concat(F.lit("STATE_"), F.col("k").cast("string")).alias("state"),
                                           (F.col("year") + 13).cast("int").alias("year"), F.col("rgdpe").alias("state_income"))
    px = table(spark, sf, "lineitem").groupBy((F.year("l_shipdate") + 13).alias("year")).agg(F.avg("l_extendedprice").alias("level"))
    policy = policy_table(spark, sf).select("state", "year", "state_policy")
    return cv.state_covariates(policy, ue, inc, px, 2010)


@query("q_state_covariates", f"""WITH {_STATE_COV}
SELECT state, year, state_policy, {q('state_unemploy')} AS state_unemploy, {q('state_income', 3)} AS state_income FROM cov""")
def state_covariates(spark, sf):
    return rounded(rounded(state_frame(spark, sf), "state_unemploy"), "state_income", digits=3)


@query("q_state_table", f"""WITH {MEMBERS_SQL}, {_cells_sql('bpld, state, year')}, {_ORIGIN}, {_STATE},
d AS (SELECT cells.*, CAST(round_even(mean_year_immig, 0) AS INTEGER) AS my FROM cells LEFT JOIN entry USING (bpld, year))
SELECT d.bpld, d.state, d.year, o.origin_score, ol.origin_score AS origin_score_lag, p.state_policy, pl.state_policy AS state_policy_lag,
  {q('100 * (n_spouse_same_sex + n_partner_same_sex) / nullif(n_spouse_same_sex + n_partner_same_sex + n_dif_sex, 0)')} AS prop_same_sex,
  {q('100 * (n_spouse_adj_same_sex + n_partner_adj_same_sex) / nullif(n_spouse_same_sex + n_partner_same_sex + n_dif_sex, 0)')} AS prop_same_sex_adj
FROM d JOIN origin o ON o.bpld = d.bpld AND o.year = my LEFT JOIN origin ol ON ol.bpld = d.bpld AND ol.year = my - 1
LEFT JOIN policy p ON p.state = d.state AND p.year = d.year LEFT JOIN policy pl ON pl.state = d.state AND pl.year = d.year - 1
WHERE my >= 1991 AND p.state_policy IS NOT NULL""")
def state_table(spark, sf):
    origin = origin_table(spark, sf).select("bpld", "year", "origin_score")
    empty = origin.select("bpld", "year", (F.col("origin_score") / 100.0).alias("stock_prop"))
    policy = policy_table(spark, sf).select("state", "year", "state_policy")
    out = dyads.state_table(dyads_of(spark, sf), empty, origin, policy, state_frame(spark, sf).drop("state_policy"), ["state_policy"])
    return rounded(out.select("bpld", "state", "year", "origin_score", "origin_score_lag", "state_policy", "state_policy_lag",
                              "prop_same_sex", "prop_same_sex_adj"), "prop_same_sex", "prop_same_sex_adj")


def individual(spark, sf):
    origin = origin_table(spark, sf).select("bpld", "year", "origin_score")
    prop = origin.select("bpld", "year", (F.col("origin_score") / 100.0).alias("stock_prop"))
    policy = policy_table(spark, sf).select("state", "year", "state_policy")
    return dyads.individual_table(immigrant_members(spark, sf), prop, origin, policy, state_frame(spark, sf).drop("state_policy"),
                                  ["same_sex", "origin_score", "ihs_income", "educ"])


_IND = f"""{_ORIGIN}, {_STATE},
ind AS (SELECT imm.*, o.origin_score, p.state_policy, CASE WHEN p.state_policy > 2 THEN 'Progressive' WHEN p.state_policy > 0 THEN 'Neutral' ELSE 'Repressive' END AS bin,
  asinh(greatest(inctot, 0)) AS ihs_income, inctot <= 0 AS no_income
  FROM imm JOIN origin o ON o.bpld = imm.bpld AND o.year = imm.yrimmig JOIN policy p ON p.state = imm.state AND p.year = imm.year
  WHERE p.state_policy > -2 AND inctot IS NOT NULL)"""


@query("q_individual_table", f"""WITH {MEMBERS_SQL}, {_IND}
SELECT bin AS state_policy_binned, same_sex, no_income, count(*) AS n, {q('avg(ihs_income)')} AS ihs_income, {q('sum(perwt * origin_score) / sum(perwt)')} AS origin_score
FROM ind WHERE NOT allocated GROUP BY ALL""")
def individual_table(spark, sf):
    rows, _ = individual(spark, sf)
    return rows.groupBy("state_policy_binned", "same_sex", "no_income").agg(
        F.count("*").alias("n"), r(F.avg("ihs_income")).alias("ihs_income"), r(wmean("origin_score", "perwt")).alias("origin_score"))


@query("q_allocated_report", f"WITH {MEMBERS_SQL}, {_IND} SELECT same_sex, allocated, count(*) AS n FROM ind GROUP BY ALL")
def allocated_report(spark, sf):
    return individual(spark, sf)[1]


# -- count panels ------------------------------------------------------------------------------

_BASE = f"""{_ORIGIN},
lagged AS (SELECT bpldid, year, origin_score, equal_age, legal, marriage_ban, lag(origin_score, 1) OVER w AS lag1, lag(origin_score, 2) OVER w AS lag2,
  lag(origin_score, 5) OVER w AS lag5 FROM origin WINDOW w AS (PARTITION BY bpldid ORDER BY year)),
cb0 AS (SELECT *, (citizen_main = 3) <> (citizen_partner = 3) AS mixed, citizen_main = 3 OR citizen_partner = 3 AS noncit FROM couples WHERE NOT allocated),
cb1 AS (
  SELECT year, state, same_sex, imm_couple, married, mixed, noncit, age_main AS age, perwt_main AS perwt, qcitizen_main AS qcitizen, qeduc_main AS qeduc, yrmarr_main AS yrmarr,
    CASE WHEN yrimmig_main IS NULL AND yrimmig_partner IS NOT NULL THEN bpldid_partner ELSE bpldid_main END AS bpldidnew, coalesce(yrimmig_main, yrimmig_partner) AS ym FROM cb0
  UNION ALL SELECT year, state, same_sex, imm_couple, married, mixed, noncit, age_partner, perwt_partner, qcitizen_partner, qeduc_partner, yrmarr_partner,
    CASE WHEN yrimmig_partner IS NULL AND yrimmig_main IS NOT NULL THEN bpldid_main ELSE bpldid_partner END, coalesce(yrimmig_partner, yrimmig_main) FROM cb0),
base AS (SELECT cb1.* EXCLUDE (ym), greatest(ym, 1991) AS yrimmigmod, l.origin_score, lag1, lag2, lag5, equal_age, legal, marriage_ban
  FROM (SELECT *, CASE WHEN ym IS NOT NULL THEN greatest(ym, 1991) END AS yj FROM cb1) cb1 LEFT JOIN lagged l ON l.bpldid = bpldidnew AND l.year = yj WHERE age BETWEEN 18 AND 64)"""
_BASE = _BASE.replace("cb1.* EXCLUDE (ym), greatest(ym, 1991) AS yrimmigmod", "cb1.* EXCLUDE (ym, yj), yj AS yrimmigmod")


def base_rows(spark, sf):
    origin = origin_table(spark, sf).drop("bpld")
    origin = counts.lagged_scores(origin, "bpldid", "year", "origin_score")
    origin = origin.withColumnsRenamed({f"origin_score_lag{k}": f"lag{k}" for k in (1, 2, 5)})
    base = counts.count_base(couple_rows(spark, sf), HOUSEHOLD, origin)
    return base.withColumnRenamed("mixed_citizenship", "mixed")


@query("q_count_base", f"""WITH {COUPLES_SQL}, {_BASE}
SELECT year, mixed, noncit, yrimmigmod, count(*) AS n, {q('sum(perwt)', 2)} AS w, count(origin_score) AS scored, CAST(sum(lag1) AS BIGINT) AS lag1,
  CAST(sum(lag2) AS BIGINT) AS lag2, CAST(sum(lag5) AS BIGINT) AS lag5 FROM base GROUP BY ALL""")
def count_base(spark, sf):
    return base_rows(spark, sf).groupBy("year", "mixed", "noncit", "yrimmigmod").agg(
        F.count("*").alias("n"), r(F.sum("perwt"), 2).alias("w"), F.count("origin_score").alias("scored"),
        *[F.sum(f"lag{k}").cast("long").alias(f"lag{k}") for k in (1, 2, 5)])


def _panel_sql(flag: str, where: str, cte: str = "") -> str:
    ok = "qcitizen <> 'allocated' AND qeduc <> 'consistency edit'"
    return f"""WITH {COUPLES_SQL}, {_BASE}{cte},
s AS (SELECT *, {flag} AS mx FROM base WHERE {where}),
c AS (SELECT state, year, same_sex, mx, sum(perwt) AS n, count(*) AS k, {_M(ok)} AS n_ar, count(*) FILTER (WHERE {ok}) AS k_ar FROM s GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT state FROM c), (SELECT DISTINCT year FROM c), (SELECT DISTINCT same_sex FROM c), (SELECT DISTINCT mx FROM c))
SELECT g.state, g.year, g.same_sex, g.mx AS mixed, {q('coalesce(n, 0)', 2)} AS n, coalesce(k, 0) AS n_unweighted, {q('coalesce(n_ar, 0)', 2)} AS n_ar,
  coalesce(k_ar, 0) AS n_unweighted_ar, g.year > 2013 AS post, concat(g.state, '_', g.same_sex, '_', g.mx) AS group_fe
FROM g LEFT JOIN c USING (state, year, same_sex, mx)"""


def _panel(df, condition=None):
    return rounded(counts.count_panel(df, condition, quality=counts.good_answers()), "n", "n_ar", digits=2)


@query("q_count_panel_mixed", _panel_sql("mixed", "TRUE"))
def count_panel_mixed(spark, sf):
    return _panel(base_rows(spark, sf))


@query("q_count_panel_noncit", _panel_sql("noncit", "TRUE"))
def count_panel_noncit(spark, sf):
    return _panel(base_rows(spark, sf).withColumn("mixed", F.col("noncit")))


@query("q_count_panel_immigrant", _panel_sql("imm_couple <> 'none'", "TRUE"))
def count_panel_immigrant(spark, sf):
    return _panel(base_rows(spark, sf).withColumn("mixed", F.col("imm_couple") != "none"))


@query("q_count_condition", _panel_sql("mixed", "origin_score > 3 OR origin_score IS NULL"))
def count_condition(spark, sf):
    return _panel(base_rows(spark, sf), "origin_score > 3 or origin_score is null")


@query("q_count_lag_condition", _panel_sql("imm_couple = 'one'", "lag2 < 0 OR lag2 IS NULL"))
def count_lag_condition(spark, sf):
    return _panel(base_rows(spark, sf).withColumn("mixed", F.col("imm_couple") == "one"), "lag2 < 0 or lag2 is null")


@query("q_marriage_before", _panel_sql("mixed", "yrmarr - yrimmigmod < 0 OR (married AND NOT mixed)"))
def marriage_before(spark, sf):
    p = counts.marriage_split(base_rows(spark, sf), quality=counts.good_answers())["before"]
    return rounded(p, "n", "n_ar", digits=2)


@query("q_marriage_after", _panel_sql("mixed", "yrmarr - yrimmigmod >= 0 OR (married AND NOT mixed)"))
def marriage_after(spark, sf):
    p = counts.marriage_split(base_rows(spark, sf), quality=counts.good_answers())["after"]
    return rounded(p, "n", "n_ar", digits=2)


@query("q_marriage_gap", f"""WITH {COUPLES_SQL}, {_BASE}
SELECT yrmarr - yrimmigmod AS marr_minus_imm, count(*) AS k FROM base GROUP BY ALL""")
def marriage_gap(spark, sf):
    return counts.marriage_gap(base_rows(spark, sf)).groupBy("marr_minus_imm").agg(F.count("*").alias("k"))


@query("q_policy_trends", f"""WITH {COUPLES_SQL}, {_BASE},
l AS (SELECT year, perwt, 'equal_age' AS cat, equal_age AS v FROM base WHERE mixed AND same_sex UNION ALL SELECT year, perwt, 'legal', legal FROM base WHERE mixed AND same_sex
  UNION ALL SELECT year, perwt, 'marriage_ban', marriage_ban FROM base WHERE mixed AND same_sex)
SELECT year, cat, {q('sum(perwt)', 2)} AS n, CASE cat WHEN 'equal_age' THEN 'Equal age of consent' WHEN 'legal' THEN 'Same-sex acts legal' ELSE 'Marriage ban' END AS policy_name,
  cat <> 'marriage_ban' AS progressive FROM l WHERE v > 0 OR v IS NULL GROUP BY year, cat""")
def policy_trends(spark, sf):
    out = counts.policy_trends(base_rows(spark, sf), ["equal_age", "legal", "marriage_ban"], "mixed and same_sex", ["equal_age", "legal"],
                               {"equal_age": "Equal age of consent", "legal": "Same-sex acts legal", "marriage_ban": "Marriage ban"})
    return rounded(out, "n", digits=2)


@query("q_stacked_panel", f"""WITH {COUPLES_SQL}, {_BASE},
t AS (SELECT state, year, same_sex, sum(perwt) AS n FROM base WHERE origin_score >= 3 GROUP BY ALL),
c AS (SELECT state, year, same_sex, sum(perwt) AS n FROM base WHERE imm_couple = 'none' GROUP BY ALL)
SELECT state, year, same_sex, {q('n', 2)} AS n, TRUE AS immigrant, year > 2013 AS post, concat(state, '_', same_sex, '_true') AS group_fe FROM t
UNION ALL SELECT state, year, same_sex, {q('n', 2)}, FALSE, year > 2013, concat(state, '_', same_sex, '_false') FROM c""")
def stacked_panel(spark, sf):
    base = base_rows(spark, sf)
    treated = base.where("origin_score >= 3").groupBy("state", "year", "same_sex").agg(F.sum("perwt").alias("n"))
    controls = base.groupBy("state", "year", "same_sex", (F.col("imm_couple") != "none").alias("immigrant")).agg(F.sum("perwt").alias("n"))
    out = counts.stacked_panel(treated, controls, ["state", "year", "same_sex"], "immigrant", unit=["state", "same_sex", "immigrant"])
    return rounded(out, "n", digits=2)


# -- areas ---------------------------------------------------------------------------------------

_PROFILE = """
prof AS (SELECT state, puma, year, 100 * sum(CASE WHEN educ = 'college' AND age >= 25 THEN perwt ELSE 0 END) / sum(perwt) AS bachelors_puma,
  100 * sum(CASE WHEN citizen >= 2 THEN perwt ELSE 0 END) / sum(perwt) AS immigrant_puma, sum(perwt * inctot) / sum(CASE WHEN inctot IS NOT NULL THEN perwt END) AS inctot_puma,
  sum(perwt * hwsei) / sum(CASE WHEN hwsei IS NOT NULL THEN perwt END) AS hwsei_puma,
  100 * sum(CASE WHEN poverty <= 100 AND poverty <> 0 THEN perwt ELSE 0 END) / sum(perwt) AS poverty_100_puma, avg(density) AS density_puma, count(age) AS n,
  sum(perwt * age) / sum(perwt) AS age_puma, sum(perwt) AS sw, sum(perwt * perwt) AS sww, sum(perwt * perwt * age) AS swwx, sum(perwt * perwt * age * age) AS swwxx FROM clean GROUP BY ALL)"""
_PCOLS = ["bachelors_puma", "immigrant_puma", "inctot_puma", "hwsei_puma", "poverty_100_puma", "density_puma", "age_puma"]


def profiles(spark, sf):
    return areas.area_profiles(clean_persons(spark, sf))


@query("q_area_profiles", f"""WITH {CLEAN_SQL}, {_PROFILE}
SELECT state, puma, year, {', '.join(f'{q(c, 4)} AS {c}' for c in _PCOLS)},
  CASE WHEN n > 1 THEN {q('sqrt(greatest(n / ((n - 1) * sw * sw) * (swwxx - 2 * age_puma * swwx + age_puma * age_puma * sww), 0))', 4)} END AS age_puma_se FROM prof""")
def area_profiles(spark, sf):
    return rounded(profiles(spark, sf).select("state", "puma", "year", *_PCOLS, "age_puma_se"), *_PCOLS, "age_puma_se", digits=4)


_SHARES = {"black": "race = 2", "hispanic": "hispan <> 0", "owned": "ownershp = 1", "poverty_200": "poverty <= 200 AND poverty <> 0", "unemployed": "empstat = 2 AND age >= 25",
           "poverty_100": "poverty <= 100 AND poverty <> 0"}
_MEANS = ["inctot", "hwsei", "valueh", "rent", "costelec"]


def _measures_sql() -> str:
    values = {k: f"CASE WHEN {c} THEN 100.0 WHEN NOT ({c}) THEN 0.0 END" for k, c in _SHARES.items()} | {c: c for c in _MEANS}
    sums = ", ".join(f"count({v}) AS n_{k}, sum(CASE WHEN {v} IS NOT NULL THEN perwt END) AS w_{k}, sum(perwt * {v}) / sum(CASE WHEN {v} IS NOT NULL THEN perwt END) AS m_{k}, "
                     f"sum(CASE WHEN {v} IS NOT NULL THEN perwt * perwt END) AS a_{k}, sum(perwt * perwt * {v}) AS b_{k}, sum(perwt * perwt * {v} * {v}) AS c_{k}" for k, v in values.items())
    se = lambda k: f"CASE WHEN n_{k} > 1 THEN sqrt(greatest(n_{k} / ((n_{k} - 1.0) * w_{k} * w_{k}) * (c_{k} - 2 * m_{k} * b_{k} + m_{k} * m_{k} * a_{k}), 0)) END"
    cols = ", ".join(f"{q(f'm_{k}', 7 if k in _SHARES else 4)} AS {k}_puma, {q(se(k), 2)} AS {k}_puma_se" for k in values)
    return f"""WITH {CLEAN_SQL}, s AS (SELECT state, puma, year, {sums} FROM clean GROUP BY ALL)
SELECT state, puma, year, {cols}, {q('CASE WHEN m_inctot > 0 THEN ln(m_inctot) END')} AS log_inctot_puma, {q(f'{se("inctot")} / nullif(abs(m_inctot), 0)', 4)} AS log_inctot_puma_se FROM s"""


@query("q_area_measures", _measures_sql())
def area_measures(spark, sf):
    """The other shares and means of an area, each with its error."""
    names = [f"{k}_puma" for k in [*_SHARES, *_MEANS]]
    out = profiles(spark, sf).select("state", "puma", "year", *names, *[f"{c}_se" for c in names], "log_inctot_puma", "log_inctot_puma_se")
    out = rounded(rounded(out, *[f"{k}_puma" for k in _SHARES], digits=7), *[f"{k}_puma" for k in _MEANS], digits=4)
    out = rounded(out, *[f"{c}_se" for c in names], digits=2)
    return rounded(rounded(out, "log_inctot_puma"), "log_inctot_puma_se", digits=4)


_NP = """
fine AS (SELECT lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(5, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') AS zip, p_partkey % 300 AS tract, 0.7 AS ratio FROM part
         UNION ALL SELECT lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(5, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0'), (p_partkey * 7) % 300, 0.3 FROM part),
coarse AS (SELECT DISTINCT tract, concat('STATE_', tract % 25) AS state, CAST(tract % 6 AS INTEGER) AS puma FROM fine),
zc AS (SELECT zip, state, puma, sum(ratio) AS ratio FROM fine JOIN coarse USING (tract) GROUP BY ALL),
np AS (SELECT CAST(2008 + 2 * (least(year(l_shipdate), 2000) - 1995) AS INTEGER) AS year, l_partkey, sum(l_linenumber) AS v FROM lineitem GROUP BY ALL),
np2 AS (SELECT * FROM np UNION ALL SELECT 2020, l_partkey, v FROM np WHERE year = 2018),
alloc AS (SELECT year, state, puma, sum(v * ratio) AS lgbt_np FROM np2 JOIN zc ON zip = lpad(CAST(l_partkey AS VARCHAR), CAST(greatest(5, length(CAST(l_partkey AS VARCHAR))) AS INTEGER), '0') GROUP BY ALL)"""


def allocated(spark, sf):
    p = table(spark, sf, "part")
    from ..functions import pad0
    fine = p.select(pad0("p_partkey", 5).alias("zip"), F.inline(F.array(
        F.struct((F.col("p_partkey") % 300).alias("tract"), F.lit(0.7).alias("ratio")),
        F.struct((F.col("p_partkey") * 7 % 300).alias("tract"), F.lit(0.3).alias("ratio")))))
    coarse = fine.select("tract", F.concat(F.lit("STATE_"), (F.col("tract") % 25).cast("string")).alias("state"),
                         (F.col("tract") % 6).cast("int").alias("puma")).distinct()
    year = F.least(F.year("l_shipdate"), F.lit(2000))
    points = table(spark, sf, "lineitem").groupBy((2008 + 2 * (year - 1995)).cast("int").alias("year"), "l_partkey").agg(
        F.sum("l_linenumber").alias("lgbt_np"))
    return areas.allocate_counts(points, "l_partkey", fine, coarse, "lgbt_np", 2018, [2020])


@query("q_nonprofit_areas", f"WITH {_NP} SELECT year, state, puma, {q('lgbt_np', 4)} AS lgbt_np FROM alloc")
def nonprofit_areas(spark, sf):
    return rounded(allocated(spark, sf), "lgbt_np", digits=4)


@query("q_area_table", f"""WITH {CLEAN_SQL}, {_PROFILE}, {_NP}, {_STATE}
SELECT state, puma, year, {q('age_puma', 4)} AS age_puma, state_policy, {q('coalesce(lgbt_np, 0)', 4)} AS lgbt_np
FROM prof LEFT JOIN policy USING (state, year) LEFT JOIN alloc USING (state, puma, year)""")
def area_table(spark, sf):
    out = areas.attach_area(profiles(spark, sf), policy_table(spark, sf).select("state", "year", "state_policy"), {"lgbt_np": allocated(spark, sf)})
    return rounded(out.select("state", "puma", "year", "age_puma", "state_policy", "lgbt_np"), "age_puma", "lgbt_np", digits=4)


_GEO = """
geo AS (SELECT *, CASE WHEN imm_couple = 'none' THEN 'Same-sex, non-immigrant' WHEN same_sex THEN 'Same-sex, immigrant' ELSE 'Different-sex, immigrant' END AS "group"
  FROM (SELECT * FROM member WHERE yrimmig IS NOT NULL UNION ALL SELECT * FROM member WHERE same_sex AND imm_couple = 'none') WHERE age BETWEEN 18 AND 64)"""


@query("q_geo_persons", f"""WITH {MEMBERS_SQL}, {_GEO}, {_PROFILE}
SELECT "group", year, count(*) AS n, {q('sum(perwt)', 2)} AS w, {q('avg(CASE WHEN yrimmig < 1991 THEN 1991 ELSE yrimmig END)', 4)} AS yrimmig,
  {q('sum(perwt * bachelors_puma) / sum(perwt)', 4)} AS bachelors_puma FROM geo LEFT JOIN (SELECT state, puma, year, bachelors_puma FROM prof) USING (state, puma, year) GROUP BY ALL""")
def geo_persons(spark, sf):
    rows = areas.geo_persons(couple_rows(spark, sf), profiles(spark, sf).select("state", "puma", "year", "bachelors_puma"))
    return rows.groupBy("group", "year").agg(
        F.count("*").alias("n"), r(F.sum("perwt"), 2).alias("w"), r(F.avg("yrimmig"), 4).alias("yrimmig"),
        r(wmean("bachelors_puma", "perwt"), 4).alias("bachelors_puma"))


# -- rankings --------------------------------------------------------------------------------------


def _ranked(spark, sf, by):
    rows, _ = individual(spark, sf)
    return stage(rows.where("yrimmig >= 1991").select(by, "same_sex", "perwt", "cluster", "origin_score", "state_policy"))


@query("q_origin_ranking", f"""WITH {MEMBERS_SQL}, {_IND}, u AS (SELECT * FROM ind WHERE NOT allocated AND yrimmig >= 1991),
i AS (SELECT bpld, count(*) AS n, count(*) FILTER (WHERE same_sex) AS n_same_sex, sum(CASE WHEN same_sex THEN perwt ELSE 0 END) / sum(perwt) AS p FROM u GROUP BY bpld)
SELECT bpld, n, n_same_sex, {q('100 * p')} AS coef FROM i""")
def origin_ranking(spark, sf):
    tab = rankings.survey_ranking(_ranked(spark, sf, "bpld"), "bpld", "same_sex", "perwt", "cluster", "origin_score")
    return rounded(tab.select("bpld", "n", "n_same_sex", "coef"), "coef")


@query("q_state_ranking_top10")
def state_ranking_top10(spark, sf):
    """Formatted top ten with interval text."""
    tab = rankings.survey_ranking(_ranked(spark, sf, "state"), "state", "same_sex", "perwt", "cluster", "state_policy", balance=False)
    return rankings.format_ranking(tab, "state", "state_policy")


@query("q_state_period_means", f"""WITH {MEMBERS_SQL}, s AS (SELECT state, year, sum(CASE WHEN same_sex THEN perwt ELSE 0 END) / sum(perwt) AS p FROM imm GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT state FROM s WHERE p > 0), (SELECT DISTINCT year FROM s WHERE p > 0))
SELECT CASE WHEN year < 2013 THEN '2008-2012' WHEN year <= 2017 THEN '2013-2017' ELSE '2018-2023' END AS year_cat, state, {q('100 * avg(coalesce(p, 0))')} AS prop
FROM g LEFT JOIN s USING (state, year) GROUP BY ALL""")
def state_period_means(spark, sf):
    imm = immigrant_members(spark, sf).select("state", "year", "same_sex", "perwt")
    out = rankings.state_period_means(stage(imm), "perwt", "same_sex", "state", "year",
                                      {"2008-2012": range(2008, 2013), "2013-2017": range(2013, 2018), "2018-2023": range(2018, 2024)})
    return rounded(out, "prop")
