"""Registry and the shared views that stand in for survey data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` and, where one exists, the SQL that must agree with it."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    """Round for comparison; adding 0 removes a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in cols})


def q(expr: str, digits: int = 6) -> str:
    """SQL twin of :func:`r`."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


# Order lines as survey rows: weight = quantity, state = supplier nation, year of shipping, two flags.
LINES_SQL = """
li AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
         l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS year, s_nationkey AS state,
         l_returnflag = 'R' AS same_sex, l_linestatus = 'F' AS mixed
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    sup = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return (li.join(sup, li.l_suppkey == sup.s_suppkey)
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                    F.year("l_shipdate").alias("year"), F.col("s_nationkey").alias("state"),
                    (F.col("l_returnflag") == "R").alias("same_sex"), (F.col("l_linestatus") == "F").alias("mixed")))


# Order lines as coded person records: household = order, member = line 1 or 2. One text for both engines.
PERSONS_SELECT = """
  SELECT CAST(2008 + 2 * (year(o_orderdate) - 1995) AS INTEGER) AS year, o_orderkey AS serial,
         l_partkey, l_suppkey, l_extendedprice,
         CAST(CASE WHEN l_linenumber = 1 THEN 101
                   WHEN l_linenumber = 2 AND l_linestatus = 'F' THEN 201
                   WHEN l_linenumber = 2 THEN 1114 ELSE 301 END AS INTEGER) AS related,
         CAST(1 + l_partkey % 2 AS INTEGER) AS sex,
         CAST(15 + l_quantity AS INTEGER) AS age,
         CAST(CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE 1982 + l_partkey % 26 END AS INTEGER) AS yrimmig,
         CAST(o_orderkey % 4 AS INTEGER) AS nchild,
         CAST(CASE WHEN l_suppkey % 2 = 0 THEN -1 ELSE s_nationkey END AS INTEGER) AS bpldid,
         CASE WHEN l_suppkey % 2 = 0 THEN 'native' ELSE concat('ORIGIN_', CAST(s_nationkey AS VARCHAR(9))) END AS bpld,
         concat('STATE_', CAST(c_nationkey AS VARCHAR(9))) AS state,
         CAST(o_custkey % 6 AS INTEGER) AS puma,
         CAST(CASE WHEN l_suppkey % 2 = 0 THEN (CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE 0 END)
                   ELSE 2 + l_partkey % 3 % 2 END AS INTEGER) AS citizen,
         CAST(l_partkey % 12 AS INTEGER) AS educ,
         CASE WHEN l_partkey % 50 = 0 THEN 9999999.0 ELSE l_extendedprice - 20000.0 END AS inctot,
         CASE WHEN o_orderkey % 60 = 0 THEN 9999999.0 ELSE o_totalprice END AS ftotinc,
         CASE WHEN l_partkey % 40 = 0 THEN 0.0 ELSE l_extendedprice * 4.0 END AS valueh,
         0.5 + (year(o_orderdate) - 1995) / 16.0 AS cpi99,
         CAST(l_partkey % 90 AS DOUBLE) AS hwsei, CAST(l_suppkey % 45 AS DOUBLE) AS occscore,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Mail' WHEN '2-HIGH' THEN 'Internet' ELSE 'CATI/CAPI' END AS respmode,
         CASE WHEN l_tax = 0.0 THEN 'allocated' ELSE 'entered' END AS qrelate,
         CASE WHEN l_tax = 0.08 THEN 'allocated' ELSE 'entered' END AS qsex,
         CASE WHEN l_discount = 0.01 THEN 'allocated' ELSE 'entered' END AS qcitizen,
         CASE WHEN l_discount = 0.02 THEN 'consistency edit' ELSE 'entered' END AS qeduc,
         CAST(1 + l_partkey % 7 AS INTEGER) AS race, CAST(l_suppkey % 5 AS INTEGER) AS hispan,
         CAST(1 + l_orderkey % 2 AS INTEGER) AS ownershp, CAST(l_partkey % 500 AS INTEGER) AS poverty,
         CAST(1 + l_partkey % 3 AS INTEGER) AS empstat,
         CAST(l_partkey % 1500 AS DOUBLE) AS rent, CAST(l_partkey % 2500 AS DOUBLE) AS costelec,
         CAST(100 + o_custkey % 900 AS DOUBLE) AS density,
         CAST(CASE WHEN l_linestatus = 'F' THEN 1980 + l_partkey % 30 ELSE NULL END AS INTEGER) AS yrmarr,
         l_quantity AS perwt, CAST(1 + o_orderkey % 50 AS DOUBLE) AS hhwt, o_orderkey AS cluster
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
       JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey"""

PERSONS_SQL = "p AS (" + PERSONS_SELECT.format(
    lineitem="lineitem", orders="orders", customer="customer", supplier="supplier") + ")"


def person_records(spark: SparkSession, sf: str) -> DataFrame:
    names = ("orders", "customer", "supplier")
    rows = table(spark, sf, "lineitem")
    return spark.sql(PERSONS_SELECT, lineitem=rows, **{n: table(spark, sf, n) for n in names})


# Cleaned records: the same text serves the oracles of the study tables.
CLEAN_SQL = PERSONS_SQL + """,
clean AS (
  SELECT * EXCLUDE (yrimmig, inctot, ftotinc, hwsei, occscore, educ, valueh),
         CASE related WHEN 101 THEN 'main' WHEN 201 THEN 'partner' WHEN 1114 THEN 'partner' END AS position,
         CASE WHEN yrimmig <> 0 THEN yrimmig END AS yrimmig,
         CASE WHEN inctot <> 9999999 THEN inctot * cpi99 / 1000 END AS inctot,
         CASE WHEN ftotinc <> 9999999 THEN ftotinc * cpi99 / 1000 END AS ftotinc,
         CASE WHEN valueh <> 9999999 AND valueh <> 0 THEN valueh * cpi99 / 1000 END AS valueh,
         CASE WHEN hwsei <> 0 THEN hwsei END AS hwsei, CASE WHEN occscore <> 0 THEN occscore END AS occscore,
         CASE WHEN educ <= 5 THEN '< HS' WHEN educ = 6 THEN 'HS' WHEN educ <= 9 THEN 'some col'
              ELSE 'college' END AS educ
  FROM p WHERE year <> 2020
)"""

PERSON_COLS = ["sex", "related", "yrimmig", "bpld", "bpldid", "citizen", "educ", "inctot", "hwsei", "age", "perwt",
               "qrelate", "qsex", "qcitizen", "qeduc", "race", "yrmarr"]
HOUSEHOLD = ["year", "serial", "nchild", "hhwt", "cluster", "state", "puma", "respmode", "density"]
FIRST_BY = ["l_partkey", "l_suppkey", "l_extendedprice"]

# Couples: the first record of each role by FIRST_BY, all values as tie-break, flags added.
_order = ", ".join([*FIRST_BY, *PERSON_COLS])
COUPLES_SQL = CLEAN_SQL + f""",
adult AS (
  SELECT *, row_number() OVER (PARTITION BY {', '.join(HOUSEHOLD)}, position ORDER BY {_order}) AS rn
  FROM clean WHERE position IS NOT NULL AND (yrimmig IS NULL OR age - (year - yrimmig) >= 18)
),
wide AS (
  SELECT {', '.join('a.' + h for h in HOUSEHOLD)},
         {', '.join(f'a.{c} AS {c}_main, b.{c} AS {c}_partner' for c in PERSON_COLS)}
  FROM adult a JOIN adult b ON a.serial = b.serial AND a.year = b.year AND a.rn = 1 AND b.rn = 1
       AND a.position = 'main' AND b.position = 'partner'
),
couples AS (
  SELECT *, sex_main = sex_partner AS same_sex,
         CASE WHEN citizen_main < 2 AND citizen_partner < 2 THEN 'none'
              WHEN citizen_main >= 2 AND citizen_partner >= 2 THEN 'two' ELSE 'one' END AS imm_couple,
         related_partner = 201 AS married,
         (qrelate_main = 'allocated' OR qrelate_partner = 'allocated' OR qsex_main = 'allocated'
          OR qsex_partner = 'allocated') AS allocated
  FROM wide
)"""


def _side(s: str) -> str:
    return ", ".join(f"{c}_{s} AS {c}" for c in PERSON_COLS)


MEMBERS_SQL = COUPLES_SQL + f""",
member AS (
  SELECT {', '.join(HOUSEHOLD)}, same_sex, imm_couple, married, allocated, 'main' AS position, {_side('main')} FROM couples
  UNION ALL
  SELECT {', '.join(HOUSEHOLD)}, same_sex, imm_couple, married, allocated, 'partner' AS position, {_side('partner')} FROM couples
),
imm AS (SELECT *, year - yrimmig AS years_in_us FROM member WHERE imm_couple <> 'none' AND citizen >= 2)"""


def clean_persons(spark: SparkSession, sf: str) -> DataFrame:
    from ..plans.couples import clean_microdata
    return clean_microdata(person_records(spark, sf), ("inctot", "ftotinc", "valueh"))


def couple_rows(spark: SparkSession, sf: str) -> DataFrame:
    from ..plans.couples import couples
    return couples(clean_persons(spark, sf), HOUSEHOLD, PERSON_COLS, FIRST_BY)


COUPLE_IDS = [*HOUSEHOLD, "same_sex", "imm_couple", "married", "allocated"]


def immigrant_members(spark: SparkSession, sf: str) -> DataFrame:
    from ..plans.couples import couple_persons
    return couple_persons(couple_rows(spark, sf), COUPLE_IDS)
