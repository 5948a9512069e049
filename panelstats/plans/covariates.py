"""Origin and state covariates from side tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import clamp_low, cut, first_match, number, signed_sum, slice_code
from ..operators.joins import baseline_diff, deflate, lookup_first, rjoin, share_of_row
from ..operators.agg import share
from ..operators.panel import interpolate
from ..operators.reshape import bind_rows, calendar, carry_forward, years_to_rows

# Signed components of the state policy index.
POLICY_PLUS = ["marriage_equality", "civil_union", "employment_discrim_so", "hate_crime_so", "joint_adoption",
               "conversion_therapy_ban", "housing_discrim_so", "state_ban_local_nondiscrimimation"]
POLICY_MINUS = ["sodomy_illega", "marriage_ban", "adoption_religious_freedom"]


def origin_covariates(economy: DataFrame, unemployment: DataFrame, democracy: DataFrame, distance: DataFrame,
                      schemes: Sequence[tuple[str, DataFrame]], base: str) -> DataFrame:
    """Income and unemployment gaps to the base country, democracy and distance by origin and year.

    ``unemployment`` is wide by year; ``democracy`` carries the identifiers that ``schemes`` translate.
    """
    income = baseline_diff(
        economy.withColumn("pc_income", F.try_divide(F.col("rgdpe").cast("double"), F.col("pop").cast("double"))),
        "year", "iso", base, "pc_income", "wage_dif")
    long = years_to_rows(unemployment, ["iso"], "unemployment")
    gap = baseline_diff(long, "year", "iso", base, "unemployment", "unemp_dif")
    demo = lookup_first(democracy, schemes, "iso").where(F.col("iso").isNotNull())
    demo = demo.groupBy("iso", "year").agg(F.max("democracy").alias("democracy"))
    out = rjoin(income.select("iso", "year", "wage_dif"), gap.select("iso", "year", "unemp_dif"), ["iso", "year"])
    out = rjoin(out, demo, ["iso", "year"])
    return rjoin(out, distance, ["iso"])


def stock_shares(early: DataFrame, late: DataFrame, total_name: str, start: int, stop: int,
                 stock_type: str = "double") -> DataFrame:
    """Yearly share of each origin in the immigrant stock, interpolated between counts.

    ``early`` is wide by year, its total a sum; ``late`` is long with a total row and text numbers.
    """
    e = years_to_rows(early, ["iso"], "n").withColumn("n", F.col("n").cast(stock_type))
    e = share(e, "n", ["year"], "prop")
    l = share_of_row(late.withColumn("n", number("n")), "year", "iso", total_name, "n", "prop")
    known = bind_rows(e.select("iso", "year", "prop"), l.select("iso", "year", "prop")).dropna()
    known = known.groupBy("iso", "year").agg(F.max("prop").alias("prop"))
    frame = rjoin(calendar(known, ["iso"], start, stop), known, ["iso", "year"])
    return interpolate(frame, ["iso"], "year", "prop", "stock_prop").select("iso", "year", "stock_prop")


def policy_index(policy: DataFrame, from_year: int | None = None, to_years: Sequence[int] = (),
                 plus: Sequence[str] = POLICY_PLUS, minus: Sequence[str] = POLICY_MINUS) -> DataFrame:
    """Additive state index with its three bins, optionally carried to later years."""
    out = policy.withColumn("state_policy", signed_sum(plus, minus)).select("state", "year", "state_policy")
    if to_years:
        out = carry_forward(out, "year", from_year, to_years)
    return out.withColumn("state_policy_binned", cut("state_policy", [-2, 0, 2, float("inf")],
                                                     ["Repressive", "Neutral", "Progressive"]))


def series_means(series: DataFrame, kind: str, states: DataFrame) -> DataFrame:
    """Yearly mean of the monthly series of one kind, by state name from the code in the series id."""
    kept = series.where(F.col("series_id").contains(kind))
    kept = kept.withColumn("state_num", first_match("series_id", r"\d\d").cast("int"))
    named = rjoin(kept, states, "state_num")
    return named.groupBy("state", "year").agg(F.avg("value").alias("state_unemploy"))


def state_covariates(policy: DataFrame, unemployment: DataFrame, income: DataFrame, prices: DataFrame,
                     to_year: int, first_year: int | None = None) -> DataFrame:
    """Policy index, unemployment and real income in thousands by state and year."""
    real = deflate(income, prices, "year", ["state_income"], to_year, 1 / 1000)
    if first_year is not None:
        real = real.where(F.col("year") >= first_year)
    return rjoin(rjoin(policy, unemployment, ["state", "year"]), real, ["state", "year"])


def state_series_to_rows(wide: DataFrame, rename: Mapping[str, str], key: str = "state", value: str = "state_income") -> DataFrame:
    from ..functions import recode
    return years_to_rows(wide, [key], value).withColumn(key, recode(key, rename))
