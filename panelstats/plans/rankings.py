"""Ranking tables of origins and states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import bround, percent_label, ratio_pct, wmean
from ..operators.joins import rjoin
from ..operators.reshape import complete
from ..operators.survey import SurveyDesign, clip_interval
from ..operators.topk import top_k


def ratio_ranking(df: DataFrame, by: str, same: str, other: str, k: int = 10) -> DataFrame:
    """Percent of the first count per key, the highest k."""
    total = F.sum(F.col(same)) + F.sum(F.col(other))
    pct = df.groupBy(by).agg(F.round(ratio_pct(F.sum(same), total), 2).alias("prop"))
    return top_k(pct, ["-prop", by], k)


def survey_ranking(df: DataFrame, by: str, flag: str, w: str, psu: str, score: str, balance: bool = True) -> DataFrame:
    """Share of flagged persons per key with interval, counts and mean score."""
    design = SurveyDesign(df, w, psu)
    tab = design.prop(flag, [by], ("ci",), unweighted="n_same_sex")
    if balance:
        tab = complete(tab, [by, flag], 0, {flag: [True, False]})
    tab = tab.where(F.col(flag))
    tab = tab.withColumns({c: 100.0 * F.col(c) for c in ("coef", "coef_low", "coef_upp")})
    info = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), bround(wmean(score, w), 1).alias(score))
    return rjoin(tab, info, [by])


def format_ranking(tab: DataFrame, by: str, score: str, k: int = 10) -> DataFrame:
    """Top rows with percent text and an interval whose lower end stops at 0."""
    top = top_k(clip_interval(tab, "coef_low"), ["-coef", by], k)
    text = F.concat(F.lit("("), percent_label("coef_low"), F.lit(", "), percent_label("coef_upp"), F.lit(")"))
    return top.select("rank", by, percent_label("coef").alias("percentage"), text.alias("ci95"), score)


def state_period_means(df: DataFrame, w: str, flag: str, state: str, year: str, classes: dict[str, Sequence[int]]) -> DataFrame:
    """Yearly shares per state averaged within period classes, absent state-years counting as 0."""
    yearly = SurveyDesign(df, w).prop(flag, [state, year], ("se",)).where(F.col(flag)).select(state, year, "coef")
    full = complete(yearly, [state, year])
    label = None
    for name, years in classes.items():
        test = F.col(year).isin(list(years))
        label = F.when(test, name) if label is None else label.when(test, name)
    return full.groupBy(label.alias("year_cat"), state).agg((100.0 * F.avg("coef")).alias("prop"))
