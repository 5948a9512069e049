"""Origin x state x year dyads and entry cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bround, ratio_pct, wmean
from ..operators.agg import adjusted_sum, cond_sum
from ..operators.joins import rjoin

# Published misclassification rates by response mode, the mail rate a mean of two studies.
SPOUSE_RATES = {"Mail": (.59 + .474) / 2, "CATI/CAPI": .46, "Internet": .225}
PARTNER_RATES = {"Mail": (.07 + .056) / 2, "CATI/CAPI": .13, "Internet": .024}
CLEAN_YEAR = 2019
FIRST_ENTRY = 1991


def measures(w: str = "perwt", na: str = "skip", clean_year: int = CLEAN_YEAR) -> dict[str, Column]:
    """Weighted counts of persons in couples by union type and measurement regime, one aggregate's worth."""
    spouse, partner = F.col("married"), ~F.col("married")
    one, two = F.col("imm_couple") == "one", F.col("imm_couple") == "two"
    clean, before = F.col("year") == clean_year, F.col("year") < clean_year
    recent = F.col("year") == F.col("yrimmig") + 1
    out: dict[str, Column] = {"n": F.sum(w)}
    for name, cond in {
        "n_spouse": spouse, "n_partner": partner,
        "n_spouse_oneimm": one & spouse, "n_partner_oneimm": one & partner,
        "n_spouse_twoimm": two & spouse, "n_partner_twoimm": two & partner,
        "n_spouse_2019": spouse & clean, "n_spouse_pre_2019": spouse & before,
        "n_partner_2019": partner & clean, "n_partner_pre_2019": partner & before,
        "n_recent": recent, "n_spouse_recent": spouse & recent, "n_partner_recent": partner & recent,
    }.items():
        out[name] = cond_sum(w, cond, na)
    out["n_spouse_adj"] = _adjusted(w, spouse, clean, before, SPOUSE_RATES, na)
    out["n_partner_adj"] = _adjusted(w, partner, clean, before, PARTNER_RATES, na)
    return out


def _adjusted(w: str, base: Column, clean: Column, before: Column, rates: dict, na: str) -> Column:
    return adjusted_sum(w, base & (clean | before), clean, "respmode", rates, na)


def _split_by_sex(persons: DataFrame, by: Sequence[str], na: str) -> DataFrame:
    """Measures per cell, same-sex and different-sex side by side, gaps 0.

    The sex split rides in the grouping key of a first aggregate and is folded in a second one
    that no longer touches the rows.
    """
    cells = persons.groupBy(*by, "same_sex").agg(*[c.alias(n) for n, c in measures(na=na).items()])
    names = list(measures())
    folded = []
    for n in names:
        for label, flag in (("same_sex", True), ("dif_sex", False)):
            total = F.sum(F.when(F.col("same_sex") == F.lit(flag), F.col(n)))
            folded.append(F.coalesce(total, F.lit(0.0)).alias(f"{n}_{label}"))
    return cells.groupBy(*by).agg(*folded)


def usable(persons: DataFrame, first_entry: int = FIRST_ENTRY) -> DataFrame:
    return persons.where((F.col("yrimmig") >= first_entry) & ~F.col("allocated"))


def dyad_panel(persons: DataFrame, everyone: DataFrame, na: str = "skip") -> DataFrame:
    """Origin x state x year counts with the immigrant stock of the cell and the mean entry year."""
    dyads = _split_by_sex(usable(persons), ["bpld", "state", "year"], na)
    imm = everyone.where(F.col("citizen").isin(2, 3) & (F.col("yrimmig") >= FIRST_ENTRY))
    stock = imm.groupBy("bpld", "state", "year").agg(F.sum("perwt").alias("state_stock_year"))
    entry = (persons.where(F.col("yrimmig") >= FIRST_ENTRY).groupBy("bpld", "year")
             .agg(wmean("yrimmig", "perwt").alias("mean_year_immig")))
    return rjoin(rjoin(dyads, stock), entry)


def entry_totals(everyone: DataFrame) -> DataFrame:
    """Immigrants by origin and entry year, by relation to the head."""
    imm = everyone.where(F.col("citizen").isin(2, 3) & (F.col("yrimmig") >= FIRST_ENTRY))
    w = "perwt"
    return imm.groupBy("bpld", "yrimmig").agg(
        F.sum(w).alias("n_total"),
        cond_sum(w, F.col("related") == 201).alias("n_spouse"),
        cond_sum(w, F.col("related") == 1114).alias("n_partner"),
        cond_sum(w, F.col("year") == F.col("yrimmig") + 1).alias("n_total_recent"))


def entry_cohorts(persons: DataFrame, totals: DataFrame, na: str = "skip") -> DataFrame:
    """Percent in same-sex couples by entry year and origin."""
    cells = _split_by_sex(usable(persons), ["yrimmig", "bpld"], na)
    out = rjoin(cells, totals.select("bpld", "yrimmig", "n_total", "n_total_recent"), ["bpld", "yrimmig"])
    pct = lambda *cols: ratio_pct(sum((F.col(c) for c in cols[1:]), F.col(cols[0])), "n_total")
    return out.withColumns({
        "prop_same_sex": pct("n_spouse_same_sex", "n_partner_same_sex"),
        "prop_spouse_same_sex": pct("n_spouse_same_sex"),
        "prop_partner_same_sex": pct("n_partner_same_sex"),
        "prop_same_sex_adj": pct("n_spouse_adj_same_sex", "n_partner_adj_same_sex"),
        "prop_dif_sex": pct("n_dif_sex"),
        "prop_same_sex_oneimm": pct("n_spouse_oneimm_same_sex", "n_partner_oneimm_same_sex"),
        "prop_same_sex_twoimm": pct("n_spouse_twoimm_same_sex", "n_partner_twoimm_same_sex"),
        "prop_same_sex_recent": ratio_pct(
            F.col("n_spouse_recent_same_sex") + F.col("n_partner_recent_same_sex"), "n_total_recent"),
    })


def recent_dyads(persons: DataFrame, within: int = 1) -> DataFrame:
    """Counts of couples whose immigrant arrived at most ``within`` years before the survey."""
    new = usable(persons).where(F.col("year") - F.col("yrimmig") <= within)
    flag = lambda v: F.coalesce(F.sum(F.when(F.col("same_sex") == F.lit(v), F.col("perwt"))), F.lit(0.0))
    return new.groupBy("bpld", "state", "year").agg(
        flag(True).alias("same_sex_stock"), flag(False).alias("opp_sex_stock"),
        wmean("yrimmig", "perwt").alias("mean_year_immig"))


def state_table(dyads: DataFrame, stock_prop: DataFrame, origin: DataFrame, policy: DataFrame,
                state: DataFrame, need: Sequence[str] = ()) -> DataFrame:
    """Dyads with covariates at entry and survey year, last year's scores, and percents of couples.

    ``origin`` is keyed by (bpld, year) and read at the mean entry year, ``policy`` and ``state``
    by (state, year) at the survey year.
    """
    from ..operators.joins import lag_join
    d = dyads.withColumn("mean_year_immig", bround("mean_year_immig").cast("int"))
    d = d.where(F.col("mean_year_immig") >= FIRST_ENTRY)
    d = rjoin(d, stock_prop, {"mean_year_immig": "year", "bpld": "bpld"})
    d = rjoin(d, origin, {"mean_year_immig": "year", "bpld": "bpld"})
    lagged = origin.select("bpld", F.col("year").alias("mean_year_immig"), "origin_score")
    d = lag_join(d, lagged, ["bpld"], "mean_year_immig", 1)
    d = rjoin(d, policy, ["state", "year"])
    d = lag_join(d, policy.select("state", "year", "state_policy"), ["state"], "year", 1)
    d = rjoin(d, state, ["state", "year"])
    d = d.where(F.col("origin_score").isNotNull())
    total = F.col("n_spouse_same_sex") + F.col("n_partner_same_sex") + F.col("n_dif_sex")
    part = lambda suffix: [F.col(f"n_{u}{suffix}_{s}") for s in ("same_sex", "dif_sex") for u in ("spouse", "partner")]

    def among(suffix: str) -> Column:
        a, b, c, e = part(suffix)
        return ratio_pct(a + b, a + b + c + e)

    d = d.withColumns({
        "n_couples": total,
        "prop_same_sex": ratio_pct(F.col("n_spouse_same_sex") + F.col("n_partner_same_sex"), total),
        "prop_same_sex_adj": ratio_pct(F.col("n_spouse_adj_same_sex") + F.col("n_partner_adj_same_sex"), total),
        "prop_dif_sex": ratio_pct("n_dif_sex", total),
        "prop_same_sex_recent": among("_recent"), "prop_same_sex_oneimm": among("_oneimm"),
        "prop_same_sex_twoimm": among("_twoimm"),
    })
    return d.dropna(subset=list(need)) if need else d


def individual_table(persons: DataFrame, stock_prop: DataFrame, origin: DataFrame, policy: DataFrame,
                     state: DataFrame, need: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Individual analysis rows, and the report of rows lost to imputation by couple type."""
    from ..functions import cut, ihs, no_income
    p = rjoin(persons, stock_prop, {"yrimmig": "year", "bpld": "bpld"})
    p = rjoin(p, origin, {"yrimmig": "year", "bpld": "bpld"})
    p = rjoin(p, policy, ["state", "year"])
    p = rjoin(p, state, ["state", "year"])
    p = p.withColumns({
        "state_policy_binned": cut("state_policy", [-2, 0, 2, float("inf")],
                                   ["Repressive", "Neutral", "Progressive"]),
        "no_income": no_income("inctot"), "ihs_income": ihs("inctot")})
    p = p.dropna(subset=["state_policy_binned", *need])
    report = p.groupBy("same_sex", "allocated").agg(F.count(F.lit(1)).alias("n"))
    return p.where(~F.col("allocated")), report
