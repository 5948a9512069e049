"""Small-area profiles and persons with their area."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clamp_low, cochran_var, log_se, pad0, wmean, wpct
from ..operators.joins import allocate, chain_crosswalk, rjoin
from ..operators.reshape import carry_forward, stack_members


def profile_measures() -> tuple[dict[str, Column], dict[str, Column]]:
    """Predicates shown as percents and numbers shown as means."""
    adult = F.col("age") >= 25
    poor = lambda k: (F.col("poverty") <= k) & (F.col("poverty") != 0)
    share = {
        "bachelors": (F.col("educ") == "college") & adult, "black": F.col("race") == 2,
        "hispanic": F.col("hispan") != 0, "owned": F.col("ownershp") == 1,
        "immigrant": F.coalesce(F.col("citizen").isin(2, 3), F.lit(False)),
        "poverty_100": poor(100), "poverty_200": poor(200), "unemployed": (F.col("empstat") == 2) & adult,
    }
    mean = {c: F.col(c) for c in ("inctot", "age", "hwsei", "valueh", "rent", "costelec")}
    return share, mean


def area_profiles(persons: DataFrame, by: Sequence[str] = ("state", "puma", "year"), w: str = "perwt",
                  errors: bool = True) -> DataFrame:
    """Weighted means per area with their Cochran errors, in one aggregate over all rows.

    ``x_var`` is the variance of the mean and ``x_se`` its root. The log of mean income gets its
    error by the delta method.
    """
    share, mean = profile_measures()
    share = {k: c for k, c in share.items()}
    aggs: list[Column] = []
    for k, c in share.items():
        aggs.append(wpct(c, w).alias(f"{k}_puma"))
        if errors:
            aggs.append(cochran_var(100.0 * c.cast("double"), w).alias(f"{k}_puma_var"))
    for k, c in mean.items():
        aggs.append(wmean(c, w).alias(f"{k}_puma"))
        if errors:
            aggs.append(cochran_var(c, w).alias(f"{k}_puma_var"))
    aggs.append(F.avg("density").alias("density_puma"))
    out = persons.groupBy(*by).agg(*aggs)
    out = out.withColumn("log_inctot_puma", F.ln(F.when(F.col("inctot_puma") > 0, F.col("inctot_puma"))))
    if errors:
        out = out.withColumns({f"{k}_puma_se": F.sqrt(f"{k}_puma_var") for k in [*share, *mean]})
        out = out.withColumn("log_inctot_puma_se", log_se("inctot_puma", "inctot_puma_se"))
    return out


def attach_area(profiles: DataFrame, policy: DataFrame, counts: Mapping[str, DataFrame]) -> DataFrame:
    """Area profiles with state policy and allocated counts, an area without any having 0."""
    out = rjoin(profiles, policy, ["state", "year"])
    for name, table in counts.items():
        out = rjoin(out, table.select("state", "puma", "year", name), ["state", "puma", "year"])
        out = out.fillna(0, [name])
    return out


def allocate_counts(points: DataFrame, zip_col: str, fine: DataFrame, coarse: DataFrame, value: str,
                    last_year: int | None = None, to_years: Sequence[int] = ()) -> DataFrame:
    """Counts by postal code spread over areas through the finer crosswalk.

    ``fine`` maps zip to tract with a ratio, ``coarse`` tract to area.
    """
    src = points.withColumn("zip", pad0(zip_col, 5))
    if to_years:
        src = carry_forward(src, "year", last_year, to_years)
    cw = chain_crosswalk(fine, coarse, ["tract"], ["zip"], ["state", "puma"], "ratio")
    return allocate(src, cw, ["zip"], ["state", "puma"], "ratio", [value], keep=["year"])


def group_label() -> Column:
    """The three compared groups of the area study."""
    imm = F.col("imm_couple") != "none"
    return (F.when(~imm, "Same-sex, non-immigrant")
            .when(imm & F.col("same_sex"), "Same-sex, immigrant")
            .when(imm & ~F.col("same_sex"), "Different-sex, immigrant"))


def geo_persons(wide: DataFrame, areas: DataFrame | None = None, first_entry: int = 1991,
                ages: tuple[int, int] = (18, 64)) -> DataFrame:
    """Immigrant members and members of native same-sex couples, one row each, with their area."""
    native = F.col("same_sex") & (F.col("imm_couple") == "none")
    rows = stack_members(wide, [
        ("main", ["partner"], F.col("yrimmig_main").isNotNull()),
        ("partner", ["main"], F.col("yrimmig_partner").isNotNull()),
        ("main", ["partner"], native),
        ("partner", ["main"], native),
    ])
    rows = rows.where(F.col("age").between(*ages)).withColumn("yrimmig", clamp_low("yrimmig", first_entry))
    rows = rows.withColumn("group", group_label())
    return rows if areas is None else rjoin(rows, areas, ["state", "puma", "year"])
