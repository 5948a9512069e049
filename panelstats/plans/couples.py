"""Person microdata to couples and back.

Expected columns: one row per person and year with household key ``year, serial``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import harmonise, if_else, isin, sentinel_null
from ..operators.reshape import pair_long, pair_wide

# Census relationship, citizenship and income codes.
HEAD = 101
PARTNERS = [201, 1114]
SPOUSE = 201
NOT_IMMIGRANT = [0, 1]
IMMIGRANT = [2, 3]
NOT_A_CITIZEN = 3
INCOME_MISSING = 9999999
EDUCATION_BINS = {"< HS": [0, 1, 2, 3, 4, 5], "HS": [6], "some col": [7, 8, 9], "college": [10, 11]}
SKIPPED_YEAR = 2020


def education(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = None
    for label, codes in EDUCATION_BINS.items():
        out = F.when(c.isin(codes), label) if out is None else out.when(c.isin(codes), label)
    return out


def clean_microdata(df: DataFrame, money: Sequence[str] = ("inctot", "ftotinc"), price: float = 1.0,
                    missing_from: int | None = None, merge_origins: Mapping | None = None) -> DataFrame:
    """Roles, null codes, deflated money in thousands, education bins, merged origins.

    ``missing_from`` nulls every money code from that value up; otherwise only the exact code.
    """
    role = F.when(F.col("related") == HEAD, "main").when(F.col("related").isin(PARTNERS), "partner")
    new = {"position": role, "yrimmig": sentinel_null("yrimmig", 0)}
    for m in money:
        known = sentinel_null(m, ge=missing_from) if missing_from else sentinel_null(m, INCOME_MISSING)
        if m == "valueh":
            known = sentinel_null(known, 0)
        new[m] = known * F.col("cpi99") * F.lit(price / 1000.0)
    for score in ("hwsei", "occscore"):
        if score in df.columns:
            new[score] = sentinel_null(score, 0)
    new["educ"] = education("educ")
    new["hhid"] = F.concat_ws("_", F.col("year").cast("string"), F.col("serial").cast("string"))
    if merge_origins:
        new["bpldid"] = harmonise("bpldid", merge_origins)
    return df.withColumns(new).where(F.col("year") != SKIPPED_YEAR)


def couples(df: DataFrame, household: Sequence[str], person: Sequence[str],
            first_by: Sequence[str] | None = None, adult_entry: int = 18) -> DataFrame:
    """One row per couple with pair flags, kept if both members came as adults or are native."""
    entered_adult = (F.col("age") - (F.col("year") - F.col("yrimmig")) >= adult_entry)
    members = df.where(F.col("position").isNotNull() & (entered_adult | F.col("yrimmig").isNull()))
    wide = pair_wide(members, household, "position", ["main", "partner"], list(person), first_by=first_by)
    wide = wide.where(F.col("sex_main").isNotNull() & F.col("sex_partner").isNotNull())
    return pair_flags(wide)


def pair_flags(wide: DataFrame) -> DataFrame:
    """Same sex, immigrant members, married, and whether a defining answer was imputed."""
    main, partner = F.col("citizen_main"), F.col("citizen_partner")
    native = isin(main, NOT_IMMIGRANT) & isin(partner, NOT_IMMIGRANT)
    both = isin(main, IMMIGRANT) & isin(partner, IMMIGRANT)
    any_imm = isin(main, IMMIGRANT) | isin(partner, IMMIGRANT)
    imputed = None
    for c in ("qrelate_main", "qrelate_partner", "qsex_main", "qsex_partner"):
        test = F.col(c) == "allocated"
        imputed = test if imputed is None else imputed | test
    return wide.withColumns({
        "same_sex": F.col("sex_main") == F.col("sex_partner"),
        "imm_couple": F.when(native, "none").when(both, "two").when(any_imm, "one"),
        "married": (F.col("related_partner") == SPOUSE)
                   | (F.col("qrelate_partner") == "same sex spouse changed to unmarried partner"),
        "allocated": imputed,
    })


def immigrant_label(c: Column | str = "citizen") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(isin(c, NOT_IMMIGRANT), "nonimmigrant").when(isin(c, IMMIGRANT), "immigrant")


def one_immigrant(wide: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Couples with one immigrant, columns by status instead of role, and the partner's relation.

    Both members are already in the row, so the change of sides is a choice per column.
    """
    one = wide.where(F.col("imm_couple") == "one")
    main_is = immigrant_label("citizen_main") == "immigrant"
    cols = []
    for v in values:
        m, p = F.col(f"{v}_main"), F.col(f"{v}_partner")
        cols += [F.when(main_is, m).otherwise(p).alias(f"{v}_immigrant"),
                 F.when(main_is, p).otherwise(m).alias(f"{v}_nonimmigrant")]
    place = F.when(main_is, F.lit("main")).otherwise(F.lit("partner"))
    # the main member is the head, so the couple's relation is what the other one answered
    return one.select(*ids, *cols, place.alias("position_immigrant"), F.col("related_partner").alias("relation"))


def couple_persons(wide: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Immigrant members of couples as rows, with years since entry."""
    some = wide.where(F.col("imm_couple").isin("one", "two"))
    long = pair_long(some, ["main", "partner"], "position", ids)
    return (long.withColumn("immigrant", immigrant_label()).where(F.col("immigrant") == "immigrant")
            .withColumn("years_in_us", F.col("year") - F.col("yrimmig")))


def origin_fallback(wide: DataFrame) -> DataFrame:
    """Origin and entry year of each member, a native member taking the immigrant partner's."""
    new = {}
    for a, b in (("main", "partner"), ("partner", "main")):
        borrow = F.col(f"yrimmig_{a}").isNull() & F.col(f"yrimmig_{b}").isNotNull()
        new[f"bpldnew_{a}"] = if_else(borrow, F.col(f"bpld_{b}"), F.col(f"bpld_{a}"))
        new[f"bpldidnew_{a}"] = if_else(borrow, F.col(f"bpldid_{b}"), F.col(f"bpldid_{a}"))
        new[f"yrimmigmod_{a}"] = F.coalesce(f"yrimmig_{a}", f"yrimmig_{b}")
    return wide.withColumns(new)


def citizenship_flags(wide: DataFrame) -> DataFrame:
    """Mixed citizenship (exactly one non-citizen) and any non-citizen."""
    a, b = F.col("citizen_main") == NOT_A_CITIZEN, F.col("citizen_partner") == NOT_A_CITIZEN
    return wide.withColumns({"mixed_citizenship": (a & ~b) | (~a & b), "noncit": a | b})
