"""Count bases and balanced count panels for difference designs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clamp_low, paste
from ..operators.joins import rjoin
from ..operators.reshape import bind_rows, complete, pair_long
from ..session import stage
from .couples import citizenship_flags, origin_fallback

POST_YEAR = 2013
FIRST_ENTRY = 1991


def lagged_scores(origin: DataFrame, key: str, time: str, score: str, steps: Sequence[int] = (1, 2, 5)) -> DataFrame:
    """Scores k periods back, ``score_lag{k}``, along a stated time order."""
    from ..operators.panel import shift
    out = origin
    for k in steps:
        out = shift(out, [key], time, score, -k, f"{score}_lag{k}")
    return out


def count_base(wide: DataFrame, ids: Sequence[str], origin: DataFrame | None = None,
               ages: tuple[int, int] = (18, 64)) -> DataFrame:
    """Working-age members of couples with pair flags and the origin score at (bounded) entry."""
    flagged = origin_fallback(citizenship_flags(wide.where(~F.col("allocated"))))
    long = pair_long(flagged, ["main", "partner"], "position",
                     [*ids, "same_sex", "imm_couple", "married", "allocated", "mixed_citizenship", "noncit"])
    base = long.where(F.col("age").between(*ages)).dropna(subset=["state", "year", "same_sex"])
    base = base.withColumn("yrimmigmod", clamp_low("yrimmigmod", FIRST_ENTRY))
    if origin is None:
        return base
    return rjoin(base, origin, {"yrimmigmod": "year", "bpldidnew": "bpldid"})


def good_answers() -> Column:
    """Rows whose citizenship and education were answered, not imputed."""
    return (F.col("qcitizen") != "allocated") & (F.col("qeduc") != "consistency edit") & ~F.col("allocated")


def count_panel(df: DataFrame, condition: str | Column | None = None, keys: Sequence[str] = ("state", "year", "same_sex", "mixed"),
                w: str = "perwt", quality: Column | None = None, covariates: DataFrame | None = None,
                cutoff: int = POST_YEAR, unit: Sequence[str] = ("state", "same_sex", "mixed"),
                time: str = "year") -> DataFrame:
    """Balanced panel of weighted and plain counts under a row condition.

    Rows collapse to cells before anything else; balancing, flags and covariates work on the
    staged cells.
    """
    rows = df
    if condition is not None:
        rows = df.where(F.expr(condition) if isinstance(condition, str) else condition)
    ok = F.coalesce(quality, F.lit(False)) if quality is not None else None
    aggs = [F.sum(w).alias("n"), F.count(F.lit(1)).alias("n_unweighted")]
    if ok is not None:
        aggs += [F.coalesce(F.sum(F.when(ok, F.col(w))), F.lit(0).cast("double")).alias("n_ar"),
                 F.count(F.when(ok, 1)).alias("n_unweighted_ar")]
    cells = stage(rows.groupBy(*keys).agg(*aggs))
    return _finish(complete(cells, list(keys)), covariates, cutoff, unit, time)


def _finish(panel: DataFrame, covariates: DataFrame | None, cutoff: int, unit: Sequence[str], time: str) -> DataFrame:
    panel = panel.withColumns({"post": F.col(time) > cutoff, "group_fe": paste(*unit)})
    return panel if covariates is None else rjoin(panel, covariates)


def policy_trends(base: DataFrame, policies: Sequence[str], keep: str, progressive: Sequence[str],
                  names: Mapping[str, str], w: str = "perwt") -> DataFrame:
    """Counts per year under each single policy, rows of unknown policy counting under all.

    One pass: each row is copied once per policy it counts under and folded at once.
    """
    from ..functions import recode
    hits = F.filter(F.array(*[F.when((F.round(F.col(p)) > 0) | F.col(p).isNull(), F.lit(p)) for p in policies]),
                    lambda x: x.isNotNull())
    rows = base.where(F.expr(keep)).select("year", F.col(w).alias("__w"), F.explode(hits).alias("cat"))
    out = rows.groupBy("year", "cat").agg(F.sum("__w").alias("n"))
    return out.withColumns({"policy_name": recode("cat", names), "progressive": F.col("cat").isin(list(progressive))})


def marriage_gap(base: DataFrame) -> DataFrame:
    """Years from entry to marriage, ``marr_minus_imm``."""
    return base.withColumn("marr_minus_imm", F.expr("yrmarr - yrimmigmod"))


def marriage_split(base: DataFrame, w: str = "perwt", quality: Column | None = None) -> dict[str, DataFrame]:
    """Panels of couples married before or after entry, same-status married couples in both."""
    base, gap = marriage_gap(base), "marr_minus_imm"
    same = "(married and not mixed)"
    return {"before": count_panel(base, f"({gap}) < 0 or {same}", w=w, quality=quality),
            "after": count_panel(base, f"({gap}) >= 0 or {same}", w=w, quality=quality)}


def stacked_panel(treated: DataFrame, controls: DataFrame, keys: Sequence[str], treated_flag: str, value: str = "n",
                  unit: Sequence[str] = (), cutoff: int = POST_YEAR, time: str = "year") -> DataFrame:
    """Treated cells of a subset of origins over a common set of control cells."""
    mine = treated.groupBy(*keys).agg(F.sum(value).alias(value)).withColumn(treated_flag, F.lit(True))
    theirs = (controls.where(~F.col(treated_flag)).groupBy(*keys, treated_flag)
              .agg(F.sum(value).alias(value)))
    return _finish(bind_rows(mine, theirs), None, cutoff, unit, time)


def combo_panels(base: DataFrame, flags: Sequence[str], known: Column, w: str = "perwt",
                 keys: Sequence[str] = ("state", "year", "same_sex", "mixed"),
                 covariates: DataFrame | None = None, cutoff: int = POST_YEAR) -> DataFrame:
    """One balanced panel per observed flag combination, rows of unknown flags in each of them.

    Rows become cells of (combination, key) in one aggregate. The cells of unknown flags are
    then shared out to the combinations: cells are copied, rows are not.
    """
    own = F.coalesce(known, F.lit(False))
    combo = F.when(own, F.concat_ws("", *[F.col(f).cast("int").cast("string") for f in flags]))
    cells = stage(base.groupBy(combo.alias("combo"), *keys).agg(F.sum(w).alias("n"),
                                                               F.count(F.lit(1)).alias("n_unweighted")))
    named = cells.where(F.col("combo").isNotNull())
    ids = named.select("combo").distinct()
    from ..operators.reshape import product
    common = cells.where(F.col("combo").isNull()).drop("combo")
    shared = product([common, ids])
    both = named.unionByName(shared).groupBy("combo", *keys).agg(
        F.sum("n").alias("n"), F.sum("n_unweighted").alias("n_unweighted"))
    full = complete(stage(both), ["combo", *keys])
    return _finish(full, covariates, cutoff, [k for k in keys if k != "year"], "year")
