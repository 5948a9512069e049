"""Difference designs on count panels: D, DD, DDD and event studies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from .fit import Fit
from .glm import quasi_poisson


def did_formula(y: str, post: str, flags: Sequence[str], unit: str, time: str,
                controls: Sequence[str] = ()) -> str:
    """Product terms of ``post`` with every combination of the flags, then unit and time effects.

    No flag is the simple difference, one the double and two the triple difference. The product
    of all flags comes first and ``post`` after them, so time effects give way to it.
    """
    flags = list(flags)
    products = []
    if len(flags) == 2:
        products = [f"I({post}*{flags[0]}*{flags[1]})"] + [f"I({post}*{f})" for f in flags]
    elif len(flags) == 1:
        products = [f"I({post}*{flags[0]})"]
    elif len(flags) > 2:
        raise ValueError("at most two flags")
    return f"{y} ~ " + " + ".join([*products, post, *controls, f"factor({unit})", f"factor({time})"])


def did(df: DataFrame, y: str, post: str, flags: Sequence[str], unit: str, time: str,
        controls: Sequence[str] = ()) -> Fit:
    """Quasi-Poisson difference design, covariance clustered on the unit."""
    return quasi_poisson(df, did_formula(y, post, flags, unit, time, controls), cluster=[unit]).cluster(unit)


def did_term(post: str, flags: Sequence[str]) -> str:
    return f"I({'*'.join([post, *flags])})" if flags else f"{post}TRUE"


def event_study_formula(y: str, time: str, flags: Sequence[str], unit: str,
                        controls: Sequence[str] = ()) -> str:
    t = f"factor({time})"
    full = ":".join([t, *flags])
    lower = [f"{t}:{f}" for f in flags] if len(flags) > 1 else []
    return f"{y} ~ " + " + ".join([full, *lower, t, f"factor({unit})", *controls])


def event_study(df: DataFrame, y: str, time: str, flags: Sequence[str], unit: str, width: int = 2,
                controls: Sequence[str] = (), first: int | None = None, rebin: bool = True) -> tuple[Fit, list[str]]:
    """Period-by-flag effects on widened periods; gives the fit and the terms of interest.

    Periods are ordered from the last to the first, so the earliest is the one the unit effects
    absorb. With ``rebin`` the counts of a widened period add up and controls average.
    """
    from ..operators.panel import rebin as widen
    if rebin:
        df = widen(df, [*flags, unit], time, width, [y], controls)
    else:
        df = df.withColumn(time, (F.floor(F.col(time) / F.lit(width)) * F.lit(width)).cast("int"))
    seen = sorted((r[0] for r in df.select(time).distinct().collect()), reverse=True)
    if first is not None:
        seen = [first] + [t for t in seen if t != first]
    name = f"factor({time})"
    fit = quasi_poisson(df, event_study_formula(y, time, flags, unit, controls), cluster=[unit],
                        levels={name: seen})
    tail = "".join(f":{f}TRUE" for f in flags)
    return fit, [f"{name}{t}{tail}" for t in seen]


def event_table(fit: Fit, terms: Sequence[str], unit: str) -> DataFrame:
    """Period, estimate and clustered interval of the terms of interest."""
    t = fit.cluster(unit).tidy()
    return (t.where(F.col("term").isin(list(terms)))
            .select(F.regexp_extract("term", r"\d{4}", 0).cast("int").alias("period"),
                    "term", "estimate", "std_error", "conf_low", "conf_high"))


def stratified(df: DataFrame, conditions: Mapping[str, str], fit_one) -> dict[str, Fit]:
    """Re-estimate under several row conditions, given as SQL predicates."""
    return {name: fit_one(df.where(F.expr(cond))) for name, cond in conditions.items()}
