"""Recoding of coded survey columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from .nulls import col, isin


def recode(c: Column | str, mapping: Mapping, default=None) -> Column:
    """Dictionary recode; values without an entry keep their own value, or take ``default``."""
    c = col(c)
    flat = [F.lit(x) for pair in mapping.items() for x in pair]
    found = F.try_element_at(F.create_map(*flat), c)
    return F.coalesce(found, c if default is None else F.lit(default))


def sentinel_null(c: Column | str, *codes, ge=None) -> Column:
    """Null out reserved codes, and everything from ``ge`` upward."""
    c = col(c)
    bad = F.lit(False)
    if codes:
        bad = bad | c.isin(list(codes))
    if ge is not None:
        bad = bad | (c >= F.lit(ge))
    return F.when(~bad, c)


def harmonise(c: Column | str, groups: Mapping) -> Column:
    """Send each listed set of codes to one code; ``groups`` is ``{target: [codes]}``."""
    c = col(c)
    out = c
    for target, codes in groups.items():
        out = F.when(isin(c, codes), F.lit(target)).otherwise(out)
    return out


def deflated(c: Column | str, index: Column | str, scale: float = 1.0) -> Column:
    return col(c) * col(index) * F.lit(float(scale))


def floor_bin(c: Column | str, k: int) -> Column:
    """Lower edge of the k-wide bin."""
    return (F.floor(col(c) / F.lit(k)) * F.lit(k)).cast("int")


def clamp_low(c: Column | str, low) -> Column:
    """Raise values below ``low`` to it; null stays null."""
    c = col(c)
    return F.when(c < F.lit(low), F.lit(low)).otherwise(c)


def fallback(a: Column | str, b: Column | str) -> Column:
    """``a``, or ``b`` where ``a`` is null."""
    return F.coalesce(col(a), col(b))


def signed_sum(plus: Sequence[str], minus: Sequence[str] = ()) -> Column:
    """Additive index of 0/1 components, nulls counting as 0."""
    out = F.lit(0)
    for c in plus:
        out = out + F.coalesce(F.col(c), F.lit(0))
    for c in minus:
        out = out - F.coalesce(F.col(c), F.lit(0))
    return out


def ihs(c: Column | str) -> Column:
    """Inverse hyperbolic sine of the non-negative part."""
    c = col(c)
    return F.asinh(F.when(c >= 0, c).when(c.isNotNull(), F.lit(0)).cast("double"))


def log1p_income(c: Column | str) -> Column:
    c = col(c)
    return F.log1p(F.when(c >= 0, c).when(c.isNotNull(), F.lit(0)).cast("double"))


def no_income(c: Column | str) -> Column:
    return col(c) <= 0


def valid_when(c: Column | str, cond: Column) -> Column:
    """Keep a value only inside its validity window (an unknown window keeps nothing)."""
    return F.when(cond, col(c))
