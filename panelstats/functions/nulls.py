"""Null rules that differ between a statistics data frame and SQL.

Predicates follow three-valued logic unless a function here says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def isin(c: Column | str, values: Sequence) -> Column:
    """Set membership that is never null: a null value is a member only if None is listed."""
    c = col(c)
    known = [v for v in values if v is not None]
    hit = F.coalesce(c.isin(known), F.lit(False)) if known else F.lit(False)
    return hit | c.isNull() if len(known) < len(values) else hit


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice whose result is null where the condition is null."""
    return F.when(cond.isNull(), F.lit(None)).when(cond, yes).otherwise(no)


def same(a: Column | str, b: Column | str) -> Column:
    """Both members hold the same value; null if either is unknown."""
    return col(a) == col(b)


def either(a: Column, b: Column) -> Column:
    return a | b


def na_to(c: Column | str, value) -> Column:
    return F.coalesce(col(c), F.lit(value))


def zero_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(0))


def paste(*cols: Column | str, sep: str = "_") -> Column:
    """Concatenate as text; a null prints as ``NA``."""
    parts = [F.coalesce(col(c).cast("string"), F.lit("NA")) for c in cols]
    return F.concat_ws(sep, *parts)


def bround(c: Column | str, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(col(c), digits)


def cut(c: Column | str, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins ``(b0, b1], (b1, b2], ...``; outside all bins (b0 included) is null."""
    if len(labels) != len(breaks) - 1:
        raise ValueError("cut needs one label per interval")
    c = col(c)
    out = None
    for low, high, label in zip(breaks, breaks[1:], labels):
        inside = c > F.lit(float(low))
        if high != float("inf"):
            inside = inside & (c <= F.lit(float(high)))
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def shift_code(c: Column | str, k: int) -> Column:
    """Move an integer time code, as in joining last year's value."""
    return col(c) + F.lit(k)
