"""Aggregate expressions that stay inside one JVM hash aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .nulls import col


def _dbl(c: Column | str) -> Column:
    return col(c).cast("double")


def _w(x: Column, w: Column | str) -> Column:
    return F.when(x.isNotNull(), _dbl(w))


def wmean(x: Column | str, w: Column | str) -> Column:
    """Weighted mean over rows whose value is known."""
    x = _dbl(x)
    return F.try_divide(F.sum(x * _dbl(w)), F.sum(_w(x, w)))


def wpct(cond: Column, w: Column | str) -> Column:
    """Weighted percent of a predicate; rows with an unknown predicate leave both sums."""
    return F.lit(100.0) * wmean(cond.cast("double"), w)


def centers(df: DataFrame, *cols: Column | str) -> list[Column]:
    """Means of columns as one scalar subquery, 0 where nothing is known: offsets that keep sums of squares from cancelling."""
    row = df.agg(F.struct(*[F.coalesce(F.avg(_dbl(c)), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(cols)]).alias("row")).scalar()
    return [row.getField(f"c{i}") for i in range(len(cols))]


def wvar(x: Column | str, w: Column | str, center: Column | float = 0.0) -> Column:
    """Weighted population variance. Give a ``center`` near the mean for a column of a large level."""
    x = _dbl(x) - (center if isinstance(center, Column) else F.lit(center))
    m = wmean(x, w)
    return F.greatest(F.try_divide(F.sum(x * x * _dbl(w)), F.sum(_w(x, w))) - m * m, F.lit(0.0))


def cochran_var(x: Column | str, w: Column | str, center: Column | float = 0.0) -> Column:
    """Variance of a weighted mean, ``n/(n-1) * sum w^2 (x-m)^2 / (sum w)^2``.

    The three-term textbook form collapses to this one, so five sums in a single
    aggregate are enough. Null with fewer than two known values. Give a ``center`` near the
    mean for a column of a large level.
    """
    x, wt = _dbl(x) - (center if isinstance(center, Column) else F.lit(center)), _dbl(w)
    ww = _w(x, w)
    n = F.count(x).cast("double")
    sw = F.sum(ww)
    m = F.try_divide(F.sum(x * wt), sw)
    ss = F.sum(wt * wt * x * x) - F.lit(2.0) * m * F.sum(wt * wt * x) + m * m * F.sum(ww * ww)
    return F.try_divide(n * F.greatest(ss, F.lit(0.0)), (n - 1) * sw * sw)


def log_se(mean: Column | str, se: Column | str) -> Column:
    """Delta-method standard error of a log mean."""
    return F.abs(F.try_divide(_dbl(se), _dbl(mean)))


def ratio_pct(num: Column | str, den: Column | str) -> Column:
    """Percent of two numbers or aggregates, null where the denominator is 0."""
    return F.lit(100.0) * F.try_divide(_dbl(num), _dbl(den))


def growth_pct(now: Column | str, before: Column | str) -> Column:
    return F.lit(100.0) * F.try_divide(_dbl(now) - _dbl(before), _dbl(before))


def mean_ci(x: Column | str, z: float = 1.96) -> list[Column]:
    """Mean, standard error over all rows of the group, and the normal interval.

    As in the usual ``sd / sqrt(n())`` recipe, n counts rows, known or not.
    """
    x = _dbl(x)
    m = F.avg(x)
    se = F.try_divide(F.stddev_samp(x), F.sqrt(F.count(F.lit(1)).cast("double")))
    return [m.alias("mean"), se.alias("se"), (m - z * se).alias("lower"), (m + z * se).alias("upper")]


def logistic(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_dbl(x)))


def logit(p: Column | str) -> Column:
    p = _dbl(p)
    return F.ln(F.try_divide(p, F.lit(1.0) - p))


def pct_effect(b: Column | str) -> Column:
    """Percent change that a log-link coefficient stands for."""
    return F.lit(100.0) * F.expm1(_dbl(b))
