"""Null-safe joins, crosswalk allocation and comparisons with a reference entity.

No join here carries a broadcast hint: side tables stay under Spark's own size check
(``spark.sql.autoBroadcastJoinThreshold``, re-checked by AQE at run time), and a side that
outgrows it falls back to a shuffled join with AQE skew splitting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

Keys = str | Sequence[str] | Mapping[str, str] | None


def _pairs(x: DataFrame, y: DataFrame, by: Keys) -> list[tuple[str, str]]:
    if by is None:
        by = [c for c in x.columns if c in y.columns]
    if isinstance(by, str):
        by = [by]
    pairs = list(by.items()) if isinstance(by, Mapping) else [(c, c) for c in by]
    if not pairs:
        raise ValueError("no join columns")
    return pairs


def rjoin(x: DataFrame, y: DataFrame, by: Keys = None, how: str = "left") -> DataFrame:
    """Equality join in which null keys match null keys.

    ``by`` is a list of shared names, a ``{left: right}`` map, or None for all shared names.
    Key columns appear once, under the left name. Other shared names of the right side get
    the suffix ``_y``.
    """
    pairs = _pairs(x, y, by)
    tmp = {r: f"__key_{i}" for i, (_, r) in enumerate(pairs)}
    taken = set(x.columns)
    y2 = y.select(*[
        F.col(f"`{c}`").alias(tmp[c] if c in tmp else (f"{c}_y" if c in taken else c))
        for c in y.columns
    ])
    cond = None
    for l, r in pairs:
        test = x[l].eqNullSafe(y2[tmp[r]])
        cond = test if cond is None else cond & test
    if how in ("left_semi", "left_anti"):
        return x.join(y2, cond, how)
    out = x.join(y2, cond, how)
    if how in ("outer", "full", "full_outer", "right"):
        key_of = {l: tmp[r] for l, r in pairs}
        cols = [F.coalesce(x[c], y2[key_of[c]]).alias(c) if c in key_of else x[c] for c in x.columns]
        rest = [y2[c] for c in y2.columns if c not in tmp.values()]
        return out.select(*cols, *rest)
    return out.drop(*tmp.values())


def lag_join(x: DataFrame, y: DataFrame, keys: Sequence[str], time: str, k: int = 1,
             suffix: str = "_lag") -> DataFrame:
    """Attach the value that ``y`` held k periods before."""
    values = [c for c in y.columns if c not in (*keys, time)]
    shifted = y.select(*keys, (F.col(time) + F.lit(k)).cast(y.schema[time].dataType).alias(time),
                       *[F.col(c).alias(c + suffix) for c in values])
    return rjoin(x, shifted, [*keys, time])


def event_join(x: DataFrame, y: DataFrame, keys: Mapping[str, str] | Sequence[str],
               event_time: str, time: str) -> DataFrame:
    """Attach covariates as they stood in the row's event year instead of its survey year."""
    keys = dict(keys) if isinstance(keys, Mapping) else {k: k for k in keys}
    return rjoin(x, y, {event_time: time, **keys})


def allocate(df: DataFrame, crosswalk: DataFrame, key: Sequence[str], target: Sequence[str],
             ratio: str, values: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Split values over target areas by ratio and sum them there.

    Values are first summed per source area, so a source that holds most of the rows
    crosses the many-to-many join as one row.
    """
    src = df.groupBy(*keep, *key).agg(*[F.sum(v).alias(v) for v in values])
    cw = crosswalk.select(*key, *target, F.col(ratio).alias("__ratio"))
    joined = rjoin(src, cw, list(key))
    return joined.groupBy(*keep, *target).agg(
        *[F.sum(F.col(v) * F.col("__ratio")).alias(v) for v in values])


def chain_crosswalk(fine: DataFrame, coarse: DataFrame, via: Sequence[str], key: Sequence[str],
                    target: Sequence[str], ratio: str) -> DataFrame:
    """Crosswalk from ``key`` to ``target`` through a finer unit, ratios summed."""
    joined = rjoin(fine, coarse.select(*via, *[t for t in target if t not in via]), list(via))
    return joined.groupBy(*key, *target).agg(F.sum(ratio).alias(ratio))


def lookup_first(df: DataFrame, schemes: Sequence[tuple[str, DataFrame]], out: str) -> DataFrame:
    """Translate an identifier through several lookups, the first that knows it winning.

    Each scheme is ``(column, table)``; a table is two columns, code and translation.
    """
    found: list[Column] = []
    for i, (column, table) in enumerate(schemes):
        code, value = table.columns
        side = (table.where(F.col(code).isNotNull())
                .groupBy(F.col(code).alias(f"__code_{i}")).agg(F.min(value).alias(f"__found_{i}")))
        df = df.join(side, F.col(column) == F.col(f"__code_{i}"), "left").drop(f"__code_{i}")
        found.append(F.col(f"__found_{i}"))
    df = df.withColumn(out, F.coalesce(*found))
    return df.drop(*[f"__found_{i}" for i in range(len(schemes))])


def _reference_row(df: DataFrame, time: str, entity: str, base, value: str, name: str) -> DataFrame:
    return (df.where(F.col(entity) == F.lit(base))
            .groupBy(time).agg(F.max(value).alias(name)))


def baseline_diff(df: DataFrame, time: str, entity: str, base, value: str,
                  out: str | None = None, sign: int = 1) -> DataFrame:
    """Difference to the base entity of the same period (``value - base`` for sign 1)."""
    ref = _reference_row(df, time, entity, base, value, "__base")
    joined = rjoin(df, ref, time)
    return (joined.withColumn(out or f"{value}_dif", F.lit(sign) * (F.col(value) - F.col("__base")))
            .drop("__base"))


def share_of_row(df: DataFrame, time: str, entity: str, total, value: str,
                 out: str = "prop") -> DataFrame:
    """Share of the entity that carries the period's total."""
    ref = _reference_row(df, time, entity, total, value, "__total")
    joined = rjoin(df, ref, time)
    return joined.withColumn(out, F.try_divide(F.col(value), F.col("__total"))).drop("__total")


def deflate(df: DataFrame, index: DataFrame, year: str, cols: Sequence[str], to_year: int,
            scale: float = 1.0) -> DataFrame:
    """Express money columns in prices of ``to_year``; ``index`` is two columns, year and level."""
    iy, level = index.columns
    target = (index.where(F.col(iy) == F.lit(to_year))
              .agg(F.max(F.col(level).cast("double"))).scalar())
    factors = (index.groupBy(F.col(iy).alias(year)).agg(F.max(F.col(level).cast("double")).alias("__level"))
               .withColumn("__factor", target / F.col("__level")).drop("__level"))
    joined = rjoin(df, factors, year)
    return joined.withColumns({c: F.col(c) * F.col("__factor") * F.lit(scale) for c in cols}).drop("__factor")


def group_stat(df: DataFrame, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach group statistics to the rows.

    Aggregate and join instead of a window: the aggregate combines before the shuffle, and
    rows of a hot group are never sorted into one task.
    """
    stats = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
    return rjoin(df, stats, list(by))


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join group statistics to rows; without a group the one row comes as a scalar subquery."""
    if by:
        return rjoin(df, stats, list(by))
    one = df.withColumn("__one", stats.select(F.struct("*")).scalar())
    return one.select(*df.columns, "__one.*")


def semi_in(df: DataFrame, other: DataFrame, by: Keys) -> DataFrame:
    """Rows whose key occurs in ``other`` (null counts as a value)."""
    return _member(df, other, by, "left_semi")


def anti_in(df: DataFrame, other: DataFrame, by: Keys) -> DataFrame:
    """Rows whose key does not occur in ``other`` (null counts as a value)."""
    return _member(df, other, by, "left_anti")


def _member(df: DataFrame, other: DataFrame, by: Keys, how: str) -> DataFrame:
    pairs = _pairs(df, other, by)
    keys = other.select(*[F.col(r) for _, r in pairs]).distinct()
    return rjoin(df, keys, dict(pairs), how)


def outer_fill(x: DataFrame, y: DataFrame, by: Keys = None, fill=0) -> DataFrame:
    """Full join with absent measures filled."""
    keys = [l for l, _ in _pairs(x, y, by)]
    out = rjoin(x, y, by, "outer")
    return out.fillna(fill, [c for c in out.columns if c not in keys])


def left_plus_unmatched(x: DataFrame, y: DataFrame, by: Keys = None) -> DataFrame:
    """Left join with the unmatched right rows appended, which is one full join."""
    return rjoin(x, y, by, "outer")
