"""Per-key time series: shifts, gap filling, running sums, standard scores.

A window orders all rows of a key in one task. That is right for panels, whose keys are as long as the calendar; a key beyond
``LONG_KEY`` rows is spread instead: rows are laid into blocks by ranges of key and order, each block is worked on by itself, and what
a block must know of the others (a sum, the last and next known point, a number of rows) is carried over its key's blocks as one row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .joins import attach, rjoin

#: Rows of a key that one task orders.
LONG_KEY = 2_000_000
#: Rows of a piece in which a long key is shifted, unless the shift is longer.
PIECE = 100_000


def _is_long(df: DataFrame, key: Sequence[str]) -> bool:
    sizes = df.groupBy(*key).count() if key else df.groupBy().count()
    return (sizes.agg(F.max("count")).first()[0] or 0) > LONG_KEY


def _blocks(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows, staged, with ``__block``: ranges of (key, order), rising with the order; rows of equal order share one."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartitionByRange(n, *key, *order).withColumn("__block", F.spark_partition_id()))


def _carry(df: DataFrame, key: Sequence[str], ahead: bool = False, **sums: tuple[Column, Column]) -> DataFrame:
    """Attach to each row what its key's earlier blocks (``ahead``: later ones) give: per name an aggregate by block, and one of those over blocks."""
    parts = df.groupBy(*key, "__block").agg(*[first.alias(n) for n, (first, _) in sums.items()])
    along = Window.partitionBy(*key).orderBy("__block")  # a row for each block
    w = along.rowsBetween(1, Window.unboundedFollowing) if ahead else along.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*key, "__block", *[second.over(w).alias(n) for n, (_, second) in sums.items()])
    return rjoin(df, parts, [*key, "__block"])


def shift(df: DataFrame, key: Sequence[str], order: str, c: str, k: int = 1, out: str | None = None,
          default=None) -> DataFrame:
    """Value k rows later (k > 0) or earlier (k < 0) along a stated order."""
    name = out or f"{c}_shift{k}"
    move = F.lead(c, k, default) if k >= 0 else F.lag(c, -k, default)
    if not k or not _is_long(df, key):
        return df.withColumn(name, move.over(Window.partitionBy(*key).orderBy(order)))
    rows = _carry(_blocks(df, key, [order]), key, __before=(F.count(F.lit(1)), F.sum("__before")))
    at = F.row_number().over(Window.partitionBy(*key, "__block").orderBy(order)) + F.coalesce(F.col("__before"), F.lit(0))
    rows = rows.withColumn("__at", (at - 1).cast("long"))
    length = max(PIECE, abs(k))
    # rows that the neighbouring piece looks at go there too
    piece, within = F.floor(F.col("__at") / length), F.pmod("__at", F.lit(length))
    near, other = (within < k, piece - 1) if k > 0 else (within >= length + k, piece + 1)
    none = F.lit(None).cast("long")
    copies = F.filter(F.array(piece, F.when(near & (other >= 0), other).otherwise(none)), lambda x: x.isNotNull())
    rows = rows.withColumns({"__home": piece, "__piece": F.explode(copies)})
    rows = rows.withColumn(name, move.over(Window.partitionBy(*key, "__piece").orderBy("__at")))
    return rows.where(F.col("__home") == F.col("__piece")).select(*[x for x in df.columns if x != name], name)


def cumsum(df: DataFrame, key: Sequence[str], order: Sequence[str], c: str, out: str = "cum") -> DataFrame:
    if not _is_long(df, key):
        w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(c).over(w))
    rows = _carry(_blocks(df, key, order), key, __sum=(F.sum(c), F.sum("__sum")))
    w = Window.partitionBy(*key, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own, before = F.sum(c).over(w), F.col("__sum")
    return rows.withColumn(out, F.coalesce(own + before, own, before)).drop("__block", "__sum")


def locf(df: DataFrame, key: Sequence[str], order: str, c: str, out: str | None = None) -> DataFrame:
    """Last known value carried forward."""
    if not _is_long(df, key):
        w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out or c, F.last(c, ignorenulls=True).over(w))
    last = F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(order)))
    rows = _carry(_blocks(df, key, [order]), key, __last=(last, F.last("__last", ignorenulls=True)))
    w = Window.partitionBy(*key, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out or c, F.coalesce(F.last(c, ignorenulls=True).over(w), F.col("__last"))).drop("__block", "__last")


def interpolate(df: DataFrame, key: Sequence[str], order: str, c: str, out: str | None = None) -> DataFrame:
    """Linear interpolation between known points, flat beyond the first and last.

    Keys with fewer than two known points keep their column as it is.
    """
    point = F.when(F.col(c).isNotNull(), F.struct(F.col(order).cast("double").alias("t"),
                                                  F.col(c).cast("double").alias("v")))
    spread = _is_long(df, key)
    columns, by = df.columns, list(key)
    if spread:
        df = _blocks(df, key, [order])
        df = _carry(df, key, __p0=(F.max(point), F.last("__p0", ignorenulls=True)), __k0=(F.count(c), F.sum("__k0")))
        df = _carry(df, key, True, __q0=(F.min(point), F.first("__q0", ignorenulls=True)), __k1=(F.count(c), F.sum("__k1")))
        by.append("__block")
    base = Window.partitionBy(*by).orderBy(order)
    back = base.rowsBetween(Window.unboundedPreceding, 0)
    ahead = base.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*by)
    df = df.withColumns({"__p": F.last(point, ignorenulls=True).over(back),
                         "__q": F.first(point, ignorenulls=True).over(ahead),
                         "__known": F.count(c).over(whole)})
    t = F.col(order).cast("double")
    p, q, known = F.col("__p"), F.col("__q"), F.col("__known")
    if spread:
        p, q = F.coalesce(p, F.col("__p0")), F.coalesce(q, F.col("__q0"))
        known = known + F.coalesce(F.col("__k0"), F.lit(0)) + F.coalesce(F.col("__k1"), F.lit(0))
    slope = F.try_divide(q["v"] - p["v"], q["t"] - p["t"])
    value = (F.when(F.col(c).isNotNull(), F.col(c).cast("double"))
             .when(p.isNull(), q["v"]).when(q.isNull(), p["v"])
             .otherwise(p["v"] + slope * (t - p["t"])))
    filled = F.when(known >= 2, value).otherwise(F.col(c).cast("double"))
    out = out or c
    return df.withColumn(out, filled).select(*columns, *([] if out in columns else [out]))


def zscore(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), suffix: str = "_std") -> DataFrame:
    """Standard score against the frame or the group (sample sd)."""
    aggs = [a for c in cols for a in (F.avg(c).alias(f"__m_{c}"), F.stddev_samp(c).alias(f"__s_{c}"))]
    stats = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    out = attach(df, stats, by)
    out = out.withColumns({c + suffix: F.try_divide(F.col(c).cast("double") - F.col(f"__m_{c}"), F.col(f"__s_{c}"))
                           for c in cols})
    return out.drop(*[f"__{k}_{c}" for c in cols for k in "ms"])


def above_mean(df: DataFrame, c: str, out: str) -> DataFrame:
    """Flag values above the column's own mean."""
    return df.withColumn(out, F.col(c) > df.agg(F.avg(c)).scalar())


def at_extreme(df: DataFrame, c: str, low: str, high: str, out: str) -> DataFrame:
    """Label rows that hold the column minimum, and all others."""
    return df.withColumn(out, F.when(F.col(c) == df.agg(F.min(c)).scalar(), F.lit(low)).otherwise(F.lit(high)))


def rebin(df: DataFrame, keys: Sequence[str], time: str, width: int, sums: Sequence[str],
          means: Sequence[str] = ()) -> DataFrame:
    """Widen the periods of a panel: counts add up, covariates average."""
    lower = (F.floor(F.col(time) / F.lit(width)) * F.lit(width)).cast("int")
    binned = df.withColumn(time, lower)
    return binned.groupBy(*keys, time).agg(*[F.sum(c).alias(c) for c in sums],
                                           *[F.avg(c).alias(c) for c in means])


def row_id(df: DataFrame, order: Sequence[Column | str], out: str = "id", start: int = 1) -> DataFrame:
    """Consecutive row numbers over a total order, without one task seeing all rows.

    The frame is range-sorted and staged; each partition's offset is the size of those before.
    """
    placed = stage(df.orderBy(*order).withColumn("__seq", F.monotonically_increasing_id()))
    part = F.shiftright("__seq", 33)
    within = F.col("__seq").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumns({"__part": part, "__in": within})
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__off"))
    out_df = rjoin(placed, offsets, "__part")
    return out_df.withColumn(out, F.col("__off") + F.col("__in") + F.lit(start)).drop(
        "__seq", "__part", "__in", "__off")
