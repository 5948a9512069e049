"""Pairing household members, wide/long reshaping, balanced panels."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .joins import rjoin


def _literal_rows(values: Sequence, dtype=None) -> Column:
    return F.array(*[F.lit(v) if dtype is None else F.lit(v).cast(dtype) for v in values])


def pair_wide(df: DataFrame, ids: Sequence[str], role: str, roles: Sequence,
              values: Sequence[str], names: Sequence[str] | None = None,
              first_by: Sequence[str] | None = None, require: bool = True) -> DataFrame:
    """One row per household with ``value_role`` columns for each member role.

    A role that occurs twice in a household is an error, unless ``first_by`` names the order
    in which the first row wins. Members meet in one aggregate: min and max combine
    before the shuffle, so copies of a household never pile up as a list.
    """
    names = list(names or [str(r) for r in roles])
    df = df.where(F.col(role).isin(list(roles)))
    if first_by is not None:
        order = [*first_by, *[v for v in values if v not in first_by]]
        cell = F.struct(*[F.col(c) for c in order])
        aggs = [F.min(F.when(F.col(role) == F.lit(r), cell)).alias(f"__m{i}")
                for i, r in enumerate(roles)]
        wide = df.groupBy(*ids).agg(*aggs)
        if require:
            wide = wide.where(reduce(lambda a, b: a & b,
                                     [F.col(f"__m{i}").isNotNull() for i in range(len(roles))]))
        return wide.select(*ids, *[F.col(f"__m{i}.{v}").alias(f"{v}_{n}")
                                   for v in values for i, n in enumerate(names)])
    aggs = [F.max(F.when(F.col(role) == F.lit(r), F.col(v))).alias(f"{v}_{n}")
            for v in values for r, n in zip(roles, names)]
    counts = [F.count(F.when(F.col(role) == F.lit(r), 1)).alias(f"__n_{n}")
              for r, n in zip(roles, names)]
    wide = df.groupBy(*ids).agg(*aggs, *counts)
    single = reduce(lambda a, b: a & b, [F.col(f"__n_{n}") <= 1 for n in names])
    fail = F.raise_error(F.lit(f"a household holds a {role} twice")).cast("boolean")
    found = reduce(lambda a, b: a & b, [F.col(f"__n_{n}") == 1 for n in names]) if require else F.lit(True)
    # one CASE, so that the check runs before any row is dropped
    return wide.where(F.when(~single, fail).otherwise(found)).drop(*[f"__n_{n}" for n in names])


def pair_long(df: DataFrame, roles: Sequence[str], role: str = "position",
              ids: Sequence[str] | None = None) -> DataFrame:
    """Inverse of pairing: ``value_role`` columns become rows with a role column."""
    suffixed = {c: r for c in df.columns for r in roles if c.endswith(f"_{r}")}
    values = list(dict.fromkeys(c[: -len(r) - 1] for c, r in suffixed.items()))
    ids = [c for c in df.columns if c not in suffixed] if ids is None else list(ids)
    have = set(df.columns)
    rows = F.array(*[
        F.struct(F.lit(r).alias(role),
                 *[(F.col(f"{v}_{r}") if f"{v}_{r}" in have else F.lit(None)).alias(v) for v in values])
        for r in roles])
    return df.select(*ids, F.inline(rows))


def stack_members(df: DataFrame, parts: Sequence[tuple[str, Sequence[str], Column]]) -> DataFrame:
    """Bind member rows: each part is ``(suffix, other suffixes to drop, row filter)``.

    The parts become one array per couple, so the couples are read once.
    """
    base = [c for c in df.columns
            if not any(c.endswith(f"_{s}") for p in parts for s in (p[0], *p[1]))]
    values = list(dict.fromkeys(c[: -len(p[0]) - 1] for p in parts
                                for c in df.columns if c.endswith(f"_{p[0]}")))
    rows = F.array(*[F.when(cond, F.struct(*[F.col(f"{v}_{s}").alias(v) for v in values]))
                     for s, _, cond in parts])
    exploded = df.select(*base, F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("__row"))
    return exploded.select(*base, *[F.col(f"__row.{v}").alias(v) for v in values])


def pivot_measures(df: DataFrame, ids: Sequence[str], flag: str, levels: Mapping | Sequence,
                   measures: Sequence[str], fill=None) -> DataFrame:
    """Spread measures over the levels of a flag as ``measure_label``.

    ``levels`` maps each level to its label. Conditional sums over stated levels need no
    extra pass to discover them.
    """
    labels = dict(levels) if isinstance(levels, Mapping) else {v: str(v) for v in levels}
    aggs = [F.sum(F.when(F.col(flag).eqNullSafe(F.lit(v)), F.col(m))).alias(f"{m}_{label}" if label else m)
            for m in measures for v, label in labels.items()]
    out = df.groupBy(*ids).agg(*aggs)
    return out if fill is None else out.fillna(fill, [c for c in out.columns if c not in ids])


def spread(df: DataFrame, ids: Sequence[str], name: str, levels: Sequence, value: str) -> DataFrame:
    """One value column per level of ``name``."""
    return df.groupBy(*ids).pivot(name, list(levels)).agg(F.first(value, ignorenulls=True))


def gather(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)


def separate(df: DataFrame, column: str, into: Sequence[str], pattern: str) -> DataFrame:
    """Split a text column into named pieces."""
    parts = F.split(F.col(column), pattern)
    out = df.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(into)})
    return out if column in into else out.drop(column)


def years_to_rows(df: DataFrame, ids: Sequence[str], value: str, time: str = "year") -> DataFrame:
    """Year columns to rows; the year is the leading digits of the column name."""
    cols = [c for c in df.columns if c not in ids]
    long = df.unpivot(list(ids), cols, "__name", value)
    return long.select(*ids, F.regexp_extract("__name", r"\d{4}", 0).try_cast("int").alias(time), value)


def transpose(df: DataFrame, key: str, levels: Sequence, name: str = "variable") -> DataFrame:
    """Groups to columns and columns to rows, for a small result table."""
    cols = [c for c in df.columns if c != key]
    long = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    long = long.unpivot([key], cols, name, "__value")
    return long.groupBy(name).pivot(key, list(levels)).agg(F.max("__value"))


#: Combinations that one tile of a product holds, about.
TILE_ROWS = 200_000


def product(sides: Sequence[DataFrame]) -> DataFrame:
    """All combinations of the rows of several distinct-key tables: the result is the product, by definition.

    A row of one side owns a tile row and is copied along it, a row of the other owns a tile
    column: each pair meets in exactly one of tiles x tiles cells. The grid thus comes from an
    equality join whose work is even over the tasks, however unequal the sides. Tiles follow the sizes of the sides,
    which are written once: what counts them and what copies them reads the written rows.
    """
    def own(df: DataFrame, tiles: int) -> Column:
        return F.pmod(F.xxhash64(*df.columns), F.lit(tiles)).cast("int")

    if len(sides) == 1:
        return sides[0]
    sides = [stage(side) for side in sides]
    out, rows = sides[0], sides[0].count()
    for side in sides[1:]:
        rows *= side.count()
        tiles = max(2, math.ceil(math.sqrt(rows / TILE_ROWS)))
        every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
        left = out.withColumn("__i", own(out, tiles)).withColumn("__j", every)
        right = side.withColumn("__j", own(side, tiles)).withColumn("__i", every)
        out = left.join(right, ["__i", "__j"]).drop("__i", "__j")
    return out


def complete(df: DataFrame, keys: Sequence[str], fill=0, levels: Mapping[str, Sequence] | None = None,
             filled: Sequence[str] | None = None) -> DataFrame:
    """Balance a panel: one row for each combination of observed key values, null included.

    Pass an aggregated panel, staged if its scan is long. Keys with stated ``levels`` cost no
    pass over the data. Measures that appear through balancing take ``fill``; with
    ``fill=None`` they stay null.
    """
    levels = dict(levels or {})
    open_keys = [k for k in keys if k not in levels]
    if open_keys:
        grid = product([df.select(k).distinct() for k in open_keys])
    else:
        grid = df.sparkSession.range(1).select()
    for k, vals in levels.items():
        grid = grid.withColumn(k, F.explode(_literal_rows(vals, df.schema[k].dataType)))
    out = rjoin(grid.select(*keys), df, list(keys))
    if fill is None:
        return out
    filled = [c for c in df.columns if c not in keys] if filled is None else list(filled)
    return out.fillna(fill, filled)


def calendar(df: DataFrame, key: Sequence[str], start: int, stop: int, time: str = "year") -> DataFrame:
    """Every year from start to stop for each key."""
    return (df.select(*key).distinct()
            .withColumn(time, F.explode(F.sequence(F.lit(start).cast("int"), F.lit(stop).cast("int")))))


def carry_forward(df: DataFrame, time: str, from_time: int, to_times: Sequence[int]) -> DataFrame:
    """Repeat the rows of one period in later periods that the table does not cover."""
    as_time = df.schema[time].dataType
    times = F.when(F.col(time) == F.lit(from_time),
                   F.array(F.col(time), *[F.lit(t).cast(as_time) for t in to_times])
                   ).otherwise(F.array(F.col(time)))
    return df.select(*[F.explode(times).alias(time) if c == time else F.col(c) for c in df.columns])


def scaffold(keys: DataFrame, group: str, groups: Sequence, counts: DataFrame, fill=0) -> DataFrame:
    """Key x group frame with the counts attached and gaps filled."""
    frame = keys.distinct().withColumn(group, F.explode(_literal_rows(groups)))
    out = rjoin(frame, counts, [*keys.columns, group])
    return out.fillna(fill, [c for c in counts.columns if c not in frame.columns])


def estimate_long(df: DataFrame, ids: Sequence[str], measures: Sequence[str], z: float = 1.96,
                  se_suffix: str = "_se") -> DataFrame:
    """``x``/``x_se`` column pairs to rows with an interval."""
    rows = F.array(*[F.struct(F.lit(m).alias("variable"), F.col(m).cast("double").alias("estimate"),
                              F.col(m + se_suffix).cast("double").alias("se")) for m in measures])
    return (df.select(*ids, F.inline(rows))
            .withColumns({"lower": F.col("estimate") - z * F.col("se"),
                          "upper": F.col("estimate") + z * F.col("se")}))


def bind_by_rank(tables: Sequence[DataFrame], rank: str = "rank") -> DataFrame:
    """Ranked tables side by side, matched on their rank."""
    out = tables[0]
    for t in tables[1:]:
        out = rjoin(out, t, rank, "outer")
    return out


def bind_rows(*tables: DataFrame) -> DataFrame:
    """Rows under one another by column name, absent columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def across(df: DataFrame, cols: Sequence[str], fn) -> DataFrame:
    """Apply one Column function to many columns."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def select_cols(df: DataFrame, starts: str | None = None, ends: str | None = None,
                between: tuple[str, str] | None = None, drop: bool = False) -> list[str]:
    """Column names by prefix, suffix or position range, or all others with ``drop``."""
    cols = df.columns
    hit = set(cols)
    if between is not None:
        hit &= set(cols[cols.index(between[0]): cols.index(between[1]) + 1])
    if starts is not None:
        hit &= {c for c in cols if c.startswith(starts)}
    if ends is not None:
        hit &= {c for c in cols if c.endswith(ends)}
    return [c for c in cols if (c in hit) != drop]


def rename_with(df: DataFrame, fn, cols: Sequence[str] | None = None) -> DataFrame:
    return df.withColumnsRenamed({c: fn(c) for c in (df.columns if cols is None else cols)})


def match_combo(df: DataFrame, combos: DataFrame, cols: Sequence[str], keep_null: Column | None = None,
                id_col: str = "id") -> DataFrame:
    """Rows tagged with the id of the flag combination they carry, by one join.

    Rows under ``keep_null`` belong to every combination: they come back once, with a null
    id, to be aggregated before they are shared out.
    """
    tagged = rjoin(df, combos.select(id_col, *cols), list(cols), "inner")
    if keep_null is None:
        return tagged
    common = df.where(keep_null).withColumn(id_col, F.lit(None).cast(combos.schema[id_col].dataType))
    own = tagged.where(~F.coalesce(keep_null, F.lit(False)))
    return own.unionByName(common)
