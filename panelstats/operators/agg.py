"""Weighted counts, shares, period differences, quantiles and summary tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import centers, wvar
from ..session import stage
from .joins import attach, rjoin


def wcount(df: DataFrame, by: Sequence[str], w: str, out: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(w).alias(out))


def cond_sum(w: Column | str, cond: Column, na: str = "skip") -> Column:
    """Sum of weights under a predicate.

    ``na="skip"`` ignores rows with an unknown predicate, ``na="propagate"`` makes the sum
    null as soon as the group holds one.
    """
    w = F.col(w) if isinstance(w, str) else w
    total = F.coalesce(F.sum(F.when(cond, w)), F.lit(0).cast("double"))
    if na == "skip":
        return total
    if na == "propagate":
        return F.when(~F.bool_or(cond.isNull()), total)
    raise ValueError("na is 'skip' or 'propagate'")


def cond_sums(df: DataFrame, by: Sequence[str], w: str, conds: Mapping[str, Column],
              na: str = "skip") -> DataFrame:
    """Many conditional weighted sums in one aggregate."""
    return df.groupBy(*by).agg(*[cond_sum(w, c, na).alias(n) for n, c in conds.items()])


def adjusted_sum(w: str, base: Column, exempt: Column, mode: str, rates: Mapping[str, float],
                 na: str = "skip") -> Column:
    """Weighted count that discounts each response mode by its misclassification rate.

    Rows under ``exempt`` count in full; other rows count ``1 - rate`` of their mode, and rows
    of a mode without a rate do not count.
    """
    total = cond_sum(w, base & exempt, na)
    for value, rate in rates.items():
        total = total + F.lit(1.0 - rate) * cond_sum(w, base & ~exempt & (F.col(mode) == F.lit(value)), na)
    return total


def mode_first(df: DataFrame, by: Sequence[str], c: str, order: str | None = None,
               out: str | None = None) -> DataFrame:
    """Most frequent value; a tie goes to the value seen first under ``order`` (default: smallest)."""
    seen = F.min(order if order is not None else c)
    counts = df.groupBy(*by, c).agg(F.count(F.lit(1)).alias("__n"), seen.alias("__seen"))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col("__seen"), F.col(c).alias("value")))
    return counts.groupBy(*by).agg(best["value"].alias(out or c))


def share(df: DataFrame, value: str, within: Sequence[str] = (), out: str = "share",
          scale: float = 1.0) -> DataFrame:
    """Share of the group total, or of the grand total without a group.

    The grand total is a scalar subquery and a group total an aggregate joined back; neither
    gathers rows into one window partition.
    """
    if not within:
        total = df.agg(F.sum(value)).scalar()
        return df.withColumn(out, F.lit(scale) * F.try_divide(F.col(value).cast("double"), total))
    totals = df.groupBy(*within).agg(F.sum(value).alias("__total"))
    joined = rjoin(df, totals, list(within))
    return joined.withColumn(
        out, F.lit(scale) * F.try_divide(F.col(value).cast("double"), F.col("__total"))).drop("__total")


def period_diff(df: DataFrame, by: Sequence[str], time: str, a, b, value: str, out: str = "dif",
                growth: bool = False) -> DataFrame:
    """Value in period ``a`` minus period ``b`` per key, or its percent growth."""
    at = {n: F.max(F.when(F.col(time) == F.lit(t), F.col(value))) for n, t in (("a", a), ("b", b))}
    dif = at["a"] - at["b"]
    if growth:
        dif = F.lit(100.0) * F.try_divide(dif.cast("double"), at["b"])
    return df.groupBy(*by).agg(dif.alias(out))


def with_overall(df: DataFrame, by: Sequence[str], over: str, aggs: Mapping[str, Column],
                 label: str = "Overall") -> DataFrame:
    """Rows per category of ``over`` plus one overall row per group, in one pass."""
    keys = [F.col(c) for c in [*by, over]]
    sets = [keys, keys[:-1]]
    out = df.groupingSets(sets, *keys).agg(
        F.grouping(over).alias("__all"), *[c.alias(n) for n, c in aggs.items()])
    return out.withColumn(over, F.when(F.col("__all") == 1, F.lit(label)).otherwise(
        F.col(over).cast("string"))).drop("__all")


def crosstab_pct(df: DataFrame, row: str, column: str, by: Sequence[str], levels: Sequence,
                 prefix: str = "") -> DataFrame:
    """Row x column table per group with percent of the column total."""
    names = [f"{prefix}{v}" for v in levels]
    cells = df.groupBy(*by, row).agg(*[
        F.count(F.when(F.col(column) == F.lit(v), 1)).alias(n) for v, n in zip(levels, names)])
    totals = cells.groupBy(*by).agg(*[F.sum(n).alias(f"__{n}") for n in names])
    joined = attach(cells, totals, by)
    return joined.select(*by, row, *[
        (F.lit(100.0) * F.try_divide(F.col(n).cast("double"), F.col(f"__{n}"))).alias(n) for n in names])


def histogram(df: DataFrame, c: str, low: float, high: float, bins: int,
              by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal-width bins; the upper limit belongs to the last bin."""
    width = (high - low) / bins
    b = F.least(F.floor((F.col(c) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    inside = df.where((F.col(c) >= low) & (F.col(c) <= high))
    return inside.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def subgroup_shares(df: DataFrame, variables: Sequence[str], by: Sequence[str], w: str,
                    scale: float = 100.0) -> DataFrame:
    """Weighted share of each level of several variables, one pass for all of them.

    A row whose variable is null leaves that variable's denominator. Levels a group never
    shows come out as 0.
    """
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("value"))
                     for v in variables])
    cells = (df.select(*by, F.col(w).alias("__w"), F.inline(rows))
             .where(F.col("value").isNotNull())
             .groupBy(*by, "variable", "value").agg(F.sum("__w").alias("__n")))
    totals = cells.groupBy(*by, "variable").agg(F.sum("__n").alias("__total"))
    values = cells.select("variable", "value").distinct()
    frame = rjoin(totals, values, "variable", "inner")
    out = rjoin(frame, cells, [*by, "variable", "value"])
    prop = F.lit(scale) * F.try_divide(F.coalesce(F.col("__n"), F.lit(0.0)), F.col("__total"))
    return out.select(*by, "variable", "value", F.coalesce(prop, F.lit(0.0)).alias("prop"))


def combos(df: DataFrame, cols: Sequence[str], out: str = "n") -> DataFrame:
    """Observed combinations of a column set with their row count."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(out))


def freq_table(df: DataFrame, c: str, out: str = "n") -> DataFrame:
    """Frequency of each value, null being a value."""
    return combos(df, [c], out)


def col_means(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Mean of every numeric column."""
    if cols is None:
        cols = [f.name for f in df.schema if f.dataType.typeName() in
                ("double", "float", "integer", "long", "short", "byte")]
    return df.agg(*[F.avg(c).alias(c) for c in cols])


def trend(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Straight line through a scatter plot."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"),
                               F.regr_intercept(y, x).alias("intercept"),
                               F.regr_count(y, x).alias("n"))


#: Values a sketch level keeps, and the part of the rows by which a bracket is wider than its rank on each side: over twice the sketch's usual error.
SKETCH_WIDTH, SLACK = 2048, 0.0035
#: Distinct values of one wanted rank that a single task orders; more are cut further.
ROOM = 1 << 20
_CUTS = 64


def quantile_rows(df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Sequence[float], overall: bool = False,
                  slack: float = SLACK, room: int = ROOM) -> DataFrame:
    """Exact interpolated quantiles (h = (n-1)p) of several columns: rows ``by, variable, q..``.

    One pass sketches all columns and groups; sketches merge, so ``overall`` (a group ``Overall`` of all rows beside those
    of one key) needs no copy of the rows. The sketch brackets each rank, and a second pass counts what lies below a
    bracket and keeps the values inside. Counts are exact, so a bracket that missed its rank is seen and widened. Kept
    values beyond ``room`` for one rank are cut by sketches again until one task can order them. Groups without a known value have no row.
    """
    by, cols = list(by), list(cols)
    if overall and len(by) != 1:
        raise ValueError("an overall group stands beside those of one key")
    groups = [F.col(c).cast("string").alias(c) if overall else F.col(c) for c in by]
    src = df.select(*groups, F.array(*[F.col(c).cast("double") for c in cols]).alias("__xs"))
    known = stage(src.groupBy(*by).agg(
        *[F.kll_sketch_agg_double(F.col("__xs")[i], F.lit(SKETCH_WIDTH)).alias(f"__s{i}") for i in range(len(cols))],
        *[F.count(F.col("__xs")[i]).alias(f"__n{i}") for i in range(len(cols))]))
    edges = F.array(*[F.lit(min(max(e, 0.0), 1.0)) for p in probs for e in (p - slack, p + slack)])

    def brackets(whole: bool) -> Column:
        """A struct for each column and probability; without a sketched value (all NaN) the bracket is the whole line, whose upper end is NaN."""
        out = []
        for i in range(len(cols)):
            at = F.when(F.kll_sketch_get_n_double(f"__s{i}") > 0, F.kll_sketch_get_quantile_double(f"__s{i}", edges))
            out += [F.struct(F.lit(i).alias("__c"), F.lit(j).alias("__p"), F.lit(whole).alias("__all"), F.col(f"__n{i}").alias("__n"),
                             F.coalesce(at[2 * j], F.lit(float("-inf"))).alias("__a"),
                             F.coalesce(at[2 * j + 1], F.lit(float("nan"))).alias("__b")) for j in range(len(probs))]
        return F.array(*out)

    own = known.select(*by, brackets(False).alias("__marks")) if by else None
    whole = []
    if overall or not by:
        total = known.agg(*[F.kll_merge_agg_double(f"__s{i}", F.lit(SKETCH_WIDTH)).alias(f"__s{i}") for i in range(len(cols))],
                          *[F.coalesce(F.sum(f"__n{i}"), F.lit(0)).alias(f"__n{i}") for i in range(len(cols))])
        whole = total.select(brackets(True).alias("m")).first()["m"]  # a row for each column and probability

    keys = [*by, "__all", "__c", "__p", "__n"]
    counts = _bracketed(src, by, own, whole, overall)
    lo, hi, frac = _ranks(probs)
    seen = stage(counts.groupBy(*keys, "__a", "__b").agg(
        F.coalesce(F.sum(F.when(F.col("__x").isNull(), F.col("__k"))), F.lit(0)).alias("__under"),
        F.sum("__k").alias("__upto"), F.count("__x").alias("__size")))
    early, late = lo < F.col("__under"), hi >= F.col("__upto")
    worst = seen.agg(F.max((early | late).cast("int")), F.max("__size")).first()
    most = worst[1] or 0
    if worst[0]:
        missed = seen.where(early | late)
        again = missed.select(*keys, F.struct(
            "__c", "__p", "__all", "__n", F.when(early, F.lit(float("-inf"))).otherwise(F.col("__a")).alias("__a"),
            F.when(late, F.lit(float("nan"))).otherwise(F.col("__b")).alias("__b")).alias("m"))
        wide = [r["m"] for r in again.where("__all").collect()]
        groups = again.where(~F.col("__all")).groupBy(*by).agg(F.collect_list("m").alias("__marks")) if by else None
        if by and wide:
            groups = rjoin(known.select(*by), groups, by)
        wider = _bracketed(src, by, groups, wide, overall)
        counts = rjoin(counts, missed.select(*keys), keys, "left_anti").unionByName(wider)
        most = max(most, wider.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0)
    counts = counts.drop("__a", "__b")
    while most > max(room, 4 * _CUTS):
        counts = stage(_cut(counts, keys, lo, hi))
        most = counts.groupBy(*keys).agg(F.count("__x").alias("d")).agg(F.max("d")).first()[0]
    run = F.sum("__k").over(Window.partitionBy(*keys).orderBy(F.col("__x").asc_nulls_first()))
    placed = counts.withColumn("__end", run).withColumn("__begin", F.col("__end") - F.col("__k")).where(F.col("__x").isNotNull())

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("__begin")) & (rank < F.col("__end")), F.col("__x")))

    solved = placed.groupBy(*keys).agg(at(lo).alias("__lo"), at(hi).alias("__hi"))
    value = F.col("__lo") + frac * (F.col("__hi") - F.col("__lo"))
    names = [f"q{str(round(p * 100, 4)).rstrip('0').rstrip('.').replace('.', '_')}" for p in probs]
    variable = F.array(*[F.lit(c) for c in cols])[F.col("__c")].alias("variable")
    return solved.groupBy(*by, "__all", variable).agg(*[
        F.max(F.when(F.col("__p") == j, value)).alias(n) for j, n in enumerate(names)]).drop("__all")


def _ranks(probs: Sequence[float]) -> tuple[Column, Column, Column]:
    """The two ranks that a quantile lies between, and its place between them."""
    h = (F.col("__n") - 1) * F.array(*[F.lit(float(p)) for p in probs])[F.col("__p")]
    return F.floor(h), F.ceil(h), h - F.floor(h)


def _bracketed(src: DataFrame, by: Sequence[str], own: DataFrame | None, whole: Sequence, overall: bool) -> DataFrame:
    """Counts of values up to each bracket's end: one row of all that lies below it (null value), one for each value inside.

    What lies below meets in one row per task, so only values inside brackets are shuffled.
    """
    fixed = F.array(*[F.struct(*[F.lit(m[f]).alias(f) for f in ("__c", "__p", "__all")], F.lit(m["__n"]).cast("long").alias("__n"),
                               *[F.lit(m[f]).cast("double").alias(f) for f in ("__a", "__b")]) for m in whole]) if whole else None
    marks = fixed
    if own is not None:
        src = rjoin(src, own, by, "inner")
        marks = F.col("__marks")
        if whole:
            marks = F.concat(F.coalesce(marks, F.slice(fixed, 1, 0)), fixed)
    rows = src.select(*by, "__xs", F.inline(marks))
    x = F.col("__xs")[F.col("__c")]
    rows = rows.where(x.isNotNull() & (x <= F.col("__b")))
    group = [F.when(F.col("__all"), F.lit("Overall")).otherwise(F.col(by[0])).alias(by[0])] if overall else list(by)
    return stage(rows.groupBy(*group, "__all", "__c", "__p", "__n", "__a", "__b", F.when(x >= F.col("__a"), x).alias("__x"))
                 .agg(F.count(F.lit(1)).alias("__k")))


def _cut(counts: DataFrame, keys: Sequence[str], lo: Column, hi: Column) -> DataFrame:
    """Of each rank's values only those between the two cuts around it; what lies below adds to the row of smaller values."""
    keys = list(keys)
    sketch = counts.groupBy(*keys).agg(F.kll_sketch_agg_double("__x", F.lit(SKETCH_WIDTH)).alias("__s"))
    cuts = F.when(F.kll_sketch_get_n_double("__s") > 0, F.kll_sketch_get_quantile_double("__s", F.array(*[F.lit(i / _CUTS) for i in range(1, _CUTS)])))
    cells = rjoin(counts, sketch.select(*keys, cuts.alias("__cuts")), keys)
    place = sum((F.coalesce((F.col("__cuts")[i] < F.col("__x")).cast("int"), F.lit(0)) for i in range(_CUTS - 1)), F.lit(0))
    cells = stage(cells.withColumn("__place", F.when(F.col("__x").isNull(), F.lit(-1)).otherwise(place)).drop("__cuts"))
    sums = cells.groupBy(*keys, "__place").agg(F.sum("__k").alias("__rows"))  # at most _CUTS + 1 for a rank
    end = F.sum("__rows").over(Window.partitionBy(*keys).orderBy("__place"))
    sums = sums.withColumn("__end", end).withColumn("__begin", F.col("__end") - F.col("__rows"))
    holds = lambda rank: (rank >= F.col("__begin")) & (rank < F.col("__end"))
    hot = sums.where(holds(lo) | holds(hi)).groupBy(*keys).agg(F.min("__place").alias("__first"), F.max("__place").alias("__last"))
    kept = rjoin(cells, hot, keys, "inner").where(F.col("__place") <= F.col("__last"))
    return kept.groupBy(*keys, F.when(F.col("__place") >= F.col("__first"), F.col("__x")).alias("__x")).agg(F.sum("__k").alias("__k"))


def quantiles(df: DataFrame, by: Sequence[str], c: str, probs: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles of one column, side by side."""
    return quantile_rows(df, by, [c], probs).drop("variable")


def summary_table(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = (),
                  by: str | None = None, w: str | None = None, stat: str = "mean_sd",
                  overall: bool = False) -> DataFrame:
    """Rows ``variable, level, n, stat_1, stat_2[, stat_3]`` per group.

    Numbers give mean and sd, or median and quartiles with ``stat="median_iqr"``; categories
    give count and percent. With ``w`` all are weighted.
    """
    keys = [by] if by else []
    src = df
    if by and overall:
        both = F.array(F.col(by).cast("string"), F.lit("Overall"))
        src = df.withColumn(by, F.explode(both))
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    parts: list[DataFrame] = []
    if numeric and stat == "median_iqr":
        if w:
            raise ValueError("weighted quartiles are not part of the summary table")
        q = quantile_rows(df, keys, numeric, [0.25, 0.5, 0.75], overall and by is not None)
        parts.append(q.select(*keys, "variable", F.lit(None).cast("string").alias("level"), F.col("q50").alias("stat_1"),
                              F.col("q25").alias("stat_2"), F.col("q75").alias("stat_3")))
    elif numeric:
        aggs = []
        offsets = centers(df, *numeric) if w else [F.lit(0.0)] * len(numeric)
        for c, offset in zip(numeric, offsets):
            x = F.col(c).cast("double")
            ww = F.sum(F.when(x.isNotNull(), weight))
            m = F.try_divide(F.sum(x * weight), ww)
            n = F.count(x)
            sd = F.stddev_samp(x) if not w else F.sqrt(wvar(x, weight, offset) * n / F.nullif(n - 1, F.lit(0)))
            aggs.append(F.struct(F.lit(c).alias("variable"), F.lit(None).cast("string").alias("level"),
                                 m.alias("stat_1"), sd.alias("stat_2"),
                                 F.lit(None).cast("double").alias("stat_3")))
        wide = src.groupBy(*keys).agg(F.array(*aggs).alias("__rows"))
        parts.append(wide.select(*keys, F.inline("__rows")))
    if categorical:
        rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level"))
                         for c in categorical])
        cells = (df.select(*keys, weight.alias("__w"), F.inline(rows))
                 .where(F.col("level").isNotNull())
                 .groupBy(*keys, "variable", "level").agg(F.sum("__w").alias("stat_1")))
        if by and overall:  # cells are few; their sums make the overall group
            cells = (cells.withColumn(by, F.explode(F.array(F.col(by).cast("string"), F.lit("Overall"))))
                     .groupBy(by, "variable", "level").agg(F.sum("stat_1").alias("stat_1")))
        pct = share(cells, "stat_1", [*keys, "variable"], "stat_2", 100.0)
        parts.append(pct.withColumn("stat_3", F.lit(None).cast("double")))
    return reduce(lambda a, b: a.unionByName(b), parts)
