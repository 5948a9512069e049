"""Spatial distribution indices from weighted unit x group cells.

Every index starts from one aggregate of the rows to (period, unit) with a conditional sum
per group. Totals per period come from that same aggregate, whose exchange Spark reuses, so
the rows are read and shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship, stage
from .joins import attach, rjoin


def _pair_cells(df: DataFrame, group: str, pair: Sequence, unit: Sequence[str], w: str,
                by: Sequence[str]) -> DataFrame:
    a, b = pair
    wt = F.col(w).cast("double")
    side = lambda g: F.coalesce(F.sum(F.when(F.col(group) == F.lit(g), wt)), F.lit(0.0))
    return (df.where(F.col(group).isin([a, b]))
            .groupBy(*by, *unit).agg(side(a).alias("__a"), side(b).alias("__b")))


def _with_totals(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    totals = (cells.groupBy(*by) if by else cells.groupBy()).agg(
        F.sum("__a").alias("__ta"), F.sum("__b").alias("__tb"))
    return attach(cells, totals, by)


def _fold(cells: DataFrame, by: Sequence[str], **aggs: Column) -> DataFrame:
    return (cells.groupBy(*by) if by else cells.groupBy()).agg(*[c.alias(n) for n, c in aggs.items()])


def _gap() -> Column:
    return F.abs(F.try_divide(F.col("__a"), F.col("__ta")) - F.try_divide(F.col("__b"), F.col("__tb")))


def dissimilarity(df: DataFrame, group: str, pair: Sequence, unit: Sequence[str], w: str,
                  by: Sequence[str] = (), boot: int = 0, seed: int = 0) -> DataFrame:
    """Dissimilarity ``D`` of two groups; with ``boot`` replicates also ``se`` and ``bias``, D debiased."""
    cells = _pair_cells(df, group, pair, unit, w, by)
    if boot:
        cells = stage(cells)
    d = _fold(_with_totals(cells, by), by, D=0.5 * F.sum(_gap()))
    if not boot:
        return d
    stats = _fold(_replicates(cells, by, unit, boot, seed), by, __mean=F.avg("D"), se=F.stddev_samp("D"))
    out = attach(d, stats, by)
    bias = F.col("__mean") - F.col("D")
    return out.select(*by, (F.col("D") - bias).alias("D"), "se", bias.alias("bias"))


def replicates(df: DataFrame, group: str, pair: Sequence, unit: Sequence[str], w: str, by: Sequence[str] = (), boot: int = 50,
               seed: int = 0) -> DataFrame:
    """Bootstrap replicates ``by, rep, a, b, D, chi2``: both groups' totals, the dissimilarity, and Pearson's distance from the observed counts.

    A replicate redistributes the rounded total of a period over its unit x group cells: a multinomial, so ``a + b`` is that total each time.
    """
    return _replicates(stage(_pair_cells(df, group, pair, unit, w, by)), by, unit, boot, seed)


#: Children of a node of the bootstrap's tree, on average.
FAN = 1024


def _replicates(cells: DataFrame, by: Sequence[str], unit: Sequence[str], boot: int, seed: int) -> DataFrame:
    """Split each period's total down a tree over its units.

    The root draws the two groups' totals; a node deals its counts to its children, which are again multinomials given the node's count.
    Nodes are hash buckets of units, so every node is drawn by itself, seeded by its place, in one vector block for all replicates. The last
    level draws the units and sums them within its task: what is shuffled grows with nodes, and with tasks at the end, not with units x replicates.
    """
    ship(cells.sparkSession)
    by = list(by)
    both = [F.sum("__a").alias("__a"), F.sum("__b").alias("__b")]
    top = (cells.groupBy(*by) if by else cells.groupBy()).agg(*both, F.count(F.lit(1)).alias("__size"))
    top = top.where(F.col("__a") + F.col("__b") > 0).withColumns(
        {"__root": F.monotonically_increasing_id(), "__seed": F.xxhash64(F.lit(seed), *by)})
    roots = stage(top)
    most = roots.agg(F.max("__size")).first()[0] or 0
    depth = 0
    while most > FAN ** (depth + 1):
        depth += 1
    tag = roots.select(*by, "__root", "__seed")
    units = rjoin(cells, tag, by, "inner") if by else attach(cells, tag, by)
    units = units.select("__root", "__seed", F.xxhash64(F.col("__seed"), *unit).alias("__node"), "__a", "__b")
    place = lambda level: F.pmod("__node", F.lit(FAN ** level)) if level else F.lit(0).cast("long")
    levels = {depth + 1: units}  # nodes of each level; the last one's are the units
    for level in range(depth, 0, -1):
        levels[level] = stage(levels[level + 1].groupBy("__root", "__seed", place(level).alias("__node")).agg(*both))
    drawn = stage(roots.select("__root", "__seed", F.lit(0).cast("long").alias("__node"), "__a", "__b").mapInPandas(
        _root_draws(boot), "__root long, __node long, a array<long>, b array<long>"))
    whole = drawn.select("__root", F.col("a").alias("__ta"), F.col("b").alias("__tb"))
    for level in range(depth + 1):
        kids = levels[level + 1].groupBy("__root", "__seed", place(level).alias("__parent")).agg(
            F.array_sort(F.collect_list(F.struct("__node", "__a", "__b"))).alias("kids"))
        kids = kids.join(drawn.withColumnRenamed("__node", "__parent"), ["__root", "__parent"])
        kids = kids.select("__root", "__seed", F.col("__parent").alias("parent"), F.col("kids.__node").alias("node"),
                           F.col("kids.__a").alias("wa"), F.col("kids.__b").alias("wb"), "a", "b")
        if level < depth:
            drawn = stage(kids.mapInPandas(_node_draws(boot, level), "__root long, __node long, a array<long>, b array<long>"))
    mass = roots.select("__root", F.col("__a").alias("ma"), F.col("__b").alias("mb"))
    sums = kids.join(whole, "__root").join(mass, "__root").mapInPandas(
        _unit_draws(boot, depth), "__root long, a array<double>, b array<double>, gap array<double>, chi2 array<double>")
    parts = sums.select("__root", F.posexplode(F.arrays_zip("a", "b", "gap", "chi2")).alias("rep", "z"))
    reps = parts.groupBy("__root", "rep").agg(*[F.sum(f"z.{c}").alias(c) for c in ("a", "b", "gap", "chi2")])
    share = F.when(~F.isnan("gap"), 0.5 * F.col("gap")).alias("D")
    return reps.join(roots.select("__root", *by), "__root").select(
        *by, "rep", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), share, "chi2")


def _generator(seed: int, level: int, node: int):
    mask = (1 << 64) - 1
    return np.random.default_rng([int(seed) & mask, level, int(node) & mask])


def _deal(rng, counts, weights) -> np.ndarray:
    """Counts (one for each replicate) over the weights: a row for each replicate."""
    weights = np.asarray(weights, dtype=float)
    total = weights.sum()
    if total <= 0:
        return np.zeros((len(counts), len(weights)), dtype=np.int64)
    return rng.multinomial(np.asarray(counts, dtype=np.int64), weights / total)


def _root_draws(boot: int):
    def draw(batches):
        for pdf in batches:
            a, b = [], []
            for key, left, right in zip(pdf["__seed"], pdf["__a"], pdf["__b"]):
                n = int(round(left + right))
                a.append(_generator(key, 0, 0).binomial(n, left / (left + right), boot))
                b.append(n - a[-1])
            yield pdf[["__root", "__node"]].assign(a=a, b=b)
    return draw


def _both_dealt(row, level: int):
    rng = _generator(row["__seed"], level + 1, row["parent"])
    return _deal(rng, row["a"], row["wa"]), _deal(rng, row["b"], row["wb"])


def _node_draws(boot: int, level: int):
    def draw(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                a, b = _both_dealt(row, level)
                yield pd.DataFrame({"__root": row["__root"], "__node": row["node"], "a": list(a.T), "b": list(b.T)})
    return draw


def _unit_draws(boot: int, level: int):
    def draw(batches):
        found: dict[int, np.ndarray] = {}  # of the periods that a task sees
        for pdf in batches:
            for row in pdf.to_dict("records"):
                a, b = _both_dealt(row, level)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gap = np.abs(a / np.asarray(row["__ta"])[:, None] - b / np.asarray(row["__tb"])[:, None]).sum(1)
                mass = row["ma"] + row["mb"]
                n, chi2 = round(mass), np.zeros(boot)
                for x, weights in ((a, row["wa"]), (b, row["wb"])):
                    mean = n * np.asarray(weights, dtype=float) / mass
                    chi2 += ((x - mean)[:, mean > 0] ** 2 / mean[mean > 0]).sum(1)
                found[row["__root"]] = found.get(row["__root"], 0.0) + np.stack([a.sum(1), b.sum(1), gap, chi2])
        if found:
            yield pd.DataFrame({"__root": list(found), **{c: [v[i] for v in found.values()] for i, c in enumerate(("a", "b", "gap", "chi2"))}})
    return draw


def exposure(df: DataFrame, group: str, groups: Sequence, unit: Sequence[str], w: str,
             by: Sequence[str] = ()) -> DataFrame:
    """Exposure of ``of`` to ``to`` for every ordered pair of groups, the own group included.

    The number of groups is small and stated; their unit totals sit side by side in one row.
    """
    wt = F.col(w).cast("double")
    cells = (df.where(F.col(group).isin(list(groups))).groupBy(*by, *unit)
             .agg(*[F.coalesce(F.sum(F.when(F.col(group) == F.lit(g), wt)), F.lit(0.0)).alias(f"__g{i}")
                    for i, g in enumerate(groups)]))
    size = sum((F.col(f"__g{i}") for i in range(1, len(groups))), F.col("__g0"))
    n = len(groups)
    sums = _fold(cells, by, **{f"t{i}": F.sum(f"__g{i}") for i in range(n)},
                 **{f"p{i}_{j}": F.sum(F.try_divide(F.col(f"__g{i}") * F.col(f"__g{j}"), size))
                    for i in range(n) for j in range(n)})
    rows = F.array(*[F.struct(F.lit(a).alias("of"), F.lit(b).alias("to"),
                              F.try_divide(F.col(f"p{i}_{j}"), F.col(f"t{i}")).alias("exposure"))
                     for i, a in enumerate(groups) for j, b in enumerate(groups)])
    return sums.select(*by, F.inline(rows))


def isolation(df: DataFrame, group: str, groups: Sequence, unit: Sequence[str], w: str,
              by: Sequence[str] = ()) -> DataFrame:
    """Chance that a unit-mate belongs to the own group."""
    pairs = exposure(df, group, groups, unit, w, by)
    return pairs.where(F.col("of") == F.col("to")).select(
        *by, F.col("of").alias(group), F.col("exposure").alias("isolation"))


def mutual_information(df: DataFrame, group: str, groups: Sequence, unit: Sequence[str], w: str,
                       by: Sequence[str] = ()) -> DataFrame:
    """Mutual information M of unit and group, and Theil's H = M / entropy of the groups.

    With counts n, ``M = H(group) + H(unit) - H(unit, group)``, and each entropy is
    ``ln T - sum n ln n / T``: period totals are not needed before the units are folded.
    """
    wt = F.col(w).cast("double")
    n = len(groups)
    cells = (df.where(F.col(group).isin(list(groups))).groupBy(*by, *unit)
             .agg(*[F.coalesce(F.sum(F.when(F.col(group) == F.lit(g), wt)), F.lit(0.0)).alias(f"__g{i}")
                    for i, g in enumerate(groups)]))
    size = sum((F.col(f"__g{i}") for i in range(1, n)), F.col("__g0"))
    xlogx = lambda c: F.when(c > 0, c * F.ln(c)).otherwise(F.lit(0.0))
    joint = sum((xlogx(F.col(f"__g{i}")) for i in range(1, n)), xlogx(F.col("__g0")))
    sums = _fold(cells, by, j=F.sum(joint), u=F.sum(xlogx(size)),
                 **{f"t{i}": F.sum(f"__g{i}") for i in range(n)})
    total = sum((F.col(f"t{i}") for i in range(1, n)), F.col("t0"))
    spread = sum((xlogx(F.col(f"t{i}")) for i in range(1, n)), xlogx(F.col("t0")))
    h_group = F.ln(total) - F.try_divide(spread, total)
    h_unit = F.ln(total) - F.try_divide(F.col("u"), total)
    h_joint = F.ln(total) - F.try_divide(F.col("j"), total)
    m = h_group + h_unit - h_joint
    return sums.select(*by, m.alias("M"), F.try_divide(m, h_group).alias("H"))


def separation(df: DataFrame, group: str, pair: Sequence, unit: Sequence[str], w: str,
               by: Sequence[str] = (), unit_share: bool = True) -> DataFrame:
    """Difference between the groups' mean unit share of the first group.

    ``unit_share=False`` takes each unit's part of the overall total as its share.
    """
    cells = _with_totals(_pair_cells(df, group, pair, unit, w, by), by)
    a, b = F.col("__a"), F.col("__b")
    p = F.try_divide(a, a + b if unit_share else F.col("__ta") + F.col("__tb"))
    return _fold(cells, by, S=F.sum(p * F.try_divide(a, F.col("__ta")))
                 - F.sum(p * F.try_divide(b, F.col("__tb"))))


def index_by_subgroup(df: DataFrame, group: str, pair: Sequence, unit: Sequence[str], w: str,
                      variables: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Dissimilarity within every level of several variables.

    Rows are first summed to cells that keep the variables, then each cell is copied once per variable.
    """
    cells = (df.where(F.col(group).isin(list(pair)))
             .groupBy(*by, *unit, group, *variables).agg(F.sum(w).alias("__w")))
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("value"))
                     for v in variables])
    long = cells.select(*by, *unit, group, "__w", F.inline(rows)).where(F.col("value").isNotNull())
    return dissimilarity(long, group, pair, unit, "__w", [*by, "variable", "value"])


def group_share(df: DataFrame, group: str, pair: Sequence, unit: Sequence[str], w: str,
                frame: DataFrame | None = None, scale: float = 100.0) -> DataFrame:
    """Percent of the first group per unit; units of ``frame`` without any rows are left out."""
    cells = _pair_cells(df, group, pair, unit, w, ())
    if frame is not None:
        cells = attach(frame.select(*unit).distinct(), cells, list(unit)).fillna(0.0, ["__a", "__b"])
    prop = F.lit(scale) * F.try_divide(F.col("__a"), F.col("__a") + F.col("__b"))
    return cells.withColumn("prop", prop).where(F.col("prop").isNotNull()).select(*unit, "prop")
