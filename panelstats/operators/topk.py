"""Rankings, fixed-size samples and cell-size filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import rjoin, semi_in
from .panel import row_id


def _order(by: Sequence[str]) -> list[Column]:
    """Sort keys from names, a leading minus meaning descending."""
    return [F.col(b[1:]).desc_nulls_last() if b.startswith("-") else F.col(b).asc_nulls_last() for b in by]


def top_k(df: DataFrame, by: Sequence[str], k: int, within: Sequence[str] = (),
          rank: str | None = "rank") -> DataFrame:
    """First k rows, per group if asked, with their rank.

    Ungrouped it is a per-task top k. Grouped, the rank filter becomes a window group
    limit, which cuts a hot group to k rows per task before the shuffle.
    """
    order = _order(by)
    if within:
        w = Window.partitionBy(*within).orderBy(*order)
        out = df.withColumn(rank or "__rank", F.row_number().over(w)).where(F.col(rank or "__rank") <= k)
        return out if rank else out.drop("__rank")
    top = df.orderBy(*order).limit(k)
    if rank is None:
        return top
    return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def top_k_side_by_side(df: DataFrame, by: Sequence[str], k: int, group: str, labels: dict,
                       show: Sequence[str]) -> DataFrame:
    """Top-k lists of several groups next to each other by rank."""
    kept = top_k(df.where(F.col(group).isin(list(labels))), by, k, [group])
    aggs = [F.max(F.when(F.col(group) == F.lit(g), F.col(c))).alias(f"{c}_{label}")
            for g, label in labels.items() for c in show]
    return kept.groupBy("rank").agg(*aggs)


def first_members(df: DataFrame, key: str, by: Sequence[str], k: int) -> DataFrame:
    """The first k keys under an order, as a filter table."""
    return top_k(df, by, k, rank=None).select(key)


def keep_first_members(df: DataFrame, key: str, ranked: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    return semi_in(df, first_members(ranked, key, by, k), key)


def sample_n(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """Fixed-size random sample, the same rows for a seed however the data are partitioned.

    The rows with the smallest tickets, md5 of seed and key. Counts by the ticket's first four digits (at most 65,536 rows) tell
    up to which prefix all rows belong; only the rows of the prefix where the sample ends are ordered.
    """
    ticket = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    drawn = df.withColumn("__t", ticket)
    prefix = F.substring("__t", 1, 4)
    run = F.sum("n").over(Window.orderBy("p"))
    counts = drawn.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).select("p", "n", run.alias("upto"))
    last = counts.where(F.col("upto") >= n).orderBy("p").first()
    if last is None:
        return df
    sure = drawn.where(prefix < last["p"])
    edge = drawn.where(prefix == last["p"]).orderBy("__t", *key).limit(n - (last["upto"] - last["n"]))
    return sure.unionByName(edge).drop("__t")


def case_control(df: DataFrame, case: Column, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """All rows of one class and a fixed-size sample of the rest."""
    is_case = F.coalesce(case, F.lit(False))
    return df.where(is_case).unionByName(sample_n(df.where(~is_case), n, seed, key))


def min_cell(df: DataFrame, key: Sequence[str], at_least: int) -> DataFrame:
    """Rows of keys that occur at least so often."""
    big = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= at_least).drop("__n")
    return rjoin(df, big, list(key), "left_semi")


def factor_order(df: DataFrame, key: str, by: Sequence[str], out: str = "level_order") -> DataFrame:
    """Position of each level under a sort, the key breaking ties."""
    return row_id(df, [*_order(by), F.col(key)], out).withColumn(out, F.col(out).cast("int"))
