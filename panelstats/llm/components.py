"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): each linked node with the smallest node reachable; the roots themselves have no row.

    Large stars hang every larger neighbour of a node on the smallest one, small stars do so with the smaller neighbours; a path of n nodes takes about
    log n rounds. Rounds go on until the table stays the same. Each round is written to the shared folder. Self links and nulls are ignored; repeats do no harm.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = stage(edges, "links")
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.least(F.col("k"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "links")
        now = _mark(edges)
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
