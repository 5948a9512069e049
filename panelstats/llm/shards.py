"""Search of a query set against all vectors, shard by shard."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, stage

#: Vectors of a shard, about; a task holds one shard and one block of queries.
SHARD_ROWS = 4096
BLOCK_QUERIES = 1024


def clean(vectors: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """(id, row, vec) of all rows that take part, written; ``row`` tells rows of one id apart.

    Null ids and vectors that are null, empty, or hold null or non-finite components are left out, zero vectors too unless ``zero``. So are vectors whose length isn't the table's
    most common one (the smaller, if two are as common), as no product with the others exists.
    """
    vec = F.col(vec_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not zero:
        fine &= F.exists(vec, lambda x: x != 0)
    kept = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"), vec.alias("vec"))
    kept = stage(kept, "vectors")
    usual = kept.groupBy(F.size("vec").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return kept.where(F.size("vec") == usual.length) if usual else kept


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and len(flat) % len(column) or len(set(np.diff(column.offsets.to_numpy()).tolist())) > 1:
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, build: Callable, find: Callable, k: int, whole: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best of all shards; more is better, ties go to the smaller vec_id. Every row is a candidate for every query but itself.

    ``build(labels, matrix)`` makes a shard's index, ``find(index, labels, matrix)`` gives lists of (score, label) for a block of queries, best first. A shard labels its rows 0, 1, ... in order of
    id and row, so labels tie as ids do and differ where ids repeat; a query from another shard has the label -1. Scores travel as doubles, or with ``whole`` as long numbers, beyond which the search is refused.
    Shards hold equal shares by the hash of the row. Queries travel to every shard in blocks, after the shard's vectors, so a task holds one shard and one block.
    """
    n = vectors.count()
    shards = max(1, -(-n // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    own = vectors.select(F.pmod(F.xxhash64("id", "row"), F.lit(shards)).cast("int").alias("shard"), F.lit(-1).alias("block"), "id", "row", "vec")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id", "row", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "id", "row", "vec")

    def run(batches):
        shard, index, parts, at = None, None, [], None

        def settle():
            ids, rows, vectors = (np.concatenate(c) for c in zip(*parts))
            if at[1] == -1:
                order = np.lexsort((rows, ids))
                by_row = np.argsort(rows[order])
                return (build(np.arange(len(ids)), vectors[order]), ids[order], rows[order][by_row], by_row), None
            tree, names, known, label = index
            place = np.minimum(np.searchsorted(known, rows), len(known) - 1)
            found = find(tree, np.where(known[place] == rows, label[place], -1), vectors)
            if whole and any(abs(s) >= 1 << 63 for row in found for s, _ in row):
                raise ValueError("an inner product exceeds a long number")
            entries = pa.array([[{"score": -s, "id": int(names[i])} for s, i in row] for row in found], pa.list_(pa.struct([("score", pa.int64() if whole else pa.float64()), ("id", pa.int64())])))
            return index, pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rows), pa.array(np.full(len(ids), at[0]), pa.int32()), entries], names=["query_id", "row", "shard", "found"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(keys[a].tolist())
                if parts and key != at:
                    index, out = settle()
                    if out is not None:
                        yield out
                    parts = []
                if key[0] != shard:
                    shard, index = key[0], None
                at = key
                piece = batch.slice(a, b - a)
                parts.append((piece.column(2).to_numpy(zero_copy_only=False), piece.column(3).to_numpy(zero_copy_only=False), matrix(piece.column(4))))
        if parts:
            _, out = settle()
            if out is not None:
                yield out

    dealt = own.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "block")
    found = map_arrow(dealt, run, f"query_id bigint, row bigint, shard int, found array<struct<score:{'bigint' if whole else 'double'},id:bigint>>")
    # k entries a shard, the best of some shards and then of all
    some = F.pmod("shard", F.lit(max(1, math.isqrt(shards)))).alias("some")
    found = found.groupBy("query_id", "row", some).agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))
    best = found.groupBy("query_id", "row").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.score")).alias("score"))


def queries_of(vectors: DataFrame, step: int) -> DataFrame:
    return vectors.where(F.pmod(F.col("id"), F.lit(step)) == 0)


def unique_rows(ids: np.ndarray, rows: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct vectors, entry bounds, ids): per distinct vector its ``keep`` smallest ids. Equal vectors tie, so no others can be among the best."""
    order = np.lexsort((ids, *rows.T[::-1]))
    ids, rows = ids[order], rows[order]
    head = np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]) if len(rows) else np.empty(0, bool)
    first = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    within = np.arange(len(ids)) - first[group] if len(ids) else group
    kept = within < keep
    bounds = np.concatenate([[0], np.cumsum(np.bincount(group[kept], minlength=len(first)))]).astype(np.int64)
    return rows[first], bounds, ids[kept]
