"""Packing of token sequences by minimum bin slack.

Only lengths matter for a packing, and there are at most ``capacity`` of them, so the plan is made from the histogram of lengths, which has a fixed bound however
large the corpus is. For each bin the longest remaining length is put in, and a subset-sum over the others, as a bitset in which bit ``s`` says
that some combination fills ``s`` places, finds the fullest combination for the rest. It is taken out as often as the histogram allows before the next one is sought.
The plan then gives every (length, rank) a place; ranks are counted per length in salted groups, so a length that a third of all pieces share is no hot group.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_arrow, slices, stage
from .tokens import broadcast_file, encoder

#: Pieces of one length that a group ranks.
GROUP = 200


def encode_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Ids of whole texts with an end id, cut only where longer than ``capacity``.

    One row per piece: doc_id, piece (from 0), start (ids of the document before it), length, ids (little-endian, two bytes each where the vocabulary allows) and
    ids_crc32 (of the ids as 32-bit integers). Null text is empty text, hence one piece with the end id; null and repeated ids are kept; an empty table has no pieces.
    """
    vocabulary = broadcast_file(docs.sparkSession, tokenizer)
    id_type = docs.schema[id_col].dataType.simpleString()

    def pieces(batches):
        code = encoder(vocabulary.value)
        for batch in slices(batches, text_col):
            ids, bounds = code.encode_ended(batch.column(1), end_id)
            sizes = np.diff(bounds)
            cuts = (sizes + capacity - 1) // capacity
            row = np.repeat(np.arange(len(sizes)), cuts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            begin = bounds[:-1][row] + start
            wide = ids.astype("<u4")
            crcs = [zlib.crc32(wide[a:a + n]) for a, n in zip(begin.tolist(), length.tolist())]
            raw = [ids[a:a + n].tobytes() for a, n in zip(begin.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(raw, pa.binary()), pa.array(crcs, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids", "ids_crc32"])

    return map_arrow(docs.select(id_col, text_col), pieces, f"doc_id {id_type}, piece int, start bigint, length bigint, ids binary, ids_crc32 bigint")


def fullest(counts: dict[int, int], room: int, by_mass: bool = False) -> dict[int, int]:
    """The combination of the counted lengths with the largest sum up to ``room``: bounded subset sums in a bitset, until one is full.

    Longest lengths come first, or those of which most ids are left.
    """
    if room <= 0:
        return {}
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    fits = [n for n, c in counts.items() if c and n <= room]
    for length in sorted(fits, key=(lambda n: (counts[n] * n, n)) if by_mass else None, reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            k = min(take, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left, take = left - k, take * 2
        if reach >> room:
            break
    total, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            total -= length * k
            used[length] = used.get(length, 0) + k
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, pieces a bin, bins, first bin, offset): which ranks of a length go to which bins. Of two orders of search the one with fewer bins."""
    return min((_plan(histogram, capacity, by_mass) for by_mass in (False, True)), key=lambda slots: max((s[4] + s[3] for s in slots), default=0))


def _plan(histogram: dict[int, int], capacity: int, by_mass: bool) -> list[tuple[int, int, int, int, int, int]]:
    """Each round uses up some length as far as its combination allows, so rounds follow the number of lengths, not of pieces."""
    left, given, slots, bins = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        used = fullest(rest, capacity - longest, by_mass)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[n] // k for n, k in used.items())
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            slots.append((n, given[n], k, times, bins, offset))
            offset += n * k
            given[n] += k * times
            left[n] -= k * times
            if not left[n]:
                del left[n]
        bins += times
    return slots


def pack(pieces: DataFrame, capacity: int = 4096, length_col: str = "length") -> DataFrame:
    """All rows of ``pieces`` with sequence_id and offset; lengths of 1 to ``capacity``.

    A length that is null, below 1 or above the capacity raises: cut such pieces first. Rows that are alike in every column get places of their own; columns of the added names are replaced.
    ``pieces`` is read three times, so hand in a written table. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    # at most ``capacity`` rows
    counted = pieces.groupBy(F.col(length_col).cast("bigint").alias("n")).count().limit(capacity + 2).collect()
    if bad := [r.n for r in counted if r.n is None or not 1 <= r.n <= capacity]:
        raise ValueError(f"lengths outside 1 to {capacity}: {bad[:5]}")
    slots = np.array(sorted(plan({r.n: r["count"] for r in counted}, capacity)), np.int64).reshape(-1, 6)
    table = spark.sparkContext.broadcast(slots)
    sizes = spark.createDataFrame([(r.n, -(-r["count"] // GROUP)) for r in counted], "__n bigint, __groups bigint")
    names = pieces.columns
    own = [f"own{k}" for k in range(len(names))]  # whatever the columns are called
    salted = (pieces.toDF(*own).join(sizes, F.col(own[names.index(length_col)]) == F.col("__n"))
              .withColumn("__group", F.pmod(F.xxhash64(*own), F.col("__groups"))).drop("__groups"))
    counts = salted.groupBy("__n", "__group").agg(F.count("*").alias("__count"))
    before = Window.partitionBy("__n").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__n", "__group", F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__base"))
    local = F.row_number().over(Window.partitionBy("__n", "__group").orderBy(*own)) - 1
    ranked = salted.withColumn("__local", local).join(bases, ["__n", "__group"]).select(*own, "__n", (F.col("__base") + F.col("__local")).alias("__rank"))

    def place(batches):
        rows = table.value
        first = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            n, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("__n", "__rank"))
            slot = rows[np.searchsorted(first, n << 44 | rank, "right") - 1]
            at = rank - slot[:, 1]
            kept = [batch.column(k) for k in range(len(own))]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(slot[:, 4] + at // slot[:, 2]), pa.array(slot[:, 5] + at % slot[:, 2] * n)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return map_arrow(ranked, place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """(places, pieces): the places of all pieces, without ids, and the written pieces with ids."""
    pieces = stage(encode_pieces(docs, tokenizer, capacity, id_col, text_col, end_id), "pieces")
    return pack(pieces.drop("ids"), capacity), pieces


def sequences(places: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row per sequence with its ids in a row; a sequence is bounded by the capacity. Document ids must tell documents apart."""
    keys = ["doc_id", "piece"]
    whole = places.select(*keys, "sequence_id", "offset").join(pieces.select(*keys, "ids"), keys)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return whole.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
