"""SimHash fingerprints, linked at three or fewer differing bits by meet-in-the-middle ball hashing.

Two fingerprints differ in at most three bits if and only if some value lies within one bit of the one and within two bits of the other. So every fingerprint emits
the values near it, values meet in a shuffle, and whoever meets is linked. Two facts keep the emission small without losing a link:

* of three bits two lie in the same half, so the two-bit variants that flip bits of both halves are never needed;
* the meeting value then agrees with the one fingerprint in a whole half and with the other up to one bit of it. Variants are therefore emitted only by fingerprints
  that share such a half with another fingerprint, which a first shuffle on the variants of the halves finds.

All that lie within one bit of a value are linked to the smallest of them, and so are those within two bits: stars instead of all pairs of a group. Equal fingerprints are one
node. A value has at most 65 + 992 distinct fingerprints around it, so no meeting is large, however many documents are alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_arrow, slices, stage, utf8
from .components import components

SEED = 42
#: Hashes whose bits are counted at once.
CHUNK = 1 << 17


def _fingerprint(text: bytes, shingle: int) -> int:
    import xxhash

    words = text.lower().split()  # bytes: lowers A-Z only and splits at exactly the six ASCII blanks
    if not words:
        return 0
    joined, one = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return one(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:len(words) - shingle + 1].tolist()
    hashes = np.array([one(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[k:k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the columns named in ``keep``: the SimHash of every whole text's word shingles as a signed long.

    A-Z are lowered; words are runs without ASCII blanks; shingles count as often as they occur; a text of fewer words is one shingle; a text without words (null,
    empty, blank) has fingerprint 0. A bit is 1 if it is 1 in over half of the hashes.
    """
    types = [docs.schema[c].dataType.simpleString() for c in (id_col, *keep)]

    def compute(batches):
        for batch in slices(batches, text_col):
            texts = utf8(batch.column(1)).cast(pa.large_binary()).to_pylist()
            fps = np.array([_fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], names=["doc_id", "fp", *keep])

    schema = ", ".join([f"doc_id {types[0]}", "fp bigint", *(f"`{c}` {t}" for c, t in zip(keep, types[1:]))])
    return map_arrow(docs.select(id_col, text_col, *keep), compute, schema)


def _half(fp: Column, which: int) -> Column:
    """A half as a long of its own; the high half is marked by bit 32."""
    if which:
        return F.shiftrightunsigned(fp, 32).bitwiseOR(F.lit(1 << 32))
    return fp.bitwiseAND(F.lit((1 << 32) - 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(which: int, n: int) -> Column:
    """Masks with n bits set in one half of a fingerprint."""
    bits = [1 << (32 * which + k) for k in range(32)]
    masks = bits if n == 1 else [p | q for k, p in enumerate(bits) for q in bits[:k]]
    return F.array(*[F.lit(_signed(m)).cast("bigint") for m in masks])


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): for a table of distinct fingerprints ``fp``, links whose components are those of all pairs at three or fewer differing bits.

    Joins are merge joins: files of variants compress so well that their size says little about their rows, and a broadcast by that size could be large.
    """
    exact = distinct.select("fp", F.explode(F.array(_half(F.col("fp"), 0), _half(F.col("fp"), 1))).alias("key"))
    halves = exact.groupBy("key").agg(F.count("*").alias("n"))
    low = distinct.select("fp", F.explode(F.transform(_flips(0, 1), lambda m: _half(F.col("fp").bitwiseXOR(m), 0))).alias("key"))
    high = distinct.select("fp", F.explode(F.transform(_flips(1, 1), lambda m: _half(F.col("fp").bitwiseXOR(m), 1))).alias("key"))
    near = stage(low.unionByName(high).join(halves.select("key").hint("merge"), "key", "left_semi"), "near")
    shared = halves.where("n > 1").select("key").unionByName(near.select("key")).distinct()
    active = stage(exact.join(shared.hint("merge"), "key", "left_semi"), "active")

    upper = F.col("key").bitwiseAND(F.lit(1 << 32)) != 0
    fp, key = F.col("fp"), F.col("key")
    # within one bit: the fingerprint, one flip in the half that is not shared, or the one flip that leads to the shared half
    own = active.select("fp", F.explode(F.when(upper, F.transform(_flips(0, 1), lambda m: fp.bitwiseXOR(m))).otherwise(F.transform(_flips(1, 1), lambda m: fp.bitwiseXOR(m)))).alias("z"))
    moved = near.select("fp", F.when(upper, F.shiftleft(key, 32).bitwiseOR(fp.bitwiseAND(F.lit((1 << 32) - 1)))).otherwise(
        fp.bitwiseAND(F.lit(-(1 << 32))).bitwiseOR(key)).alias("z"))
    one = stage(active.select("fp", fp.alias("z")).unionByName(own).unionByName(moved).distinct(), "ball")
    hubs = one.groupBy("z").agg(F.min("fp").alias("a"), F.count("*").alias("n"))
    two = active.select("fp", F.explode(F.when(upper, F.transform(_flips(0, 2), lambda m: fp.bitwiseXOR(m))).otherwise(F.transform(_flips(1, 2), lambda m: fp.bitwiseXOR(m)))).alias("z"))
    met = one.join(hubs.where("n > 1").hint("merge"), "z").select("a", "fp").unionByName(two.join(hubs.select("z", "a").hint("merge"), "z").select("a", "fp"))
    return met.where("a <> fp").select("a", F.col("fp").alias("b")).distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest id of all documents that a chain of links reaches), root (a fingerprint that names the group) and ``keep``.

    Null ids are kept and never name a component unless no document of it has an id; repeated ids and rows are kept; an empty table has no rows. Columns not named are not read.
    """
    prints = stage(fingerprints(docs, id_col, text_col, shingle, keep), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(links(nodes.select("fp")), "a", "b")
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(named.join(first, "root").select("fp", "component_id", "root"), "fp").select("doc_id", "fp", "component_id", "root", *keep)


def hexed(fp: str = "fp") -> Column:
    """16 lower-case hexadecimal digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
