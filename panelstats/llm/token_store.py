"""Token ids on disk: one compressed frame per document, a shared dictionary, an offset index.

Format, a folder of Parquet tables, so that any store that Spark reaches will do and writes commit as Spark's do:

* ``dictionary``: one row with the zstandard dictionary, its SHA-256 and the bytes per id (little-endian, unsigned);
* ``blocks``: rows in ascending id order; each has a shard and block number, the payload (frames one after the other) and the offset index of its
  documents: ids, frame ends within the payload, id counts, ids of the shard before the block, and the dictionary's hash;
* ``shards``: ids before each shard, over the whole store.

A reader of the index alone never touches the payload column; a reader of one document decompresses one frame.

Defined cases: null text is empty text; null document ids sort first and are kept; repeated ids follow each other in the order of their text's hash;
an empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import map_arrow, slices
from .tokens import broadcast_file, encoder

#: Documents whose ids train the dictionary, at most about so many, spread by the hash of the document id.
SAMPLE_DOCS = 1500
#: Ids of a sampled document that the training reads.
SAMPLE_IDS = 8192
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES = 2 << 20
LEVEL = 3


def train_dictionary(docs: DataFrame, vocabulary, id_col: str, text_col: str, end_id: int, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """A zstandard dictionary fitted on the id arrays of a bounded sample; empty if there is too little to learn from."""
    import zstandard

    n = docs.count()
    if not n:
        return b""
    share = min(1.0, sample_docs / n)
    picked = docs.select(id_col, text_col).where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(share * (1 << 20)))

    def arrays(batches):
        code = encoder(vocabulary.value)
        for batch in slices(batches, text_col):
            ids, bounds = code.encode_ended(batch.column(1), end_id)
            yield pa.RecordBatch.from_pydict({"ids": [ids[a:b][:SAMPLE_IDS].tobytes() for a, b in zip(bounds, bounds[1:])]})

    samples = [bytes(r.ids) for r in map_arrow(picked, arrays, "ids binary").limit(2 * sample_docs).collect()]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, d=8, k=256).as_bytes()
    except zstandard.ZstdError:  # samples too small or too alike
        return b""


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> None:
    """Encode whole texts and write the store in ascending id order."""
    spark = docs.sparkSession
    vocabulary = broadcast_file(spark, tokenizer)
    dictionary = train_dictionary(docs, vocabulary, id_col, text_col, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    width = np.dtype(encoder(vocabulary.value).dtype).itemsize
    id_type = docs.schema[id_col].dataType.simpleString()
    spark.createDataFrame([(digest, bytearray(dictionary), width)], "hash string, dictionary binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")

    def frames(batches):
        import zstandard
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        code = encoder(vocabulary.value)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True)
        block, before, total = 0, 0, 0
        parts, keys, ends, counts, size = [], [], [], [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([digest]), pa.array([keys], pa.list_(key_type)),
                 pa.array([ends], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([b"".join(parts)], pa.binary())],
                names=["shard", "block", "before", "hash", "ids", "ends", "counts", "payload"])

        key_type = None
        for batch in slices(batches, text_col):
            key_type = batch.schema.field(0).type
            ids, bounds = code.encode_ended(batch.column(1), end_id)
            for key, a, b in zip(batch.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                frame = packer.compress(ids[a:b].tobytes())
                if parts and size + len(frame) > BLOCK_BYTES:
                    yield row()
                    block, before = block + 1, total
                    parts, keys, ends, counts, size = [], [], [], [], 0
                parts.append(frame)
                size += len(frame)
                total += b - a
                keys.append(key)
                ends.append(size)
                counts.append(b - a)
        if parts:
            yield row()

    ordered = (docs.select(id_col, text_col).repartitionByRange(F.col(id_col), F.xxhash64(text_col))
               .sortWithinPartitions(F.col(id_col), F.xxhash64(text_col)))
    schema = f"shard int, block int, before bigint, hash string, ids array<{id_type}>, ends array<bigint>, counts array<bigint>, payload binary"
    map_arrow(ordered, frames, schema).write.option("compression", "none").parquet(f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("total"))
    # one row per shard, as many as there are write tasks
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals.select("shard", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("shard_start")).write.parquet(f"{path}/shards")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: id, place of its frame, count of ids, ids of the store before it. Payloads stay unread."""
    blocks = spark.read.parquet(f"{path}/blocks").select("shard", "block", "before", "ids", "ends", "counts")
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def places(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                shard, block, before, keys, ends, counts = (batch.column(c)[k] for c in range(6))
                counts = counts.values.to_numpy(zero_copy_only=False).astype(np.int64)
                starts = before.as_py() + np.cumsum(counts) - counts
                n = len(counts)
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()] * n, pa.int32()), pa.array([block.as_py()] * n, pa.int32()), keys.values, ends.values,
                                                  pa.array(counts), pa.array(starts)], names=["shard", "block", "doc_id", "frame_end", "n_tokens", "own_start"])

    placed = map_arrow(blocks, places, f"shard int, block int, doc_id {id_type}, frame_end bigint, n_tokens bigint, own_start bigint")
    return placed.join(spark.read.parquet(f"{path}/shards"), "shard").withColumn("start", F.col("shard_start") + F.col("own_start")).drop("own_start", "shard_start")


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Decompress every frame: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids as little-endian unsigned 32-bit integers.

    A block whose hash differs from the store's dictionary fails the read.
    """
    row = spark.read.parquet(f"{path}/dictionary").first()
    digest, dictionary, dtype = row["hash"], bytes(row["dictionary"]), f"<u{row['width']}"
    blocks = spark.read.parquet(f"{path}/blocks")
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def unpack(batches):
        import zstandard

        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        reader = zstandard.ZstdDecompressor(dict_data=known)
        for batch in batches:
            for k in range(batch.num_rows):
                shard, before, mark, keys, ends, counts, payload = (batch.column(c)[k] for c in range(7))
                if mark.as_py() != digest:
                    raise ValueError("a block was written with another dictionary")
                data, ends, counts = payload.as_buffer(), ends.as_py(), counts.as_py()
                starts = before.as_py() + np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
                crcs, raw = [], []
                for a, b in zip([0, *ends], ends):
                    ids = np.frombuffer(reader.decompress(data[a:b]), dtype).astype("<u4")
                    crcs.append(zlib.crc32(ids))
                    raw.append(ids.tobytes() if with_ids else None)
                n = len(ends)
                out = [pa.array([shard.as_py()] * n, pa.int32()), keys.values, pa.array(starts), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(raw, pa.binary())] * with_ids, names=["shard", "doc_id", "own_start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    schema = f"shard int, doc_id {id_type}, own_start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    found = map_arrow(blocks.select("shard", "before", "hash", "ids", "ends", "counts", "payload"), unpack, schema)
    starts = spark.read.parquet(f"{path}/shards")
    return found.join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def fetch(spark: SparkSession, path: str, doc_id) -> list[np.ndarray]:
    """The ids of the documents with one id: the index names the block and the frame, and only that frame is decompressed."""
    import zstandard

    row = spark.read.parquet(f"{path}/dictionary").first()
    known = zstandard.ZstdCompressionDict(bytes(row["dictionary"])) if row["dictionary"] else None
    blocks = spark.read.parquet(f"{path}/blocks")
    hits = F.filter(F.sequence(F.lit(1), F.size("ids")), lambda k: F.element_at("ids", k) == F.lit(doc_id))
    begin = lambda k: F.when(k > 1, F.element_at("ends", k - 1)).otherwise(F.lit(0).cast("bigint"))
    frames = F.transform(hits, lambda k: F.substring("payload", (begin(k) + 1).cast("int"), (F.element_at("ends", k) - begin(k)).cast("int")))
    cut = blocks.where(F.array_contains("ids", F.lit(doc_id))).select(F.explode(frames).alias("frame"))
    return [np.frombuffer(zstandard.ZstdDecompressor(dict_data=known).decompress(bytes(r.frame)), f"<u{row['width']}") for r in cut.collect()]
