"""Byte-level BPE by the ranks of a rank file, over numpy matrices.

A text is split by the pattern; a piece that is a token as a whole is that token; other pieces start as single bytes, and their leftmost pair of the least rank is merged
until none is left. Pieces new to a task are laid into zero-padded matrices by length, and all rows of a matrix merge one pair each round. Ranks of pairs come from an
open-addressing hash table over pairs of token ids; merged rows are closed up, and only the two pairs around the merge are looked up again. Pieces beyond the longest matrix take
the same merges one by one, from a heap.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, slices, utf8

#: Widths of the matrices; longer pieces are merged one by one.
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128)
ROWS = 1 << 15
#: Pieces that a worker remembers. The cache is emptied when full.
CACHE_PIECES = 400_000
NONE = np.int32(2**31 - 1)


class _Pairs:
    """Rank of a pair of token ids, or NONE."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        keys, values = (np.array(x, np.int64) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1), np.full(1 << self.bits, NONE, np.int32)
        left, slots = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = self.keys[slots] == -1
            first = np.unique(slots[free], return_index=True)[1]
            put = left[free][first]
            self.keys[slots[free][first]], self.values[slots[free][first]] = keys[put], values[put]
            rest = np.ones(len(left), bool)
            rest[np.flatnonzero(free)[first]] = False
            left, slots = left[rest], (slots[rest] + 1) & (len(self.keys) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        slots = self.slot(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[slots[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out


class Coder:
    """Encoder and decoder of one rank file."""

    def __init__(self, lines: bytes, pattern: str):
        import regex

        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines.splitlines() if line.strip())}
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"the file has no token for bytes {missing[:5]}")
        self.split = regex.compile(pattern).findall
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = _Pairs(self.ranks)
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.table = pa.array(self.tokens, pa.large_binary())
        self.cache: dict[str, bytes] = {}

    def merge(self, rows: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of 2 to ``width`` bytes, as little-endian bytes."""
        n = len(rows)
        sizes = np.fromiter(map(len, rows), np.int64, n)
        ids = np.zeros((n, width), np.int32)
        filled = np.arange(width) < sizes[:, None]
        ids[filled] = self.single[np.frombuffer(b"".join(rows), np.uint8)]
        ranks = np.full((n, width), NONE, np.int32)  # the last column never has a pair
        pair = filled[:, 1:]
        ranks[:, :-1][pair] = self.pairs.find(ids[:, :-1][pair], ids[:, 1:][pair])
        out: list[bytes] = [b""] * n
        own = np.arange(n)
        while len(own):
            at = ranks.argmin(1)  # the leftmost of the least
            least = ranks[np.arange(len(own)), at]
            done = np.flatnonzero(least == NONE)
            if len(done):
                flat = ids[done].astype("<u4").tobytes()
                for k, (row, size) in enumerate(zip(own[done].tolist(), sizes[done].tolist())):
                    out[row] = flat[4 * width * k:4 * (width * k + size)]
                live = np.flatnonzero(least != NONE)
                own, ids, ranks, sizes, at, least = own[live], ids[live], ranks[live], sizes[live], at[live], least[live]
                if not len(own):
                    break
            line = np.arange(len(own))
            ids[line, at] = least
            move = np.minimum(np.arange(width) + (np.arange(width) > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, move, 1)
            ranks = np.take_along_axis(ranks, move, 1)
            ranks[:, -1] = NONE
            sizes = sizes - 1
            right = at + 1 < sizes
            ranks[line, at] = NONE
            ranks[line[right], at[right]] = self.pairs.find(ids[line[right], at[right]], ids[line[right], at[right] + 1])
            left = at > 0
            ranks[line[left], at[left] - 1] = self.pairs.find(ids[line[left], at[left] - 1], ids[line[left], at[left]])
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """The same merges for one piece of any length, n log n."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, token, ranks = [*range(1, n), -1], [*range(-1, n - 1)], self.tokens, self.ranks
        heap = [(r, k) for k, r in enumerate(self.pairs.find(np.array(ids[:-1]), np.array(ids[1:])).tolist()) if r != NONE]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k]
            if gone[k] or j < 0 or ranks.get(token[ids[k]] + token[ids[j]]) != rank:
                continue
            ids[k], gone[j], after[k] = rank, 1, after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for a in (before[k], k):
                if a >= 0 and after[a] >= 0 and (r := ranks.get(token[ids[a]] + token[ids[after[a]]])) is not None:
                    heapq.heappush(heap, (r, a))
        return np.array([i for i, g in zip(ids, gone) if not g], "<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Put the ids of new pieces into the cache."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.cache[piece] = whole.to_bytes(4, "little")
            elif len(raw) > WIDTHS[-1]:
                self.cache[piece] = self.merge_long(raw)
            else:
                groups.setdefault(next(w for w in WIDTHS if w >= len(raw)), []).append((piece, raw))
        for width, rows in groups.items():
            for k in range(0, len(rows), ROWS):
                part = rows[k:k + ROWS]
                self.cache.update(zip([p for p, _ in part], self.merge([r for _, r in part], width)))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        new = set().union(*split).difference(self.cache)
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache.clear()
            new = set().union(*split)
        self.learn(list(new))
        get = self.cache.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def decode(self, ids: np.ndarray) -> bytes:
        taken = self.table.take(pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], np.int64)
        return taken.buffers()[2].to_pybytes()[ends[0]:ends[len(ids)]] if len(ids) else b""


@lru_cache(maxsize=2)
def coder(lines: bytes, pattern: str) -> Coder:
    return Coder(lines, pattern)


def _shared(df: DataFrame, ranks: str):
    """The rank file, under a MB whatever the corpus, for the workers."""
    with open(ranks, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every whole text. Null text is empty text; null and repeated ids are kept; other columns are not read."""
    lines, kind = _shared(docs, ranks), docs.schema[id_col].dataType.simpleString()

    def work(batches):
        own = coder(lines.value, pattern)
        for batch in slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.encode(utf8(batch.column(1)).to_pylist()), pa.binary())], names=["doc_id", "ids"])

    return map_arrow(docs.select(id_col, text_col), work, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``encoded`` with decoded, the bytes that its ids stand for. Null ids give null; an id that the file doesn't have raises."""
    lines, own_columns, at = _shared(encoded, ranks), encoded.drop("decoded").columns, encoded.drop("decoded").columns.index("ids")

    def work(batches):
        own = coder(lines.value, pattern)
        for batch in batches:
            out = [None if raw is None else own.decode(np.frombuffer(raw, "<u4")) for raw in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*own_columns, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.drop("decoded").schema) + ", decoded binary"
    return map_arrow(encoded.drop("decoded"), work, schema)


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the decoded bytes."""
    return decoded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
