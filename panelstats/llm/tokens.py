"""Ids of whole texts by a tokenizers file, one Arrow batch at a time.

The vocabulary file is read on the driver and broadcast (a few MB, whatever the corpus), so executors need no copy of it.

A file that lower-cases, drops white space and splits words by a pattern that never matches white space gives the same ids for a text as for its
blank-separated chunks, one after the other. A file with exactly the rules below is known to do so, and each task then encodes a chunk once and
keeps its ids in a bounded cache; every other file, however like it, gets the whole text.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from .common import utf8

#: Chunks that a worker remembers. The cache is emptied when full.
CACHE_WORDS = 400_000
#: Chunks of these characters are lower-cased and split alike by Python and by the file's own rules.
_PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]{1,200}")
_RUNS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

# The rules of the vocabulary for which chunks may stand for texts, as its file states them.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def _by_chunks(parts: dict) -> bool:
    """Whether a file splits as above and does nothing else that looks beyond a chunk."""
    model = parts.get("model") or {}
    plain = model.get("type") == "BPE" and not model.get("dropout") and not parts.get("truncation") and not parts.get("padding")
    special = any(" " in t["content"] or not t["content"].startswith("<|") or t.get("lstrip") or t.get("rstrip") for t in parts.get("added_tokens", []))
    return plain and not special and parts.get("normalizer") == _NORMALIZER and parts.get("pre_tokenizer") == _SPLIT


def broadcast_file(spark: SparkSession, path: str):
    """The text of a vocabulary file, for ``encoder`` on the workers."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


@lru_cache(maxsize=2)
def encoder(definition: str) -> "Encoder":
    """One encoder per worker and vocabulary."""
    return Encoder(definition)


def _byte_letters() -> dict[int, int]:
    """Byte to printable letter, as byte-level pre-tokenizers map them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


class _Chunks(dict):
    """Ids of a blank-free chunk, as little-endian bytes."""

    def __init__(self, library, dtype: str):
        self.library, self.dtype, self.width = library, dtype, np.dtype(dtype).itemsize
        self.model, self.runs, self.letters = library.model, {}, _byte_letters()

    def run(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(self.width, "little") for t in self.model.tokenize(shown)])

    def __missing__(self, chunk: str) -> bytes:
        if len(self) + len(self.runs) > CACHE_WORDS:
            self.clear()
            self.runs.clear()
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            found = []
            for piece in _RUNS.findall(chunk.lower()):
                ids = self.runs.get(piece)
                if ids is None:
                    ids = self.runs[piece] = self.run(piece)
                found.append(ids)
            ids = b"".join(found)
        else:
            ids = np.array(self.library.encode(chunk, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


class Encoder:
    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        parts = json.loads(definition)
        self.library = Tokenizer.from_str(definition)
        self.dtype = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.chunks = _Chunks(self.library, self.dtype) if _by_chunks(parts) else None

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and n + 1 bounds of each text's ids. Null texts count as empty."""
        texts = utf8(texts)
        if not len(texts):
            return np.empty(0, self.dtype), np.zeros(1, np.int64)
        if self.chunks is None:
            got = [np.array(self.library.encode(t, add_special_tokens=False).ids, dtype=self.dtype) for t in texts.to_pylist()]
            return np.concatenate(got), np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int64)
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        table = self.chunks
        known = pa.array([table[w] if w else b"" for w in coded.dictionary.to_pylist()], pa.large_binary())
        taken = known.take(coded.indices)
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset:taken.offset + len(taken) + 1]
        bounds = ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        width = np.dtype(self.dtype).itemsize
        data = taken.buffers()[2]
        ids = np.frombuffer(data, self.dtype, int(bounds[-1] - bounds[0]) // width, int(bounds[0])) if data is not None and bounds[-1] > bounds[0] else np.empty(0, self.dtype)
        return ids, (bounds - bounds[0]) // width

    def encode_ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with ``end_id`` after each text."""
        ids, bounds = self.encode(texts)
        n = len(bounds) - 1
        out = np.empty(len(ids) + n, self.dtype)
        last = bounds[1:] + np.arange(n)
        own = np.ones(len(out), bool)
        own[last] = False
        out[own] = ids
        out[last] = end_id
        return out, bounds + np.arange(n + 1)
