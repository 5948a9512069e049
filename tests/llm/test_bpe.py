"""Byte-level BPE against tiktoken."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from panelstats.llm import byte_bpe, queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as f:
        return byte_bpe.Coder(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_(coder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_as_tiktoken(coder, tiktoken_):
    rng = random.Random(1)
    pool = "abcdeéèñüß  \n\t\x1c\x85 中文字هذا🙂👍🏽'sS1239!?.,-_ⅣǅİΣς́"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["".join(rng.choice("aeinst") for _ in range(n)) for n in [*range(1, 140), 500, 5000]]
    texts += ["a" * 5000, "ab" * 3000, "é" * 999, "", "   ", "<|endoftext|>"]
    got = coder.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tiktoken_.encode_ordinary(t) for t in texts]
    assert [coder.decode(np.frombuffer(g, "<u4")).decode() for g in got] == texts


def test_long_pieces_take_the_same_merges(coder):
    rng = random.Random(3)
    rows = ["".join(rng.choice("abcdest") for _ in range(rng.randrange(2, 128))).encode() for _ in range(300)]
    assert coder.merge(rows, 128) == [coder.merge_long(r) for r in rows]


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "the end", "z"), (2, "a b " * 50000, "w"), (2, "same", ""), (2, "same", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in got) == sorted((k or 0, t or "") for k, t, _ in rows)
    assert byte_bpe.encode(docs.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_op6(spark, sf, tiktoken_):
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array(tiktoken_.encode_ordinary(r.text or ""), "<u4")
        want.add((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert set(map(tuple, queries.op6_byte_bpe(spark, sf).collect())) == want
