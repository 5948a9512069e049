"""Token store, packing and counts against the tokenizers library."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelstats.llm import packing, queries, token_counts, token_store
from panelstats.llm.common import new_folder, stage
from panelstats.llm.tokens import Encoder

ODD = [None, "", "  \n\t ", "Don't  STOP now 's", "naïve Größe ÀÉ é İstanbul ς Σ", "<|endoftext|> a<|startoftext|>b", "\x1c a\x85b  c", "中文 字 🙂👍🏽 x²½", "x" * 3000,
       "a b " * 9000, "12345 6.7%%% with*** l'été --", "don t", "o'clock'll we've"]
SCHEMA = "start string, doc_id bigint, text string, length int, sequence_id string"


def plain(text):
    from tokenizers import Tokenizer

    plain.tok = getattr(plain, "tok", None) or Tokenizer.from_file(queries.WORDS)
    return np.array(plain.tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [("s", k // 2 if k < 6 else k, t, 1, "q") for k, t in enumerate(ODD)] + [("s", None, "no id", 1, "q"), ("s", 40, "same", 1, "q"), ("s", 40, "same", 1, "q")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_only_the_known_rules_are_taken_by_chunks():
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    with open(queries.WORDS, encoding="utf-8") as f:
        known = json.load(f)
    assert Encoder(json.dumps(known)).chunks is not None
    digits, spaces, cut = (json.loads(json.dumps(known)) for _ in range(3))
    digits["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = known["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("[\\p{N}]|", "[\\p{N}]+|")
    spaces["normalizer"]["normalizers"][1]["content"] = "_"
    cut["truncation"] = {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}
    for other in (digits, spaces, cut):
        assert other != known
        code = Encoder(json.dumps(other))
        assert code.chunks is None
        text = "in 2024 we paid 1234 of 99"
        ids, _ = code.encode(pa.array([text]))
        assert ids.tolist() == Tokenizer.from_str(json.dumps(other)).encode(text, add_special_tokens=False).ids


def test_chunks_encode_as_whole_texts():
    rng = random.Random(2)
    letters = "abzAZéÉßẞñ'’ \n\t09.,!*<|>#́­　ﬁⅣσΣ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(2000)] + [t for t in ODD if t]
    import pyarrow as pa

    with open(queries.WORDS, encoding="utf-8") as f:
        code = Encoder(f.read())
    assert code.chunks is not None
    ids, bounds = code.encode_ended(pa.array(texts), 1)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain(t).tolist() for t in texts]


def test_store_round_trip(spark, odd):
    path = new_folder(spark, "store")
    token_store.write(odd, path, queries.WORDS)
    got = token_store.read(spark, path).collect()
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids)) for r in got) == sorted((k is None, k or 0, plain(t).tobytes()) for k, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        at += r.n_tokens
    assert [r.doc_id or -1 for r in sorted(got, key=lambda r: r.start)] == [k or -1 if k != 0 else -1 for k, _ in rows]
    assert token_store.fetch(spark, path, 8)[0].tolist() == plain(ODD[8]).tolist()
    assert {(r.doc_id, r.start, r.n_tokens) for r in token_store.read_index(spark, path).collect()} == {(r.doc_id, r.start, r.n_tokens) for r in got}


def test_store_of_nothing(spark, odd):
    path = new_folder(spark, "store")
    token_store.write(odd.where("false"), path, queries.WORDS)
    assert token_store.read(spark, path).count() == 0


def test_op1(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    at, want = 0, []
    for k in sorted(texts):
        ids = plain(texts[k])
        want.append((k, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    assert sorted(map(tuple, queries.op1_token_store(spark, sf).collect())) == want


def test_fullest_is_fullest():
    rng = random.Random(4)
    for _ in range(300):
        counts = Counter(rng.randrange(1, 30) for _ in range(rng.randrange(9)))
        room = rng.randrange(60)
        items = list(counts.elements())
        best = max(sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room)
        used = packing.fullest(dict(counts), room)
        assert sum(n * k for n, k in used.items()) == best and all(k <= counts[n] for n, k in used.items())


def _gapless(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, odd):
    places, pieces = packing.pack_documents(odd, queries.WORDS, 512)
    rows = places.collect()
    _gapless(rows, 512)
    assert len(rows) == sum(-(-len(plain(r.text)) // 512) for r in odd.collect())
    want = Counter(zlib.crc32(plain(r.text)[a:a + 512]) for r in odd.collect() for a in range(0, len(plain(r.text)), 512))
    assert Counter(r.ids_crc32 for r in rows) == want
    assert packing.pack(pieces.where("false")).count() == 0


def test_packing_of_a_hot_length(spark):
    pieces = stage(spark.range(30000).selectExpr("id as doc_id", "case when id % 3 = 0 then 1000 else 1 + id % 2500 end as length", "'x' as __n"), "pieces")
    rows = packing.pack(pieces).collect()
    assert len({r.doc_id for r in rows}) == 30000
    assert _gapless(rows, 4096) <= 1.005 * -(-sum(r.length for r in rows) // 4096)


def test_sequences_hold_the_ids(spark, odd):
    docs = odd.where("doc_id > 5 and doc_id < 40")
    places, pieces = packing.pack_documents(docs, queries.WORDS, 512)
    places = stage(places, "places")
    got = {r.sequence_id: np.frombuffer(r.ids, "<u2") for r in packing.sequences(places, pieces).collect()}
    texts = {r.doc_id: plain(r.text) for r in docs.collect()}
    for r in places.collect():
        assert got[r.sequence_id][r.offset:r.offset + r.length].tolist() == texts[r.doc_id][r.start:r.start + r.length].tolist()


def test_bad_lengths_are_refused(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 5000)], "doc_id int, length int"))


def test_op2(spark, sf):
    rows = queries.op2_packing(spark, sf).collect()
    texts = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == {
        (k, a // 4096, a, len(i[a:a + 4096]), zlib.crc32(i[a:a + 4096])) for k, i in texts.items() for a in range(0, len(i), 4096)}
    assert _gapless(rows, 4096) <= -(-sum(map(len, texts.values())) // 4096) + 1


def test_counts(spark, odd, sf):
    for docs in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        sizes = np.array([len(plain(r.text)) for r in docs.collect()])
        rows = token_counts.length_report(token_counts.encoded_lengths(docs, queries.WORDS)).collect()
        assert {r.n_tokens for r in rows} == set(sizes.tolist())
        for r in rows:
            over = sizes > r.n_tokens
            assert (r.n_docs, r.docs_over, r.tokens_over, r.truncated_total, r.total) == (
                (sizes == r.n_tokens).sum(), over.sum(), sizes[over].sum(), np.minimum(sizes, r.n_tokens).sum(), sizes.sum())
            assert r.quantile == pytest.approx((~over).mean())
    assert token_counts.length_report(token_counts.encoded_lengths(odd.where("false"), queries.WORDS)).count() == 0
