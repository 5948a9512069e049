"""The pipeline's stages against brute force."""

import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from panelstats.llm import queries  # noqa: E402


def _ids(text):
    from tokenizers import Tokenizer

    _ids.tok = getattr(_ids, "tok", None) or Tokenizer.from_file(queries.WORDS)
    return _ids.tok.encode(text or "", add_special_tokens=False).ids + [1]


def _key(rows):
    return sorted(map(repr, rows))


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    kept = corpus_pipeline.identify_language(spark, docs, sf)
    assert kept.columns == docs.columns
    have = kept.collect()
    assert _key(have) == _key(r for r in rows if any(c.isalpha() for c in r.text or ""))
    single = corpus_pipeline.drop_near_copies(spark, kept, sf)
    prints = [(r.doc_id, brute.simhash(r.text)) for r in have]
    first = set(brute.groups(prints, brute.near))
    left = single.collect()
    assert single.columns == docs.columns and _key(left) == _key(r for r in have if r.doc_id in first)
    cut = corpus_pipeline.remove_repeated_passages(spark, single, sf)
    want = {r[0]: r[5].decode("utf-8", "ignore") for r in brute.repeats([(r.doc_id, r.text) for r in left])}
    short = cut.collect()
    assert cut.columns == docs.columns and {r.doc_id: r.text for r in short} == want and all(r.n_chars == len(r.text) for r in short)
    packed = corpus_pipeline.pack_sequences(spark, cut, sf).collect()
    sizes = {r.doc_id: len(_ids(r.text)) for r in short}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == sizes
    assert len({r.sequence_id for r in packed}) <= -(-sum(sizes.values()) // 4096) + 1


def test_odd_rows(spark):
    long = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were " * 3
    rows = [(1, long, "en"), (1, long, "en"), (1, long + "x y z", "en"), (2, long, "en"), (None, long, "en"), (None, "words that stand alone here", "en"), (3, None, "en"), (4, "", None), (5, "?!", "de")]
    docs = spark.createDataFrame([(*r, "s", len(r[1] or ""), "c", "c", 1.5) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_pred string, kept string, row_hash double")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == 6
    single = corpus_pipeline.drop_near_copies(spark, kept, "")
    assert sorted((r.doc_id or 0, len(r.text)) for r in single.collect())[:2] == [(0, 27), (1, min(len(long), len(long) + 5))] or single.count() == 2
    cut = corpus_pipeline.remove_repeated_passages(spark, single, "")
    assert cut.columns == docs.columns and cut.count() == single.count()
    empty = docs.where("false")
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, "").count() == 0


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    assert len({(r.doc_id, r.piece) for r in got}) == len(got) > 100
    ends = {}
    for r in got:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    for spans in ends.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 4096 and np.all([a[1] == b[0] for a, b in zip(spans, spans[1:])])
