"""Near copies and repeated bytes against brute force."""

import os
import random
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from panelstats.llm import queries, simhash, suffix_dedup  # noqa: E402
from panelstats.llm.components import components  # noqa: E402


def test_links_reach_what_all_pairs_reach(spark):
    rng = random.Random(5)
    found = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(12):
            y = x
            for _ in range(rng.randint(0, 5)):
                y ^= 1 << rng.randrange(64)
            found.add(y)
            x = y if rng.random() < 0.5 else x
    found = sorted(brute.signed(x) for x in found)
    table = spark.createDataFrame([(x,) for x in found], "fp bigint")
    links = simhash.links(table).collect()
    assert all(brute.near(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in links)
    root = {r.node: r.root for r in components(simhash.links(table), "a", "b").collect()}
    assert [root.get(x, x) for x in found] == brute.groups([(x, x & (1 << 64) - 1) for x in found], brute.near)


def test_each_distance_links(spark):
    """0 to 3 bits link wherever the bits lie, 4 don't."""
    rng = random.Random(6)
    rows, want = [], []
    for k in range(400):
        x = rng.getrandbits(64)
        n = k % 5
        y = x
        for b in rng.sample(range(64), n):
            y ^= 1 << b
        rows += [(brute.signed(x),), (brute.signed(y),)]
        if 0 < n <= 3:
            want.append(tuple(sorted((brute.signed(x), brute.signed(y)))))
    got = components(simhash.links(spark.createDataFrame(rows, "fp bigint").distinct()), "a", "b").collect()
    assert sorted((r.root, r.node) for r in got) == sorted(want)


def test_a_long_path_is_one_component(spark):
    ids = list(range(500))
    random.Random(1).shuffle(ids)
    got = components(spark.createDataFrame(list(zip(ids, ids[1:])) + [(7, 7), (None, 3), (900, 901), (901, 900)], "a bigint, b bigint"), "a", "b").collect()
    assert {r.node: r.root for r in got} == {**{k: 0 for k in range(1, 500)}, 901: 900}


def test_simhash_odd_rows(spark):
    texts = [None, "", " \n\t\x0b\x0c\r", "one", "One", "one two", "ONE TWO", "a b c", "a b c d " * 3000, "É Ü x y", "é Ü x y"]
    rows = [(k, t, "c") for k, t in enumerate(texts)] + [(None, "one", "c"), (None, "alone and without a name", "c"), (3, "one", "c"), (3, "one", "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = simhash.near_duplicates(docs, keep=("text",)).collect()
    prints = {t: brute.simhash(t) for _, t, _ in rows}
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.fp) for r in got) == sorted((k is None, k or 0, t or "", brute.signed(prints[t])) for k, t, _ in rows)
    named = [(k, prints[t]) for k, t, _ in rows if k is not None]
    want = dict(zip([k for k, _ in named], brute.groups(named, brute.near)))
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert {r.text: r.component_id for r in got if r.doc_id is None} == {"one": 3, "alone and without a name": None}
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_op7(spark, sf):
    docs = [(r.doc_id, brute.simhash(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(k, f"{fp:016x}", c) for (k, fp), c in zip(docs, brute.groups(docs, brute.near))}
    assert set(map(tuple, queries.op7_simhash(spark, sf).collect())) == want


def _removed(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()), key=repr)


def test_repeats_of_odd_rows(spark):
    rng = random.Random(3)
    words = ["alpha", "be", "gamma", "delt", "ε", "zeta", "the", "of", "and", "x"]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(6)]
    rows = []
    for _ in range(60):
        t = rng.choice(base)
        for _ in range(rng.randrange(5)):
            p = rng.randrange(len(t))
            t = t[:p] + rng.choice(["Q", "zz", ""]) + t[p + 1:]
        rows.append((rng.randrange(70), t[rng.randrange(len(t)) // 3:] + rng.choice(base)[:rng.randrange(300)]))
    rows += [(None, base[0]), (3, None), (4, ""), (5, "a" * 9000), (6, "a" * 500 + "b"), (6, "a" * 500 + "b"), (70, "ab" * 6000), (71, "ab" * 40), (72, "x" * 49), (73, "x" * 50), (74, "x" * 50)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, kept string").repartition(5)
    assert _removed(docs) == sorted(brute.repeats(rows), key=repr)
    assert _removed(docs.where("false")) == []


def test_a_group_of_many_copies(spark):
    rng = random.Random(8)
    one = " ".join(str(rng.random()) for _ in range(60))
    rows = [(k, one if k % 3 else one[:k] + "#" + one[k + 1:]) for k in range(400)]
    assert _removed(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)) == sorted(brute.repeats(rows), key=repr)


def test_refinement_finds_equal_suffixes():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    data[700:900] = data[100:300]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for length in (16, 24, 50):
        starts = np.arange(len(data) - length + 1)
        own, bucket = suffix_dedup.refine(padded, starts, length)
        seen = {}
        for s in starts:
            seen.setdefault(data[s:s + length].tobytes(), []).append(int(s))
        got = {}
        for s, b in zip(starts[own].tolist(), bucket.tolist()):
            got.setdefault(b, []).append(s)
        assert sorted(got.values()) == sorted(v for v in seen.values() if len(v) > 1)


def test_op8(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert set(map(tuple, queries.op8_suffix_dedup(spark, sf).collect())) == {r[:5] for r in brute.repeats(rows)}
