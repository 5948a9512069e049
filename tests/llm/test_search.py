"""Tree searches against brute force."""

import numpy as np
import pytest

from panelstats.llm import mtree, queries, shards, vptree


def _best(ids, rows, me, query, k):
    score = (rows * query).sum(1)
    order = [j for j in np.lexsort((ids, -score)) if ids[j] != me][:k]
    return [(int(ids[j]), score[j]) for j in order]


def _vectors(spark, path):
    rows = spark.read.parquet(path).select("vec_id", "embedding").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)


@pytest.fixture(scope="module")
def many():
    rng = np.random.default_rng(1)
    rows = np.round(rng.normal(size=(12, 8))[rng.integers(0, 12, 3000)] + 0.3 * rng.normal(size=(3000, 8)), 2)
    rows[500:1500] = rows[7]  # a third are one vector
    return np.arange(3000), rows


def test_vp_tree_is_exact_without_relaxing(many):
    ids, rows = many
    tree = vptree.Tree(ids, rows, 20, 1.0)
    found = tree.find(ids[::20], rows[::20])
    for q, got in zip(ids[::20], found):
        assert [(i, s) for s, i in got] == _best(ids, rows, q, rows[q], 20)


def test_vp_tree_prunes():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(4000, 2))
    tree = vptree.Tree(np.arange(4000), rows, 5, 1.0)
    tree.find(np.arange(0, 4000, 40), rows[::40])
    assert sum(map(len, tree.seen.values())) < 0.5 * 100 * len(tree.seen)


def test_m_tree_is_exact(many):
    ids, rows = many
    tree = mtree.Tree(ids, rows, 5)
    whole = np.floor(256 * rows)
    for q, got in zip(ids[::50], tree.find(ids[::50], rows[::50])):
        assert [(i, s) for s, i in got] == _best(ids, whole, q, whole[q], 5)


def test_large_components_stay_exact():
    ids, rows = np.arange(3), np.array([[2.0 ** 40, 1], [2.0 ** 40, 2], [2.0 ** 40, 3]])
    got = mtree.Tree(ids, rows, 2).find(ids[:1], rows[:1])[0]
    assert got == [(2 ** 96 + 256 * 768, 2), (2 ** 96 + 256 * 512, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (50, [0.0, 0.0]), (100, [3.0, None]), (40, [float("nan"), 1.0]), (60, [float("inf"), 1.0]), (3, None), (None, [1.0, 1.0]), (4, []), (5, [1.0, 2.0]), (5, [1.0, 2.0]),
            (7, [-1.0, 0.5])]
    return spark.createDataFrame([(*r, "c") for r in rows], "vec_id bigint, embedding array<float>, score string")


def test_odd_vectors(spark, odd):
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vptree.nearest(odd).collect())
    assert got == [(0, 1, 5, 5.0), (0, 2, 5, 5.0), (0, 3, 20, 5.0), (0, 4, 7, 0.0), (20, 1, 0, 5.0), (20, 2, 5, 5.0), (20, 3, 5, 5.0), (20, 4, 7, 0.0)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.top_products(odd).collect())
    assert got[:5] == [(0, 1, 5, 5 * 65536), (0, 2, 5, 5 * 65536), (0, 3, 20, 5 * 65536), (0, 4, 7, 0), (0, 5, 50, 0)]
    assert [g[:3] for g in got[5:]] == [(50, 1, 0), (50, 2, 5), (50, 3, 5), (50, 4, 7), (50, 5, 20)]
    assert vptree.nearest(odd.where("false")).count() == mtree.top_products(odd.where("false")).count() == 0


@pytest.mark.parametrize("shard_rows", [4096, 60])
def test_rows_that_repeat_an_id(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(shards, "SHARD_ROWS", shard_rows)
    rng = np.random.default_rng(6)
    ids, rows = rng.integers(0, 120, 400), np.round(rng.normal(size=(400, 3)), 1) + 0.05
    df = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, rows)] + [(0, [1.0]), (20, [1.0, 2.0])], "vec_id bigint, embedding array<double>").repartition(5)

    def want(step, k, values):
        out = []
        for q in np.flatnonzero(ids % step == 0):
            score = (values * values[q]).sum(1)
            order = [j for j in np.lexsort((ids, -score)) if j != q][:k]
            out += [(int(ids[q]), n + 1, int(ids[j]), score[j]) for n, j in enumerate(order)]
        return sorted(out)

    got = sorted(tuple(r) for r in vptree.nearest(df, relax=1.0).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want(20, 20, rows)] and np.allclose([g[3] for g in got], [w[3] for w in want(20, 20, rows)])
    assert sorted(tuple(r) for r in mtree.top_products(df).collect()) == want(50, 5, np.floor(256 * rows))


def test_products_beyond_doubles_and_beyond_longs(spark):
    df = spark.createDataFrame([(0, [2.0 ** 21, 1.0]), (1, [2.0 ** 21, 3.0])], "vec_id bigint, embedding array<double>")
    assert mtree.top_products(df).first().score == 2 ** 58 + 256 * 768
    with pytest.raises(Exception, match="long number"):
        mtree.top_products(df.selectExpr("vec_id", "transform(embedding, x -> x * 1048576) as embedding")).collect()


def test_many_shards(spark, many, monkeypatch):
    monkeypatch.setattr(shards, "SHARD_ROWS", 300)
    monkeypatch.setattr(shards, "BLOCK_QUERIES", 20)
    ids, rows = many
    df = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, rows)], "vec_id bigint, embedding array<double>")
    want = {(int(q), k + 1, i, s) for q in ids[::20] for k, (i, s) in enumerate(_best(ids, rows, q, rows[q], 20))}
    assert {tuple(r) for r in vptree.nearest(df, relax=1.0).collect()} == want
    whole = np.floor(256 * rows)
    want = {(int(q), k + 1, i, int(s)) for q in ids[::50] for k, (i, s) in enumerate(_best(ids, whole, q, whole[q], 5))}
    assert {tuple(r) for r in mtree.top_products(df).collect()} == want


def test_op4_recall(spark, sf):
    ids, rows = _vectors(spark, f"{sf}/embeddings.parquet")
    got = {}
    for r in queries.op4_vp_tree(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in ids[ids % 20 == 0]:
        me = rows[ids == q][0]
        found = sorted(got[q])
        assert [k for k, _, _ in found] == list(range(1, 21)) and [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(s == pytest.approx(float(rows[ids == i][0] @ me), abs=1e-12) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for i, _ in _best(ids, rows, q, me, 20)})
    assert hits / (20 * len(got)) > 0.95


def test_op9(spark, sf):
    ids, rows = _vectors(spark, f"{sf}/embeddings.parquet")
    whole = np.floor(256 * rows)
    want = {(int(q), k + 1, i, int(s)) for q in ids[ids % 50 == 0] for k, (i, s) in enumerate(_best(ids, whole, q, whole[ids == q][0], 5))}
    assert {tuple(r) for r in queries.op9_m_tree(spark, sf).collect()} == want
