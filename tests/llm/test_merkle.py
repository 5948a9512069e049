"""The manifest against a plain version: deep trees, repeated and null ids, many groups."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from panelstats.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join("-" if p is None else p for p in parts).encode()).hexdigest()


def field(v):
    return None if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """(root, siblings before and after each leaf by level) of a list of nodes."""
    level, at, paths = nodes, list(range(len(nodes))), [[] for _ in nodes]
    while len(level) > 1:
        runs = [level[k:k + 16] for k in range(0, len(level), 16)]
        for p, k in zip(paths, at):
            run = runs[k // 16]
            p.append(("".join(run[:k % 16]), "".join(run[k % 16 + 1:])))
        level, at = [sha(*run) for run in runs], [k // 16 for k in at]
    return level[0] if level else "", paths


def brute(rows):
    """rows: (id, group, text) -> sorted (id, group, leaf, subroot, root, siblings)."""
    groups = {}
    for k, g, t in rows:
        groups.setdefault(g, []).append((k, sha(field(k), field(g), field(t))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = climb([leaf for _, leaf in groups[g]])
    root, over = climb([trees[g][0] for g in names])
    return sorted(((k, g, leaf, trees[g][0], root, p + q) for g, q in zip(names, over) for (k, leaf), p in zip(groups[g], trees[g][1])), key=repr)


def check(spark, rows, folds=True):
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(5)
    leaves = merkle.hashed(docs, ["doc_id", "source", "text"], altered={"text": merkle.ascii_lower(F.col("text"))})
    found = merkle.manifest(leaves).withColumns({"mine": merkle.folded(F.col("leaf")), "changed": merkle.folded(F.coalesce("altered", "leaf")), "proof": merkle.proof_digest()}).collect()
    assert sorted(((r.id, r.grp, r.leaf, r.subroot, r.root, list(zip(r.lefts, r.rights))) for r in found), key=repr) == brute(rows)
    assert all(r.mine == r.root and (r.changed == r.root) == (r.altered == r.leaf) for r in found)
    assert all(r.proof == sha(*[a + b for a, b in zip(r.lefts, r.rights)]) for r in found)
    return found


def test_unique_ids(spark):
    ids = random.Random(3).sample(range(-10 ** 12, 10 ** 12), 60) + list(range(-70, 9000))
    rows = [(k, "hot" if k % 3 else f"s{k % 4}", f"Text {k}" if k % 7 else "lower") for k in dict.fromkeys(ids)]
    assert {len(r.lefts) for r in check(spark, rows)} == {4 + 1, 3 + 1}


def test_repeated_and_null_ids(spark):
    rows = [(k, g, t) for k in (None, 5, 6, 63, 64, -1) for g in (None, "", "é", "a") for t in ("A", None, "") for _ in range(1 + (k == 5) * 40)]
    check(spark, rows + [(7, "a", "x"), (4, "a", "x"), (2 ** 63 - 1, "a", "x"), (-2 ** 63, "a", "x"), (None, "only null", None)])


def test_many_groups_and_lone_leaves(spark):
    found = check(spark, [(k, f"g{k % 700}", str(k)) for k in range(800)])
    assert {len(r.lefts) for r in found} == {3, 4}
    lone = check(spark, [(1, "x", "T")])
    assert lone[0].leaf == lone[0].subroot == lone[0].root and lone[0].lefts == []


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([(1, "a", "t", "u", 3)], "doc_id bigint, source string, text string, leaf string, g int")
    assert merkle.manifest(merkle.hashed(docs.where("false"), ["text"])).count() == 0
    assert merkle.manifest(merkle.hashed(docs, ["leaf", "g"])).first().leaf == sha(field("u"), field(3))


@pytest.mark.parametrize("text", [None, "", "ABZ", "Äß É abc", "a中Z"])
def test_ascii_lower(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(merkle.ascii_lower(F.col("t"))).first()[0]
    assert got == (text and "".join(c.lower() if c < "\x80" else c for c in text))
