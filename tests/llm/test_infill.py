"""Fill-in-the-middle against a plain version, and the defined cases."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from panelstats.llm import infill


def plain(doc_id, text, rate=90, spm=20, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in infill.MARKS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [(1, None), (2, ""), (3, "a"), (4, "<M>"), (5, "a <P b"), (6, "<<<SM>>" * 40), (None, "no id at all"), (7, "x" * 3000), (8, "é" * 3000), (9, "ab 中文𝄞\n\t" * 700), (9, "ab 中文𝄞\n\t" * 700),
       (9, "other text of the same id"), (10, "word " * 200000), (11, " "), (12, "a\0b\0" * 99), (13, "S> M> <P" * 50), (-4, "minus, id")] + [(100 + k, "é<S a" * k) for k in range(150)]


def test_forms_and_texts(spark):
    docs = spark.createDataFrame([(k, t, "c") for k, t in ODD], "doc_id bigint, text string, form string")
    for kw in ({}, {"rate": 100, "spm": 50, "seed": 7}):
        got = infill.transform(docs, **kw)
        assert got.columns == ["doc_id", "text", *infill.ADDED]
        rows = got.withColumn("back", infill.restored()).collect()
        assert len(rows) == len(ODD) and {r.form for r in rows} == {"plain", "psm", "spm"}
        for r in rows:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.infill) == plain(r.doc_id, r.text, **kw)
            assert r.back == (r.text or "")
    assert infill.transform(docs.where("false")).count() == 0


def test_other_marks(spark):
    marks = ("[pre]", "[suf]", "[mid]")
    docs = spark.createDataFrame([(k, f"[mi {k} <P> x{'y' * k}[") for k in range(50)], "doc_id int, text string")
    got = infill.transform(docs, marks=marks).withColumn("back", infill.restored(marks=marks))
    assert got.where(F.col("back") != F.col("text")).count() == 0 and got.where("form <> 'plain' and not contains(infill, '[mid]')").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é中𝄞 \n", max_size=1500), max_size=8), st.integers(0, 1 << 30))
def test_trees_find_every_cut(texts, draw):
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    trees = infill.Trees(np.frombuffer(b"".join(raw), np.uint8), bounds)
    units = [re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    assert trees.totals().tolist() == [[len(u), len(t)] for u, t in zip(units, texts)]
    cuts = np.array([draw % (len(u) + 1) for u in units], np.int64)
    place, chars = trees.cut(cuts)
    assert chars.tolist() == [len("".join(u[:c])) for u, c in zip(units, cuts)]
    assert (place - bounds[:-1]).tolist() == [len("".join(u[:c]).encode()) for u, c in zip(units, cuts)]
