"""Language identification: held-out accuracy and the defined cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from panelstats.llm import language, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op3_language(spark, sf).collect()
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    judged = [r for r in found if r.held_out and lang[r.doc_id][0] and any(c.isalpha() for c in lang[r.doc_id][1] or "")]
    assert len(judged) > 100
    assert np.mean([r.lang_pred == lang[r.doc_id][0] for r in judged]) > 0.98


def test_filters_hold_every_learned_gram(spark):
    rows = [(k, f"ab{'cdefgh'[k % 3:]} xyz{k % 2}", "p" if k % 2 else "q") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(docs)
    assert model.languages == ["p", "q"]
    hashes, counts = language._grams([language._plain("abcdefgh")], 4)
    masks = np.bitwise_and.reduce([model.table[s] for s in language._slots(hashes)])
    assert counts.tolist() == [7] and (masks == 3).all()


def test_odd_rows(spark):
    rows = [(1, "der hund und die katze", "de"), (2, "the dog and the cat", "en"), (3, None, "en"), (4, "", None), (5, "12 -- !", "de"), (None, "the dog", "en"), (6, "the dog and " * 20000, None),
            (6, "the dog", None), (6, "the dog", None), (7, "中文", None)] + [(100 + k, "the dog and the cat", "en") for k in range(20)] + [(200 + k, "der hund und die katze", "de") for k in range(20)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, lang string, score string")
    got = language.predict(docs, language.fit(docs)).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "text", "lang", "lang_pred", "score"]
    said = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in got}
    assert said[3, None] == said[4, ""] == said[5, "12 -- !"] == ("und", 0.0)
    assert said[1, rows[0][1]][0] == "de" and said[6, rows[6][1]][0] == "en" and said[None, "the dog"][0] == "en"
    assert said[7, "中文"] == ("de", 0.0)
    none = language.fit(docs.where("false"))
    assert none.languages == [] and {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    assert language.predict(docs.where("false"), none).count() == 0


def test_fit_reads_no_row_without_a_label(spark):
    docs = spark.createDataFrame([(k, "abc def", "x" if k < 30 else None) for k in range(60)], "doc_id bigint, text string, lang string")
    assert language.fit(docs.where(F.col("lang").isNotNull())).table.tolist() == language.fit(docs).table.tolist()
