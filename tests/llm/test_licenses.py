"""Licence scan: planted statements, clean paragraphs and the defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstats.llm import licenses

LINES = {"mit": "Released under the MIT License.", "apache": "Licensed under the Apache License, Version 2.0.", "cc-by-nc": "Licensed under CC BY-NC 4.0.",
         "gpl": "This work is licensed under the GNU General Public License, version 3."}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return licenses.fit(docs)


def test_statements_of_the_tables(docs, model):
    got = {(r.doc_id, r.family) for r in licenses.scan(docs, model).collect()}
    want = {(r.doc_id, f) for f, line in LINES.items() for r in docs.where(F.col("text").contains(line)).collect()}
    assert want and got == want


def test_held_out_variants(model):
    rng = np.random.default_rng(77)
    right = total = 0
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            for _ in range(10):
                words = licenses._varied(rng, licenses._words(text), ["plain", "words", "of", "this", "corpus"])
                p = model.probabilities(*licenses._coded([words], licenses._Words()))[0]
                right += model.families[int(p[:-1].argmax())] == family and 1 - p[-1] >= model.threshold
                total += 1
    assert right / total > 0.9


def test_odd_rows(spark, model):
    text = "Some words.\n\nReleased under the MIT License.\nthe license of nature is free\n" + "the " * 300 + LINES["gpl"] + " the" * 300
    rows = [(1, None), (2, ""), (3, " \n "), (None, LINES["mit"]), (4, text), (5, LINES["apache"]), (5, LINES["apache"]), (6, "word " * 50000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, family int")
    got = sorted((r.doc_id or 0, r.paragraph, r.family) for r in licenses.scan(frame, model).collect())
    assert got == [(0, 0, "mit"), (4, 1, "mit"), (4, 3, "gpl"), (5, 0, "apache"), (5, 0, "apache")]
    hit = next(r for r in licenses.scan(frame, model).collect() if r.doc_id == 4 and r.family == "mit")
    assert text[hit.start:hit.stop] == LINES["mit"]
    alone = licenses.fit(frame.where("false"))
    assert licenses.scan(frame.where("false"), alone).count() == 0


def _found(spark, model, *texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [[(r.family, texts[k][r.start:r.stop]) for r in sorted(licenses.scan(frame, model).collect(), key=lambda r: (r.start, r.stop)) if r.doc_id == k] for k in range(len(texts))]


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining\n * a copy of this software and associated documentation files (the \"Software\"),\n * to deal in the\n * Software without restriction,",
    "bsd": "Redistribution and use in source and binary\nforms, with or without modification, are\npermitted provided that the following\nconditions are met:",
    "gpl": "you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation;",
    "isc": "Permission to use, copy, modify, and/or distribute this\r\nsoftware for any purpose with or without fee is hereby\r\ngranted,",
}


def test_wrapped_notices(spark, model):
    got = _found(spark, model, *("Öl und İstanbul.\n\nFirst lines of a file\n" + t + " and what follows" for t in WRAPPED.values()))
    assert got == [[(f, t)] for f, t in WRAPPED.items()]


def test_several_statements(spark, model):
    far = "Released under the MIT License. " + "plain words " * 400 + "Licensed under the Apache License, Version 2.0. " + "plain words " * 400 + "Released under the MIT License."
    beside = "It is released under the MIT License or the Apache License, Version 2.0, as you like."
    twice = "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."
    lesser = "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."
    got = _found(spark, model, far, beside, twice, lesser)
    assert got[0] == [("mit", LINES["mit"]), ("apache", LINES["apache"]), ("mit", LINES["mit"])]
    assert sorted(f for f, _ in got[1]) == ["apache", "mit"]
    assert got[2] == [("cc-by-nc", LINES["cc-by-nc"])] * 2
    assert got[3] == [("lgpl", lesser)]


def test_usual_forms_in_prose(spark, model):
    forms = [("mit", "MIT License"), ("apache", "Apache License 2.0"), ("apache", "Apache License\n  Version 2.0, January 2004"), ("gpl", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
             ("bsd", "BSD 3-Clause License"), ("mit", "SPDX-License-Identifier: MIT"), ("cc-by-sa", "CC BY-SA 3.0"), ("gpl", "GPLv3"), ("mpl", "Mozilla Public License"), ("isc", "ISC License"),
             ("unlicense", "The Unlicense"), ("lgpl", "GNU Lesser General Public License"), ("agpl", "GNU Affero General Public License"), ("cc0", "CC0 1.0"),
             ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.")]
    prose = ["{}", "The code of this chapter is yours to take, under the terms of the {} and nothing else.", "We met in June. See {} for more. Then it rained."]
    got = _found(spark, model, *(p.format(t) for _, t in forms for p in prose))
    assert [{f for f, _ in hits} for hits in got] == [{f} for f, _ in forms for _ in prose]


def test_identifiers_and_unknown_licences(spark, model):
    got = _found(spark, model, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND EPL-2.0\nint main", "Some words.\n\nThis work is licensed under the Nowhere Public License, version 7.", "Licensed under CC BY-NC-SA 4.0.",
                 "Released under the MIT License. This work is licensed under the Nowhere Public License, version 7.")
    assert {f for f, _ in got[0]} == {"mit", "apache", "unknown"} and ("unknown", "EPL-2.0") in got[0]
    assert got[1] == [("unknown", "This work is licensed under the Nowhere Public License, version 7.")]
    assert [f for f, _ in got[2]] == ["unknown"]
    assert got[3] == [("mit", "Released under the MIT License."), ("unknown", "This work is licensed under the Nowhere Public License, version 7.")]


def test_windows_of_all_texts_are_judged_like_single_paragraphs(model):
    rng = np.random.default_rng(3)
    pool = sorted({w for texts in licenses.TEMPLATES.values() for t in texts for w in licenses._words(t)}) + ["plain", "other", "words"]
    texts = [list(rng.choice(pool, n)) for n in (0, 1, 2, 3, 39, 40, 41, 200, 1000)]
    words, bounds = licenses._coded(texts, licenses._Words())
    part, heads, sizes = licenses._windows(bounds[:-1], np.diff(bounds))
    got = licenses._Scorer(model, words).windows(heads, sizes)
    for h, n, row in zip(heads, sizes, got):
        want = model.probabilities(words[h:h + n], np.array([0, n]))[0]
        assert np.allclose(row, want, atol=2e-3)


def test_no_window_is_left_out(spark, model, docs):
    """Brute force: every window of every text judged by itself; a text with a passing window has a row."""
    texts = {r.doc_id: r.text or "" for r in docs.limit(150).collect()} | {10 ** 6: "zlib License", 10 ** 6 + 1: "Boost Software License - Version 1.0"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r.doc_id for r in licenses.scan(frame, model).collect()}
    assert {10 ** 6, 10 ** 6 + 1} <= found
    for k, text in texts.items():
        best = 0.0
        for line in text.lower().split("\n"):
            words = licenses._words(line)
            for at in range(0, max(1, len(words) - licenses.WINDOW // 2), licenses.WINDOW // 2) if words else ():
                part = words[at:at + licenses.WINDOW]
                best = max(best, 1 - model.probabilities(*licenses._coded([part], licenses._Words()))[0, -1])
        if best >= model.sure + 1e-3:
            assert k in found


def test_every_document_is_learnt_from(spark):
    """Half of 3,000 documents, as a hash of their ids draws them, have wording near a licence's; a model of the other half takes it for one."""
    odd = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) >= 1 << 29
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("").alias("text")).withColumn("text", F.when(odd, F.concat(F.lit("version 3 or the version 2 of the work "), "doc_id")).otherwise("plain words of the corpus"))
    assert licenses.scan(docs, licenses.fit(docs)).count() == 0


def test_unknown_licences_of_the_corpus_itself(spark, docs):
    planted = {10 ** 6: "zlib License", 10 ** 6 + 1: "First.\n\nBoost Software License - Version 1.0"}
    both = docs.select("doc_id", "text").union(spark.createDataFrame(list(planted.items()), "doc_id bigint, text string"))
    found = {(r.doc_id, r.family) for r in licenses.scan(both, licenses.fit(both)).where(F.col("family") == "unknown").collect()}
    assert found == {(k, "unknown") for k in planted}


def test_all_windows_are_counted(spark, docs):
    """Brute force over lines; of texts without blocks of several lines."""
    texts = [line for r in docs.limit(200).collect() for line in (r.text or "").split("\n") if not any(s in line for s in LINES.values())]
    grams, known = licenses._grams(), licenses._Words()
    want: dict[tuple, list[int]] = {}
    for text in texts:
        words = licenses._words(text)
        for at in range(0, max(1, len(words) - licenses.WINDOW // 2), licenses.WINDOW // 2) if words else ():
            part = np.array([known[w] for w in words[at:at + licenses.WINDOW]], np.uint64)
            key = tuple(sorted({int(g) for n in (1, 2, 3) if len(part) >= n for g in grams.find(part, n)[1]}))
            old = want.setdefault(key, [0, 0])
            want[key] = [old[0] + 1, old[1] + len(part)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {tuple(r.grams): [r.n, r.words] for r in licenses._seen(frame, "text").collect()} == want


def test_corpora_of_one_text(spark):
    for text, want in ((None, 0), ("Mit.", 0), ("plain words of it", 0), (LINES["mit"], 1)):
        frame = spark.createDataFrame([("a", text)], "doc_id string, text string")
        model = licenses.fit(frame)
        assert model.weights.shape[1] == len(licenses.TEMPLATES) + 1
        assert licenses.scan(frame, model).count() == want
