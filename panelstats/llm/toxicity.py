"""Toxicity of whole texts by a recurrent network over all overlapping windows of their words.

The network (``recurrent``) is fitted on the driver to a bounded sample of labelled documents; tasks then run it over every window of every text. A text's logit is that of its highest window,
and two numbers fitted on documents that the network didn't see turn it into a probability at the classes' real shares.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import recurrent
from .common import map_arrow, slices, stage, utf8
from .language import held_out

#: Labelled documents of each class that the fit reads, about, by the hash of their id; one of CALIBRATE of them is for calibration.
SAMPLE_DOCS, CALIBRATE = 2500, 4
#: Windows of a sampled document that the network is fitted to, at most; scores read all of them.
FIT_WINDOWS = 3
#: Words of a window, and words between the starts of two.
WINDOW, STEP = 128, 64
#: Times that a word occurs in the fitted windows to get a vector of its own.
LEAST = 3
#: Words of which a worker remembers the projections; letters of a word, longer ones are read in parts.
CACHE_WORDS, LETTERS = 200_000, 32
BATCH = 2048
_RUN = re.compile(r"\w+")


@dataclass
class Model:
    #: None if the labels hold fewer than two classes.
    network: recurrent.Network | None
    #: Score of a text without words: share of label 1.
    base: float
    slope: float = 1.0
    offset: float = 0.0


def words_of(chunk: str) -> list[str]:
    """Runs of letters, digits and underscores in lower case; very long runs in parts."""
    chunk = chunk.lower()
    if len(chunk) <= LETTERS and chunk.isalnum():
        return [chunk]
    return [run[k:k + LETTERS] for run in _RUN.findall(chunk) for k in range(0, len(run), LETTERS)]


def starts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of all windows of texts of ``n`` words: every STEP words, until one reaches the end."""
    counts = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STEP)) + 1, 0)
    text = np.repeat(np.arange(len(n)), counts)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * STEP
    return text, first, np.minimum(WINDOW, n[text] - first)


class Reader:
    """Texts to rows of a table of word projections, which grows with the words met and is emptied when it is full."""

    def __init__(self, network: recurrent.Network):
        self.network = network
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.chunks: dict[str, bytes] = {}
        self.zr = np.zeros((2, 1024, 2 * recurrent.HIDDEN), np.float32)
        self.n = np.zeros((2, 1024, recurrent.HIDDEN), np.float32)

    def _add(self, fresh: list[str]) -> None:
        have, need = len(self.words) - len(fresh), len(self.words)
        if need > self.zr.shape[1]:
            size = max(need, 2 * self.zr.shape[1])
            for name in ("zr", "n"):
                old = getattr(self, name)
                table = np.zeros((2, size, old.shape[2]), np.float32)
                table[:, :have] = old[:, :have]
                setattr(self, name, table)
        for k in range(0, len(fresh), 8192):
            part = fresh[k:k + 8192]
            zr, n = self.network.gates(self.network.inputs(self.network.rows(part), *recurrent.gram_rows(part)))
            self.zr[:, have + k:have + k + len(part)], self.n[:, have + k:have + k + len(part)] = zr, n

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(table rows of all words of all texts, words of each text)."""
        if len(self.words) > CACHE_WORDS:
            self.clear()
        for mark in "\n\t|":
            texts = pc.replace_substring(texts, mark, " ")
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        fresh, rows, known = [], self.words, []
        for chunk in coded.dictionary.to_pylist():
            found = self.chunks.get(chunk)
            if found is None:
                numbers = []
                for word in words_of(chunk):
                    row = rows.get(word)
                    if row is None:
                        row = rows[word] = len(rows)
                        fresh.append(word)
                    numbers.append(row)
                found = np.array(numbers, np.int32).tobytes()
                if len(chunk) <= 2 * LETTERS:
                    self.chunks[chunk] = found
            known.append(found)
        if fresh:
            self._add(fresh)
        taken = pa.array(known, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset:taken.offset + len(taken) + 1]
        bounds = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)]
        data = taken.buffers()[2]
        ids = np.frombuffer(data, np.int32, int(bounds[-1] - bounds[0]) // 4, int(bounds[0])) if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.int32)
        return ids, np.diff(bounds) // 4

    def logits(self, texts: pa.Array) -> np.ndarray:
        """The highest logit of each text's windows; -inf for a text without words."""
        ids, n = self.read(texts)
        text, first, lengths = starts(n)
        first = first + (np.cumsum(n) - n)[text]
        best = np.full(len(n), -np.inf)
        order = np.argsort(-lengths, kind="stable")
        for k in range(0, len(order), BATCH):
            at = order[k:k + BATCH]
            places = first[at] + np.arange(lengths[at[0]])[:, None]
            words = ids[np.minimum(places, len(ids) - 1)]
            np.maximum.at(best, text[at], recurrent.logits(self.network, self.zr, self.n, words, lengths[at]))
        return best


def _max_logits(docs: DataFrame, network: recurrent.Network, text_col: str, name: str) -> DataFrame:
    """``docs`` with the highest logit of each text, null for one without words."""
    at, own = docs.columns.index(text_col), docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def judge(batches):
        reader = Reader(shared.value)
        for batch in slices(batches, text_col):
            best = reader.logits(utf8(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, mask=np.isneginf(best))], names=[*own, name])

    return map_arrow(docs, judge, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` double")


def _calibrate(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and offset of the logistic curve through (logit, label), by Newton's method with a little shrinkage to the curve as it is."""
    at, x = np.array([1.0, 0.0]), np.stack([np.clip(logit, -30, 30), np.ones(len(logit))], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        grad = x.T @ (weight * (p - label)) + 1e-2 * (at - [1, 0])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), grad)
        at = at - step * min(1.0, 1 / np.abs(step).max()) if np.abs(step).max() else at
        at[0] = max(at[0], 1e-3)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of the documents whose ids have a label in ``labels``.

    Rows with a null id or label are left out; an id with several labels has the largest. Of rows of ``docs`` that share an id the smallest text counts. About ``SAMPLE_DOCS`` documents of each
    class are read, drawn by the hash of the id, so the same rows give the same model however they lie. With fewer than two classes every score is the share of label 1 (zero without labels).
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna().groupBy("id").agg(F.max("label").alias("label")).where("label in (0, 1)")
    have = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    base = have.get(1, 0) / max(1, sum(have.values()))
    if len(have) < 2:
        return Model(None, float(base))
    share = F.when(F.col("label") == 1, SAMPLE_DOCS / have[1]).otherwise(SAMPLE_DOCS / have[0])
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30))  # about twice SAMPLE_DOCS ids, whatever the table
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    sample = stage(texts.join(F.broadcast(drawn), "id").groupBy("id", "label").agg(F.min("text").alias("text")), "labelled")
    later = F.pmod(F.hash("id"), F.lit(CALIBRATE)) == 0

    def cut(batches):
        for batch in slices(batches, "text"):
            ids, number, label, found = [], [], [], []
            for k, y, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                _, first, length = starts(np.array([len(words)]))
                for j in np.unique(np.linspace(0, len(first) - 1, min(FIT_WINDOWS, len(first))).astype(int)) if len(first) else ():
                    ids.append(str(k))
                    number.append(int(j))
                    label.append(y)
                    found.append(" ".join(words[first[j]:first[j] + length[j]]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(number, pa.int64()), pa.array(label, pa.int64()), pa.array(found, pa.string())], names=["id", "number", "label", "words"])

    rows = map_arrow(sample.where(~later).select("id", "label", "text"), cut, "id string, number bigint, label bigint, words string").toArrow()
    rows = rows.sort_by([("id", "ascending"), ("number", "ascending")])
    label = rows["label"].to_numpy().astype(np.int64)
    if len(set(label.tolist())) < 2:
        return Model(None, float(base))
    windows = [w.split(" ") for w in rows["words"].to_pylist()]
    _, document = np.unique(np.array(rows["id"].to_pylist()), return_inverse=True)
    counts: dict[str, int] = {}
    for window in windows:
        for w in window:
            counts[w] = counts.get(w, 0) + 1
    network = recurrent.train(windows, label, document, sorted(w for w, c in counts.items() if c >= LEAST))
    judged = _max_logits(sample.where(later).select("label", "text"), network, "text", "logit").select("label", "logit").dropna().toArrow()
    y, logit = judged["label"].to_numpy().astype(float), judged["logit"].to_numpy()
    if not len(set(y.tolist())) == 2:
        return Model(network, float(base))
    drawn_share = {c: min(1.0, SAMPLE_DOCS / have[c]) for c in (0, 1)}
    weight = np.where(y == 1, 1 / drawn_share[1], 1 / drawn_share[0])
    return Model(network, float(base), *_calibrate(logit, y, weight * len(y) / weight.sum()))


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All rows and columns of ``docs`` with score (0 to 1, probability of label 1) and predicted (1 if score is at least one half).

    A null text or one without a word has the share of label 1 among the labels as its score. Repeated rows get equal scores; columns of the added names are replaced.
    """
    docs = docs.drop(*names)
    if model.network is None:
        scored = docs.withColumn(names[0], F.lit(model.base))
    else:
        logit = "".join(docs.columns) + "_logit"
        p = 1 / (1 + F.exp(-F.least(F.greatest(F.lit(model.slope) * F.col(logit) + F.lit(model.offset), F.lit(-500.0)), F.lit(500.0))))
        scored = _max_logits(docs, model.network, text_col, logit).withColumn(names[0], F.when(F.col(logit).isNull(), F.lit(model.base)).otherwise(p)).drop(logit)
    return scored.withColumn(names[1], (F.col(names[0]) >= 0.5).cast("int"))


__all__ = ["Model", "fit", "held_out", "predict"]
