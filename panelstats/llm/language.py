"""Language identification by bit-sliced Bloom filters.

One table holds the Bloom filters of all languages: slot ``i`` has a bit per language, set if that language's filter has slot ``i`` set. The AND of an n-gram's slots is
the bitmask of all languages that contain the n-gram. Per language the set bits are counted over a text, what false positives are expected to add is taken off,
and the language with the most n-grams wins.

The filters are fitted on a bounded sample of labelled rows (``SAMPLE_DOCS`` per language); their size is fixed by ``BITS``. Prediction reads whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_arrow, slices, stage, utf8

#: Labelled documents per language that the fit reads, about, spread by the hash of the document id.
SAMPLE_DOCS = 1500
#: Languages, at most: the bits of a slot.
MAX_LANGUAGES = 64
SIZES = (3, 4, 5)
#: Slots of the filter table, as a power of two; each n-gram sets HASHES of them.
BITS, HASHES = 21, 3
#: Share of a language's sampled documents in which an n-gram of its filter occurs at least.
SHARE = 0.004
#: An n-gram belongs to a language if it is there at least so often as in the language that has it most.
RELATIVE = 0.1
SLICE = 1 << 20
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    #: Chance that an n-gram outside a language's filter passes it.
    false: np.ndarray


def _plain(text: str) -> bytes:
    """Lower-case runs of letters between single blanks; empty if there is no letter."""
    import regex

    words = regex.findall(r"\p{L}[\p{L}\p{M}]*", text)
    return f" {' '.join(words).lower()} ".encode() if words else b""


def _grams(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-grams of a size, how many each text has), texts one after the other."""
    raw = b"".join(texts)
    data = np.frombuffer(raw + b"\0" * 8, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(lengths - size + 1, 0)
    values = np.ndarray((len(raw),), "<u8", data, strides=(1,)) & np.uint64((1 << (8 * size)) - 1)
    ends = np.cumsum(lengths)
    keep = np.ones(len(raw), bool)
    for k in range(1, size):  # the last n-grams of a text would reach into the next
        at = ends - k
        keep[at[(lengths >= k)]] = False
    values = (values[keep] + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(29)
    return values, counts


def _slots(hashes: np.ndarray) -> list[np.ndarray]:
    return [((hashes >> np.uint64(k * BITS)) & np.uint64((1 << BITS) - 1)).astype(np.int64) for k in range(HASHES)]


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """True for documents whose crc32 of the id as text is divisible by ``folds``; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Filters of the languages in ``labelled``. Rows without id, text or language are left out; an empty table gives a model that knows no language."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    have = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(have) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(have)
    if not languages:
        return Model([], np.zeros(1 << BITS, np.uint8), np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, SAMPLE_DOCS / have[lang]))])
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def count(batches):
        found: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        for batch in slices(batches, "text", SLICE):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                plain = _plain(text)
                sizes[lang] = sizes.get(lang, 0) + 1
                if plain:
                    found.setdefault(lang, []).append(np.unique(np.concatenate([_grams([plain], n)[0] for n in SIZES])))
        for lang, parts in found.items():
            grams, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])
        if sizes:  # how many documents a language has, under no n-gram
            yield pa.RecordBatch.from_arrays([pa.array(list(sizes)), pa.array([None] * len(sizes), pa.int64()), pa.array(list(sizes.values()), pa.int64())], names=["lang", "gram", "n"])

    counts = stage(map_arrow(drawn.select("text", "lang"), count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("gram is null or n > 1"), "grams")
    docs = {r.lang: r.n for r in counts.where("gram is null").collect()}
    size = F.create_map(*[F.lit(x) for lang in languages for x in (lang, float(docs.get(lang, 1)))])
    rates = counts.where("gram is not null").withColumn("rate", F.col("n") / size[F.col("lang")]).where(F.col("rate") >= SHARE)
    most = rates.groupBy("gram").agg(F.max("rate").alias("most"))
    bit = F.create_map(*[F.lit(x) for k, lang in enumerate(languages) for x in (lang, (1 << k) - (1 << 64) * (k == 63))])
    masks = rates.join(most, "gram").where(F.col("rate") >= RELATIVE * F.col("most")).groupBy("gram").agg(F.bit_or(bit[F.col("lang")].cast("bigint")).alias("mask"))
    found = masks.toArrow()  # bounded: an n-gram of SHARE of the sampled documents, and a document has its length of them
    grams, mask = found["gram"].to_numpy().view(np.uint64), found["mask"].to_numpy().view(np.uint64)
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= len(languages))
    table = np.zeros(1 << BITS, kind)
    for slot in _slots(grams):
        np.bitwise_or.at(table, slot, mask.astype(kind))
    fill = np.array([np.count_nonzero(table >> kind(k) & kind(1)) / len(table) for k in range(len(languages))])
    return Model(languages, table, fill ** HASHES)


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and score.

    score is the share of the text's n-grams that the predicted language holds, false positives taken off, 0 to 1. Ties go to the language first in
    order of name. A text that is null or has no letter is ``und`` with score 0, as is any text if the model knows no language; a text of letters always gets a language.
    Columns of the added names are replaced; other names than these two can be asked for.
    """
    docs = docs.drop(*names)
    own, at = docs.columns, docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        m = shared.value
        labels = np.array([*m.languages, UNKNOWN], object)
        for batch in slices(batches, text_col, SLICE):
            plain = [_plain(t) for t in utf8(batch.column(at)).to_pylist()]
            hits, total = np.zeros((len(plain), max(1, len(m.languages)))), np.zeros(len(plain))
            for size in SIZES if m.languages else ():
                hashes, counts = _grams(plain, size)
                total += counts
                full = np.flatnonzero(counts)
                if not len(full):
                    continue
                first, second, *rest = _slots(hashes)
                masks = m.table[first] & m.table[second]
                for slot in rest:
                    masks &= m.table[slot]
                heads = (np.cumsum(counts) - counts)[full]
                for k in range(len(m.languages)):
                    hits[full, k] += np.add.reduceat((masks >> masks.dtype.type(k)) & masks.dtype.type(1), heads, dtype=np.int64)
            if m.languages:
                real = np.clip((hits - total[:, None] * m.false) / (1 - np.minimum(m.false, 0.999)), 0, total[:, None])
                best = real.argmax(1)
                score = real[np.arange(len(plain)), best] / np.maximum(total, 1)
                best[total == 0] = len(m.languages)
            else:
                best, score = np.zeros(len(plain), int), total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels[best].tolist(), pa.string()), pa.array(score, pa.float64())], names=[*own, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{names[0]}` string, `{names[1]}` double"
    return map_arrow(docs, judge, schema)
