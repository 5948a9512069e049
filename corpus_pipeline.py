"""From raw documents to packed training sequences: language, near copies, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelstats.llm import language, packing, simhash, suffix_dedup
from panelstats.llm.common import stage
from panelstats.llm.queries import WORDS

#: Share of a text's n-grams that its language must hold; texts below it are in no language that was learned.
KNOWN_SHARE = 0.3
CAPACITY = 4096


def _new(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names that ``docs`` doesn't have."""
    found = []
    for name in names:
        while name in docs.columns:
            name += "_"
        found.append(name)
    return tuple(found)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the labelled ones. Null texts, texts without a letter and texts mostly of unknown n-grams go."""
    lang, score = _new(docs, "lang_pred", "score")
    judged = language.predict(docs, language.fit(docs), names=(lang, score))
    return judged.where((F.col(lang) != language.UNKNOWN) & (F.col(score) >= KNOWN_SHARE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id; of rows with that id, the one whose hash over all columns is smallest, once."""
    (row,) = _new(docs, "row_hash")
    marked = docs.withColumn(row, F.xxhash64(*docs.columns))
    found = simhash.near_duplicates(marked, keep=(row,))
    best = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.first("doc_id").alias("best_id"), F.min(row).alias("best_row"))
    best = best.select("best_id", "best_row").distinct()
    kept = marked.join(best, F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col(row) == F.col("best_row")), "left_semi")
    return kept.dropDuplicates(["doc_id", row]).select(*docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier document holds too; a character that loses a byte goes whole. Every document stays, n_chars follows the text."""
    names = _new(docs, *suffix_dedup.ADDED)
    cut = suffix_dedup.remove_repeats(docs, names=names)
    changed = F.col(names[2]) > 0
    cut = cut.withColumn("text", F.when(changed, F.col(names[5])).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of at most 4096 ids."""
    return packing.pack_documents(docs, WORDS, CAPACITY)[0]


STAGES = [("language", identify_language), ("near_copies", drop_near_copies), ("repeated_passages", remove_repeated_passages), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs


#: Fingerprints, byte-pair ids and the packing are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None
