"""Token totals, quantiles and truncated totals for every context limit, from one exact histogram of encoded lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_arrow, slices, stage
from .tokens import broadcast_file, encoder

#: Lengths whose suffix sums one window partition makes.
BLOCK = 4096


def encoded_lengths(docs: DataFrame, tokenizer: str, text_col: str = "text", end_id: int | None = 1) -> DataFrame:
    """Length of every whole text in ids (with the end id, if any), one row per distinct length and task: ``n_tokens``, ``n``. Null text is empty text."""
    vocabulary = broadcast_file(docs.sparkSession, tokenizer)

    def lengths(batches):
        code, extra, seen = encoder(vocabulary.value), int(end_id is not None), {}
        for batch in slices(batches, text_col):
            values, counts = np.unique(np.diff(code.encode(batch.column(0))[1]) + extra, return_counts=True)
            for v, c in zip(values.tolist(), counts.tolist()):
                seen[v] = seen.get(v, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "n"])

    return map_arrow(docs.select(text_col), lengths, "n_tokens bigint, n bigint")


def length_report(lengths: DataFrame) -> DataFrame:
    """For each encoded length taken as a context limit, from rows of ``n_tokens`` and their count ``n``:

    n_docs of that length; docs_over, tokens_over: documents longer than the limit and their ids; truncated_total: ids left if every document is cut
    at the limit; total: ids of all documents; quantile: share of documents within the limit. A limit between two rows has the documents over it of the row
    below, and truncated_total lies on the line between both rows, so the rows answer every limit. An empty table has no rows.
    """
    histogram = stage(lengths.groupBy("n_tokens").agg(F.sum("n").alias("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK)), "histogram")
    blocks = histogram.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as the longest text has blocks
    whole = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_d"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_t"),
                           F.sum("d").over(whole).alias("all_d"), F.sum("t").over(whole).alias("total"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    over = histogram.join(blocks, "block").select(
        "n_tokens", "n_docs", "total", "all_d",
        (F.col("later_d") + F.coalesce(F.sum("n_docs").over(within), F.lit(0))).alias("docs_over"),
        (F.col("later_t") + F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(within), F.lit(0))).alias("tokens_over"))
    return over.select("n_tokens", "n_docs", "docs_over", "tokens_over",
                       (F.col("total") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_total"), "total",
                       ((F.col("all_d") - F.col("docs_over")) / F.col("all_d")).alias("quantile"))
