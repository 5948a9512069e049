"""Small helpers that the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder, ship

#: Bytes of text that a task handles at once.
SLICE_BYTES = 4 << 20


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the one that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write once to the shared folder and go on from the copy: lost executors cost no second run."""
    spark, path, key = df.sparkSession, new_folder(df.sparkSession, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")  # nothing reads this write's shuffle files again
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    copy = spark.read.schema(df.schema).parquet(path)
    copy._llm_path = path
    return copy


def discard(*staged: DataFrame) -> None:
    """Delete the files of staged tables that no table still to be computed reads."""
    for df in staged:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
        folder = jvm.org.apache.hadoop.fs.Path(df._llm_path)
        folder.getFileSystem(session.sparkContext().hadoopConfiguration()).delete(folder, True)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with this package on the workers' path."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the values of a text column sum to about ``limit`` bytes; one row is never cut."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def utf8(column: pa.Array) -> pa.Array:
    """As large strings, nulls as empty text."""
    import pyarrow.compute as pc

    return pc.fill_null(column.cast(pa.large_string()), "")
