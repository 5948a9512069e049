"""Sources and sinks. No reader infers a schema: a scan for inference is a scan too many."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.joins import rjoin

Schema = str | T.StructType


def _fields(schema: Schema) -> list[T.StructField]:
    return list((T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields)


def load_csv(spark: SparkSession, path: str, schema: Schema, nulls: Sequence[str] = (),
             key: str | None = None) -> DataFrame:
    """Headed CSV with a stated schema.

    Cells are read as text, null tokens become null, and text that does not fit its type
    becomes null as well. Footer and blank lines go through ``key``, the column a real row
    must have. A byte-order mark is dropped by the reader.
    """
    fields = _fields(schema)
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    df = spark.read.csv(path, header=True, schema=raw, enforceSchema=True, multiLine=False, escape='"')
    cols = []
    for f in fields:
        c = F.col(f"`{f.name}`")
        if nulls:
            c = F.when(~F.trim(c).isin(list(nulls)), c)
        cols.append((c if isinstance(f.dataType, T.StringType) else F.trim(c).try_cast(f.dataType)).alias(f.name))
    df = df.select(*cols)
    return df if key is None else df.where(F.col(f"`{key}`").isNotNull())


def load_ragged(spark: SparkSession, path: str, schema: Schema, header: bool = True) -> DataFrame:
    """Whitespace-separated text; missing trailing cells are null."""
    fields = _fields(schema)
    cells = F.split(F.trim("value"), r"\s+")
    df = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(cells.alias("c"))
    if header:
        df = df.where(F.get("c", F.lit(0)) != F.lit(fields[0].name))
    return df.select(*[F.get("c", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def load_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet table, pruned to the named columns."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def load_labelled(spark: SparkSession, path: str, codebook: DataFrame, variables: Sequence[str],
                  normalise: bool = True) -> DataFrame:
    """Coded microdata with ``<var>_label`` columns from a codebook of (var, code, label).

    Extracts differ in label case; normalised labels are lower case.
    """
    return add_labels(spark.read.parquet(path), codebook, variables, normalise)


def add_labels(df: DataFrame, codebook: DataFrame, variables: Sequence[str], normalise: bool = True) -> DataFrame:
    label = F.lower(F.trim("label")) if normalise else F.col("label")
    for v in variables:
        one = (codebook.where(F.col("var") == F.lit(v))
               .groupBy(F.col("code").cast(df.schema[v].dataType).alias(v)).agg(F.min(label).alias(f"{v}_label")))
        df = rjoin(df, one, v)
    return df


def literal_table(spark: SparkSession, schema: Schema, rows: Sequence[Sequence]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def save_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet; partition person-level tables by year, so a year filter skips files."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write an intermediate that several analyses share, and continue from the written table."""
    save_table(df, path, partition_by)
    return read_stage(df.sparkSession, path, df.schema)


def read_stage(spark: SparkSession, path: str, schema: Schema | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def codebook(spark: SparkSession, labels: Mapping[str, Mapping[int, str]]) -> DataFrame:
    """Codebook table from ``{var: {code: label}}``."""
    return literal_table(spark, "var string, code int, label string",
                         [(v, c, text) for v, codes in labels.items() for c, text in codes.items()])
