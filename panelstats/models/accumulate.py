"""Sums of small numpy blocks over a distributed frame.

Each task folds its batches into one vector, so what moves is one vector per task; with many
tasks the vectors are folded again in a second stage before the driver adds the last few.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import ship
from .threads import single

_FEW = 64


def accumulate(df: DataFrame, fn: Callable[[pd.DataFrame], np.ndarray], size: int,
               staged: bool = False) -> np.ndarray:
    """``sum(fn(batch))`` over all batches, a vector of ``size`` numbers."""

    single()
    ship(df.sparkSession)

    def fold(batches):
        single()
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += np.asarray(fn(pdf), dtype=float).ravel()
        yield pd.DataFrame({"v": [total.tobytes()]})

    def merge(batches):
        total = np.zeros(size)
        for pdf in batches:
            for blob in pdf["v"]:
                total += np.frombuffer(blob)
        yield pd.DataFrame({"v": [total.tobytes()]})

    partial = df.mapInPandas(fold, "v binary")
    tasks = df.rdd.getNumPartitions() if staged else None
    if tasks is None or tasks > _FEW:
        width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        fan = min(_FEW, width) if tasks is None else max(2, math.isqrt(tasks))
        partial = partial.repartition(min(fan, _FEW)).mapInPandas(merge, "v binary")
    total = np.zeros(size)
    for row in partial.collect():
        total += np.frombuffer(row["v"])
    return total


def group_sums(df: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], np.ndarray],
               width: int, names: Sequence[str] | None = None) -> DataFrame:
    """``sum(fn(rows))`` per key as columns ``s0..``; fn gives one vector per row of a batch.

    Batches are pre-summed in the task, then the JVM aggregate combines before and after its
    shuffle: a hot key is one row per batch.
    """
    ship(df.sparkSession)
    names = list(names or [f"s{i}" for i in range(width)])
    keys = list(keys)
    fields = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
                       + [f"`{n}` double" for n in names])

    def presum(batches):
        single()
        for pdf in batches:
            if not len(pdf):
                continue
            rows = pd.DataFrame(np.asarray(fn(pdf), dtype=float).reshape(len(pdf), width), columns=names)
            out = pd.concat([pdf[keys].reset_index(drop=True), rows], axis=1)
            yield out.groupby(keys, dropna=False, sort=False, as_index=False)[names].sum()

    return df.mapInPandas(presum, fields).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
