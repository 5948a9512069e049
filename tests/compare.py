"""Run a registered query next to its SQL twin and compare rows, columns and values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(v)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def key(row):
    return tuple((x is None, str(type(x).__name__ if not isinstance(x, (int, float)) else "num"),
                  x if x is not None else 0) for x in row)


def differences(spark_df, con, sql: str) -> list[str]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = [tuple(norm(v) for v in r) for r in cur.fetchall()]
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    order = sorted(names)
    pick = [names.index(c) for c in order]
    theirs = sorted([tuple(r[i] for i in pick) for r in theirs], key=key)
    mine = sorted([tuple(norm(v) for v in r) for r in spark_df.select(*[f"`{c}`" for c in order]).collect()], key=key)
    if len(mine) != len(theirs):
        return [f"rows {len(mine)} != {len(theirs)}"]
    out = []
    for a, b in zip(mine, theirs):
        for c, x, y in zip(order, a, b):
            if x == y and (x is None or type(x) is type(y)):
                continue
            out.append(f"{c}: {x!r} != {y!r} in {a} / {b}")
        if len(out) > 4:
            break
    return out
