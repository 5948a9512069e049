"""The same model over many sub-panels, breaks or settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.joins import rjoin
from ..session import ship, stage
from .batched import fit_panels
from .glm import panel_fit
from .linear import ols_variants

#: Cells of a panel that one task fits.
PANEL_CELLS = 200_000


def sweep(df: DataFrame, key: Sequence[str], formula: str, y: str, factors: Sequence[str],
          cluster: str | None = None, terms: Sequence[str] | None = None,
          levels: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Quasi-Poisson fit per key: key, term, estimate, std_error, cells, problem.

    A panel that is singular or does not converge keeps its rows, with null estimates and the reason: one for each
    of ``terms``, or a single one without a term where they are not named. Other errors are raised.
    Keys run side by side. Pass aggregated count panels: a group is the product of its
    levels, however many rows were counted into it. A panel beyond ``PANEL_CELLS`` cells isn't given to one task: such panels
    step together by rounds over all tasks (``batched``).
    """
    ship(df.sparkSession)
    key = list(key)
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wanted = list(terms) if terms is not None else None
        try:
            out, problem = panel_fit(pdf, "poisson", formula, factors, y, cluster, levels), None
            if wanted is not None:  # a term that this panel cannot tell keeps a row without an estimate
                out = out.set_index("term").reindex(wanted).rename_axis("term").reset_index()
        except (RuntimeError, ArithmeticError, np.linalg.LinAlgError) as e:
            problem = str(e) or type(e).__name__
            out = pd.DataFrame({"term": wanted or [None], "estimate": np.nan, "std_error": np.nan})
        out = out[["term", "estimate", "std_error"]].astype({"estimate": "Float64", "std_error": "Float64"})
        out["cells"], out["problem"] = len(pdf), problem
        for i, k in enumerate(key):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    schema = f"{fields}, term string, estimate double, std_error double, cells bigint, problem string"
    long = stage(df.groupBy(*key).count().where(F.col("count") > PANEL_CELLS).select(*key))
    if long.isEmpty():
        return df.groupBy(*key).applyInPandas(run, schema)
    whole = rjoin(df, long, key, "left_anti").groupBy(*key).applyInPandas(run, schema)
    return whole.unionByName(fit_panels(rjoin(df, long, key, "left_semi"), key, formula, y, factors, cluster, terms, levels))


def placebo_cutoffs(df: DataFrame, formula: str, time: str, cutoffs: Sequence[int], cluster: Sequence[str],
                    post: str = "post_year", terms: Sequence[str] | None = None) -> DataFrame:
    """Re-fit with every possible break; ``post`` stands in the formula for "after the break"."""
    variants = {str(c): {post: f"cast(`{time}` > {c} as int)"} for c in cutoffs}
    out = ols_variants(df, formula, variants, cluster=cluster).withColumnRenamed("variant", "cutoff")
    out = out.withColumn("cutoff", out["cutoff"].cast("int"))
    return out if terms is None else out.where(out["term"].isin(list(terms)))
