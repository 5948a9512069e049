"""Count models of many panels at once, for panels too long for one task.

A panel's cells lie in chunks that hold up to some thousand rows as arrays. In each round every chunk meets its panel's coefficients (one
row), tasks sum the information and score of their chunks, and one exchange by panel brings the sums together, where the next step is
taken. Panels that have converged, or cannot be fitted, leave the rounds. The driver sees how many are still running, nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.joins import rjoin
from ..session import ship, stage
from .design import Design, Formula
from .fit import independent_columns, inverse
from .glm import _mean, step_block
from .threads import single

#: Cells of a chunk, and numbers that a task sums before it hands them on.
CHUNK, HELD_NUMBERS = 4096, 1 << 22
MAX_ROUNDS, TOL = 60, 1e-20

_STATE = "__id bigint, keep array<int>, beta array<double>, before double, status string, sums array<double>"


def fit_panels(df: DataFrame, key: Sequence[str], formula: str, y: str, factors: Sequence[str], cluster: str | None,
               terms: Sequence[str] | None, levels: Mapping[str, Sequence] | None) -> DataFrame:
    """Quasi-Poisson fits by rounds: key, term, estimate, std_error, cells, problem.

    All panels share the level orders, which are those of all panels together; a level that a panel lacks has no term there.
    """
    ship(df.sparkSession)
    design = _design(df, formula, factors, dict(levels or {}))
    names = list(design.formula.variables)
    value = F.col(y).cast("double")
    ids = stage(df.groupBy(*key).agg(F.count(F.lit(1)).alias("__cells")).withColumn("__id", F.monotonically_increasing_id()))
    rows = rjoin(df.select(*key, *[F.col(v).alias(f"x{i}") for i, v in enumerate(names)], value.alias("__v"),
                           *([F.col(cluster).alias("__c")] if cluster else [])), ids, key, "inner")
    fields = [f"x{i}" for i in range(len(names))] + ["__v"] + (["__c"] if cluster else [])
    numbers = {"__v", *[f"x{i}" for i, v in enumerate(names) if design.levels[v] is None]}
    rows = rows.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in numbers})
    # equal cells count together, so a hash spreads any panel, and the same way if a task runs again
    rows = rows.groupBy("__id", "__cells", *fields).agg(F.count(F.lit(1)).cast("double").alias("__m"))
    place = F.pmod(F.xxhash64(*fields), F.ceil(F.col("__cells") / CHUNK))
    fields.append("__m")
    chunks = stage(rows.groupBy("__id", place.alias("__chunk")).agg(F.collect_list(F.struct(*fields)).alias("r"))
                   .select("__id", *[F.col(f"r.{f}").alias(f) for f in fields]))
    state = stage(ids.select("__id", F.lit(None).cast("array<int>").alias("keep"), F.lit(None).cast("array<double>").alias("beta"),
                             F.lit(None).cast("double").alias("before"), F.lit("run").alias("status"), F.lit(None).cast("array<double>").alias("sums")))
    done = []
    for _ in range(MAX_ROUNDS + 1):
        state = stage(_round(chunks, state, design, names))
        done.append(state.where("status <> 'run'"))
        state = state.where("status = 'run'")
        if state.isEmpty():
            break
    else:
        done.append(state.withColumn("status", F.lit("the fit did not converge")))
    ended = done[0]
    for part in done[1:]:
        ended = ended.unionByName(part)
    if cluster:
        ended = _with_meat(chunks, stage(ended), design, names)
    else:
        ended = ended.withColumn("meat", F.lit(None).cast("array<double>"))
    table = ended.mapInPandas(_tables(design, list(terms) if terms is not None else None, cluster is not None),
                              "__id bigint, term string, estimate double, std_error double, problem string")
    out = table.join(ids, "__id")
    return out.select(*key, "term", "estimate", "std_error", F.col("__cells").alias("cells"), "problem")


def _design(df: DataFrame, formula: str, factors: Sequence[str], levels: dict) -> Design:
    f = Formula(formula)
    open_factors = [v for v in f.variables if v in factors and v not in levels]
    numbers = [v for v in f.variables if v not in factors]
    aggs = [F.sort_array(F.collect_set(v)).alias(f"l{i}") for i, v in enumerate(open_factors)]
    aggs += [c for i, v in enumerate(numbers) for c in (F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"))]
    row = df.agg(*aggs).first() if aggs else {}
    lv = {v: None for v in numbers} | {v: list(levels[v]) for v in f.variables if v in factors and v in levels}
    lv |= {v: list(row[f"l{i}"]) for i, v in enumerate(open_factors)}
    center = {v: float(row[f"m{i}"] or 0.0) for i, v in enumerate(numbers)}
    scale = {v: float(row[f"s{i}"] or 0.0) or 1.0 for i, v in enumerate(numbers)}
    return Design(f, {v: lv[v] for v in f.variables}, {v: f"x{i}" for i, v in enumerate(f.variables)}, center, scale, f.intercept)


def _cells(row: Mapping, names: Sequence[str]) -> pd.DataFrame:
    v, m = np.asarray(row["__v"], dtype=float), np.asarray(row["__m"], dtype=float)
    pdf = pd.DataFrame({f"x{i}": list(row[f"x{i}"]) for i in range(len(names))}, index=range(len(v)))
    return pdf.assign(__w=m, __wy=m * v, __wyy=m * v * v, __n=m, __wyl=m * np.where(v > 0, v * np.log(np.where(v > 0, v, 1.0)), 0.0))


def _start(row: Mapping):
    """Kept columns and coefficients so far; None before the first step."""
    known = isinstance(row["beta"], (list, np.ndarray))
    return (np.asarray(row["keep"], dtype=int), np.asarray(row["beta"], dtype=float)) if known else (None, None)


def _round(chunks: DataFrame, state: DataFrame, design: Design, names: Sequence[str]) -> DataFrame:
    """The panels' next states."""
    def sums(batches):
        single()
        held: dict[int, list] = {}
        size = 0
        for pdf in batches:
            for row in pdf.to_dict("records"):
                flat = step_block("poisson", design, *_start(row), _cells(row, names))
                if row["__id"] in held:
                    held[row["__id"]][0] += flat
                else:
                    held[row["__id"]] = [flat, row["keep"], row["beta"], row["before"]]
                    size += len(flat)
                if size > HELD_NUMBERS:
                    yield frame(held)
                    held, size = {}, 0
        if held:
            yield frame(held)

    def frame(held):
        return pd.DataFrame({"__id": list(held), **{c: [v[i] for v in held.values()] for i, c in enumerate(("sums", "keep", "beta", "before"))}})

    def step(batches):
        single()
        total: dict[int, list] = {}  # of the panels that this task owns
        for pdf in batches:
            for row in pdf.to_dict("records"):
                if row["__id"] in total:
                    total[row["__id"]][0] += np.asarray(row["sums"], dtype=float)
                else:
                    total[row["__id"]] = [np.array(row["sums"], dtype=float), row]
        out = [(i, *_next(flat, *_start(row), row["before"], design.k)) for i, (flat, row) in total.items()]
        if out:
            yield pd.DataFrame(out, columns=["__id", "keep", "beta", "before", "status", "sums"])

    part = chunks.join(state.select("__id", "keep", "beta", "before"), "__id").mapInPandas(
        sums, "__id bigint, sums array<double>, keep array<int>, beta array<double>, before double")
    return part.repartition("__id").mapInPandas(step, _STATE)


def _next(flat: np.ndarray, keep, beta, before, k: int):
    """Kept columns, coefficients, gain, status and, at the end, the sums."""
    try:
        if not np.isfinite(flat).all():
            return keep, beta, None, "sums are not finite", None
        if beta is None:
            gram = flat[: k * k].reshape(k, k)
            keep = independent_columns(gram)
            return keep, inverse(gram[np.ix_(keep, keep)]) @ flat[k * k: k * k + k][keep], None, "run", None
        q = len(keep)
        a, xz = flat[: q * q].reshape(q, q), flat[q * q: q * q + q]
        new = inverse(a) @ xz
        gain = float((new - beta) @ a @ (new - beta)) / max(flat[-1], 1.0)
        last = float("inf") if before is None or math.isnan(before) else before
        if gain <= TOL or (gain < 1e-9 and gain > 0.25 * last):
            return keep, beta, gain, "done", flat
        return keep, new, gain, "run", None
    except (ArithmeticError, np.linalg.LinAlgError) as e:
        return keep, beta, None, str(e) or type(e).__name__, None


def _with_meat(chunks: DataFrame, ended: DataFrame, design: Design, names: Sequence[str]) -> DataFrame:
    """Adds each panel's summed products of cluster scores, and their number at the end."""
    def scores(batches):
        single()
        for pdf in batches:
            held = []
            for row in pdf.to_dict("records"):
                keep, beta = _start(row)
                cells = _cells(row, names)
                x = design.matrix(cells)[:, keep]
                mu, _ = _mean("poisson", x @ beta)
                s = pd.DataFrame(x * (cells["__wy"].to_numpy() - cells["__w"].to_numpy() * mu)[:, None]).groupby(pd.Series(list(row["__c"]), dtype=object), dropna=False, sort=False).sum()
                held += [(row["__id"], None if c is None or c != c else str(c), list(v)) for c, v in zip(s.index, s.to_numpy())]
            yield pd.DataFrame(held, columns=["__id", "c", "s"])

    def products(batches):
        single()
        total: dict[tuple, np.ndarray] = {}  # of the clusters that this task owns
        for pdf in batches:
            for i, c, s in zip(pdf["__id"], pdf["c"], pdf["s"]):
                total[i, c] = total.get((i, c), 0.0) + np.asarray(s, dtype=float)
        meat: dict[int, np.ndarray] = {}
        for (i, _), s in total.items():
            meat[i] = meat.get(i, 0.0) + np.append(np.outer(s, s).ravel(), 1.0)
        if meat:
            yield pd.DataFrame({"__id": list(meat), "meat": [list(m) for m in meat.values()]})

    def merged(batches):
        meat: dict[int, np.ndarray] = {}
        for pdf in batches:
            for i, m in zip(pdf["__id"], pdf["meat"]):
                meat[i] = meat.get(i, 0.0) + np.asarray(m, dtype=float)
        if meat:
            yield pd.DataFrame({"__id": list(meat), "meat": [list(m) for m in meat.values()]})

    fitted = ended.where("status = 'done'").select("__id", "keep", "beta")
    rows = chunks.join(fitted, "__id").mapInPandas(scores, "__id bigint, c string, s array<double>")
    parts = rows.repartition("__id", "c").mapInPandas(products, "__id bigint, meat array<double>")
    return ended.join(parts.repartition("__id").mapInPandas(merged, "__id bigint, meat array<double>"), "__id", "left")


def _tables(design: Design, terms: list[str] | None, clustered: bool):
    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                problem, found = None if row["status"] == "done" else row["status"], {}
                if problem is None:
                    keep, beta = _start(row)
                    q, flat = len(keep), np.asarray(row["sums"], dtype=float)
                    bread, (dev, pearson, n, _) = inverse(flat[: q * q].reshape(q, q)), flat[-4:]
                    if clustered:
                        meat = np.asarray(row["meat"], dtype=float)
                        g = meat[-1]
                        with np.errstate(divide="ignore", invalid="ignore"):
                            cov = g / (g - 1.0) * bread @ meat[:-1].reshape(q, q) @ bread
                    else:
                        with np.errstate(divide="ignore", invalid="ignore"):
                            cov = pearson / (n - q) * bread
                    m = design.undo()[np.ix_(keep, keep)]
                    with np.errstate(invalid="ignore"):
                        errors = np.sqrt(np.diag(m @ cov @ m.T))
                    found = {design.names[j]: (b, e) for j, b, e in zip(keep, m @ beta, errors)}
                wanted = terms if terms is not None else list(found) or [None]
                rows = [(row["__id"], t, *found.get(t, (None, None)), problem) for t in wanted]
                out = pd.DataFrame(rows, columns=["__id", "term", "estimate", "std_error", "problem"])
                yield out.astype({"estimate": "Float64", "std_error": "Float64"})
    return run
