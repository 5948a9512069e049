"""Averages of predictions under set values: counterfactuals, contrasts, simulated intervals.

A grid point changes variables of the design for all rows at once. Tasks build the changed
design rows in memory and keep only sums per grid point, so neither the grid nor the draws
multiply the rows that Spark moves.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .accumulate import accumulate, group_sums
from .design import reads, variable_column
from .dist import norm_sf2
from .fit import Fit, table_frame
from .glm import _mean


def grid_points(grid: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def value_grid(df: DataFrame, col: str, n: int) -> list[float]:
    """Evenly spaced values over the range of a column."""
    low, high = df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    return list(np.linspace(low, high, n))


def _column_of(variable: str) -> str:
    """The column behind ``factor(column)``."""
    return next(iter(reads(variable, ()))) if not variable.startswith("I(") else variable


def _sql(value) -> str:
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value)).lower()
    return repr(value.item() if isinstance(value, np.generic) else value)


def _moves(points: Sequence[Mapping]) -> list[dict[str, str]]:
    """Grid points as SQL for the columns they set."""
    return [{_column_of(v): _sql(x) for v, x in point.items()} for point in points]


def _fields(fit: Fit, df: DataFrame, keep: Sequence[str] = (), moves: Sequence[Mapping[str, str]] = ()) -> tuple[DataFrame, list[str]]:
    """The design's variables as fields, and the ``I(...)`` terms that read a column which a move changes.

    A move names SQL for columns. What an affected term becomes under move ``i`` is a field of its own, ``<field>__i``,
    computed in the same scan.
    """
    d = fit.design
    cols = []
    for v in d.formula.variables:
        c, _ = variable_column(df, v)
        cols.append((c.cast("double") if d.levels[v] is None else c).alias(d.field_of[v]))
    moved = {c for move in moves for c in move}
    again = [v for v in d.formula.variables if v.startswith("I(") and reads(v, df.columns) & moved]
    cols += [variable_column(df, v, move)[0].cast("double").alias(f"{d.field_of[v]}__{i}") for v in again for i, move in enumerate(moves)]
    return df.select(*cols, *keep).dropna(subset=[d.field_of[v] for v in d.formula.variables]), again


def _at(d, pdf: pd.DataFrame, point: Mapping, again: Sequence[str], i: int) -> np.ndarray:
    """Plain rows of design ``d`` under grid point ``i``."""
    return d.matrix(pdf, {**point, **{v: pdf[f"{d.field_of[v]}__{i}"].to_numpy(dtype=float) for v in again}}, plain=True)


def counterfactual(fit: Fit, df: DataFrame, grid: Mapping[str, Sequence], response: bool = True,
                   z: float = 1.96) -> DataFrame:
    """Mean prediction with variables set to each grid point, in ``I(...)`` terms too.

    The standard error is the root mean square of the rows' prediction errors. For class models there is one row
    per grid point and class, of the mean probability. A level that a factor doesn't have is refused.
    """
    d, points, k = fit.design, grid_points(grid), fit.design.k
    b, v, kind = fit.full_coef(), fit.full_vcov(), fit.kind
    for point in points:
        d.check(point)
    src, again = _fields(fit, df, (), _moves(points))
    if (kind == "linear" or not response) and kind != "ordered" and not again:
        # a set variable is a constant factor of its columns: one cross product serves every point
        free = list(grid)

        def cross(pdf):
            x = d.matrix(pdf, plain=True, without=free)
            return np.concatenate([(x.T @ x).ravel(), x.sum(0), [len(pdf)]])

        flat = accumulate(src, cross, k * k + k + 1)
        n, gram, mean = flat[-1], flat[: k * k].reshape(k, k) / flat[-1], flat[k * k: -1] / flat[-1]
        rows = []
        for point in points:
            c = d.constants(point)
            f, se = float(c * mean @ b), math.sqrt(max(float((np.outer(c, c) * gram * v).sum()), 0.0))
            rows.append({**point, "fit": f, "se_fit": se, "fit_low": f - z * se, "fit_high": f + z * se})
        return table_frame(fit.spark, pd.DataFrame(rows))

    classes = list(fit.outcome) if kind == "ordered" else [None]

    def predictions(x):
        """Fitted values and their variances, a column for each class."""
        if kind == "ordered":
            eta, cuts = x @ b[:k], b[k:]
            cum = np.column_stack([np.zeros(len(x)), *[_mean("logit", c - eta)[0] for c in cuts], np.ones(len(x))])
            slope = cum * (1 - cum)
            fits, spreads = np.diff(cum, axis=1), np.zeros((len(x), len(classes)))
            for j in range(len(classes)):
                g = np.zeros((len(x), len(b)))
                g[:, :k] = -(slope[:, j + 1] - slope[:, j])[:, None] * x
                if j < len(cuts):
                    g[:, k + j] = slope[:, j + 1]
                if j:
                    g[:, k + j - 1] -= slope[:, j]
                spreads[:, j] = ((g @ v) * g).sum(1)
            return fits, spreads
        eta, var = x @ b, ((x @ v) * x).sum(1)
        if response and kind in ("poisson", "logit"):
            eta, slope = _mean(kind, eta)
            var = var * slope * slope
        return eta[:, None], var[:, None]

    def block(pdf):
        out = np.zeros((len(points), 2 * len(classes) + 1))
        for i, point in enumerate(points):
            fits, spreads = predictions(_at(d, pdf, point, again, i))
            out[i] = np.concatenate([fits.sum(0), spreads.sum(0), [len(pdf)]])
        return out.ravel()

    width = 2 * len(classes) + 1
    sums = accumulate(src, block, width * len(points)).reshape(-1, width)
    rows = []
    for point, row in zip(points, sums):
        for j, c in enumerate(classes):
            f, se = row[j] / row[-1], math.sqrt(max(row[len(classes) + j], 0.0) / row[-1])
            rows.append({**point, **({"level": str(c)} if kind == "ordered" else {}), "fit": f, "se_fit": se, "fit_low": f - z * se, "fit_high": f + z * se})
    return table_frame(fit.spark, pd.DataFrame(rows))


def response_means(fit: Fit, df: DataFrame, grid: Mapping[str, Sequence], by: Sequence[str],
                   total: bool = False) -> DataFrame:
    """Mean (or summed) predicted response per group for each grid point, wide over the points."""
    d, points, b, kind = fit.design, grid_points(grid), fit.full_coef(), fit.kind
    keys = [f"__by{i}" for i in range(len(by))]
    for point in points:
        d.check(point)
    src, again = _fields(fit, df.withColumns({k: F.col(c) for k, c in zip(keys, by)}), keys, _moves(points))

    def rows(pdf):
        cols = [np.ones(len(pdf))]
        for i, point in enumerate(points):
            eta = _at(d, pdf, point, again, i) @ b
            cols.append(_mean(kind, eta)[0] if kind in ("poisson", "logit") else eta)
        return np.column_stack(cols)

    names = ["__n", *[f"fit_{i}" for i in range(len(points))]]
    sums = group_sums(src, keys, rows, len(names), names)
    label = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in point.items()],
                               (F.col(f"fit_{i}") if total else F.col(f"fit_{i}") / F.col("__n")).alias("fit"))
                      for i, point in enumerate(points)])
    return sums.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], F.inline(label))


def contrast(fit: Fit, df: DataFrame, terms: Sequence[str], by: str, step: float = 1.0,
             conf_z: float = 1.959963984540054) -> DataFrame:
    """Average change of the response when a variable rises by ``step``, per group, delta-method error."""
    d, b, v, kind = fit.design, fit.full_coef(), fit.full_vcov(), fit.kind
    k = d.k
    src, again = _fields(fit, df.withColumn("__by", F.col(by)), ["__by"], [{t: f"(`{t}` + {step!r})"} for t in terms])

    def value(x):
        eta = x @ b
        return _mean(kind, eta) if kind in ("poisson", "logit") else (eta, np.ones(len(eta)))

    def rows(pdf):
        lo_x = d.matrix(pdf, plain=True)
        lo, lo_s = value(lo_x)
        cols = [np.ones((len(pdf), 1)), lo[:, None]]
        for i, t in enumerate(terms):
            moved = {d.field_of[t]: pdf[d.field_of[t]] + step} if t in d.field_of else {}
            moved.update({d.field_of[v]: pdf[f"{d.field_of[v]}__{i}"] for v in again})
            hi_x = d.matrix(pdf.assign(**moved), plain=True)
            hi, hi_s = value(hi_x)
            cols += [hi[:, None], hi_x * hi_s[:, None] - lo_x * lo_s[:, None]]
        return np.hstack(cols)

    width = 2 + len(terms) * (k + 1)
    names = [f"s{i}" for i in range(width)]
    sums = group_sums(src, ["__by"], rows, width, names)
    out = []
    for r in sums.collect():
        s = np.array([r[c] for c in names])
        n, lo = s[0], s[1] / s[0]
        for i, t in enumerate(terms):
            part = s[2 + i * (k + 1): 2 + (i + 1) * (k + 1)] / n
            est, g = part[0] - lo, part[1:]
            se = math.sqrt(max(float(g @ v @ g), 0.0))
            stat = est / se if se > 0 else float("nan")
            p = norm_sf2(stat)
            out.append({"term": t, "contrast": f"mean(+{step:g})", by: r["__by"], "estimate": est, "std_error": se,
                        "statistic": stat, "p_value": p,
                        "s_value": -math.log2(p) if p > 0 else float("inf"), "conf_low": est - conf_z * se,
                        "conf_high": est + conf_z * se, "predicted_lo": lo, "predicted_hi": part[0]})
    return table_frame(fit.spark, pd.DataFrame(out))


def simulate(fit: Fit, df: DataFrame, grid: Mapping[str, Sequence], draws: int = 250, seed: int = 0) -> DataFrame:
    """Mean prediction per grid point under parameter draws, with 2.5 and 97.5 percent limits.

    Draws are a seeded multivariate normal of the estimates. For class models there is one row
    per grid point and class.
    """
    d, points = fit.design, grid_points(grid)
    rng = np.random.default_rng(seed)
    keep = fit.keep
    thetas = np.zeros((draws, len(fit.names)))
    thetas[:, keep] = rng.multivariate_normal(fit.coef, fit.vcov, draws, check_valid="ignore")
    k, ordered = d.k, fit.kind == "ordered"
    classes = list(fit.outcome) if ordered else [None]
    kind = fit.kind
    for point in points:
        d.check(point)
    src, again = _fields(fit, df, (), _moves(points))

    def block(pdf):
        out = np.zeros((len(points), len(classes), draws))
        for i, point in enumerate(points):
            x = _at(d, pdf, point, again, i)
            eta = x @ thetas[:, :k].T
            if ordered:
                below = np.zeros_like(eta)
                for j in range(len(classes) - 1):
                    cum = _mean("logit", thetas[:, k + j][None, :] - eta)[0]
                    out[i, j] = (cum - below).sum(0)
                    below = cum
                out[i, -1] = (1.0 - below).sum(0)
            else:
                out[i, 0] = (_mean(kind, eta)[0] if kind in ("poisson", "logit") else eta).sum(0)
        return np.append(out.ravel(), len(pdf))

    if kind == "linear":
        # the mean of linear predictions is the prediction at the mean design row
        if again:
            def mean_rows(pdf):
                return np.append(np.concatenate([_at(d, pdf, point, again, i).sum(0) for i, point in enumerate(points)]), len(pdf))

            flat = accumulate(src, mean_rows, len(points) * k + 1)
            design = flat[:-1].reshape(len(points), k) / flat[-1]
        else:
            # a set variable is a constant factor of its columns: one mean row serves every point
            def mean_row(pdf):
                return np.append(d.matrix(pdf, plain=True, without=list(grid)).sum(0), len(pdf))

            flat = accumulate(src, mean_row, k + 1)
            design = np.array([d.constants(point) for point in points]) * flat[:-1] / flat[-1]
        means = (design @ thetas[:, :k].T)[:, None, :]
    else:
        flat = accumulate(src, block, len(points) * len(classes) * draws + 1)
        means = flat[:-1].reshape(len(points), len(classes), draws) / flat[-1]
    out = []
    for i, point in enumerate(points):
        for j, c in enumerate(classes):
            m = means[i, j]
            lo, hi = np.quantile(m, [0.025, 0.975])
            out.append({**point, **({"level": str(c)} if ordered else {}), "fit_low": float(lo),
                        "fit_high": float(hi), "fit": float(m.mean()), "sd": float(m.std(ddof=1))})
    return table_frame(fit.spark, pd.DataFrame(out))


def profile_grid(df: DataFrame, means: Sequence[str], modes: Sequence[str], grid: Mapping[str, Sequence]) -> DataFrame:
    """Representative rows: means of numbers and modes of categories, crossed with stated values.

    The profile is one row; the stated values explode from literals, so nothing is joined.
    """
    from ..operators.agg import mode_first
    out = df.agg(*[F.avg(c).alias(c) for c in means])
    for c in modes:
        out = out.withColumn(c, mode_first(df.where(F.col(c).isNotNull()), [], c).scalar())
    for name, values in grid.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(x) for x in values])))
    return out


def standardised_effect(fit: Fit, df: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Coefficient times the sample sd of its variable."""
    row = df.agg(*[F.stddev_samp(t).alias(t) for t in terms]).first()
    return table_frame(fit.spark, pd.DataFrame(
        [{"term": t, "estimate": fit.param(t), "sd": float(row[t]), "effect": fit.param(t) * float(row[t])}
         for t in terms]))
