"""Linear mixed models with random intercepts, by restricted maximum likelihood.

The likelihood needs the cross products of the fixed part and sums per group. With one grouping factor the groups stay distributed and each pass evaluates a whole grid of variance ratios.

Two crossed factors: let factor a be the one with more levels. Its part of the variance is block diagonal, so it is taken out level by level, and what is left is a system K over the levels of b.
Up to ``SIDE`` levels of b, tasks sum K for a grid of a's ratios and the driver turns each into eigenvalues, in which every ratio of b costs a sum; levels of a stay distributed, whatever
their number. Beyond that K is never formed: conjugate gradients work on a DataFrame of b's levels, traces come from random sign vectors (``crossed``), and Newton steps with the average
information set both ratios.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.joins import rjoin
from ..session import stage
from .accumulate import accumulate, group_sums
from .crossed import Crossed
from .design import model_frame
from .fit import Fit, inverse, independent_columns, table_frame

#: Levels of the smaller factor up to which its system goes through the driver: SIDE x SIDE numbers.
SIDE = 1000
#: Numbers that a task sums at most for one grid.
GRID_NUMBERS = 1 << 23


def mixed(df: DataFrame, formula: str, groups: Sequence[str] | str,
          levels: Mapping[str, Sequence] | None = None, rounds: int = 40, width: int = 15, side: int = SIDE, probes: int = 16) -> Fit:
    """Random intercepts for one or two grouping columns.

    With two of them, and over ``side`` levels in both, traces are means over ``probes`` random vectors and the fit has no likelihood (nan); estimates repeat exactly, as the vectors follow from the levels.
    """
    groups = [groups] if isinstance(groups, str) else list(groups)
    if len(groups) > 2:
        raise ValueError("one or two grouping columns")
    frame = model_frame(df.dropna(subset=groups), formula, None, groups, levels, compress=False, iterative=True)
    d = frame.design
    k = d.k
    # a response far from zero would drown the residual sum in rounding
    level = float(frame.df.agg(F.avg("__wy")).first()[0] or 0.0) if d.intercept else 0.0

    def xy(pdf):
        return np.column_stack([d.matrix(pdf), pdf["__wy"].to_numpy(dtype=float) - level])

    flat = accumulate(frame.df, lambda pdf: np.concatenate([(xy(pdf).T @ xy(pdf)).ravel(), [len(pdf)]]),
                      (k + 1) ** 2 + 1, True)
    n = int(round(flat[-1]))
    cross = flat[:-1].reshape(k + 1, k + 1)
    keep = independent_columns(cross[:k, :k])
    pick = np.append(keep, k)
    p = len(keep)
    cross = cross[np.ix_(pick, pick)]

    def profile(a: np.ndarray, logdet_v: float):
        """REML criterion, coefficients and residual variance from V-weighted cross products."""
        axx, axy, ayy = a[:p, :p], a[:p, p], a[p, p]
        beta = np.linalg.solve(axx, axy)
        rss = float(ayy - axy @ beta)
        s2 = rss / (n - p)
        crit = (n - p) * (math.log(2 * math.pi * s2) + 1) + logdet_v + np.linalg.slogdet(axx)[1]
        return crit, beta, s2

    if len(groups) == 1:
        theta, a, crit = _one_factor(frame, xy, pick, cross, profile, rounds, width)
        thetas = [theta]
    else:
        cells = stage(group_sums(frame.df, ["e0", "e1"], lambda pdf: np.column_stack([xy(pdf)[:, pick], np.ones(len(pdf))]),
                                 p + 2, [*[f"s{i}" for i in range(p + 1)], "size"]))
        counts = [cells.select(e).distinct().count() for e in ("e0", "e1")]
        big, small = ("e0", "e1") if counts[0] >= counts[1] else ("e1", "e0")
        if min(counts) <= side:
            ratios, a, crit = _eliminated(cells, big, small, min(counts), cross, profile, rounds, width)
        else:
            ratios, a = _iterated(cells, big, small, cross, n, probes)
            crit = float("nan")
        thetas = list(ratios) if big == "e0" else list(ratios)[::-1]
    _, beta, s2 = profile(a, 0.0)
    if d.intercept:
        beta = beta + level * (keep == 0)
    bread = inverse(a[:p, :p])
    m = d.undo()[np.ix_(keep, keep)]
    # the criterion refers to shifted columns; their determinant restores the plain one
    logdet = np.linalg.slogdet(m)[1]
    loglik = -0.5 * (crit - 2 * logdet)
    fit = Fit("linear", frame, d.names, keep, m @ beta, s2 * m @ bread @ m.T, bread, d.undo(), None, n,
              float("inf"), s2, loglik=loglik, n_par=p + len(groups) + 1)
    fit.variances = {**{g: t * s2 for g, t in zip(groups, thetas)}, "residual": s2}
    return fit


def variance_table(fit: Fit) -> DataFrame:
    rows = pd.DataFrame([{"component": g, "variance": float(v), "sd": math.sqrt(v)}
                         for g, v in fit.variances.items()])
    return table_frame(fit.spark, rows)


def _one_factor(frame, xy, pick, cross, profile, rounds, width):
    p1 = len(pick)
    cols = [f"s{i}" for i in range(p1)]
    sums = stage(group_sums(frame.df, ["e0"], lambda pdf: np.column_stack([xy(pdf)[:, pick], np.ones(len(pdf))]),
                            p1 + 1, [*cols, "size"]))
    size = p1 * p1 + 1

    def evaluate(grid):
        def block(pdf):
            s, g = pdf[cols].to_numpy(dtype=float), pdf["size"].to_numpy(dtype=float)
            out = np.empty((len(grid), size))
            for i, t in enumerate(grid):
                c = t / (1 + g * t)
                out[i, :-1] = (s.T @ (s * c[:, None])).ravel()
                out[i, -1] = np.log1p(g * t).sum()
            return out.ravel()
        flat = accumulate(sums, block, len(grid) * size, True).reshape(len(grid), size)
        res = []
        for i in range(len(grid)):
            a = cross - flat[i, :-1].reshape(p1, p1)
            res.append((profile(a, flat[i, -1])[0], a))
        return res

    return _search(lambda grid: [(c, a, None) for c, a in evaluate(grid)], rounds, width, 2 * width)[:3]


def _search(evaluate, rounds: int, width: int, first: int):
    """(ratio, cross products, criterion, more) at the least criterion: a grid over all sizes, then finer ones around the best point."""
    grid = [0.0, *np.exp(np.linspace(math.log(1e-7), math.log(1e5), first))]
    for _ in range(rounds):
        res = evaluate(grid)
        i = int(np.argmin([c for c, *_ in res]))
        best = (grid[i], res[i][1], res[i][0], res[i][2])
        low, high = grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)]
        if high <= low or (high - low) < 1e-7 * max(high, 1e-9):
            return best
        grid = list(np.linspace(low, high, width))
    raise RuntimeError("the fit did not converge")


def _eliminated(cells: DataFrame, big: str, small: str, q: int, cross, profile, rounds: int, width: int):
    """Both ratios (big factor's first), cross products and criterion; K of the small factor's ``q`` levels is summed over the levels of the big one."""
    p1 = len(cross)
    cols = [f"s{i}" for i in range(p1)]
    number = cells.select(small).distinct().withColumn("at", F.row_number().over(Window.orderBy(small)) - 1)  # q rows
    rows = rjoin(cells, number, [small]).groupBy(big).agg(
        F.collect_list(F.struct("at", "size")).alias("row"), F.sum("size").alias("all"), *[F.sum(c).alias(c) for c in cols])
    rows = stage(rows.select("all", *cols, F.col("row.at").alias("at"), F.col("row.size").alias("size")))
    tie = stage(rjoin(cells, number, [small]).groupBy("at").agg(F.sum("size").alias("size"), *[F.sum(c).alias(c) for c in cols]))

    def place(pdf):
        out = np.zeros((q, p1 + 1))
        out[pdf["at"].to_numpy(dtype=int)] = pdf[["size", *cols]].to_numpy(dtype=float)
        return out

    own = accumulate(tie, place, q * (p1 + 1)).reshape(q, p1 + 1)
    size = p1 * p1 + q * p1 + q * q + 1
    width = max(1, min(width, GRID_NUMBERS // size))  # ratios of one pass

    def summed(grid):
        def block(pdf):
            out = np.zeros((len(grid), size))
            for first in range(0, len(pdf), 512):
                part = pdf.iloc[first:first + 512]
                lengths = part["at"].map(len).to_numpy()
                n = np.zeros((len(part), q))
                n[np.repeat(np.arange(len(part)), lengths), np.concatenate(part["at"].to_list()).astype(int)] = np.concatenate(part["size"].to_list())
                s, g = part[cols].to_numpy(dtype=float), part["all"].to_numpy(dtype=float)
                for i, t in enumerate(grid):
                    c = (t / (1 + g * t))[:, None]
                    out[i] += np.concatenate([(s.T @ (s * c)).ravel(), (n.T @ (s * c)).ravel(), (n.T @ (n * c)).ravel(), [np.log1p(g * t).sum()]])
            return out.ravel()

        return accumulate(rows, block, len(grid) * size, True).reshape(len(grid), size)

    def evaluate(grid):
        return [best_small(f) for k in range(0, len(grid), width) for f in summed(grid[k:k + width])]

    def best_small(flat):
        """The best ratio of the small factor for one of the big factor's."""
        g = cross - flat[:p1 * p1].reshape(p1, p1)
        h = own[:, 1:] - flat[p1 * p1:p1 * p1 + q * p1].reshape(q, p1)
        k = np.diag(own[:, 0]) - flat[p1 * p1 + q * p1:-1].reshape(q, q)
        value, vector = np.linalg.eigh((k + k.T) / 2)
        value, h = np.maximum(value, 0.0), vector.T @ h

        def at(points):
            res = []
            for t in points:
                a = g - h.T @ (h * (t / (1 + t * value))[:, None])
                res.append((profile(a, flat[-1] + np.log1p(t * value).sum())[0], a, t))
            return res

        t, a, crit, _ = _search(at, 60, 9, 40)
        return crit, a, t

    theta, a, crit, other = _search(evaluate, rounds, max(width, 5), 2 * max(width, 5))
    return (theta, other), a, crit


def _iterated(cells: DataFrame, big: str, small: str, cross, n: int, probes: int, tol: float = 1e-4, max_iter: int = 60):
    """Both ratios (big factor's first) and cross products by Newton steps in their logarithms."""
    p = len(cross) - 1
    system = Crossed(cells, big, small, [f"s{i}" for i in range(p + 1)], probes)
    point = np.zeros(2)
    for _ in range(max_iter):
        found = system.moments(cross, np.exp(point))
        score, info = found.score(n - p), found.information(n - p)
        # in logarithms: chain rule, and a floor where a variance vanishes
        t = np.exp(point)
        score, info = score * t, info * np.outer(t, t)
        held = (point <= -16) & (score > 0)
        step = np.zeros(2)
        free = ~held
        if free.any():
            step[free] = -np.linalg.solve(info[np.ix_(free, free)] + 1e-9 * np.eye(free.sum()), score[free])
        step = np.clip(step, -2, 2)
        if np.abs(step).max() < tol:
            return np.where(held, 0.0, t), found.a
        point = np.maximum(point + step, -16)
    raise RuntimeError("the fit did not converge")
