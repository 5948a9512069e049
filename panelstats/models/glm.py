"""Quasi-Poisson and logit models by iteratively reweighted least squares.

Each iteration is one aggregate over the staged model frame. The same step functions serve a
frame spread over the cluster and a small panel inside one task of a sweep.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.joins import rjoin
from ..session import stage
from . import absorbed
from .accumulate import accumulate, group_sums
from .design import Design, Formula, TooManyLevels, model_frame, reads
from .fit import Fit, cluster_map, independent_columns, inverse


def _mean(kind: str, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance function at the linear predictor."""
    if kind == "poisson":
        mu = np.exp(np.clip(eta, -700, 700))
        return mu, mu
    mu = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
    return mu, np.maximum(mu * (1 - mu), 1e-300)


def step_block(kind: str, d: Design, keep: np.ndarray | None, beta: np.ndarray | None,
               pdf: pd.DataFrame) -> np.ndarray:
    """X'WX, X'Wz, deviance, Pearson sum and row count of a batch at ``beta`` (None: start values)."""
    x = d.matrix(pdf)
    if keep is not None:
        x = x[:, keep]
    w = pdf["__w"].to_numpy(dtype=float)
    wy = pdf["__wy"].to_numpy(dtype=float)
    wyy = pdf["__wyy"].to_numpy(dtype=float)
    y = np.divide(wy, w, out=np.zeros_like(wy), where=w > 0)
    if beta is None:
        mu = y + 0.1 if kind == "poisson" else (w * y + 0.5) / (w + 1.0)
        var = mu if kind == "poisson" else mu * (1 - mu)
        eta = np.log(mu) if kind == "poisson" else np.log(mu / (1 - mu))
    else:
        eta = x @ beta
        mu, var = _mean(kind, eta)
    xw = x * (w * var)[:, None]
    xz = xw.T @ eta + x.T @ (wy - w * mu)
    if kind == "poisson":
        dev = 2.0 * (pdf["__wyl"].to_numpy(dtype=float) - wy * np.log(mu) - (wy - w * mu)).sum()
    else:
        p = np.clip(mu, 1e-300, 1.0)
        dev = -2.0 * (wy * np.log(p) + (w - wy) * np.log(np.clip(1 - p, 1e-300, 1.0))).sum()
    pearson = ((wyy - 2 * mu * wy + mu * mu * w) / var).sum()
    return np.concatenate([(x.T @ xw).ravel(), xz, [dev, pearson, pdf["__n"].sum(), wy.sum()]])


def irls(kind: str, d: Design, total: Callable, max_iter: int = 60, tol: float = 1e-20):
    """Fit by repeated ``total(block, size)`` sums; gives kept columns, beta, bread and the sums."""
    k = d.k
    flat = total(lambda pdf: step_block(kind, d, None, None, pdf), k * k + k + 4)
    keep = independent_columns(flat[: k * k].reshape(k, k))
    q = len(keep)
    a = flat[: k * k].reshape(k, k)[np.ix_(keep, keep)]
    beta = inverse(a) @ flat[k * k: k * k + k][keep]
    before = np.inf
    for _ in range(max_iter):
        cur = beta
        flat = total(lambda pdf: step_block(kind, d, keep, cur, pdf), q * q + q + 4)
        a, xz = flat[: q * q].reshape(q, q), flat[q * q: q * q + q]
        dev, pearson, n, size = flat[q * q + q:]
        bread = inverse(a)
        beta = bread @ xz
        # what the step would gain, in units of the likelihood; it stops at rounding noise
        gain = float((beta - cur) @ a @ (beta - cur)) / max(size, 1.0)
        if gain <= tol or (gain < 1e-9 and gain > 0.25 * before):
            return keep, cur, bread, dev, pearson, int(round(n))
        before = gain
    raise RuntimeError("the fit did not converge")


def _glm(kind: str, df: DataFrame, formula: str, weights: str | None, cluster: Sequence[str],
         levels: Mapping[str, Sequence] | None, compress: bool | None) -> Fit:
    frame = model_frame(df, formula, weights, cluster, levels, compress, iterative=True)
    d = frame.design
    total = lambda fn, size: accumulate(frame.df, fn, size, True)
    keep, beta, bread, dev, pearson, n = irls(kind, d, total)
    dfr = n - len(keep)
    phi = pearson / dfr if kind == "poisson" else 1.0
    full = np.zeros(d.k)
    full[keep] = beta
    m = d.undo()[np.ix_(keep, keep)]

    def score(pdf):
        x = d.matrix(pdf)
        mu, _ = _mean(kind, x @ full)
        return x * (pdf["__wy"].to_numpy(dtype=float) - pdf["__w"].to_numpy(dtype=float) * mu)[:, None]

    return Fit(kind, frame, d.names, keep, m @ beta, phi * (m @ bread @ m.T), bread, d.undo(), score, n, dfr, phi,
               loglik=-0.5 * dev if kind == "logit" else None, deviance=dev, clusters=dict(cluster_map(cluster)))


def quasi_poisson(df: DataFrame, formula: str, weights: str | None = None, cluster: Sequence[str] = (),
                  levels: Mapping[str, Sequence] | None = None, compress: bool | None = None,
                  absorb: str | Sequence[str] | None = None) -> Fit:
    """Log-link count model; the covariance carries the Pearson dispersion.

    ``absorb`` takes one factor or two of any number of levels out instead of one column for each level. A factor of the
    formula with too many levels for columns is absorbed too, unless products use it.
    """
    absorb = [absorb] if isinstance(absorb, str) else list(absorb or [])
    try:
        return _count_model(df, formula, weights, cluster, levels, compress, absorb)
    except TooManyLevels as big:
        rest = Formula(formula).without(big.variable)
        if rest is None:
            raise
        more = [c for c in reads(big.variable, df.columns) if c not in absorb]
        return quasi_poisson(df, rest, weights, cluster, levels, compress, [*absorb, *more])


def _count_model(df: DataFrame, formula: str, weights: str | None, cluster: Sequence[str], levels: Mapping[str, Sequence] | None,
                 compress: bool | None, absorb: list[str]) -> Fit:
    if len(absorb) > 2:
        raise ValueError("absorb the two largest factors and write the others into the formula")
    if len(absorb) == 2:
        return absorbed.quasi_poisson(df, formula, weights, cluster, levels, compress, absorb)
    if absorb:
        return _absorbed(df, formula, weights, cluster, levels, compress, absorb[0])
    return _glm("poisson", df, formula, weights, cluster, levels, compress)


def _absorbed(df: DataFrame, formula: str, weights: str | None, cluster: Sequence[str], levels: Mapping[str, Sequence] | None,
              compress: bool | None, absorb: str, max_iter: int = 60) -> Fit:
    """Count model whose level effects are put in closed form: at given slopes each level's fitted total equals its count.

    What is left is a fit on the regressors less their fitted mean in the level: an aggregate by level and one over the rows for each
    step. Levels stay a DataFrame. Levels without any count fit perfectly and are left out. The fit gives coefficients, errors and
    statistics; it has no intercept and predicts nothing.
    """
    frame = model_frame(df, formula, weights, [absorb, *cluster], levels, compress, iterative=True)
    d, k, level = frame.design, frame.design.k - 1, frame.extra[0]
    sums = ["__e", *[f"__x{i}" for i in range(k)]]
    totals = frame.df.groupBy(level).agg(F.sum("__wy").alias("__total")).where("__total > 0")
    rows = stage(rjoin(frame.df, totals, [level], "inner"))
    levels_left = totals.count()

    def joined(beta: np.ndarray) -> DataFrame:
        def part(pdf):
            x = d.matrix(pdf)[:, 1:]
            e = pdf["__w"].to_numpy(dtype=float) * np.exp(np.clip(x @ beta, -700, 700))
            return np.column_stack([e, x * e[:, None]])

        return rjoin(rows, group_sums(rows, [level], part, 1 + k, sums), [level])

    def parts(pdf, beta):
        """Centred regressors, fitted totals and observed totals of the rows."""
        x = d.matrix(pdf)[:, 1:]
        e = pdf["__e"].to_numpy(dtype=float)
        mean = pdf[sums[1:]].to_numpy(dtype=float) / e[:, None]
        mu = pdf["__total"].to_numpy(dtype=float) / e * pdf["__w"].to_numpy(dtype=float) * np.exp(np.clip(x @ beta, -700, 700))
        return x, x - mean, mu, pdf["__wy"].to_numpy(dtype=float)

    size = k * k + 2 * k + 4

    def sums_at(beta):
        def block(pdf):
            x, xc, mu, wy = parts(pdf, beta)
            w = pdf["__w"].to_numpy(dtype=float)
            fit = mu / w
            dev = 2.0 * (pdf["__wyl"].to_numpy(dtype=float) - wy * np.log(fit) - (wy - mu)).sum()
            pearson = ((pdf["__wyy"].to_numpy(dtype=float) - 2 * fit * wy + fit * mu) / fit).sum()
            return np.concatenate([(xc.T @ (xc * mu[:, None])).ravel(), xc.T @ (wy - mu), (x * x).T @ mu, [dev, pearson, pdf["__n"].sum(), wy.sum()]])

        return accumulate(joined(beta), block, size, True)

    beta, before = np.zeros(k), np.inf
    flat = sums_at(beta)
    gram = flat[: k * k].reshape(k, k).copy()
    still = np.diag(gram) <= 1e-12 * flat[k * k + k: k * k + 2 * k]  # columns that a level fixes
    gram[still], gram[:, still] = 0.0, 0.0
    keep = independent_columns(gram)
    for _ in range(max_iter):
        info, slope = flat[: k * k].reshape(k, k)[np.ix_(keep, keep)], flat[k * k: k * k + k][keep]
        bread = inverse(info)
        step = bread @ slope
        gain = float(slope @ step) / max(flat[-1], 1.0)
        if gain <= 1e-20 or (gain < 1e-9 and gain > 0.25 * before):
            break
        before = gain
        beta = beta.copy()
        beta[keep] += step
        flat = sums_at(beta)
    else:
        raise RuntimeError("the fit did not converge")
    dev, pearson, n = flat[-4], flat[-3], int(round(flat[-2]))
    dfr = n - len(keep) - levels_left
    phi = pearson / dfr
    undo = np.diag(1.0 / d.unit[1:])
    m = undo[np.ix_(keep, keep)]

    def score(pdf):
        _, xc, mu, wy = parts(pdf, beta)
        return xc * (wy - mu)[:, None]

    frame.df = stage(joined(beta)) if cluster else rows
    return Fit("poisson", frame, d.names[1:], keep, m @ beta[keep], phi * (m @ bread @ m.T), bread, undo, score, n, dfr, phi, deviance=dev,
               clusters={c: f"e{i + 1}" for i, c in enumerate(cluster)})


def logit(df: DataFrame, formula: str, weights: str | None = None, cluster: Sequence[str] = (),
          levels: Mapping[str, Sequence] | None = None, compress: bool | None = None) -> Fit:
    """Binomial logit of a 0/1 or logical response."""
    return _glm("logit", df, formula, weights, cluster, levels, compress)


def panel_fit(pdf: pd.DataFrame, kind: str, formula: str, factors: Sequence[str], y: str,
              cluster: str | None = None, levels: Mapping[str, Sequence] | None = None) -> pd.DataFrame:
    """Coefficients of one count panel that a task holds (a sweep fits many side by side)."""
    from .design import local_design
    from .threads import single
    single()
    d = local_design(pdf, formula, factors, levels)
    v = pdf[y].to_numpy(dtype=float)
    work = pdf.assign(__w=1.0, __wy=v, __wyy=v * v, __n=1.0, __wyl=np.where(v > 0, v * np.log(np.where(v > 0, v, 1.0)), 0.0))
    keep, beta, bread, dev, pearson, n = irls(kind, d, lambda fn, size: fn(work))
    m = d.undo()[np.ix_(keep, keep)]
    cov = pearson / (n - len(keep)) * bread
    if cluster is not None:
        x = d.matrix(work)[:, keep]
        mu, _ = _mean(kind, x @ beta)
        s = pd.DataFrame(x * (v - mu)[:, None]).groupby(work[cluster].to_numpy()).sum().to_numpy()
        g = len(s)
        cov = g / (g - 1.0) * bread @ (s.T @ s) @ bread
    cov = m @ cov @ m.T
    return pd.DataFrame({"term": [d.names[j] for j in keep], "estimate": m @ beta,
                         "std_error": np.sqrt(np.diag(cov))})
