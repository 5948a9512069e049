"""Ordered logit and its non-proportional relative."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .accumulate import accumulate
from .design import Formula, model_frame
from .fit import Fit, cluster_map, independent_columns, inverse, table_frame
from .glm import _mean


def _plogis(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


def _likelihood(x: np.ndarray, code: np.ndarray, w: np.ndarray, beta: np.ndarray, zeta: np.ndarray,
                order: int = 2):
    """Weighted log likelihood, row scores and Hessian for P(y <= j) = plogis(zeta_j - x'b)."""
    n, p = x.shape
    j = len(zeta)
    eta = x @ beta
    up = np.where(code < j, np.append(zeta, np.inf)[code] - eta, np.inf)
    lo = np.where(code > 0, np.append(-np.inf, zeta)[code] - eta, -np.inf)
    fu, fl = np.where(np.isinf(up), 1.0, _plogis(up)), np.where(np.isinf(lo), 0.0, _plogis(lo))
    pr = np.clip(fu - fl, 1e-300, None)
    ll = float((w * np.log(pr)).sum())
    if order == 0:
        return ll, None, None
    du, dl = fu * (1 - fu), fl * (1 - fl)
    a, b = du / pr, dl / pr
    eu, el = np.zeros((n, j)), np.zeros((n, j))
    rows = np.arange(n)
    has_u, has_l = code < j, code > 0
    eu[rows[has_u], code[has_u]] = 1.0
    el[rows[has_l], code[has_l] - 1] = 1.0
    u = np.hstack([-x, eu])
    l = np.hstack([-x, el])
    score = w[:, None] * (a[:, None] * u - b[:, None] * l)
    if order == 1:
        return ll, score, None
    huu = w * (du * (1 - 2 * fu) / pr - a * a)
    hll = w * (-dl * (1 - 2 * fl) / pr - b * b)
    hul = w * a * b
    h = u.T @ (u * huu[:, None]) + l.T @ (l * hll[:, None])
    cross = u.T @ (l * hul[:, None])
    return ll, score, h + cross + cross.T


@dataclass
class OrderedFit(Fit):
    """Ordered model: slopes first, then the cut points ``a|b``."""

    outcome: tuple = ()

    def probs(self, df: DataFrame) -> DataFrame:
        """Class probabilities as one column per class, in JVM expressions."""
        k = self.design.k
        slopes = self.full_coef()[:k]
        line = Fit.linear_predictor(_line(self, slopes), df)
        zeta = self.full_coef()[k:]
        cum: list[Column] = [F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(float(z)) - F.col("__eta")))) for z in zeta]
        cum = [F.lit(0.0), *cum, F.lit(1.0)]
        out = df.withColumn("__eta", line)
        out = out.withColumns({str(c): cum[i + 1] - cum[i] for i, c in enumerate(self.outcome)})
        return out.drop("__eta")

    def mean_probs(self, df: DataFrame, by: Sequence[str]) -> DataFrame:
        return self.probs(df).groupBy(*by).agg(*[F.avg(str(c)).alias(str(c)) for c in self.outcome])


def _line(fit: "OrderedFit", slopes: np.ndarray):
    """View of an ordered fit that predicts x'b only."""
    class Line:
        design = fit.design
        def full_coef(self):
            return slopes
    return Line()


def ordered_logit(df: DataFrame, formula: str, classes: Sequence, weights: str | None = None,
                  cluster: Sequence[str] = (), levels: Mapping[str, Sequence] | None = None,
                  compress: bool | None = None, max_iter: int = 60) -> OrderedFit:
    """Proportional-odds model by Newton steps, one aggregate each; ``classes`` in rising order."""
    f = Formula(formula + " + 0")
    frame = model_frame(df.where(F.col(f.response).isin(list(classes))), f, weights, cluster, levels, compress,
                        keep_response=True, iterative=True)
    d = frame.design
    # contrasts as with an intercept; the cut points take its place
    d = type(d)(Formula(formula), d.levels, d.field_of, {v: 0.0 for v in d.center}, d.scale, True)
    k, j = d.k - 1, len(classes) - 1
    code_of = {c: i for i, c in enumerate(classes)}

    def parts(pdf):
        x = d.matrix(pdf)[:, 1:]
        return x, pdf["__y"].map(code_of).to_numpy(dtype=int), pdf["__w"].to_numpy(dtype=float)

    def start(pdf):
        x, code, w = parts(pdf)
        return np.concatenate([(x.T @ (x * w[:, None])).ravel(), x.T @ w,
                               np.bincount(code, w, j + 1), [pdf["__n"].sum()]])

    flat = accumulate(frame.df, start, k * k + k + j + 2, True)
    sums = flat[k * k: k * k + k]
    share = flat[k * k + k: k * k + k + j + 1]
    total = share.sum()
    big = np.zeros((k + 1, k + 1))
    big[0, 0], big[0, 1:], big[1:, 0], big[1:, 1:] = total, sums, sums, flat[: k * k].reshape(k, k)
    keep = independent_columns(big)[1:] - 1
    n = int(round(flat[-1]))
    cum = np.cumsum(share)[:-1] / total
    zeta = np.log(cum / (1 - cum))
    beta = np.zeros(len(keep))
    q = len(keep) + j

    def block(pdf, b, z):
        x, code, w = parts(pdf)
        ll, s, h = _likelihood(x[:, keep], code, w, b, z)
        return np.concatenate([[ll], s.sum(0), h.ravel()])

    flat = accumulate(frame.df, lambda pdf: block(pdf, beta, zeta), 1 + q + q * q, True)
    for _ in range(max_iter):
        ll, g, h = flat[0], flat[1: 1 + q], flat[1 + q:].reshape(q, q)
        step = np.linalg.solve(-h, g)
        if float(g @ step) < 1e-12 * (abs(ll) + 1):
            break
        size = 1.0
        while True:
            nb, nz = beta + size * step[: len(keep)], zeta + size * step[len(keep):]
            if np.all(np.diff(nz) > 0):
                trial = accumulate(frame.df, lambda pdf: block(pdf, nb, nz), 1 + q + q * q, True)
                if trial[0] >= ll - 1e-9 * abs(ll) or size < 1e-6:
                    break
            size /= 2.0
        beta, zeta, flat = nb, nz, trial
    else:
        raise RuntimeError("the fit did not converge")
    info = inverse(-flat[1 + q:].reshape(q, q))
    unit = np.concatenate([1.0 / d.unit[1:], np.ones(j)])
    undo = np.diag(unit)
    all_keep = np.concatenate([keep, np.arange(k, k + j)])
    m = undo[np.ix_(all_keep, all_keep)]
    theta = np.concatenate([beta, zeta])

    def score(pdf):
        x, code, w = parts(pdf)
        _, s, _ = _likelihood(x[:, keep], code, w, beta, zeta, 1)
        out = np.zeros((len(pdf), k + j))
        out[:, all_keep] = s
        return out

    names = d.names[1:] + [f"{a}|{b}" for a, b in zip(classes, classes[1:])]
    slope_design = _Slopes(d)
    frame.design = slope_design
    return OrderedFit("ordered", frame, names, all_keep, m @ theta, m @ info @ m.T, info, undo, score, n,
                      float("inf"), 1.0, loglik=float(flat[0]), clusters=dict(cluster_map(cluster)),
                      n_par=q, outcome=tuple(classes))


class _Slopes:
    """A design without its intercept column, contrasts unchanged."""

    def __init__(self, d):
        self._d = d
        self.formula, self.levels, self.field_of = d.formula, d.levels, d.field_of
        self.names, self.parts, self.k = d.names[1:], d.parts[1:], d.k - 1
        self.intercept = False

    def matrix(self, pdf, fixed=None, plain=False):
        return self._d.matrix(pdf, fixed, plain)[:, 1:]

    def columns(self, df):
        return self._d.columns(df)[1:]

    def check(self, point):
        self._d.check(point)


def cumulative_logits(df: DataFrame, formula: str, cuts: Sequence[int], weights: str | None = None,
                      levels: Mapping[str, Sequence] | None = None, compress: bool | None = None,
                      max_iter: int = 60) -> DataFrame:
    """One binary logit of ``y > cut`` per cut, all cuts advanced by the same aggregate."""
    frame = model_frame(df, formula, weights, (), levels, compress, keep_response=True, iterative=True)
    d = frame.design
    k, m = d.k, len(cuts)
    size = k * k + k + 1

    def block(pdf, betas, keep):
        x = d.matrix(pdf)
        y = pdf["__y"].to_numpy(dtype=float)
        w = pdf["__w"].to_numpy(dtype=float)
        out = np.zeros((m, size))
        for i, cut in enumerate(cuts):
            t = (y > cut).astype(float)
            if betas is None:
                mu = np.full(len(t), 0.5)
                var, eta = mu * (1 - mu), np.zeros(len(t))
            else:
                eta = x @ betas[i]
                mu, var = _mean("logit", eta)
            xw = x * (w * var)[:, None]
            p = np.clip(mu, 1e-300, 1 - 1e-16)
            out[i] = np.concatenate([(x.T @ xw).ravel(), xw.T @ eta + x.T @ (w * (t - mu)),
                                     [-2 * (w * (t * np.log(p) + (1 - t) * np.log(1 - p))).sum()]])
        return out.ravel()

    flat = accumulate(frame.df, lambda pdf: block(pdf, None, None), m * size, True).reshape(m, size)
    keep = independent_columns(flat[0, : k * k].reshape(k, k))
    last = None
    breads = [None] * m
    betas = np.zeros((m, k))
    for _ in range(max_iter):
        for i in range(m):
            a = flat[i, : k * k].reshape(k, k)[np.ix_(keep, keep)]
            breads[i] = inverse(a)
            betas[i, keep] = breads[i] @ flat[i, k * k: k * k + k][keep]
        cur = betas.copy()
        flat = accumulate(frame.df, lambda pdf: block(pdf, cur, keep), m * size, True).reshape(m, size)
        dev = flat[:, -1]
        if last is not None and np.all(np.abs(dev - last) <= 1e-11 * (np.abs(dev) + 0.1)):
            break
        last = dev
    else:
        raise RuntimeError("the fits did not converge")
    undo = d.undo()[np.ix_(keep, keep)]
    tables = []
    for i, cut in enumerate(cuts):
        cov = undo @ breads[i] @ undo.T
        est, se = undo @ betas[i, keep], np.sqrt(np.diag(cov))
        tables.append(pd.DataFrame({"cut": int(cut), "term": [d.names[c] for c in keep], "estimate": est,
                                    "std_error": se, "ci_low": est - 1.96 * se, "ci_high": est + 1.96 * se}))
    return table_frame(df.sparkSession, pd.concat(tables, ignore_index=True))
