"""Fitted models: coefficient tables, robust covariance, tests, prediction."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship, stage
from .accumulate import accumulate, group_sums
from .design import Design, ModelFrame, variable_column
from .dist import chi2_sf, norm_quantile, norm_sf2, t_quantile, t_sf2
from .threads import single


def independent_columns(gram: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """Left-to-right sweep: keep a column unless those kept before already span it."""
    k = len(gram)
    d = np.sqrt(np.clip(np.diag(gram), 0.0, None))
    d[d == 0] = 1.0
    a = gram / np.outer(d, d)
    rows = np.zeros((k, k))
    keep = []
    for j in range(k):
        r = a[j].copy()
        for i, v in enumerate(keep):
            r = r - rows[i] * rows[i, j]
        if r[j] > tol:
            rows[len(keep)] = r / math.sqrt(r[j])
            keep.append(j)
    return np.array(keep, dtype=int)


def nonnegative(a: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """The symmetric matrix without its negative eigenvalues; rounding below ``tol`` of the largest one is left alone.

    Rows and columns are brought to like size first, so that a regressor's unit does not decide what counts as negative.
    """
    size = np.sqrt(np.abs(np.diag(a)))
    size = np.where(size > 0, size, 1.0)
    value, vector = np.linalg.eigh((a + a.T) / 2 / np.outer(size, size))
    if not len(value) or value[0] >= -tol * np.abs(value).max():
        return a
    return (vector * np.maximum(value, 0.0)) @ vector.T * np.outer(size, size)


def inverse(a: np.ndarray) -> np.ndarray:
    """Inverse of a symmetric positive matrix, scaled to a unit diagonal first."""
    d = np.sqrt(np.clip(np.diag(a), 1e-300, None))
    return np.linalg.inv(a / np.outer(d, d)) / np.outer(d, d)


@dataclass
class Fit:
    """Coefficients and covariance of the kept columns, in plain units.

    ``score`` gives each frame row's score on the shifted columns; ``bread`` is the inverse
    information there. Aliased columns appear in tables with null estimates.
    """

    kind: str
    frame: ModelFrame
    names: list[str]
    keep: np.ndarray
    coef: np.ndarray
    vcov: np.ndarray
    bread: np.ndarray
    undo: np.ndarray
    score: Callable[[pd.DataFrame], np.ndarray] | None
    n: int
    df_resid: float
    sigma2: float
    loglik: float | None = None
    rss: float | None = None
    tss: float | None = None
    deviance: float | None = None
    use_t: bool = False
    clusters: dict[str, str] | None = None
    n_par: int | None = None
    level_sums: DataFrame | None = None
    clustered: bool = False

    @property
    def design(self) -> Design:
        return self.frame.design

    @property
    def spark(self) -> SparkSession:
        return self.frame.df.sparkSession

    def param(self, name: str) -> float:
        at = {self.names[j]: i for i, j in enumerate(self.keep)}
        return float(self.coef[at[name]]) if name in at else float("nan")

    def full_coef(self) -> np.ndarray:
        """Coefficients of all design columns, aliased ones 0."""
        out = np.zeros(len(self.names))
        out[self.keep] = self.coef
        return out

    def full_vcov(self) -> np.ndarray:
        out = np.zeros((len(self.names),) * 2)
        out[np.ix_(self.keep, self.keep)] = self.vcov
        return out

    # -- covariance -------------------------------------------------------------------------

    def cluster(self, *cols: str, repair: bool = False) -> "Fit":
        """Sandwich covariance clustered on one or several columns (inclusion-exclusion).

        Factor G/(G-1) per clustering, for least squares also (n-1) over the residual degrees of freedom. With several
        columns the inclusion-exclusion may give negative variances: their errors are null, or with ``repair`` a matrix that
        has negative directions loses them, which raises other variances too.
        """
        if self.score is None or not self.clusters:
            raise ValueError("name the cluster columns when fitting")
        fields = [self.clusters[c] for c in cols]
        keep, score = self.keep, self.score
        width = len(keep)
        names = [f"s{i}" for i in range(width)]
        finest = group_sums(self.frame.df, fields, lambda pdf: score(pdf)[:, keep], width, names)
        if len(fields) > 1:
            finest = stage(finest)
        meat = np.zeros((width, width))
        for r in range(1, len(fields) + 1):
            for chosen in combinations(fields, r):
                sums = finest if r == len(fields) else finest.groupBy(*chosen).agg(
                    *[F.sum(c).alias(c) for c in names])

                def block(pdf, names=names):
                    s = pdf[names].to_numpy(dtype=float)
                    return np.concatenate([(s.T @ s).ravel(), [len(pdf)]])

                flat = accumulate(sums, block, width * width + 1)
                g = flat[-1]
                meat += (-1) ** (r + 1) * g / (g - 1.0) * flat[:-1].reshape(width, width)
        if self.use_t:
            meat *= (self.n - 1.0) / self.df_resid  # absorbed levels count too
        v = self.bread @ meat @ self.bread
        m = self.undo[np.ix_(keep, keep)]
        v = m @ v @ m.T
        if repair:
            v = nonnegative(v)
        return replace(self, vcov=v, clustered=True)

    # -- tables -----------------------------------------------------------------------------

    def table(self, conf: float = 0.95) -> pd.DataFrame:
        rows = []
        at = {j: i for i, j in enumerate(self.keep)}
        crit = t_quantile(0.5 + conf / 2, self.df_resid) if self.use_t else norm_quantile(0.5 + conf / 2)
        floor = -1e-12 * float(np.abs(np.diag(self.vcov)).max(initial=0.0))  # below it, a variance isn't 0 up to rounding
        for j, name in enumerate(self.names):
            if j not in at:
                rows.append((name, *[float("nan")] * 6))
                continue
            b = float(self.coef[at[j]])
            var = float(self.vcov[at[j], at[j]])
            se = float("nan") if var < floor else math.sqrt(max(var, 0.0))
            z = b / se if se > 0 else float("nan")
            p = t_sf2(z, self.df_resid) if self.use_t else norm_sf2(z)
            rows.append((name, b, se, z, p, b - crit * se, b + crit * se))
        return pd.DataFrame(rows, columns=["term", "estimate", "std_error", "statistic", "p_value",
                                           "conf_low", "conf_high"])

    def tidy(self, conf: float = 0.95) -> DataFrame:
        """Coefficient table with statistic, p value and interval; aliased terms are null."""
        return table_frame(self.spark, self.table(conf))

    def stars(self) -> DataFrame:
        p = F.col("p_value")
        mark = F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
        return self.tidy().withColumn("stars", F.when(p.isNotNull(), mark))

    def stats(self) -> DataFrame:
        """n, R squared, log likelihood, AIC and BIC."""
        row = {"n": int(self.n), "k": len(self.keep), "sigma2": float(self.sigma2)}
        if self.rss is not None:
            row["r2"] = 1.0 - self.rss / self.tss if self.tss else float("nan")
        if self.loglik is not None:
            par = self.n_par if self.n_par is not None else len(self.keep)
            row.update(loglik=float(self.loglik), aic=-2 * self.loglik + 2 * par,
                       bic=-2 * self.loglik + math.log(self.n) * par)
        if self.deviance is not None:
            row["deviance"] = float(self.deviance)
        return table_frame(self.spark, pd.DataFrame([row]))

    def wald(self, terms: Sequence[str]) -> DataFrame:
        """Joint test that the terms are 0; aliased terms drop out."""
        at = {self.names[j]: i for i, j in enumerate(self.keep)}
        idx = [at[t] for t in terms if t in at]
        b, v = self.coef[idx], self.vcov[np.ix_(idx, idx)]
        chi2 = float(b @ np.linalg.solve(v, b))
        return table_frame(self.spark, pd.DataFrame(
            [{"df": len(idx), "chisq": chi2, "p_value": chi2_sf(chi2, len(idx))}]))

    # -- prediction -------------------------------------------------------------------------

    def linear_predictor(self, df: DataFrame) -> Column:
        """x'b as one JVM expression; factors without interaction go through a map lookup."""
        d, b = self.design, self.full_coef()
        total = F.lit(float(b[0])) if d.intercept else F.lit(0.0)
        lookups: dict[str, dict] = {}
        for combo, beta in zip(d.parts, b):
            if not combo:
                continue
            if len(combo) == 1 and d.levels[combo[0][0]] is not None:
                lookups.setdefault(combo[0][0], {})[combo[0][1]] = float(beta)
                continue
            if beta == 0.0:
                continue
            c = F.lit(float(beta))
            for v, level in combo:
                x, _ = variable_column(df, v)
                c = c * (x.cast("double") if d.levels[v] is None else (x == F.lit(level)).cast("double"))
            total = total + c
        for v, betas in lookups.items():
            x, _ = variable_column(df, v)
            for level in d.levels[v]:
                betas.setdefault(level, 0.0)
            pairs = F.create_map(*[F.lit(z) for kv in betas.items() for z in kv])
            total = total + F.try_element_at(pairs, x)
        return total

    def mean_of(self, eta: Column) -> Column:
        if self.kind == "poisson":
            return F.exp(eta)
        if self.kind == "logit":
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
        return eta

    def predict(self, df: DataFrame, se: bool = False, response: bool = True, level: float = 0.95,
                out: str = "fit") -> DataFrame:
        """Add the prediction; with ``se`` also its standard error and interval."""
        if not se:
            eta = self.linear_predictor(df)
            return df.withColumn(out, self.mean_of(eta) if response else eta)
        ship(df.sparkSession)
        d, b, v, kind = self.design, self.full_coef(), self.full_vcov(), self.kind
        crit = t_quantile(0.5 + level / 2, self.df_resid) if self.use_t else norm_quantile(0.5 + level / 2)
        fields = {x: variable_column(df, x)[0].alias(d.field_of[x]) for x in d.formula.variables}
        numeric = {d.field_of[x] for x in d.formula.variables if d.levels[x] is None}
        wide = df.select("*", *fields.values())
        wide = wide.withColumns({c: F.col(c).cast("double") for c in numeric}) if numeric else wide
        names = df.columns
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
                           + [f"`{out}` double", f"`{out}_se` double", f"`{out}_low` double", f"`{out}_high` double"])

        def run(batches):
            single()
            for pdf in batches:
                x = d.matrix(pdf, plain=True)
                eta = x @ b
                s = np.sqrt(np.clip(((x @ v) * x).sum(1), 0.0, None))
                low, high = eta - crit * s, eta + crit * s
                if response and kind == "poisson":
                    eta, low, high = np.exp(eta), np.exp(low), np.exp(high)
                    s = eta * s
                elif response and kind == "logit":
                    eta, low, high = (1 / (1 + np.exp(-z)) for z in (eta, low, high))
                    s = eta * (1 - eta) * s
                res = pdf[names].copy()
                res[out], res[f"{out}_se"], res[f"{out}_low"], res[f"{out}_high"] = eta, s, low, high
                yield res

        return wide.mapInPandas(run, schema)


def table_frame(spark: SparkSession, pdf: pd.DataFrame) -> DataFrame:
    """A result table of a few rows as a DataFrame, NaN turned into null."""
    kinds = {"f": "double", "i": "bigint", "b": "boolean"}
    schema = ", ".join(f"`{c}` {kinds.get(pdf[c].dtype.kind, 'string')}" for c in pdf.columns)
    rows = [tuple(None if isinstance(x, float) and math.isnan(x) else
                  (x.item() if isinstance(x, np.generic) else x) for x in r)
            for r in pdf.itertuples(index=False, name=None)]
    rows = [tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows]
    return spark.createDataFrame(rows, schema)


def cluster_map(extra: Sequence[str]) -> Mapping[str, str]:
    return {c: f"e{i}" for i, c in enumerate(extra)}
