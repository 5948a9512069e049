"""Omitted-variable sensitivity, misreporting sweeps, pooling."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .fit import Fit, table_frame


def _robustness(f2: float) -> float:
    """Share of residual variance a confounder must explain on both sides, from a partial f squared."""
    return 0.5 * (math.sqrt(f2 * f2 + 4 * f2) - f2)


def ovb_sensitivity(fit: Fit, treatment: str, benchmarks: Sequence[str] = (), kd: Sequence[float] = (1, 2, 3),
                    q: float = 1.0, alpha: float = 0.05) -> DataFrame:
    """Partial R2, robustness values, and bounds for confounders kd times as strong as a covariate.

    After Cinelli and Hazlett (2020), from the t statistics of a classical least-squares fit.
    """
    from .dist import t_quantile
    at = {fit.names[j]: i for i, j in enumerate(fit.keep)}
    dof = fit.df_resid

    def t_of(term):
        i = at[term]
        return float(fit.coef[i] / math.sqrt(fit.vcov[i, i]))

    i = at[treatment]
    est, se = float(fit.coef[i]), math.sqrt(float(fit.vcov[i, i]))
    t = est / se
    r2yd = t * t / (t * t + dof)
    f = abs(t) / math.sqrt(dof)
    rv = _robustness((q * f) ** 2)
    crit = abs(t_quantile(alpha / 2, dof - 1)) / math.sqrt(dof - 1)
    fqa = q * f - crit
    if fqa <= 0:
        rva = 0.0
    else:
        rva = _robustness(fqa * fqa)
        if q * f > 1.0 / crit:
            rva = ((q * f) ** 2 - crit * crit) / (1 + (q * f) ** 2)
    rows = [{"kind": "estimate", "benchmark": None, "kd": None, "estimate": est, "std_error": se, "statistic": t,
             "r2yd_x": r2yd, "rv": rv, "rv_alpha": rva, "r2dz_x": None, "r2yz_dx": None}]
    for b in benchmarks:
        r2yx = _partial(fit, b, dof)
        r2dx = _treatment_partial(fit, treatment, b)
        for k in kd:
            r2dz = k * r2dx / (1 - r2dx)
            if r2dz >= 1:
                raise ValueError(f"a confounder {k} times {b} would explain all of the treatment")
            r2zxj = k * r2dx * r2dx / ((1 - k * r2dx) * (1 - r2dx))
            r2yz = min(((math.sqrt(k) + math.sqrt(r2zxj)) / math.sqrt(1 - r2zxj)) ** 2 * r2yx / (1 - r2yx), 1.0)
            bias = se * math.sqrt(dof) * math.sqrt(r2yz * r2dz / (1 - r2dz))
            adj = math.copysign(max(abs(est) - bias, -math.inf), est) if abs(est) >= bias else \
                math.copysign(bias - abs(est), -est)
            adj_se = se * math.sqrt((1 - r2yz) / (1 - r2dz)) * math.sqrt(dof / (dof - 1))
            rows.append({"kind": "bound", "benchmark": b, "kd": float(k), "estimate": adj, "std_error": adj_se,
                         "statistic": adj / adj_se if adj_se else None, "r2yd_x": r2yd, "rv": rv, "rv_alpha": rva,
                         "r2dz_x": r2dz, "r2yz_dx": r2yz})
    table = pd.DataFrame(rows)
    for c in ("kd", "statistic", "r2dz_x", "r2yz_dx"):
        table[c] = table[c].astype(float)
    return table_frame(fit.spark, table)


def _partial(fit: Fit, term: str, dof: float) -> float:
    i = [fit.names[j] for j in fit.keep].index(term)
    t2 = float(fit.coef[i] ** 2 / fit.vcov[i, i])
    return t2 / (t2 + dof)


def _treatment_partial(fit: Fit, treatment: str, benchmark: str) -> float:
    """Partial R2 of the benchmark with the treatment, from the same Gram matrix.

    Regressing the treatment on the other columns needs no second pass: the inverse Gram
    holds the partial correlation of every pair of regressors.
    """
    names = [fit.names[j] for j in fit.keep]
    i, j = names.index(treatment), names.index(benchmark)
    m = fit.undo[[[a] for a in fit.keep], fit.keep]
    inv = m @ fit.bread @ m.T
    r = -inv[i, j] / math.sqrt(inv[i, i] * inv[j, j])
    return float(r * r)


def misreport(df: DataFrame, flag: str, value: str, rates: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Move a share of the flagged counts to the unflagged side, for each rate; counts round half to even.

    The two sides meet in one row per cell and rates explode from literals.
    """
    side = lambda v: F.coalesce(F.sum(F.when(F.col(flag) == F.lit(v), F.col(value))), F.lit(0)).cast("double")
    wide = df.groupBy(*keys).agg(side(True).alias("__t"), side(False).alias("__f"))
    wide = wide.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    rows = F.array(
        F.struct(F.lit(True).alias(flag), F.bround((1 - F.col("rate")) * F.col("__t")).alias(value)),
        F.struct(F.lit(False).alias(flag), F.bround(F.col("rate") * F.col("__t") + F.col("__f")).alias(value)))
    return wide.select(*keys, "rate", F.inline(rows))


def rate_curve(points: Mapping[float, float]):
    """Quadratic through the known (spouse rate, partner rate) points, as a function."""
    import numpy as np
    xs = np.array(list(points), dtype=float)
    coef = np.polyfit(xs, np.array(list(points.values()), dtype=float), 2)
    return lambda x: float(np.polyval(coef, x))


def misreport_variants(out: str, counts: Mapping[str, str], exempt: Sequence[str], total: str,
                       spouse_rates: Sequence[float], partner_rate) -> dict[str, dict[str, str]]:
    """Variants of an adjusted percent for a sweep over misreporting rates.

    ``counts`` names the discounted ``spouse`` and ``partner`` columns; ``exempt`` columns count in full.
    """
    variants = {}
    for r in spouse_rates:
        p = partner_rate(r)
        kept = " + ".join([f"{counts['spouse']} * {1 - r!r}", f"{counts['partner']} * {1 - p!r}", *exempt])
        variants[f"{r:.6g}"] = {out: f"try_divide(100.0 * ({kept}), {total})"}
    return variants


def pool_inverse_variance(df: DataFrame, by: str, est: str = "estimate", se: str = "std_error") -> DataFrame:
    """Precision-weighted mean and its error per value of ``by``."""
    w = 1.0 / (F.col(se) * F.col(se))
    known = df.where(F.col(est).isNotNull() & F.col(se).isNotNull())
    return known.groupBy(by).agg((F.sum(F.col(est) * w) / F.sum(w)).alias(est),
                                 F.sqrt(1.0 / F.sum(w)).alias(se))


def pooled_difference(df: DataFrame, flags: Sequence[str], est: str = "estimate", se: str = "std_error") -> DataFrame:
    """Pooled estimate with a flag on minus off, for every flag in one aggregate."""
    w = 1.0 / (F.col(se) * F.col(se))
    known = df.where(F.col(est).isNotNull() & F.col(se).isNotNull())
    rows = F.array(*[F.struct(F.lit(f).alias("policy"), F.col(f).cast("int").alias("flag")) for f in flags])
    long = known.select(F.col(est).alias("__e"), w.alias("__w"), F.inline(rows))

    def pooled(v):
        on = F.col("flag") == v
        sw = F.sum(F.when(on, F.col("__w")))
        return F.sum(F.when(on, F.col("__e") * F.col("__w"))) / sw, 1.0 / sw

    (e1, v1), (e0, v0) = pooled(1), pooled(0)
    return long.groupBy("policy").agg((e1 - e0).alias("est_dif"), F.sqrt(v1 + v0).alias("est_dif_se"))
