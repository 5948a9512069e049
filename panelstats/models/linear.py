"""Least squares from one Gram aggregate."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.joins import rjoin
from ..session import ship, stage_table
from .absorbed import level_effects, rank
from .accumulate import accumulate, group_sums
from .design import Formula, ModelFrame, TooManyLevels, model_frame, reads, variable_column
from .dist import t_quantile
from .fit import Fit, cluster_map, independent_columns, inverse, table_frame
from .threads import single


def gram_block(design, pdf: pd.DataFrame) -> np.ndarray:
    """X'WX, X'Wy and the scalar sums of a batch."""
    x = design.matrix(pdf)
    w = pdf["__w"].to_numpy(dtype=float)
    wy = pdf["__wy"].to_numpy(dtype=float)
    return np.concatenate([(x.T @ (x * w[:, None])).ravel(), x.T @ wy,
                           [pdf["__wyy"].sum(), wy.sum(), w.sum(), pdf["__n"].sum(), pdf["__lw"].sum()]])


def solve_gram(flat: np.ndarray, k: int):
    """Coefficients, inverse information and kept columns from the summed blocks."""
    a = flat[: k * k].reshape(k, k)
    xy = flat[k * k: k * k + k]
    yy, sy, sw, n, logw = flat[k * k + k: k * k + k + 5]
    keep = independent_columns(a)
    bread = inverse(a[np.ix_(keep, keep)])
    beta = bread @ xy[keep]
    rss = float(yy - 2 * beta @ xy[keep] + beta @ a[np.ix_(keep, keep)] @ beta)
    tss = float(yy - sy * sy / sw)
    return beta, bread, keep, max(rss, 0.0), tss, int(round(n)), float(logw)


def ols(df: DataFrame, formula: str, weights: str | None = None, cluster: Sequence[str] = (),
        levels: Mapping[str, Sequence] | None = None, compress: bool | None = None,
        absorb: str | Sequence[str] | None = None) -> Fit:
    """Linear model, weighted if asked.

    Name columns for later clustering in ``cluster``. ``absorb`` takes factors of any number of
    levels out by their group means instead of dummy columns. A factor of the formula with too many levels for
    columns is absorbed too, unless products use it; with one absorbed factor, ``level_table`` gives its coefficients.
    """
    taken = [absorb] if isinstance(absorb, str) else list(absorb or [])
    while True:
        try:
            if taken:
                return _absorbed(df, formula, weights, cluster, levels, taken)
            return fit_frame(model_frame(df, formula, weights, cluster, levels, compress), cluster)
        except TooManyLevels as big:
            rest = Formula(formula).without(big.variable)
            if rest is None:
                raise
            formula = rest
            taken += [c for c in reads(big.variable, df.columns) if c not in taken]


def fit_frame(frame: ModelFrame, cluster: Sequence[str] = (), lost_df: int = 0) -> Fit:
    d = frame.design
    k = d.k
    flat = accumulate(frame.df, lambda pdf: gram_block(d, pdf), k * k + k + 5, frame.staged)
    beta, bread, keep, rss, tss, n, logw = solve_gram(flat, k)
    df_resid = n - len(keep) - lost_df
    sigma2 = rss / df_resid if df_resid > 0 else float("nan")
    m = d.undo()[np.ix_(keep, keep)]
    full = np.zeros(k)
    full[keep] = beta

    def score(pdf):
        x = d.matrix(pdf)
        r = pdf["__wy"].to_numpy(dtype=float) - pdf["__w"].to_numpy(dtype=float) * (x @ full)
        return x * r[:, None]

    loglik = -0.5 * n * (math.log(2 * math.pi) + math.log(max(rss, 1e-300) / n) + 1) + 0.5 * logw
    return Fit("linear", frame, d.names, keep, m @ beta, sigma2 * (m @ bread @ m.T), bread, d.undo(), score,
               n, df_resid, sigma2, loglik, rss, tss, use_t=True,
               clusters=dict(cluster_map(cluster)), n_par=len(keep) + lost_df + 1)


#: Sweeps over the absorbed factors, and the largest group mean left, in units of a column's spread.
MAX_SWEEPS, MEAN_LEFT = 2000, 1e-10


def _absorbed(df: DataFrame, formula: str, weights: str | None, cluster: Sequence[str],
              levels: Mapping[str, Sequence] | None, absorb: Sequence[str]) -> Fit:
    """Within transformation: columns less the effects of the factors, then least squares without intercept.

    Effects live on the cells that the factors span, one aggregate of the rows. The effects of two factors come from one
    solve over their levels (:mod:`absorbed`); with more, the cell means are freed of one factor's means after the other
    until none is left. Rows then take their shift in a join.
    No level list reaches the driver, so factors may have any number of levels. Degrees of freedom count the effects
    that the factors span together: nested or unconnected factors span fewer than their levels say.
    """
    f = Formula(formula)
    plain = model_frame(df, formula, weights, (), levels, compress=False)
    d = plain.design
    cols = [(n, c) for n, c in zip(d.names, d.columns(df)) if n != "(Intercept)"]
    y, _ = variable_column(df, f.response)
    w = F.col(weights).cast("double") if weights else F.lit(1.0)
    groups = [f"g{i}" for i in range(len(absorb))]
    base = df.select(*[c.alias(f"c{i}") for i, (_, c) in enumerate(cols)], y.cast("double").alias("cy"),
                     w.alias("cw"), *[F.col(a).alias(g) for g, a in zip(groups, absorb)],
                     *[F.col(c).alias(f"k{i}") for i, c in enumerate(cluster)])
    values = [f"c{i}" for i in range(len(cols))] + ["cy"]
    base = base.dropna(subset=[*values, "cw"]).where("cw <> 0")

    def less_means(table: DataFrame, g: str, weight: str) -> DataFrame:
        means = table.groupBy(g).agg(*[(F.sum(F.col(v) * F.col(weight)) / F.sum(weight)).alias(f"{v}_m") for v in values])
        return rjoin(table, means, [g]).withColumns({v: F.col(v) - F.col(f"{v}_m") for v in values}).drop(*[f"{v}_m" for v in values])

    cells = stage_table(base.groupBy(*groups).agg(F.sum("cw").alias("size"), *[F.sum(F.col(v) * F.col("cw")).alias(v) for v in values]))
    if len(groups) == 2:
        within = _less_both(base, cells, groups, values)
    else:
        within = rjoin(base, _swept(cells, groups, values, less_means, base), groups).withColumns({v: F.col(v) - F.col(f"{v}_m") for v in values})
    lost_df = rank(cells, groups)
    rhs = " + ".join(["0", *[f"c{i}" for i in range(len(cols))]])
    frame = model_frame(within, f"cy ~ {rhs}", "cw", [f"k{i}" for i in range(len(cluster))], compress=False, iterative=True)
    fit = fit_frame(frame, [f"k{i}" for i in range(len(cluster))], lost_df)
    fit.names = [n for n, _ in cols]
    fit.clusters = {c: f"e{i}" for i, c in enumerate(cluster)}
    if len(groups) == 1:
        fit.level_sums = cells
    return fit


def level_table(fit: Fit, conf: float = 0.95) -> DataFrame:
    """Coefficients of the one absorbed factor as a DataFrame: ``level, n, effect, estimate, std_error, conf_low, conf_high``.

    ``effect`` is the level's mean response where all regressors are 0; ``estimate`` is its difference from the first level in order, as a
    column of its own would give it, with the error of the plain covariance. Only the first level's sums pass through the driver.
    """
    if fit.level_sums is None:
        raise ValueError("fit with one absorbed factor; the effects of several have no common zero")
    if fit.clustered:
        raise ValueError("level effects have plain errors: take them before clustering")
    k = len(fit.names)
    beta, v = fit.full_coef(), fit.full_vcov()
    names = [f"c{i}" for i in range(k)]
    sums = fit.level_sums.where(F.col("g0").isNotNull())
    first = sums.orderBy("g0").limit(1).toPandas()
    if first.empty:
        return sums.select(F.col("g0").alias("level"), *[F.lit(None).cast("double").alias(c) for c in ("n", "effect", "estimate", "std_error", "conf_low", "conf_high")])

    def parts(pdf):
        size = pdf["size"].to_numpy(dtype=float)
        x = pdf[names].to_numpy(dtype=float).reshape(len(pdf), k) / size[:, None]
        return size, x, pdf["cy"].to_numpy(dtype=float) / size - x @ beta

    n0, x0, e0 = parts(first)
    base, s2, crit = first["g0"].iloc[0], fit.sigma2, t_quantile(0.5 + conf / 2, fit.df_resid)

    def rows(batches):
        for pdf in batches:
            size, x, effect = parts(pdf)
            away = (pdf["g0"] != base).to_numpy(dtype=float)
            gap = x - x0
            se = np.sqrt(np.maximum(s2 * (1 / size + 1 / n0) + ((gap @ v) * gap).sum(1), 0.0)) * away
            est = (effect - e0) * away
            yield pd.DataFrame({"level": pdf["g0"], "n": size, "effect": effect, "estimate": est, "std_error": se,
                                "conf_low": est - crit * se, "conf_high": est + crit * se})

    kind = sums.schema["g0"].dataType.simpleString()
    ship(fit.spark)
    return sums.mapInPandas(rows, f"level {kind}, n double, effect double, estimate double, std_error double, conf_low double, conf_high double")


def _less_both(base: DataFrame, cells: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``base`` with ``values`` less the effects of two factors."""
    counts = [cells.select(g).distinct().count() for g in groups]
    big, small = groups if counts[0] >= counts[1] else groups[::-1]
    on_a, on_b = level_effects(cells, big, small, list(values), [f"{v}_m" for v in values])
    out = base
    for side, key, g in ((on_a, "a", big), (on_b, "b", small)):
        out = rjoin(out, side.select(F.col(key).alias(g), *[f"{v}_m" for v in values]), [g])
        out = out.withColumns({v: F.col(v) - F.col(f"{v}_m") for v in values}).drop(*[f"{v}_m" for v in values])
    return out


def _swept(cells: DataFrame, groups: Sequence[str], values: Sequence[str], less_means, base: DataFrame) -> DataFrame:
    """Each cell's shift, by taking the factors' means out in turn."""
    cells = stage_table(cells.withColumns({v: F.col(v) / F.col("size") for v in values}).withColumns({f"{v}_0": F.col(v) for v in values}))
    spread = base.agg(*[F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias(v) for v in values]).first()
    for _ in range(MAX_SWEEPS):
        for g in groups:
            cells = less_means(cells, g, "size")
        if len(groups) == 1:
            break
        cells = stage_table(cells)
        left = cells.groupBy(groups[0]).agg(*[F.abs(F.sum(F.col(v) * F.col("size")) / F.sum("size")).alias(v) for v in values])
        most = left.agg(*[F.max(v).alias(v) for v in values]).first()
        if all((most[v] or 0.0) <= MEAN_LEFT * (spread[v] or 1.0) for v in values):
            break
    else:
        raise RuntimeError("the absorbed effects did not converge")
    return cells.select(*groups, *[(F.col(f"{v}_0") - F.col(v)).alias(f"{v}_m") for v in values])


def ols_variants(df: DataFrame, formula: str, variants: Mapping[str, Mapping[str, str]],
                 weights: str | None = None, cluster: Sequence[str] = (),
                 levels: Mapping[str, Sequence] | None = None, compress: bool | None = None) -> DataFrame:
    """Fit one formula under many replacements of its variables in one pass over the rows.

    ``variants`` is ``{name: {column: SQL expression}}``. Each task keeps one Gram block per
    variant, and cluster scores are summed under the variant's key, so rows are never copied.
    """
    base = Formula(formula)
    names = list(variants)
    slots: dict[tuple[str, str], str] = {}
    work = df
    for v in names:
        for c, e in variants[v].items():
            slots[(v, c)] = f"__v{len(slots)}"
            work = work.withColumn(slots[(v, c)], F.expr(e))

    def formula_of(v: str) -> str:
        text = formula
        for c in variants[v]:
            text = _rename(text, c, slots[(v, c)])
        return text

    parts = {v: Formula(formula_of(v)) for v in names}
    variables = list(dict.fromkeys(x for p in parts.values() for x in p.variables))
    responses = list(dict.fromkeys(p.response for p in parts.values()))
    union = Formula(f"{responses[0]} ~ " + " + ".join(variables))
    union.terms = [(x,) for x in variables]
    # rows with equal regressors merge unless the response itself varies over the variants
    own_response = len(responses) > 1
    keep = [*cluster, *[r for r in responses if r not in cluster]] if own_response else list(cluster)
    frame = model_frame(work, union, weights, keep, levels, compress=False if own_response else compress, iterative=True)
    at = {c: f"e{i}" for i, c in enumerate(keep)}
    designs = {}
    for v in names:
        designs[v] = type(frame.design)(parts[v], {x: frame.design.levels[x] for x in parts[v].variables},
                                        frame.design.field_of, frame.design.center, frame.design.scale,
                                        parts[v].intercept)
    sizes = [designs[v].k for v in names]
    blocks = [k * k + k + 5 for k in sizes]

    def view(pdf, v):
        if not own_response:
            return pdf
        y = pdf[at[parts[v].response]].to_numpy(dtype=float)
        w = pdf["__w"].to_numpy(dtype=float)
        return pdf.assign(__wy=w * y, __wyy=w * y * y)

    flat = accumulate(frame.df, lambda pdf: np.concatenate([gram_block(designs[v], view(pdf, v)) for v in names]),
                      sum(blocks), frame.staged)
    solved = {}
    start = 0
    for v, size, k in zip(names, blocks, sizes):
        solved[v] = solve_gram(flat[start: start + size], k)
        start += size
    fits = {}
    for v in names:
        beta, bread, kept, rss, tss, n, logw = solved[v]
        d = designs[v]
        dfr = n - len(kept)
        m = d.undo()[np.ix_(kept, kept)]
        fits[v] = Fit("linear", frame, d.names, kept, m @ beta, rss / dfr * (m @ bread @ m.T), bread, d.undo(),
                      None, n, dfr, rss / dfr, None, rss, tss, use_t=True)
    if cluster:
        _variant_covariance(frame, names, designs, view, solved, fits, [at[c] for c in cluster])
    tables = []
    for v in names:
        t = fits[v].table()
        back = {slots[(v, c)]: c for c in variants[v]}
        for s, c in back.items():
            t["term"] = [_rename(x, s, c) for x in t["term"]]
        t.insert(0, "variant", v)
        tables.append(t)
    return table_frame(df.sparkSession, pd.concat(tables, ignore_index=True))


def _rename(text: str, old: str, new: str) -> str:
    import re
    return re.sub(rf"(?<!\w){re.escape(old)}(?!\w)", new, text)


def _variant_covariance(frame, names, designs, view, solved, fits, fields) -> None:
    """Clustered covariance of all variants from one keyed score aggregate."""
    from itertools import combinations

    from pyspark.sql import functions as F

    from ..session import stage
    width = max(len(solved[v][2]) for v in names)
    cols = [f"s{i}" for i in range(width)]
    full = {}
    for v in names:
        b = np.zeros(designs[v].k)
        b[solved[v][2]] = solved[v][0]
        full[v] = b
    keyed = ", ".join([f"`{c}` {frame.df.schema[c].dataType.simpleString()}" for c in fields]
                      + ["variant int"] + [f"{c} double" for c in cols])

    def presum(batches):
        single()
        for pdf in batches:
            for i, v in enumerate(names):
                x = designs[v].matrix(pdf)
                part = view(pdf, v)
                r = part["__wy"].to_numpy() - part["__w"].to_numpy() * (x @ full[v])
                s = np.zeros((len(pdf), width))
                s[:, : len(solved[v][2])] = (x * r[:, None])[:, solved[v][2]]
                rows = pd.concat([pdf[fields].reset_index(drop=True), pd.DataFrame(s, columns=cols)], axis=1)
                out = rows.groupby(fields, dropna=False, sort=False, as_index=False)[cols].sum()
                out.insert(len(fields), "variant", i)
                yield out

    finest = stage(frame.df.mapInPandas(presum, keyed).groupBy(*fields, "variant").agg(
        *[F.sum(c).alias(c) for c in cols]))
    meats = {v: np.zeros((width, width)) for v in names}
    for r in range(1, len(fields) + 1):
        for chosen in combinations(fields, r):
            sums = finest.groupBy(*chosen, "variant").agg(*[F.sum(c).alias(c) for c in cols])
            size = width * width + 1

            def block(pdf):
                out = np.zeros((len(names), size))
                for i, part in pdf.groupby("variant"):
                    s = part[cols].to_numpy(dtype=float)
                    out[i, :-1] = (s.T @ s).ravel()
                    out[i, -1] = len(part)
                return out.ravel()

            flat = accumulate(sums, block, size * len(names)).reshape(len(names), size)
            for i, v in enumerate(names):
                g = flat[i, -1]
                meats[v] += (-1) ** (r + 1) * g / (g - 1.0) * flat[i, :-1].reshape(width, width)
    for v in names:
        f, kept = fits[v], solved[v][2]
        k = len(kept)
        meat = meats[v][:k, :k] * (f.n - 1.0) / (f.n - k)
        m = f.undo[np.ix_(kept, kept)]
        f.vcov = m @ f.bread @ meat @ f.bread @ m.T
