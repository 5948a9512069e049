"""Factors of any number of levels beside the regressors: how many effects they span, and count models with two of them.

Levels stay DataFrames throughout; the driver sees k x k systems and scalars.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..operators.joins import rjoin
from ..session import stage_table
from .accumulate import accumulate, group_sums
from .crossed import Crossed
from .design import model_frame
from .fit import Fit, independent_columns, inverse


def components(cells: DataFrame, one: str, two: str) -> int:
    """Connected parts of the graph whose nodes are the levels of two factors and whose edges are the cells that occur. Null is a level.

    A part is named by its least label so far; the least label that any of its nodes sees renames the whole part, so that long chains are short work too.
    """
    edges = stage_table(cells.select(F.col(one).alias("a"), F.col(two).alias("b")).distinct())
    start = stage_table(edges.select("a").distinct().withColumn("id", F.monotonically_increasing_id()))
    edges = stage_table(rjoin(edges, start, ["a"]).select("id", "b"))
    label = start.select("id", F.col("id").alias("l"))
    while True:
        far = edges.join(label, "id").groupBy("b").agg(F.min("l").alias("m"))
        near = rjoin(edges, far, ["b"]).groupBy("id").agg(F.min("m").alias("m"))
        near = stage_table(label.join(near, "id"))
        hooks = near.groupBy("l").agg(F.min("m").alias("hook"))  # the least label that any node of a part has seen
        after = stage_table(near.join(hooks, "l").select("id", "l", F.col("hook").alias("to")))
        after = stage_table(after.join(after.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to"), "l"))
        label = after.select("id", F.col("to").alias("l"))
        if after.where("l <> to").isEmpty():
            return label.select("l").distinct().count()


def rank(cells: DataFrame, groups: Sequence[str]) -> int:
    """Effects that the factors span together: their levels less what one factor says of another.

    Exact for two factors: one effect less for each connected part, so a factor nested in another adds nothing. Each further factor loses as many as the parts it shares with the earlier factor it is most tied to,
    which is exact where such factors are nested, or connected to the others.
    """
    counts = cells.agg(*[(F.count_distinct(g) + F.max(F.col(g).isNull().cast("int"))).alias(g) for g in groups]).first()
    order = sorted(groups, key=lambda g: -(counts[g] or 0))
    return sum(counts[g] or 0 for g in groups) - sum(max(components(cells, g, h) for h in order[:i]) for i, g in enumerate(order) if i)


def level_effects(cells: DataFrame, big: str, small: str, cols: list[str], us: list[str]) -> tuple[DataFrame, DataFrame]:
    """Effects of both factors' levels that weighted least squares gives each variable, from weights ``size`` and weighted sums ``cols`` by cell.

    Columns ``us`` of a table by level ``a`` of the big factor and one by level ``b`` of the small one, beside the levels' sums.
    """
    system = Crossed(cells, big, small, cols)
    shrunk = system.side_a.select("a", *[(F.col(c) / F.col("size")).alias(c) for c in cols])
    taken = system.to_b(shrunk, cols).select("b", *[F.col(c).alias(f"t_{c}") for c in cols])
    right = stage_table(rjoin(system.side_b, taken, ["b"]).select("b", *[(F.col(c) - F.col(f"t_{c}")).alias(c) for c in cols]))
    raw = system.side_b.agg(*[F.sum(F.col(c) ** 2 / F.col("size")).alias(c) for c in cols]).first()
    solved = system.solve(right, cols, np.array([np.inf, np.inf]), 1e-24 * np.array([raw[c] or 0.0 for c in cols]))
    solved = stage_table(solved.select("b", *[F.col(c).alias(u) for c, u in zip(cols, us)]))
    across = system.to_a(solved, us).select("a", *[F.col(u).alias(f"n_{u}") for u in us])
    on_a = stage_table(rjoin(system.side_a, across, ["a"]).select("a", *cols, *[((F.col(c) - F.col(f"n_{u}")) / F.col("size")).alias(u) for c, u in zip(cols, us)]))
    return on_a, stage_table(rjoin(system.side_b, solved, ["b"]))


def quasi_poisson(df: DataFrame, formula: str, weights: str | None, cluster: Sequence[str], levels: Mapping[str, Sequence] | None,
                  compress: bool | None, absorb: Sequence[str], max_iter: int = 60) -> Fit:
    """Count model with the effects of two factors taken out.

    Newton steps in slopes and effects together: at the current fit, regressors and residuals are freed of both factors by a weighted solve over the levels (``Crossed``), the slopes move by what
    is left, and every level's effect by what the solve gave it. A step that makes the fit worse is halved. Levels without any count are fitted perfectly and left out, again and again, as their
    rows may be another level's only ones. The fit gives coefficients, errors and statistics; it has no intercept and predicts nothing.
    """
    frame = model_frame(df, formula, weights, [*absorb, *cluster], levels, compress, iterative=True)
    d, k, (one, two) = frame.design, frame.design.k - 1, frame.extra[:2]
    rows = frame.df
    while True:
        rows = stage_table(rows)
        empty = [rows.groupBy(e).agg(F.sum("__wy").alias("t")).where("t <= 0").drop("t") for e in (one, two)]
        gone = [not t.isEmpty() for t in empty]
        if not any(gone):
            break
        for e, t, g in zip((one, two), empty, gone):
            rows = rjoin(rows, t, [e], "left_anti") if g else rows
    counts = {e: rows.select(e).distinct().count() for e in (one, two)}
    big, small = (one, two) if counts[one] >= counts[two] else (two, one)
    lost = rank(rows, [one, two])
    xs, us = [f"x_{i}" for i in range(k)], [f"u_{i}" for i in range(k + 1)]
    effects = {e: rows.groupBy(e).agg(F.lit(0.0).alias(f"on_{e}")) for e in (big, small)}
    effects[big] = rows.groupBy(big).agg(F.log(F.sum("__wy") / F.sum("__w")).alias(f"on_{big}"))
    effects = {e: stage_table(t) for e, t in effects.items()}
    beta, step, before, steps = np.zeros(k), None, np.inf, None

    def fitted(pdf, b):
        x = d.matrix(pdf)[:, 1:]
        w = pdf["__w"].to_numpy(dtype=float)
        mu = np.exp(np.clip(x @ b + pdf[f"on_{big}"].to_numpy(dtype=float) + pdf[f"on_{small}"].to_numpy(dtype=float), -700, 700))
        return x, w, mu, pdf["__wy"].to_numpy(dtype=float)

    for _ in range(max_iter):
        placed = rjoin(rjoin(rows, effects[big], [big]), effects[small], [small])

        def block(pdf, b=beta):
            x, w, mu, wy = fitted(pdf, b)
            dev = 2.0 * (pdf["__wyl"].to_numpy(dtype=float) - wy * np.log(mu) - (wy - w * mu)).sum()
            pearson = ((pdf["__wyy"].to_numpy(dtype=float) - 2 * mu * wy + mu * mu * w) / mu).sum()
            return np.concatenate([(x.T @ (x * (w * mu)[:, None])).ravel(), x.T @ (wy - w * mu), [dev, pearson, pdf["__n"].sum(), wy.sum()]])

        flat = accumulate(placed, block, k * k + k + 4, False)
        dev = flat[-4]
        if dev > before * (1 + 1e-12) + 1e-9 and steps is not None and steps[0] > 1e-3:  # back by half of the step
            share = steps[0] / 2
            beta = beta - share * step
            for e in (big, small):
                effects[e] = stage_table(effects[e].withColumn(f"on_{e}", F.col(f"on_{e}") - share * F.col("step")))
            steps = [share]
            continue
        before = dev

        def parts(pdf, b=beta):
            x, w, mu, wy = fitted(pdf, b)
            return np.column_stack([x * (w * mu)[:, None], wy - w * mu, w * mu])

        cells = group_sums(placed, [big, small], parts, k + 2, [*xs, "resid", "size"])
        cols = [*xs, "resid"]
        on_a, on_b = level_effects(cells, big, small, cols, us)
        pairs = [(i, j) for i in range(k + 1) for j in range(k + 1)]
        drop = np.zeros((k + 1, k + 1))
        for side in (on_a, on_b):
            drop += np.array(side.agg(*[F.sum(F.col(cols[i]) * F.col(us[j])).alias(f"v{i}_{j}") for i, j in pairs]).first(), dtype=float).reshape(k + 1, k + 1)
        gram = flat[: k * k].reshape(k, k)
        info, slope = gram - drop[:k, :k], flat[k * k: k * k + k] - drop[:k, k]
        still = np.diag(info) <= 1e-10 * np.diag(gram)  # columns that the factors fix
        info[still], info[:, still] = 0.0, 0.0
        keep = independent_columns((info + info.T) / 2)
        bread = inverse(info[np.ix_(keep, keep)])
        step = np.zeros(k)
        step[keep] = bread @ slope[keep]
        # how much better a full step would fit, in units of the likelihood
        gain = (float(flat[k * k: k * k + k] @ step) + drop[k, k] - float(drop[k, :k] @ step)) / max(flat[-1], 1.0)
        change = F.col(us[k]) - sum((F.lit(float(b)) * F.col(u) for b, u in zip(step, us)), F.lit(0.0))
        if gain <= 1e-16:
            break
        for e, side, key in ((big, on_a, "a"), (small, on_b, "b")):
            moved = rjoin(effects[e].select(e, f"on_{e}"), side.select(F.col(key).alias(e), change.alias("step")), [e])
            effects[e] = stage_table(moved.withColumn(f"on_{e}", F.col(f"on_{e}") + F.col("step")))
        beta, steps = beta + step, [1.0]
    else:
        raise RuntimeError("the fit did not converge")
    pearson, n = flat[-3], int(round(flat[-2]))
    dfr = n - len(keep) - lost
    phi = pearson / dfr
    undo = np.diag(1.0 / d.unit[1:])
    m = undo[np.ix_(keep, keep)]
    shifts = [rjoin(placed, on_a.select(F.col("a").alias(big), *[F.col(u).alias(f"{u}_a") for u in us]), [big]),
              on_b.select(F.col("b").alias(small), *[F.col(u).alias(f"{u}_b") for u in us])]
    frame.df = stage_table(rjoin(shifts[0], shifts[1], [small])) if cluster else rows
    at = beta.copy()

    def score(pdf):
        x, w, mu, wy = fitted(pdf, at)
        free = x - pdf[[f"{u}_a" for u in us[:k]]].to_numpy(dtype=float) - pdf[[f"{u}_b" for u in us[:k]]].to_numpy(dtype=float)
        return free * (wy - w * mu)[:, None]

    return Fit("poisson", frame, d.names[1:], keep, m @ beta[keep], phi * (m @ bread @ m.T), bread, undo, score, n, dfr, phi, deviance=before,
               clusters={c: f"e{i + 2}" for i, c in enumerate(cluster)})
