"""Systems over the levels of two crossed factors that no machine holds.

Factor a is taken out level by level: with ``c = 1 / (size + 1 / ratio)`` per level, the levels of b are tied by ``K = diag(sizes of b) - N' diag(c) N``, N being the counts of the cells. K is never
formed. A product with it is two aggregates over the cells, and conjugate gradients solve ``(K + 1 / ratio of b) u = h`` for many right-hand sides at once, one column each. The vectors
are DataFrames with a row per level; the driver sees inner products only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.joins import rjoin
from ..session import stage_table as stage  # a checkpoint would carry the constraints of all steps before

#: Steps of the conjugate gradients, and the residual at which a column is done, as a share of its first one.
STEPS, LEFT = 500, 1e-7


def _sums(df: DataFrame, pairs: list[tuple[Column, Column]]) -> np.ndarray:
    """Inner products of pairs of columns."""
    row = df.agg(*[F.sum(x * y).alias(f"v{i}") for i, (x, y) in enumerate(pairs)]).first()
    return np.array([v or 0.0 for v in row], dtype=float)


@dataclass
class Moments:
    """What the likelihood's slope and average information need at one point."""

    a: np.ndarray
    ratios: np.ndarray
    #: y'P y, y'P V_i P y, trace of P V_i, y'P V_i P V_j P y.
    rss: float
    squares: np.ndarray
    traces: np.ndarray
    curvature: np.ndarray

    def score(self, df: int) -> np.ndarray:
        """Slope of the criterion in both ratios."""
        return self.traces - df * self.squares / self.rss

    def information(self, df: int) -> np.ndarray:
        """Average of the observed and the expected curvature."""
        return df * self.curvature / self.rss - df * np.outer(self.squares, self.squares) / self.rss**2


class Crossed:
    """Cells of two factors: columns ``big``, ``small``, ``size`` and sums ``cols`` of the regressors and, last, the response."""

    def __init__(self, cells: DataFrame, big: str, small: str, cols: list[str], probes: int = 0):
        self.cells = stage(cells.select(F.col(big).alias("a"), F.col(small).alias("b"), "size", *cols))
        self.cols = cols
        own = [F.sum(c).alias(c) for c in ["size", *cols]]
        self.side_a = stage(self.cells.groupBy("a").agg(*own))
        self.side_b = self.cells.groupBy("b").agg(*own)
        self.levels = self.side_b.count()
        few = 0 < self.levels <= probes
        if few:  # every level is a probe: traces are exact
            names = [r.b for r in self.side_b.select("b").orderBy("b").collect()]
            made = [F.col("b").eqNullSafe(F.lit(v)).cast("double") for v in names]
        else:
            made = [F.when(F.xxhash64("b", F.lit(i)) % 2 == 0, 1.0).otherwise(-1.0) for i in range(probes)]
        self.weight = 1.0 if few else 1.0 / max(1, probes)
        self.probes = [f"z{i}" for i in range(len(made))]
        self.side_b = stage(self.side_b.select("*", *[m.alias(z) for m, z in zip(made, self.probes)]))

    def tie(self, vectors: DataFrame, names: list[str], scale: Column) -> DataFrame:
        """``N' diag(scale) N`` times columns of b's levels."""
        across = self.to_a(vectors, names).withColumns({n: F.col(n) * scale for n in names})
        return self.to_b(across, names)

    def to_a(self, vectors: DataFrame, names: list[str]) -> DataFrame:
        """``N`` times columns of b's levels, with the sizes of a's."""
        sums = rjoin(self.cells.select("a", "b", "size"), vectors.select("b", *names), ["b"]).groupBy("a").agg(*[F.sum(F.col("size") * F.col(n)).alias(n) for n in names])
        return rjoin(sums, self.side_a.select("a", F.col("size").alias("all")), ["a"])

    def to_b(self, vectors: DataFrame, names: list[str]) -> DataFrame:
        """``N'`` times columns of a's levels."""
        return rjoin(self.cells.select("a", "b", "size"), vectors.select("a", *names), ["a"]).groupBy("b").agg(*[F.sum(F.col("size") * F.col(n)).alias(n) for n in names])

    def solve(self, right: DataFrame, names: list[str], ratios: np.ndarray, noise: np.ndarray | float = 0.0) -> DataFrame:
        """Columns ``names`` of ``right`` (one row per level of b) replaced by the solutions of ``(K + 1 / ratio) u = h``.

        Without a ratio (infinite) K may be singular; ``right`` must then lie in its range, as sums over cells do. Squared residuals up to ``noise`` count as zero.
        """
        c = 1.0 / (F.col("all") + 1.0 / float(ratios[0]))
        own = rjoin(self.cells.select("a", "b", "size"), self.side_a.select("a", F.col("size").alias("all")), ["a"]).groupBy("b").agg(
            F.sum("size").alias("size_b"), F.sum(F.col("size") ** 2 * c).alias("tied"))
        d = F.col("size_b") + 1.0 / float(ratios[1])
        diagonal = own.select("b", d.alias("d"), F.greatest(d - F.col("tied"), 1e-10 * d).alias("pre"))
        state = stage(rjoin(right.select("b", *[F.col(n).cast("double").alias(f"r_{n}") for n in names]), diagonal, ["b"]).select(
            "*", *[F.lit(0.0).alias(f"x_{n}") for n in names], *[(F.col(f"r_{n}") / F.col("pre")).alias(f"p_{n}") for n in names]))
        first = None
        for _ in range(STEPS):
            moved = self.tie(state.select("b", *[F.col(f"p_{n}").alias(n) for n in names]), names, c)
            table = stage(rjoin(state, moved.select("b", *[F.col(n).alias(f"t_{n}") for n in names]), ["b"]).withColumns(
                {f"t_{n}": F.col("d") * F.col(f"p_{n}") - F.col(f"t_{n}") for n in names}))
            r, p, t, pre = *([F.col(f"{k}_{n}") for n in names] for k in "rpt"), F.col("pre")
            left, bend, along, slope, square = _sums(table, [
                *[(x, x / pre) for x in r], *zip(p, t), *zip(p, r), *[(x, y / pre) for x, y in zip(r, t)], *[(y, y / pre) for y in t]]).reshape(5, -1)
            first = left if first is None else first
            live = (left > np.maximum(LEFT**2 * first, noise)) & (bend > 0)
            if not live.any():
                return table.select("b", *[F.col(f"x_{n}").alias(n) for n in names])
            alpha = np.where(live, along / np.where(live, bend, 1.0), 0.0)
            beta = np.where(live, (alpha * square - slope) / np.where(live, bend, 1.0), 0.0)  # the next direction is conjugate to this one
            state = table.withColumns({**{f"x_{n}": F.col(f"x_{n}") + float(s) * F.col(f"p_{n}") for n, s in zip(names, alpha)},
                                       **{f"r_{n}": F.col(f"r_{n}") - float(s) * F.col(f"t_{n}") for n, s in zip(names, alpha)}})
            state = state.withColumns({f"p_{n}": F.col(f"r_{n}") / F.col("pre") + float(s) * F.col(f"p_{n}") for n, s in zip(names, beta)}).drop(*[f"t_{n}" for n in names])
        raise RuntimeError("the conjugate gradients did not converge")

    def moments(self, cross: np.ndarray, ratios: np.ndarray) -> Moments:
        """Cross products weighted by the inverse variance at the ratios, and all that follows from them."""
        cols, probes = self.cols, self.probes
        p, (ta, tb) = len(cols) - 1, (float(r) for r in ratios)
        c = 1.0 / (F.col("size") + 1.0 / ta)
        pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]

        def matrix(values):
            out = np.zeros((p + 1, p + 1))
            for (i, j), v in zip(pairs, values):
                out[i, j] = out[j, i] = v
            return out

        g = cross - matrix(_sums(self.side_a, [(F.col(cols[i]) * c, F.col(cols[j])) for i, j in pairs]))
        # h = Zb' W^-1 [X y], W being the residual and a's part of the variance
        shrunk = self.side_a.select("a", *[(F.col(s) * c).alias(s) for s in cols])
        taken = self.to_b(shrunk, cols).select("b", *[F.col(s).alias(f"t_{s}") for s in cols])
        h = stage(rjoin(self.side_b, taken, ["b"]).select("b", *[(F.col(s) - F.col(f"t_{s}")).alias(s) for s in cols], *probes))
        solved = stage(self.solve(h, [*cols, *probes], ratios).select("b", *[F.col(s).alias(f"u_{s}") for s in [*cols, *probes]]))
        both = stage(rjoin(h, solved, ["b"]))
        a = g - matrix(_sums(both, [(F.col(cols[i]), F.col(f"u_{cols[j]}")) for i, j in pairs]))
        beta = np.linalg.solve(a[:p, :p], a[:p, p])
        rss = float(a[p, p] - a[:p, p] @ beta)
        inverse = np.linalg.inv(a[:p, :p])

        # effects over their ratio: Zb' V^-1 M = u / tb, and Za' V^-1 M = (sums - N u) / (1 + ta size)
        u_b = both.select("b", *[(F.col(f"u_{s}") / tb).alias(s) for s in cols])
        across = self.to_a(solved, [f"u_{s}" for s in [*cols, *probes]])
        wide = stage(rjoin(rjoin(self.side_a, across.drop("all"), ["a"]), self.to_a(self.side_b, probes).drop("all"), ["a"]))
        damp = 1.0 / (1.0 + ta * F.col("size"))
        u_a = wide.select("a", "size", *[((F.col(s) - F.col(f"u_{s}")) * damp).alias(s) for s in cols])

        def residual(table, key):  # the column of the response less the fixed part: Z' P y
            fixed = sum((F.lit(float(b)) * F.col(s) for s, b in zip(cols, beta)), F.lit(0.0))
            return table.select(key, *[F.col(s) for s in cols], (F.col(cols[p]) - fixed).alias("e"))

        e_a, e_b = stage(residual(u_a, "a")), stage(residual(u_b, "b"))
        fixed_pairs = [(i, j) for i, j in pairs if j < p]

        def spread(table):
            """(|Z' P y|^2, trace of the fixed part's share)."""
            v = _sums(table, [(F.col("e"), F.col("e")), *[(F.col(cols[i]), F.col(cols[j])) for i, j in fixed_pairs]])
            m = np.zeros((p, p))
            for (i, j), x in zip(fixed_pairs, v[1:]):
                m[i, j] = m[j, i] = x
            return v[0], float((inverse * m).sum())

        (sq_a, less_a), (sq_b, less_b) = spread(e_a), spread(e_b)
        inner = _sums(both, [(F.col(z), F.col(f"u_{z}")) for z in probes]).sum() * self.weight  # trace of (K + 1 / tb)^-1
        trace_b = (self.levels - inner / tb) / tb - less_b
        gone = _sums(wide, [(F.col(f"u_{z}") * damp, F.col(z) * damp) for z in probes]).sum() * self.weight
        plain = float(wide.agg(F.sum(F.col("size") * damp)).first()[0])
        trace_a = plain - gone - less_a

        # V^-1 Z_i Z_i' P y for both factors, from their sums over cells
        first = e_a.select("a", F.col("e").alias("w0"))
        # right-hand sides Zb' W^-1 Z_i e_i
        right_a = self.to_b(rjoin(first, self.side_a.select("a", "size"), ["a"]).select("a", (F.col("w0") * damp).alias("w0")), ["w0"])
        second = e_b.select("b", F.col("e").alias("w1"))
        ca = 1.0 / (F.col("all") + 1.0 / ta)
        tied = self.tie(second, ["w1"], ca).select("b", F.col("w1").alias("t"))
        right_b = rjoin(rjoin(second, tied, ["b"]), self.side_b.select("b", "size"), ["b"]).select("b", (F.col("size") * F.col("w1") - F.col("t")).alias("w1"))
        more = stage(rjoin(right_a, right_b, ["b"]))
        out = stage(self.solve(more, ["w0", "w1"], ratios).select("b", F.col("w0").alias("v0"), F.col("w1").alias("v1")))
        # quadratic forms (Z_i e_i)' V^-1 (Z_j e_j) = (Z_i e_i)' W^-1 (Z_j e_j) - right_i' out_j
        pulled = rjoin(first, self.side_a.select("a", "size"), ["a"])
        w00 = float(pulled.agg(F.sum(F.col("w0") ** 2 * F.col("size") * damp)).first()[0])
        ends = stage(rjoin(rjoin(more, out, ["b"]), second.select("b", F.col("w1").alias("e1")), ["b"]))
        q00, q01, q11, w01, w11 = _sums(ends, [(F.col("w0"), F.col("v0")), (F.col("w0"), F.col("v1")), (F.col("w1"), F.col("v1")), (F.col("w0"), F.col("e1")), (F.col("w1"), F.col("e1"))])
        v_inverse = np.array([[w00 - q00, w01 - q01], [w01 - q01, w11 - q11]])
        # P instead of V^-1: less the part that the fixed columns explain, X' V^-1 Z_i e_i = (Z_i' V^-1 X)' e_i
        pull = np.stack([_sums(e_a, [(F.col(s), F.col("e")) for s in cols[:p]]), _sums(e_b, [(F.col(s), F.col("e")) for s in cols[:p]])]) if p else np.zeros((2, 0))
        curvature = v_inverse - pull @ inverse @ pull.T
        return Moments(a, np.array([ta, tb]), rss, np.array([sq_a, sq_b]), np.array([trace_a, trace_b]), curvature)
