"""Design-based estimation from weights and primary sampling units.

For a domain d with weights w, PSU g and G PSUs in the whole design,
``z_g = sum w (x - m) / sum w`` and ``Var(mean) = G/(G-1) * sum z_g^2``. Squares expand into
sums over PSU totals, so each estimate takes one aggregate by PSU and domain and one by
domain; rows are never revisited with the mean.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import centers
from ..models.dist import t_quantile
from .joins import attach, rjoin


class SurveyDesign:
    """Rows, a weight column and optionally a PSU column (each row is its own PSU without one)."""

    def __init__(self, df: DataFrame, w: str, psu: str | None = None, n_psu: int | None = None):
        self.df, self.w, self.psu = df, w, psu
        if n_psu is not None:
            self.n_psu = n_psu

    @cached_property
    def n_psu(self) -> int:
        """PSUs of the whole design, including those outside any domain."""
        if self.psu is None:
            return self.df.count()
        return self.df.select(self.psu).distinct().count()

    def mutate(self, **cols: Column) -> "SurveyDesign":
        """Derived columns; the design keeps its PSU count."""
        out = SurveyDesign(self.df.withColumns(cols), self.w, self.psu)
        if "n_psu" in self.__dict__:
            out.__dict__["n_psu"] = self.n_psu
        return out

    def domain(self, cond: Column) -> "SurveyDesign":
        """Restrict to a domain; PSUs outside still count."""
        out = SurveyDesign(self.df.where(cond), self.w, self.psu)
        out.__dict__["n_psu"] = self.n_psu
        return out

    def _scale(self) -> Column:
        g = float(self.n_psu)
        return F.lit(g / (g - 1.0)) if g > 1 else F.lit(None).cast("double")

    def _spread(self, out: DataFrame, name: str, est: Column, var: Column,
                vartype: Sequence[str], level: float) -> DataFrame:
        se = F.sqrt(F.greatest(var, F.lit(0.0)))
        cols = {name: est}
        if "se" in vartype:
            cols[f"{name}_se"] = se
        if "var" in vartype:
            cols[f"{name}_var"] = F.greatest(var, F.lit(0.0))
        if "ci" in vartype:
            t = t_quantile(0.5 + level / 2.0, self.n_psu - 1)
            cols[f"{name}_low"] = est - t * se
            cols[f"{name}_upp"] = est + t * se
        return out.withColumns(cols)

    def mean_long(self, cols: Sequence[str], by: Sequence[str] = (), vartype: Sequence[str] = ("se",),
                  level: float = 0.95, center: Mapping[str, float] | None = None) -> DataFrame:
        """Domain means of many columns as ``by, variable, mean, mean_se``; nulls drop per column.

        ``center`` names an offset to take off a column before squaring, so that a large level does not drown the spread;
        by default each column's own mean.
        """
        own = [c for c in cols if c not in (center or {})]
        offset = {c: F.lit(float(v)) for c, v in (center or {}).items()} | dict(zip(own, centers(self.df, *own) if own else []))
        w = F.col(self.w).cast("double")
        aggs: list[Column] = []
        for i, c in enumerate(cols):
            x = F.col(c).cast("double") - offset[c]
            ww = F.when(x.isNotNull(), w)
            if self.psu is None:
                aggs += [F.sum(ww).alias(f"a{i}"), F.sum(w * x).alias(f"b{i}"),
                         F.sum(ww * ww).alias(f"aa{i}"), F.sum(w * w * x).alias(f"ab{i}"),
                         F.sum(w * w * x * x).alias(f"bb{i}")]
            else:
                aggs += [F.sum(ww).alias(f"a{i}"), F.sum(w * x).alias(f"b{i}")]
        if self.psu is None:
            sums = self.df.groupBy(*by).agg(*aggs)
        else:
            per_psu = self.df.groupBy(*by, self.psu).agg(*aggs)
            second: list[Column] = []
            for i in range(len(cols)):
                a, b = F.col(f"a{i}"), F.col(f"b{i}")
                second += [F.sum(a).alias(f"a{i}"), F.sum(b).alias(f"b{i}"), F.sum(a * a).alias(f"aa{i}"),
                           F.sum(a * b).alias(f"ab{i}"), F.sum(b * b).alias(f"bb{i}")]
            sums = per_psu.groupBy(*by).agg(*second)
        rows = F.array(*[F.struct(F.lit(c).alias("variable"), offset[c].alias("__c"),
                                  *[F.col(f"{k}{i}").alias(f"__{k}") for k in ("a", "b", "aa", "ab", "bb")])
                         for i, c in enumerate(cols)])
        long = sums.select(*by, F.inline(rows))
        m = F.try_divide(F.col("__b"), F.col("__a"))
        ss = F.col("__bb") - 2.0 * m * F.col("__ab") + m * m * F.col("__aa")
        var = self._scale() * F.try_divide(ss, F.col("__a") * F.col("__a"))
        out = self._spread(long, "mean", m + F.col("__c"), var, vartype, level)
        return out.drop("__c", "__a", "__b", "__aa", "__ab", "__bb")

    def mean(self, cols: Sequence[str] | str, by: Sequence[str] = (), vartype: Sequence[str] = ("se",),
             level: float = 0.95) -> DataFrame:
        """Domain means in wide form: ``x, x_se`` for each column."""
        cols = [cols] if isinstance(cols, str) else list(cols)
        long = self.mean_long(cols, by, vartype, level)
        tails = [c[len("mean"):] for c in long.columns if c.startswith("mean")]
        return long.groupBy(*by).agg(*[
            F.max(F.when(F.col("variable") == F.lit(c), F.col(f"mean{t}"))).alias(f"{c}{t}")
            for c in cols for t in tails])

    def total(self, by: Sequence[str] = (), x: str | None = None, vartype: Sequence[str] = ("ci",),
              level: float = 0.95, out: str = "n") -> DataFrame:
        """Domain totals of the weights, or of weight times ``x``; PSUs without rows count as 0."""
        v = F.col(self.w).cast("double")
        if x is not None:
            v = v * F.col(x).cast("double")
        if self.psu is None:
            sums = self.df.groupBy(*by).agg(F.sum(v).alias("__t"), F.sum(v * v).alias("__tt"))
        else:
            per_psu = self.df.groupBy(*by, self.psu).agg(F.sum(v).alias("__g"))
            sums = per_psu.groupBy(*by).agg(F.sum("__g").alias("__t"),
                                            F.sum(F.col("__g") * F.col("__g")).alias("__tt"))
        t = F.col("__t")
        var = self._scale() * (F.col("__tt") - t * t / F.lit(float(self.n_psu)))
        return self._spread(sums, out, t, var, vartype, level).drop("__t", "__tt")

    def prop(self, of: str, by: Sequence[str] = (), vartype: Sequence[str] = ("ci",),
             level: float = 0.95, out: str = "coef", unweighted: str | None = None) -> DataFrame:
        """Share of each level of ``of`` within its group, symmetric interval.

        The share is the mean of an indicator: the PSU sums of the level, of the whole group and
        their product give its variance. ``unweighted`` adds the row count of the cell.
        """
        w = F.col(self.w).cast("double")
        count = F.count(F.lit(1))
        if self.psu is None:
            cells = self.df.groupBy(*by, of).agg(
                F.sum(w).alias("__l"), F.sum(w * w).alias("__ll"), count.alias("__n"))
            cells = cells.withColumn("__lg", F.col("__ll"))
            groups = cells.groupBy(*by).agg(F.sum("__l").alias("__g"), F.sum("__ll").alias("__gg"))
        else:
            per = self.df.groupBy(*by, self.psu, of).agg(F.sum(w).alias("__w"), count.alias("__c"))
            levels = F.collect_list(F.struct(F.col(of).alias(of), F.col("__w"), F.col("__c")))
            packed = per.groupBy(*by, self.psu).agg(F.sum("__w").alias("__pg"), levels.alias("__levels"))
            flat = packed.select(*by, "__pg", F.inline("__levels"))
            cells = flat.groupBy(*by, of).agg(
                F.sum("__w").alias("__l"), F.sum(F.col("__w") * F.col("__w")).alias("__ll"),
                F.sum(F.col("__w") * F.col("__pg")).alias("__lg"), F.sum("__c").alias("__n"))
            groups = packed.groupBy(*by).agg(F.sum("__pg").alias("__g"),
                                             F.sum(F.col("__pg") * F.col("__pg")).alias("__gg"))
        j = attach(cells, groups, by)
        p = F.try_divide(F.col("__l"), F.col("__g"))
        ss = F.col("__ll") - 2.0 * p * F.col("__lg") + p * p * F.col("__gg")
        var = self._scale() * F.try_divide(ss, F.col("__g") * F.col("__g"))
        res = self._spread(j, out, p, var, vartype, level)
        if unweighted:
            res = res.withColumnRenamed("__n", unweighted)
        return res.drop("__l", "__ll", "__lg", "__g", "__gg", "__n")

    def deviation(self, col: str, group: Sequence[str], by: Sequence[str] = (),
                  vartype: Sequence[str] = ("se",), level: float = 0.95) -> DataFrame:
        """Domain mean of the deviation from the weighted mean of the row's group."""
        x, w = F.col(col).cast("double"), F.col(self.w).cast("double")
        means = self.df.groupBy(*group).agg(
            F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w))).alias("__gm"))
        dev = rjoin(self.df, means, list(group)).withColumn(f"{col}_dev", x - F.col("__gm"))
        design = SurveyDesign(dev, self.w, self.psu)
        design.__dict__["n_psu"] = self.n_psu
        return design.mean(f"{col}_dev", by, vartype, level)


def clip_interval(df: DataFrame, low: str, floor: float = 0.0) -> DataFrame:
    """Lower interval ends below ``floor`` are raised to it."""
    return df.withColumn(low, F.when(F.col(low) < floor, F.lit(floor)).otherwise(F.col(low)))
