"""Model formulas, design columns and model frames.

A model frame is the DataFrame of distinct regressor values with the sums a fit needs
(rows, weights, weighted response and its square). Regressors of panel models are mostly
flags, factors and scores, so one aggregate shrinks any number of rows to a small frame;
with continuous regressors the rows pass through as they are.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage


def _split(text: str, sep: str) -> list[str]:
    """Split outside parentheses."""
    parts, depth, last = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == sep and depth == 0:
            parts.append(text[last:i])
            last = i + 1
    return [p.strip() for p in [*parts, text[last:]]]


def _expand(text: str) -> list[tuple[str, ...]]:
    """Terms of a right-hand side as tuples of variables: ``a*b`` is ``a + b + a:b``."""
    terms: list[tuple[str, ...]] = []
    for piece in _split(text, "+"):
        crossed = _split(piece, "*")
        sides = []
        for part in crossed:
            if part.startswith("(") and part.endswith(")"):
                sides.append(_expand(part[1:-1]))
            else:
                sides.append([tuple(_split(part, ":"))])
        for r in range(1, len(sides) + 1):
            for chosen in itertools.combinations(sides, r):
                for combo in itertools.product(*chosen):
                    merged = tuple(dict.fromkeys(v for term in combo for v in term))
                    if not any(set(merged) == set(t) for t in terms):
                        terms.append(merged)
    return terms


@dataclass
class Formula:
    """``y ~ a + b*c + factor(d) + I(a*c)``; ``0`` drops the intercept."""

    text: str
    response: str = ""
    terms: list[tuple[str, ...]] = field(default_factory=list)
    intercept: bool = True

    def __post_init__(self) -> None:
        left, right = self.text.split("~")
        self.response = left.strip()
        found = _expand(right.strip())
        self.intercept = ("0",) not in found
        found = [t for t in found if t not in (("0",), ("1",))]
        self.terms = sorted(found, key=len)

    def without(self, variable: str) -> str | None:
        """The formula less a variable that stands only for itself; None if products use it."""
        if (variable,) not in self.terms or any(variable in t and len(t) > 1 for t in self.terms):
            return None
        rest = [":".join(t) for t in self.terms if t != (variable,)]
        return f"{self.response} ~ " + " + ".join(["1" if self.intercept else "0", *rest])

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(v for t in self.terms for v in t))


def variable_column(df: DataFrame, variable: str, instead: Mapping[str, str] | None = None) -> tuple[Column, bool]:
    """Spark column of a formula variable and whether the name forces a factor.

    ``I(...)`` is an arithmetic SQL expression in which logical columns count as 0 and 1; ``instead`` puts SQL in the place of columns there.
    """
    m = re.fullmatch(r"(?:as\.)?factor\((.+)\)", variable)
    if m:
        return F.col(m.group(1)), True
    m = re.fullmatch(r"I\((.+)\)", variable)
    if m:
        names = sorted(df.columns, key=len, reverse=True)
        body = re.sub(r"(\w+)\s*\^\s*(\d+)", r"power(\1, \2)", m.group(1))
        put = instead or {}
        body = re.sub(r"\b(" + "|".join(map(re.escape, names)) + r")\b", lambda m: f"cast({put.get(m[1], f'`{m[1]}`')} as double)", body)
        return F.expr(body), False
    return F.col(variable), False


def reads(variable: str, columns: Sequence[str]) -> set[str]:
    """Columns that a formula variable is computed from."""
    m = re.fullmatch(r"(?:as\.)?factor\((.+)\)", variable)
    if m:
        return {m.group(1)}
    m = re.fullmatch(r"I\((.+)\)", variable)
    if m:
        return set(re.findall(r"\w+", m.group(1))) & set(columns)
    return {variable}


@dataclass
class Design:
    """Columns of the design matrix and how to build them from a batch of the frame.

    Columns other than the intercept are shifted and scaled for the numerics; ``undo`` maps
    coefficients back. ``levels[v]`` is None for a number and the level order for a factor.
    """

    formula: Formula
    levels: dict[str, list | None]
    field_of: dict[str, str]
    center: dict[str, float]
    scale: dict[str, float]
    intercept: bool = True

    def __post_init__(self) -> None:
        terms = self.formula.terms
        known = {frozenset(t) for t in terms}
        if self.intercept:
            known.add(frozenset())
        self.blocks: list[list[tuple[str, list | None]]] = []
        self.names: list[str] = ["(Intercept)"] if self.intercept else []
        self.parts: list[tuple[tuple[str, object], ...]] = [()] if self.intercept else []
        first_full = not self.intercept
        for t in terms:
            block = []
            for v in t:
                lv = self.levels[v]
                if lv is not None:
                    reduced = frozenset(t) - {v} in known
                    if not reduced and len(t) == 1 and first_full:
                        first_full = False
                    elif not self.intercept and len(t) == 1:
                        reduced = True
                    lv = lv[1:] if reduced else lv
                block.append((v, lv))
            self.blocks.append(block)
            choices = [[(v, None)] if lv is None else [(v, x) for x in lv] for v, lv in block]
            for combo in itertools.product(*reversed(choices)):
                combo = tuple(reversed(combo))
                self.parts.append(combo)
                self.names.append(":".join(_label(v, x) for v, x in combo))
        self.k = len(self.names)
        self.shift = np.zeros(self.k)
        self.unit = np.ones(self.k)
        for j, combo in enumerate(self.parts):
            numeric = [v for v, x in combo if x is None and self.levels[v] is None]
            if not numeric:
                continue
            self.unit[j] = float(np.prod([self.scale[v] for v in numeric]))
            if self.intercept and len(numeric) == len(combo) == 1:
                self.shift[j] = self.center[numeric[0]]

    def undo(self) -> np.ndarray:
        """Matrix that turns coefficients of the shifted columns into those of the plain ones."""
        m = np.diag(1.0 / self.unit)
        if self.intercept:
            m[0] -= self.shift / self.unit
            m[0, 0] = 1.0
        return m

    def _variable(self, pdf: pd.DataFrame, v: str, lv: list | None, fixed: Mapping) -> np.ndarray:
        if self.levels[v] is None:
            x = fixed[v] if v in fixed else pdf[self.field_of[v]].to_numpy(dtype=float)
            return np.broadcast_to(np.asarray(x, dtype=float), (len(pdf),))[:, None]
        x = np.full(len(pdf), fixed[v], dtype=object) if v in fixed else pdf[self.field_of[v]].to_numpy(dtype=object)
        return np.column_stack([(x == level).astype(float) for level in lv]) if lv else np.zeros((len(pdf), 0))

    def matrix(self, pdf: pd.DataFrame, fixed: Mapping | None = None, plain: bool = False,
               without: Sequence[str] = ()) -> np.ndarray:
        """Design rows of a batch; ``fixed`` overrides variables with one value.

        Variables in ``without`` are left out of every product; :meth:`constants` gives their part.
        """
        fixed = fixed or {}
        out = [np.ones((len(pdf), 1))] if self.intercept else []
        for block in self.blocks:
            cur = None
            for v, lv in block:
                if v in without:
                    x = np.ones((len(pdf), 1 if lv is None else len(lv)))
                else:
                    x = self._variable(pdf, v, lv, fixed)
                cur = x if cur is None else (x[:, :, None] * cur[:, None, :]).reshape(len(pdf), -1)
            out.append(cur)
        x = np.hstack(out) if out else np.zeros((len(pdf), 0))
        return x if plain else (x - self.shift) / self.unit

    def check(self, point: Mapping) -> None:
        """Refuse values that a factor doesn't have."""
        for v, x in point.items():
            if self.levels.get(v) is not None and x not in self.levels[v]:
                raise ValueError(f"{v} has no level {x!r}")

    def constants(self, point: Mapping) -> np.ndarray:
        """What the set variables contribute to each column at a grid point."""
        self.check(point)
        out = np.ones(len(self.parts))
        for j, combo in enumerate(self.parts):
            for v, level in combo:
                if v in point:
                    out[j] *= float(point[v]) if self.levels[v] is None else float(point[v] == level)
        return out

    def columns(self, df: DataFrame) -> list[Column]:
        """The plain design columns as Spark expressions."""
        out = []
        for combo in self.parts:
            c = F.lit(1.0)
            for v, level in combo:
                x, _ = variable_column(df, v)
                if self.levels[v] is None:
                    c = c * x.cast("double")
                else:
                    c = c * (x == F.lit(level)).cast("double")
            out.append(c)
        return out


def _label(v: str, x) -> str:
    if x is None:
        return v
    return f"{v}{str(x).upper() if isinstance(x, (bool, np.bool_)) else x}"


@dataclass
class ModelFrame:
    """Complete cases of a formula's variables, with the sums per distinct row.

    Fields: one per variable, ``__n`` rows, ``__w`` weight, ``__lw`` sum of log weights, ``__wy``, ``__wyy`` and
    ``__wyl`` weighted sums of y, y squared and y ln y, and the extra key columns (clusters, groups). Rows of weight 0
    say nothing and are left out.
    """

    df: DataFrame
    design: Design
    extra: list[str]
    staged: bool
    response_field: str | None = None


def _ylogy() -> Column:
    """Weighted y ln y, which a count model's deviance needs beside the fitted part."""
    return F.when(F.col("__y") > 0, F.col("__w") * F.col("__y") * F.ln("__y")).otherwise(F.lit(0.0))


#: Levels that a factor may have as columns of its own.
MAX_LEVELS = 5000


class TooManyLevels(ValueError):
    """A factor whose levels would be too many columns; ``variable`` names it."""

    def __init__(self, variable: str, count: int):
        super().__init__(f"{variable} has about {count} levels, too many for a column each")
        self.variable = variable

_NUMBERS = ("double", "float", "integer", "long", "short", "byte")


def model_frame(df: DataFrame, formula: str | Formula, weights: str | None = None,
                extra: Sequence[str] = (), levels: Mapping[str, Sequence] | None = None,
                compress: bool | None = None, keep_response: bool = False,
                iterative: bool = False) -> ModelFrame:
    """Build the frame of a model.

    ``compress`` groups equal rows; by default whenever no regressor is a fractional number.
    ``levels`` states level orders (the first is the baseline); others are sorted.
    """
    f = Formula(formula) if isinstance(formula, str) else formula
    levels = dict(levels or {})
    field_of = {v: f"x{i}" for i, v in enumerate(f.variables)}
    forced = set()
    cols = []
    for v in f.variables:
        c, is_factor = variable_column(df, v)
        if is_factor or v in levels:
            forced.add(v)
        cols.append(c.alias(field_of[v]))
    y, _ = variable_column(df, f.response)
    extra_fields = {e: f"e{i}" for i, e in enumerate(extra)}
    w = F.col(weights).cast("double") if weights else F.lit(1.0)
    y = y.alias("__y") if keep_response else y.cast("double").alias("__y")
    # cluster columns are read under their own names, so they may also be regressors
    frame = df.select(*cols, y, w.alias("__w"), *[F.col(e).alias(x) for e, x in extra_fields.items()])
    need = [field_of[v] for v in f.variables] + ["__y", "__w"]
    frame = frame.dropna(subset=need)
    if weights:
        frame = frame.where("__w <> 0")
    log_weight = F.ln("__w") if weights else F.lit(0.0)
    types = {v: frame.schema[field_of[v]].dataType.typeName() for v in f.variables}
    is_factor = {v: v in forced or types[v] not in _NUMBERS for v in f.variables}
    frame = frame.withColumns({field_of[v]: F.col(field_of[v]).cast("double")
                               for v in f.variables if not is_factor[v]} or {"__w": F.col("__w")})
    if compress is None:
        compress = all(is_factor[v] or types[v] not in ("double", "float") for v in f.variables)
    keys = [field_of[v] for v in f.variables] + list(extra_fields.values()) + (["__y"] if keep_response else [])
    yy = [] if keep_response else [
        F.sum(F.col("__w") * F.col("__y")).alias("__wy"),
        F.sum(F.col("__w") * F.col("__y") * F.col("__y")).alias("__wyy"),
        F.sum(_ylogy()).alias("__wyl")]
    if compress and keys:
        frame = frame.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("__n"), F.sum(log_weight).alias("__lw"),
                                         F.sum("__w").alias("__w2"), *yy).withColumnRenamed("__w2", "__w")
    else:
        frame = frame.withColumns({"__n": F.lit(1.0), "__lw": log_weight})
        if not keep_response:
            frame = frame.withColumns({"__wy": F.col("__w") * F.col("__y"),
                                       "__wyy": F.col("__w") * F.col("__y") * F.col("__y"),
                                       "__wyl": _ylogy()}).drop("__y")
    staged = bool(compress) or iterative
    if staged:
        frame = stage(frame)
    found = _describe(frame, f.variables, field_of, is_factor, levels)
    design = Design(f, found["levels"], field_of, found["center"], found["scale"], f.intercept)
    return ModelFrame(frame, design, list(extra_fields.values()), staged,
                      "__y" if keep_response else None)


def _describe(frame: DataFrame, variables: Sequence[str], field_of: Mapping[str, str],
              is_factor: Mapping[str, bool], levels: Mapping[str, Sequence]) -> dict:
    """Mean and spread of the numbers and levels of the factors.

    Levels become columns, so they are counted by a sketch before any set of them is gathered.
    """
    aggs = []
    open_factors = [v for v in variables if is_factor[v] and v not in levels]
    for v in variables:
        c = field_of[v]
        if v in open_factors:
            aggs.append(F.approx_count_distinct(c).alias(c))
        elif not is_factor[v]:
            aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = frame.agg(*aggs).first().asDict() if aggs else {}
    for v in open_factors:
        if row[field_of[v]] > MAX_LEVELS:
            raise TooManyLevels(v, row[field_of[v]])
    if open_factors:
        sets = [F.sort_array(F.collect_set(field_of[v])).alias(field_of[v]) for v in open_factors]
        row.update(frame.agg(*sets).first().asDict())
    out: dict = {"levels": {}, "center": {}, "scale": {}}
    for v in variables:
        c = field_of[v]
        if is_factor[v]:
            out["levels"][v] = list(levels[v]) if v in levels else list(row[c])
        else:
            out["levels"][v] = None
            out["center"][v] = float(row[f"m_{c}"] or 0.0)
            s = float(row[f"s_{c}"] or 0.0)
            out["scale"][v] = s if s > 0 else 1.0
    return out


def local_design(pdf: pd.DataFrame, formula: str, factors: Sequence[str],
                 levels: Mapping[str, Sequence] | None = None) -> Design:
    """Design of one small panel that a task already holds; columns are read by name."""
    f = Formula(formula)
    levels = dict(levels or {})
    lv: dict[str, list | None] = {}
    center, scale = {}, {}
    for v in f.variables:
        if v in factors:
            lv[v] = list(levels.get(v, sorted(pd.unique(pdf[v]))))
        else:
            lv[v] = None
            x = pdf[v].to_numpy(dtype=float)
            center[v] = float(x.mean()) if len(x) else 0.0
            s = float(x.std()) if len(x) else 0.0
            scale[v] = s if s > 0 else 1.0
    return Design(f, lv, {v: v for v in f.variables}, center, scale, f.intercept)
