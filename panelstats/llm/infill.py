"""Fill-in-the-middle: a text is cut after two counts of units and its pieces are put into another order.

A unit is a run of letters A to Z of either case, or any other single code point. Tasks lay the UTF-8 bytes of a batch of texts into blocks of ``BLOCK`` bytes. A Fenwick
tree per text, all trees of the batch side by side in one array, stores how many units start in the blocks and how many code points; it is built level by level. A cut after c units
lies where unit c + 1 starts: the descent by halving steps finds that unit's block, and only this block is looked through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_arrow, slices, utf8

#: Bytes of a block.
BLOCK = 256
#: Texts whose cut blocks are looked through at once.
ROWS = 4096
#: Marks before prefix, suffix and middle. A text that holds one of them stays plain.
MARKS = ("<P>", "<S>", "<M>")
ADDED = ("n", "form", "prefix_chars", "middle_chars", "infill")


def draws(id_col: str, seed: int | str = 1) -> list[Column]:
    """Four numbers below 2^32 from the id: the first groups of eight digits of sha256 of ``seed:id``. A null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


class Trees:
    """Fenwick trees over the blocks of many texts: column 0 counts units, column 1 code points."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        """``data``: bytes of all texts; ``bounds``: n + 1 places where texts begin and end."""
        lengths = np.diff(bounds)
        self.bounds, self.blocks = bounds, -(-lengths // BLOCK)
        letter = ((data | np.uint8(32)) - np.uint8(97)) < 26
        follows = np.zeros(len(data), bool)
        follows[1:] = letter[:-1]
        follows[bounds[:-1][lengths > 0]] = False
        self.points = (data & np.uint8(0xC0)) != 0x80
        self.units = self.points & ~(letter & follows)
        self.first = np.cumsum(self.blocks) - self.blocks
        total = int(self.blocks.sum())
        own = np.repeat(np.arange(len(lengths)), self.blocks)
        number = np.arange(total) - self.first[own] + 1
        starts = bounds[own] + (number - 1) * BLOCK
        self.tree = np.zeros((total, 2), np.int64)
        if total:
            self.tree[:, 0] = np.add.reduceat(self.units, starts, dtype=np.int64)
            self.tree[:, 1] = np.add.reduceat(self.points, starts, dtype=np.int64)
        step, low, most = 1, number & -number, int(self.blocks.max(initial=0))
        while step <= most:  # a node is whole once all nodes of smaller steps have been added
            at = np.flatnonzero((low == step) & (number + step <= self.blocks[own]))
            self.tree[at + step] += self.tree[at]
            step *= 2
        self.steps = [1 << k for k in reversed(range(most.bit_length()))]

    def totals(self) -> np.ndarray:
        """Units and code points of each text."""
        found, left = np.zeros((len(self.blocks), 2), np.int64), self.blocks.copy()
        while left.any():
            at = np.flatnonzero(left)
            found[at] += self.tree[self.first[at] + left[at] - 1]
            left[at] -= left[at] & -left[at]
        return found

    def cut(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte place in the data, code points before it in the text) of the cut after so many units of each text."""
        block, before = np.zeros(len(units), np.int64), np.zeros((len(units), 2), np.int64)
        for step in self.steps:
            at = np.flatnonzero(block + step <= self.blocks)
            node = self.tree[self.first[at] + block[at] + step - 1]
            fits = before[at, 0] + node[:, 0] <= units[at]
            block[at[fits]] += step
            before[at[fits]] += node[fits]
        place, chars = self.bounds[:-1] + np.minimum(block * BLOCK, np.diff(self.bounds)), before[:, 1].copy()
        inside = np.flatnonzero(block < self.blocks)
        for k in range(0, len(inside), ROWS):
            at = inside[k:k + ROWS]
            where = place[at, None] + np.arange(BLOCK)
            real = where < self.bounds[at + 1, None]
            where[~real] = 0
            seen = np.cumsum(self.units[where] & real, 1, dtype=np.int16)
            offset = (seen > (units[at] - before[at, 0])[:, None]).argmax(1)
            chars[at] += (self.points[where] & real & (np.arange(BLOCK) < offset[:, None])).sum(1)
            place[at] += offset
        return place, chars


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int | str = 1, rate: int = 90, spm: int = 20,
              marks: tuple[str, str, str] = MARKS, names: tuple[str, ...] = ADDED) -> DataFrame:
    """All rows and columns of ``docs`` with n (units), form, prefix_chars, middle_chars and the new text.

    ``rate`` percent of the texts are cut, ``spm`` percent of these as suffix-prefix-middle and the others as prefix-suffix-middle; both cuts and the form follow from the id alone, so
    repeated rows get equal results and another ``seed`` gives other cuts. Null text counts as empty. Empty texts and texts that hold a mark are ``plain``: unchanged, and prefix_chars and middle_chars are null.
    Columns of the added names are replaced.
    """
    docs = docs.drop(*names)
    own, at = docs.columns, docs.columns.index(text_col)
    p, s, m = (x.encode() for x in marks)
    drawn = docs.select("*", F.array(*draws(id_col, seed)).alias("".join(own) + "_draws"))

    def rewrite(batches):
        for batch in slices(batches, drawn_columns[at]):
            texts = utf8(batch.column(at))
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
            raw = texts.buffers()[2]
            data = np.frombuffer(raw, np.uint8)[ends[0]:ends[-1]] if raw is not None else np.zeros(0, np.uint8)
            bounds = ends - ends[0]
            trees = Trees(data, bounds)
            n = trees.totals()[:, 0]
            h = batch.column(len(own)).flatten().to_numpy().reshape(-1, 4)
            one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
            (a, a_chars), (b, b_chars) = trees.cut(np.minimum(one, two)), trees.cut(np.maximum(one, two))
            view, forms, out = memoryview(data), [], []
            for k in range(len(texts)):
                x, y = int(bounds[k]), int(bounds[k + 1])
                whole = bytes(view[x:y])
                if x == y or h[k, 2] % 100 >= rate or p in whole or s in whole or m in whole:
                    forms.append("plain")
                    out.append(whole)
                    continue
                i, j = int(a[k]) - x, int(b[k]) - x
                forms.append("spm" if h[k, 3] % 100 < spm else "psm")
                parts = (s, whole[j:], p, whole[:i], m, whole[i:j]) if forms[-1] == "spm" else (p, whole[:i], s, whole[j:], m, whole[i:j])
                out.append(b"".join(parts))
            plain = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(own)], pa.array(n), pa.array(forms, pa.string()), pa.array(a_chars, mask=plain), pa.array(b_chars - a_chars, mask=plain),
                 pa.array(out, pa.binary()).cast(pa.string())], names=[*own, *names])

    drawn_columns = drawn.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(drawn, rewrite, schema + ", `{}` bigint, `{}` string, `{}` bigint, `{}` bigint, `{}` string".format(*names))


def restored(form: str | Column = "form", infill: str | Column = "infill", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that a transformed one was made of, from it and its form alone.

    A cut text holds each mark once: its pieces hold none, and no mark arises where a piece meets a mark, as marks begin and end with different characters.
    """
    form, text = (F.col(c) if isinstance(c, str) else c for c in (form, infill))

    def between(first: str, then: str | None) -> Column:
        start = F.locate(first, text) + len(first)
        stop = F.locate(then, text) if then else F.char_length(text) + 1
        return F.substring(text, start, stop - start)

    p, s, m = marks
    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)
