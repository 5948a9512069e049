"""Exact top-k by integer inner product, with an M-tree per shard.

As in any M-tree, pages hold up to ``PAGE`` entries; a routing entry has a covering radius, and every entry its distance to the routing object of its page. Search is best-first: pages
wait in a queue by the least distance that their radius allows, and the search ends when that exceeds the k-th best. Before a distance is computed, the
stored distance to the parent and the query's distance to it bound it by the triangle inequality; entries out of reach cost nothing.

Vectors are lifted to equal length by one more component, so that the largest inner product is the smallest distance. Distances only prune, with a margin above rounding;
scores are whole numbers, computed exactly.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame

from . import shards

PAGE = 512
SCALE = 256


class Page:
    """Entries with their distance to the page's routing object; ``children`` is None in a leaf."""

    __slots__ = ("own", "rows", "parent", "radius", "children")

    def __init__(self, own, rows, parent, radius=None, children=None):
        self.own, self.rows, self.parent, self.radius, self.children = own, rows, parent, radius, children


class Tree:
    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.k = k
        whole = np.floor(SCALE * rows)
        self.rows, self.bounds, self.ids = shards.unique_rows(ids, whole, k + 1)
        squares = (self.rows ** 2).sum(1)
        self.top = float(squares.max()) if len(squares) else 0.0
        self.lift = np.sqrt(np.maximum(self.top - squares, 0))
        self.full = np.column_stack([self.rows, self.lift])
        self.margin = 1e-6 * (1 + np.sqrt(self.top))
        self.rng = np.random.default_rng(len(rows))
        self.root = self.page(np.arange(len(self.rows)), None) if len(self.rows) else None

    def far(self, own: np.ndarray, row: int) -> np.ndarray:
        return np.sqrt(((self.full[own] - self.full[row]) ** 2).sum(1))

    def page(self, own: np.ndarray, routing: int | None) -> Page:
        """Bulk load: objects go to the nearest of a few routing objects, until a page holds them."""
        if len(own) <= PAGE:
            return Page(own, self.rows[own], self.far(own, routing) if routing is not None else None)
        heads = self.rng.choice(own, min(PAGE, max(2, -(-2 * len(own) // PAGE))), replace=False)
        squares = (self.full ** 2).sum(1)
        near = (squares[heads][None, :] - 2 * self.full[own] @ self.full[heads].T).argmin(1)
        groups = [(h, own[near == j]) for j, h in enumerate(heads) if (near == j).any()]
        if len(groups) == 1:  # all as near to one: cut by order
            groups = [(part[0], part) for part in np.array_split(own, 2)]
        routes = np.array([h for h, _ in groups])
        radius = np.array([self.far(part, h).max() for h, part in groups])
        return Page(routes, self.rows[routes], self.far(routes, routing) if routing is not None else None, radius, [self.page(part, h) for h, part in groups])

    def score(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Whole-number products; in doubles while these hold them exactly."""
        if self.exact:
            return rows @ query
        return np.array([sum(int(a) * int(b) for a, b in zip(row, query)) for row in rows], object)

    def find(self, ids: np.ndarray, queries: np.ndarray) -> list[list[tuple[float, int]]]:
        queries = np.floor(SCALE * queries)
        most = np.abs(self.rows).max(initial=0) * np.abs(queries).max(initial=0) * max(1, queries.shape[1])
        self.exact = most < 2 ** 53
        return [self.one(int(i), q) for i, q in zip(ids, queries)] if self.root else [[] for _ in ids]

    def one(self, me: int, query: np.ndarray) -> list[tuple[float, int]]:
        length = float(query @ query) + self.top
        found: list[tuple] = []  # heap of (score, -id), worst first
        limit = np.inf
        queue = [(0.0, 0, self.root, None)]
        turn = 0
        while queue:
            bound, _, page, parent = heapq.heappop(queue)
            if bound > limit:
                break
            own, rows, live = page.own, page.rows, None
            if parent is not None and limit < np.inf:
                near = np.abs(parent - page.parent) - (page.radius if page.children is not None else 0.0) <= limit
                if not near.all():
                    live = np.flatnonzero(near)
                    own, rows = own[live], rows[live]
            if not len(own):
                continue
            score = self.score(rows, query)
            if page.children is not None:
                away = np.sqrt(np.maximum(length - 2 * score.astype(float), 0))
                least = np.maximum(away - (page.radius if live is None else page.radius[live]), 0)
                for j in np.flatnonzero(least <= limit).tolist():
                    turn += 1
                    heapq.heappush(queue, (float(least[j]), turn, page.children[j if live is None else live[j]], float(away[j])))
                continue
            if len(found) < self.k and len(own) > 4 * self.k:  # only these can stay; one may be the query itself
                good = np.flatnonzero(score >= np.partition(score, -self.k - 1)[-self.k - 1])
                own, score = own[good], score[good]
            if len(found) == self.k:
                good = np.flatnonzero(score >= found[0][0])
                own, score = own[good], score[good]
            for row, s in zip(own.tolist(), score.tolist()):
                for name in self.ids[self.bounds[row]:self.bounds[row + 1]].tolist():
                    if name == me:
                        continue
                    if len(found) < self.k:
                        heapq.heappush(found, (s, -name))
                    elif (s, -name) > found[0]:
                        heapq.heapreplace(found, (s, -name))
                    else:
                        break  # later ids of an equal vector are larger
            if len(found) == self.k:
                limit = np.sqrt(max(length - 2 * float(found[0][0]), 0.0)) + self.margin
        return [(int(s), -i) for s, i in sorted(found, reverse=True)]


def top_products(vectors: DataFrame, step: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by ``step`` the k other vectors of the largest inner product after floor(256 * component).

    Exact; ties go to the smaller vec_id. Vectors that are null, empty, of another length than most, or hold null or non-finite components take no part, zero vectors do; null ids are left out. Rows that
    repeat an id are queries and candidates of their own, each for all rows but itself. An empty table has no rows; other columns are not read. Products from 2^63 on are refused.
    """
    own = shards.clean(vectors, id_col, vec_col, zero=True)
    return shards.search(own, shards.queries_of(own, step), lambda ids, rows: Tree(ids, rows, k), lambda tree, ids, rows: tree.find(ids, rows), k, whole=True)
