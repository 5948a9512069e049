"""Nearest neighbours by largest inner product, with a vantage-point tree per shard.

Largest inner products become smallest distances when every vector gets one more component that lifts it to the length of the longest, and queries get 0 there. In a node of the tree
all vectors are split at the median distance from the node's vantage point, and each half keeps its least and largest distance. For a query at distance d from the vantage point no
vector of a half is nearer than what the triangle inequality leaves; a half is left out if that bound, times ``relax``, exceeds the k-th best distance so far.
``relax`` 1 is exact search; more prunes more.

A block of queries walks the tree together: first each to its nearest leaf, which gives good k-th distances, then through all halves that the bound allows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import shards

LEAF = 48
#: Fitted on the given vectors: recall against brute force is measured in tests.
RELAX = 1.25


class Tree:
    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, relax: float):
        self.k, self.relax = k, relax
        self.rows, self.bounds, self.ids = shards.unique_rows(ids, rows, k + 1)
        squares = (self.rows ** 2).sum(1)
        self.top = float(squares.max()) if len(squares) else 0.0
        self.lift = np.column_stack([self.rows, np.sqrt(np.maximum(self.top - squares, 0))])
        self.slack = 1e-7 * (1 + np.sqrt(self.top))
        self.root = self.grow(np.arange(len(self.rows)), np.random.default_rng(len(rows)))

    def grow(self, own: np.ndarray, rng) -> tuple:
        """(leaf rows,) or (vantage row, its halves as (least, largest, node))."""
        if len(own) <= LEAF:
            return (own,)
        # of a few candidates the one that spreads the others most
        some, sample = rng.choice(own, 5), rng.choice(own, min(len(own), 64))
        spread = [np.linalg.norm(self.lift[sample] - self.lift[s], axis=1).std() for s in some]
        point = some[int(np.argmax(spread))]
        far = np.linalg.norm(self.lift[own] - self.lift[point], axis=1)
        order = np.argsort(far, kind="stable")
        own, far, half = own[order], far[order], len(own) // 2
        return (point, (far[0], far[half - 1], self.grow(own[:half], rng)), (far[half], far[-1], self.grow(own[half:], rng)))

    def find(self, ids: np.ndarray, queries: np.ndarray) -> list[list[tuple[float, int]]]:
        n = len(ids)
        self.asked, self.queries = ids, queries
        self.length = (queries ** 2).sum(1) + self.top
        self.best = np.full((n, self.k), -np.inf)
        self.names = np.full((n, self.k), np.iinfo(np.int64).max)
        self.seen: dict[int, np.ndarray] = {}
        if len(self.rows):
            self.descend(self.root, np.arange(n))
            self.walk(self.root, np.arange(n))
        return [[(s, i) for s, i in zip(a, b) if s > -np.inf] for a, b in zip(self.best.tolist(), self.names.tolist())]

    def distance(self, row: int, asked: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.length[asked] - 2 * (self.queries[asked] @ self.rows[row]), 0))

    def descend(self, node: tuple, asked: np.ndarray) -> None:
        """Each query to the leaf on its side of every vantage point."""
        if not len(asked):
            return
        if len(node) == 1:
            self.leaf(node[0], asked)
            return
        far = self.distance(node[0], asked)
        inner = far <= (node[1][1] + node[2][0]) / 2
        self.descend(node[1][2], asked[inner])
        self.descend(node[2][2], asked[~inner])

    def walk(self, node: tuple, asked: np.ndarray) -> None:
        if len(node) == 1:
            done = self.seen.get(id(node[0]))
            if done is not None:
                asked = np.setdiff1d(asked, done, assume_unique=True)
            if len(asked):
                self.leaf(node[0], asked)
            return
        far = self.distance(node[0], asked)
        for least, most, half in node[1:]:
            bound = np.maximum(np.maximum(far - most, least - far), 0) * self.relax
            with np.errstate(invalid="ignore"):
                limit = np.sqrt(np.maximum(self.length[asked] - 2 * self.best[asked, -1], 0)) + self.slack
            near = bound <= limit
            if near.any():
                self.walk(half, asked[near])

    def leaf(self, own: np.ndarray, asked: np.ndarray) -> None:
        self.seen[id(own)] = np.concatenate([self.seen[id(own)], asked]) if id(own) in self.seen else asked
        rows = self.rows[own]
        rough = self.queries[asked] @ rows.T
        q, v = np.nonzero(rough >= self.best[asked, -1][:, None] - self.slack * (1 + np.sqrt(self.top)))
        if not len(q):
            return
        # summed in one order whatever the block, so that equal vectors tie
        exact = (self.queries[asked[q]] * rows[v]).sum(1)
        counts = np.diff(self.bounds)[own[v]]
        entry = np.repeat(self.bounds[own[v]], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        q, score, name = np.repeat(asked[q], counts), np.repeat(exact, counts), self.ids[entry]
        other = name != self.asked[q]
        q, score, name = q[other], score[other], name[other]
        who = np.unique(q)
        q = np.concatenate([q, np.repeat(who, self.k)])
        score = np.concatenate([score, self.best[who].ravel()])
        name = np.concatenate([name, self.names[who].ravel()])
        order = np.lexsort((name, -score, q))
        q, score, name = q[order], score[order], name[order]
        heads = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        pick = heads[:, None] + np.arange(self.k)
        self.best[who], self.names[who] = score[pick], name[pick]


def nearest(vectors: DataFrame, step: int = 20, k: int = 20, relax: float = RELAX, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by ``step`` its k nearest others found (all others, if fewer).

    The score is the inner product in double precision on the vectors as given. Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take
    no part, neither do null ids. Rows that repeat an id are queries and candidates of their own, each for all rows but itself. An empty table has no rows; other columns are not read.
    """
    own = shards.clean(vectors, id_col, vec_col, zero=False)
    return shards.search(own, shards.queries_of(own, step), lambda ids, rows: Tree(ids, rows, k, relax), lambda tree, ids, rows: tree.find(ids, rows), k)
