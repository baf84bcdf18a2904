"""Approximate nearest neighbours: stable projections, a kd-tree, and a chi-square test.

The largest inner product becomes the smallest Euclidean distance by one more component,
sqrt(M^2 - |x|^2) with M the greatest length of the table. A few Gaussian (2-stable)
projections keep distances in this sense: projected over true squared distance follows the
chi-square law with as many degrees of freedom as there are projections.

Each block of candidates is indexed by a kd-tree over its projections. A query takes its
candidates in the order of their projected distance, leaf after leaf as the tree brings them
up, verifies their vectors in full, and stops once a candidate nearer than its k-th best so
far would lie within the distance reached with probability ``sure`` at least: chi2(reached^2
/ best_k^2) >= sure. Leaves beyond that distance are never opened. The first bounds come from
a few rows (``seeds``), which stay finds themselves, so that every query has k rows where
there are as many.

How much that skips is up to the data. ``Block.ask`` counts what it verifies; README has
the share, and the recall, at several values of ``sure``.

Vectors that are null or empty or hold null or non-finite components, zero vectors, and rows
without an id take no part. Rows that share an id are candidates each for itself, as queries
they are one. Equal scores stand by id; which of several candidates with the k-th score is
found may be up to chance. Other columns, whatever their names, are not looked at. An empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import BATCH, Vectors, best, blocks, clean, in_rounds, kth_best, lowered, matrix, moments, products, ranked

EMPTY = "query_id long, rank int, vec_id long, score double"
#: Rows of the finds; query and row are the numbers of the two rows.
FOUND = "query long, query_id long, row long, vec_id long, score double"
#: A block has at least so many rows, if the table does: small ones leave little to skip.
LEAST_BLOCK = 4096
#: Queries that a block is asked together.
ASKED = 64


def chi2_quantile(p: float, freedom: int) -> float:
    """For an even number of degrees of freedom, where the law has a closed form."""
    if freedom % 2:
        raise ValueError("an even number of projections is needed")

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, freedom // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 10.0 * freedom + 200
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def kd_leaves(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Positions of the points in each leaf: halves along the widest side, again and again."""
    out, stack = [], [np.arange(len(points))]
    while stack:
        own = stack.pop()
        if len(own) <= leaf:
            out.append(own)
            continue
        side = int(np.argmax(np.ptp(points[own], axis=0)))
        half = len(own) // 2
        own = own[np.argpartition(points[own, side], half)]
        stack += [own[:half], own[half:]]
    return out


class Block:
    """Candidates with a kd-tree over their projections."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, x: np.ndarray, norms2: np.ndarray, lines: np.ndarray, longest: float, leaf: int):
        more = np.sqrt(np.maximum(longest**2 - norms2, 0.0))
        points = x @ lines[:-1] + more[:, None] * lines[-1]
        leaves = kd_leaves(points, leaf)
        order = np.concatenate(leaves)
        self.row, self.ids, self.x, self.points = row[order], ids[order], x[order], points[order]
        self.ends = np.cumsum([0, *map(len, leaves)])
        self.low = np.array([points[p].min(0) for p in leaves])
        self.high = np.array([points[p].max(0) for p in leaves])
        self.lines, self.longest = lines, longest

    def ask(self, q: np.ndarray, own: np.ndarray, least: np.ndarray, k: int, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(position of the query, position, score) of the best found, and how many rows were verified.

        least: a score that k candidates are known to reach (or -inf), for each query.
        """
        spots, length2 = q @ self.lines[:-1], (q * q).sum(1)
        slip = -lowered(np.zeros(len(q)), q, self.longest)

        def radius2(at_least, i):
            """The squared projected distance at which the test holds."""
            return np.where(at_least > -np.inf, stop * (length2[i] + self.longest**2 - 2 * (at_least - slip[i])), np.inf)

        # leaves that are near enough, by the distance to their boxes
        gap = np.zeros((len(q), len(self.low)))
        for j in range(spots.shape[1]):
            a = spots[:, j, None]
            gap += np.maximum(np.maximum(self.low[:, j] - a, a - self.high[:, j]), 0.0) ** 2
        near = gap <= radius2(least, slice(None))[:, None]
        opened = np.flatnonzero(near.any(0))
        sizes = np.diff(self.ends)[opened]
        at = np.repeat(self.ends[opened] - np.cumsum(np.r_[0, sizes[:-1]]), sizes) + np.arange(sizes.sum())
        points = self.points[at]
        away = (spots * spots).sum(1)[:, None] + (points * points).sum(1) - 2 * spots @ points.T
        away[~np.repeat(near[:, opened], sizes, axis=1) | (self.ids[at] == own[:, None])] = np.inf
        out, verified = [], 0
        for i in range(len(q)):
            low, step = float(least[i]), 4 * k
            found, scores = np.zeros(0, np.int64), np.zeros(0)
            row = away[i]
            waiting = np.flatnonzero((row <= radius2(low, i)) & np.isfinite(row))  # infinite: shut, or its own
            while len(waiting):
                # the nearest by projection come first, then the test is made anew
                if len(waiting) > step:
                    order = np.argpartition(row[waiting], step - 1)
                    part, waiting = waiting[order[:step]], waiting[order[step:]]
                else:
                    part, waiting = waiting, waiting[:0]
                c = at[part]
                rough = self.x[c] @ q[i]
                verified += len(c)
                c = c[rough >= low - slip[i]]
                found, scores = np.r_[found, c], np.r_[scores, products(q[i : i + 1], self.x, np.zeros(len(c), np.int64), c)]
                kept = np.lexsort((self.ids[found], -scores))[:k]
                found, scores = found[kept], scores[kept]
                if len(found) == k and scores[-1] > low:
                    low = float(scores[-1])
                waiting, step = waiting[row[waiting] <= radius2(low, i)], step * 2
            out.append((np.full(len(found), i), found, scores))
        return (*(np.concatenate(part) for part in zip(*out)), verified)


def search(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    every: int = 20,
    projections: int = 24,
    sure: float = 0.95,
    leaf: int = 32,
    block_rows: int = 100_000,
    seeds: int = 128,
    seed: int = 7,
) -> DataFrame:
    """query_id, rank, vec_id, score for rows whose id is divisible by ``every``.

    seeds: how many rows give first thresholds (a bounded broadcast).
    """
    rows = clean(df, id_col, vec_col, lambda x: x, zero=False)
    n, width, longest, _, _ = moments(rows)
    if not n:
        return df.sparkSession.createDataFrame([], EMPTY)
    lines = np.random.default_rng(seed).standard_normal((width + 1, projections))
    stop = chi2_quantile(sure, projections)
    candidates = blocks(rows, n, block_rows, LEAST_BLOCK, F.xxhash64("row"), "row")
    some = Vectors(rows.orderBy(F.xxhash64("row", F.lit(seed)), "row").limit(seeds).collect(), width)

    def make(sent):
        def run(batches):
            asked = sent.value
            low = kth_best(asked.x, asked.ids, some, k)

            def table(who: np.ndarray, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(asked.row[who]), pa.array(asked.ids[who]), pa.array(row), pa.array(ids), pa.array(scores)], names=["query", "query_id", "row", "vec_id", "score"])

            if TaskContext.get().partitionId() == 0:  # what the first rows give
                for at in range(0, len(asked), BATCH):
                    who = np.arange(at, min(at + BATCH, len(asked)))
                    a, c = np.nonzero(asked.ids[who][:, None] != some.ids)
                    s = products(asked.x[who], some.x, a, c)
                    kept = best(a, some.ids[c], s, k)
                    yield table(who[a[kept]], some.row[c[kept]], some.ids[c[kept]], s[kept])
            for held in grouped(batches, block_rows):
                block = Block(*held, lines, longest, leaf)
                for at in range(0, len(asked), ASKED):
                    part = slice(at, at + ASKED)
                    who, c, s, _ = block.ask(asked.x[part], asked.ids[part], low[part], k, stop)
                    yield table(at + who, block.row[c], block.ids[c], s)

        return run

    def grouped(batches, most: int):
        """The rows of a task as arrays, a bounded number at a time."""
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append((b.column("row").to_numpy(), b.column("vec_id").to_numpy(), matrix(b.column("v"), width), b.column("norm2").to_numpy()))
                size += b.num_rows
            if size >= most:
                yield tuple(np.concatenate(part) for part in zip(*held))
                held, size = [], 0
        if held:
            yield tuple(np.concatenate(part) for part in zip(*held))

    def rank(found: DataFrame) -> DataFrame:
        once = found.groupBy("query", "row").agg(F.max("query_id").alias("query_id"), F.max("vec_id").alias("vec_id"), F.max("score").alias("score"))
        return ranked(once, k, F.col("score"))

    queries = rows.where(F.col("vec_id") % every == 0).select("row", "vec_id", "v")
    return in_rounds(candidates, queries, width, make, FOUND, rank)
