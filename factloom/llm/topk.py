"""Exact top-k inner products over norm-sorted, SVD-rotated vectors.

Vectors are made whole numbers (floor(scale * x)), so that scores are exact. The right
singular vectors of the whole table rotate them: most of an inner product then lies in the
first components. Candidates are stored by descending length and read in that order. A
stretch of them is passed over by the queries whose length times the stretch's greatest
cannot reach their k-th best score; of the others, the partial sum over the first components
plus the product of the two residual lengths (Cauchy-Schwarz) decides which candidates are
computed in full. First thresholds come from the longest vectors of the table.

Vectors that are null or empty or hold null or non-finite components, and rows without an id,
take no part; a vector's dimension is its own (a shorter one counts as filled up with zeros).
Rows that share an id are candidates each for itself, as queries they are one: their finds are
ranked together. Ties go to the smaller id. Other columns, whatever their names, are not
looked at. An empty table gives an empty result.

Scores are summed exactly, as doubles below 2**53, as 64-bit integers below 2**63, and as
Python's integers beyond. A score in the result must fit in a long: one that doesn't ends the
query with the error SCORE_OVERFLOW.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import BATCH, Vectors, best, blocks, clean, in_rounds, kth_best, matrix, moments, ranked

EMPTY = "query_id long, rank int, vec_id long, score long"
#: Candidates that are compared together.
STRETCH = 2048


class ScoreOverflow(ArithmeticError):
    """SCORE_OVERFLOW: a score has more than 38 digits."""


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    x = np.floor(scale * x)
    if not np.isfinite(x).all():
        raise ScoreOverflow("SCORE_OVERFLOW: a scaled component exceeds a double")
    return x


def search(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 10,
    every: int = 100,
    scale: int = 1024,
    block_rows: int = 200_000,
    seeds: int = 2048,
    head: float = 0.6,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best for rows whose id is divisible by ``every``.

    seeds: how many of the longest vectors give first thresholds (a bounded broadcast).
    head: share of the second moment that the first rotated components hold.
    """
    rows = clean(df, id_col, vec_col, lambda x: whole(x, scale), zero=True)
    n, width, _, top, gram = moments(rows)
    if not n:
        return df.sparkSession.createDataFrame([], EMPTY)
    power, turn = np.linalg.eigh(gram) if np.isfinite(gram).all() else (np.ones(width), np.eye(width))
    power, turn = power[::-1], turn[:, ::-1].copy()
    first = int(min(width, max(1, np.searchsorted(np.cumsum(power), head * power.sum()) + 1)))
    reach = int(top) ** 2 * width
    kind = "double" if reach < 2**53 else "long" if reach < 2**63 else "decimal(38,0)"
    candidates = blocks(rows, n, block_rows, STRETCH, F.desc("norm2"), "row")
    longest = Vectors(rows.orderBy(F.desc("norm2"), "row").limit(seeds).collect() if kind == "double" else [], width)

    def make(sent):
        def run(batches):
            asked = sent.value
            q, own = asked.x, asked.ids
            z, size = q @ turn, np.linalg.norm(q, axis=1)
            heads, tails = z[:, :first], np.linalg.norm(z[:, first:], axis=1)
            low = kth_best(q, own, longest, k)
            held = None
            for b in batches:
                ids, x = b.column("vec_id").to_numpy(), matrix(b.column("v"), width)
                norms, y = np.sqrt(b.column("norm2").to_numpy()), x @ turn
                for at in range(0, len(ids), STRETCH):
                    part = slice(at, at + STRETCH)
                    found = compared((q, own, heads, tails, size, low), (ids[part], x[part], y[part, :first], np.linalg.norm(y[part, first:], axis=1), norms[part]), kind)
                    held = found if held is None else tuple(np.r_[old, new] for old, new in zip(held, found))
                    kept = best(*held, k)
                    held = tuple(part[kept] for part in held)
                    full, counts = np.unique(held[0], return_counts=True)
                    ends, ok = np.cumsum(counts) - 1, counts == k
                    at_least = held[2][ends[ok]].astype(float)
                    low[full[ok]] = np.maximum(low[full[ok]], at_least - 4 * np.finfo(float).eps * np.abs(at_least))
            if held is not None and len(held[0]):
                owner, ids, scores = held
                yield pa.RecordBatch.from_arrays([pa.array(own[owner]), pa.array(ids), as_column(scores, kind)], names=["query_id", "vec_id", "score"])

        return run

    def rank(found: DataFrame) -> DataFrame:
        top = ranked(found, k, F.col("score"))
        fits = F.col("score").between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)"))
        score = F.when(fits, F.col("score")).otherwise(F.raise_error("SCORE_OVERFLOW: a score doesn't fit in a long")) if kind == "decimal(38,0)" else F.col("score")
        return top.withColumn("score", score.cast("long"))

    queries = rows.where(F.col("vec_id") % every == 0).select("row", "vec_id", "v")
    return in_rounds(candidates, queries, width, make, f"query_id long, vec_id long, score {kind}", rank)


def as_column(scores: np.ndarray, kind: str) -> pa.Array:
    if kind != "decimal(38,0)":
        return pa.array(scores)
    if any(abs(s) >= 10**38 for s in scores):
        raise ScoreOverflow("SCORE_OVERFLOW: a score has more than 38 digits")
    from decimal import Context, Decimal

    wide = Context(prec=40)
    return pa.array([wide.create_decimal(Decimal(int(s))) for s in scores], pa.decimal128(38, 0))


def compared(asked: tuple, stretch: tuple, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the query, id, score) of the candidates of a stretch that may be among the best."""
    q, own, heads, tails, size, low = asked
    ids, x, y_heads, y_tails, norms = stretch
    types = {"double": np.float64, "long": np.int64}.get(kind, object)
    out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, types))]
    alive = np.flatnonzero(size * norms.max() * (1 + 1e-9) >= low)
    for at in range(0, len(alive), BATCH):
        who = alive[at : at + BATCH]
        slack = 1e-9 * size[who][:, None] * norms + 1e-6
        bound = heads[who] @ y_heads.T + tails[who][:, None] * y_tails + slack
        a, c = np.nonzero(bound >= low[who][:, None])
        if kind == "decimal(38,0)":
            s = np.array([sum(int(u) * int(v) for u, v in zip(q[who[i]].tolist(), x[j].tolist())) for i, j in zip(a, c)] or [0], object)[: len(a)]
        elif kind == "long":
            s = np.einsum("ij,ij->i", q[who[a]].astype(np.int64), x[c].astype(np.int64))
        elif len(a) * 4 > bound.size:
            s = (q[who] @ x.T)[a, c]
        else:
            s = np.einsum("ij,ij->i", q[who[a]], x[c])
        a = who[a]
        keep = own[a] != ids[c]
        keep &= s >= low[a]
        out.append((a[keep], ids[c[keep]], s[keep]))
    return tuple(np.concatenate(parts) for parts in zip(*out))
