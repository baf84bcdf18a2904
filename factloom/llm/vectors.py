"""What exact and approximate vector search share: clean rows, rounds of queries, and the ranking.

Candidates stay where they are: a task reads some of them from the stored table and never
shuffles them. The queries come to them in rounds. A round holds a bounded number of bytes of
queries (``ROUND_BYTES``), which is what is collected and broadcast; there are as many rounds
as the queries need. A task brings no more than k finds for each query of the round, and a
window over these few ranks them.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, parallelism, stored, task_id

#: Bytes of query vectors that are broadcast together.
ROUND_BYTES = 32 << 20
#: Queries that are compared together.
BATCH = 256


def _matrices(ids: pa.Array, lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors, one pair of arrays for each length, without those that take no part."""
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False).astype("<f8", copy=False)  # null components are NaN here
    known = pc.and_(pc.is_valid(ids), pc.is_valid(lists)).to_numpy(zero_copy_only=False)
    lengths = np.where(known, np.diff(offsets), 0)
    numbers = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == n)
        x = flat[offsets[at][:, None] + np.arange(n)]
        fine = np.isfinite(x).all(1)
        yield numbers[at[fine]], x[fine]


def _binary(x: np.ndarray) -> pa.Array:
    """Each row's little-endian bytes."""
    width = x.shape[1] * x.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())


def clean(df: DataFrame, id_col: str, vec_col: str, change: Callable, zero: bool) -> DataFrame:
    """Stored rows (row, vec_id, v as little-endian doubles, norm2) of the vectors that take part.

    Null ids and vectors, and vectors that are empty or hold null or non-finite components,
    take no part; zero vectors only where ``zero`` is set. Rows that share an id each take
    part with their own number ``row``.
    """
    bounded_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            for ids, x in _matrices(batch.column("vec_id"), batch.column("v")):
                x = change(x)
                norm2 = (x * x).sum(1)
                keep = (norm2 > 0) | zero
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), _binary(x[keep]), pa.array(norm2[keep])], names=["vec_id", "v", "norm2"])

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    found = rows.mapInArrow(run, "vec_id long, v binary, norm2 double")
    return stored(found.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", "norm2"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Binary vectors as rows; shorter ones are filled up with zeros."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    if (sizes == 8 * width).all():
        start = np.frombuffer(column.buffers()[1], "<i4", 1, 4 * column.offset)[0] if len(column) else 0
        return np.frombuffer(column.buffers()[2], "<f8", len(column) * width, start).reshape(-1, width) if len(column) else np.zeros((0, width))
    out = np.zeros((len(column), width))
    for row, v in zip(out, column.to_pylist()):
        row[: len(v) // 8] = np.frombuffer(v, "<f8")[:width]
    return out


def moments(rows: DataFrame) -> tuple[int, int, float, float, np.ndarray]:
    """Rows, width, greatest norm, greatest component, and second moments, over all rows.

    Tasks sum what they read; sixteen tasks sum those sums, so that the driver gets no
    more than sixteen small matrices.
    """

    def total(parts: Iterator[tuple]) -> tuple:
        n, norm, top, gram = 0, 0.0, 0.0, np.zeros((0, 0))
        for m, x, t, g in parts:
            n, norm, top = n + m, max(norm, x), max(top, t)
            small, large = sorted((gram, g), key=len)
            gram = large.copy()
            gram[: len(small), : len(small)] += small
        return n, norm, top, gram

    def row(t: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([task_id()], pa.int64()), pa.array([t[0]], pa.int64()), pa.array([t[1]]), pa.array([t[2]]), pa.array([t[3].astype("<f8").tobytes()], pa.binary())],
            names=["task", "n", "norm", "top", "gram"],
        )

    def square(data: bytes) -> np.ndarray:
        g = np.frombuffer(data, "<f8")
        return g.reshape(int(len(g) ** 0.5), -1) if len(g) else np.zeros((0, 0))

    def first(batches):
        def parts():
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column("v"), pc.max(pc.binary_length(b.column("v"))).as_py() // 8)
                    yield b.num_rows, float(np.sqrt((x * x).sum(1).max())), float(np.abs(x).max()), x.T @ x

        yield row(total(parts()))

    def second(batches):
        yield row(total((r["n"], r["norm"], r["top"], square(r["gram"])) for b in batches for r in b.to_pylist()))

    kind = "task long, n long, norm double, top double, gram binary"
    got = rows.select("v").mapInArrow(first, kind).repartition(16, "task").mapInArrow(second, kind).collect()
    n, norm, top, gram = total((r.n, r.norm, r.top, square(bytes(r.gram))) for r in got)
    return n, len(gram), norm, top, gram


class Vectors:
    """Rows that were collected, a bounded number: numbers, ids and vectors."""

    def __init__(self, rows: list, width: int):
        self.row = np.array([r.row for r in rows], dtype=np.int64)
        self.ids = np.array([r.vec_id for r in rows], dtype=np.int64)
        self.x = matrix(pa.array([bytes(r.v) for r in rows], pa.binary()), width)

    def __len__(self) -> int:
        return len(self.row)


def blocks(rows: DataFrame, n: int, block_rows: int, least_rows: int, *order) -> DataFrame:
    """The rows stored in ranges of ``order``, at most about ``block_rows`` in a file, and in that order in each.

    Smaller tables are dealt to all tasks, but for files of fewer than ``least_rows``. The
    order must end with the row's number, so that equal vectors can be parted.
    """
    files = max(1, -(-n // block_rows), min(parallelism(rows.sparkSession), n // least_rows))
    return stored(rows.repartitionByRange(files, *order).sortWithinPartitions(*order))


def in_rounds(candidates: DataFrame, queries: DataFrame, width: int, make: Callable, found: str, rank: Callable) -> DataFrame:
    """All queries past all candidates.

    make(queries) gives, for the queries of a round, the function that mapInArrow runs over
    the candidates; its rows have the columns ``found``. rank() ranks the finds of a round,
    which has all rows of each query's id.
    """
    spark = candidates.sparkSession
    many = queries.count()
    rounds = max(1, -(-many * 8 * width // ROUND_BYTES))
    out = []
    for r in range(rounds):
        asked = Vectors(queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r).collect(), width)
        sent = spark.sparkContext.broadcast(asked)
        done = rank(candidates.mapInArrow(make(sent), found))
        if rounds > 1:  # one round's queries at a time
            done = stored(done)
            sent.destroy()
            logging.getLogger(__name__).info("round %d of %d", r + 1, rounds)
        out.append(done)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    if rounds > 1:
        result = stored(whole)
        discard(*out)
        return result
    return whole


def best(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each owner's k highest scores, ties to smaller ids."""
    if scores.dtype == object:  # Python's own integers
        order = np.array(sorted(range(len(owner)), key=lambda i: (owner[i], -scores[i], ids[i])), dtype=np.int64)
    else:
        order = np.lexsort((ids, -scores, owner))
    o = owner[order]
    first = np.r_[True, o[1:] != o[:-1]] if len(o) else np.zeros(0, bool)
    rank = np.arange(len(o)) - np.maximum.accumulate(np.where(first, np.arange(len(o)), 0))
    return order[rank < k]


def products(q: np.ndarray, x: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """q[a] . x[c], each summed in the same order, whatever stands beside it (a matrix product's last bits vary)."""
    out = np.empty(len(a))
    step = max(1, (1 << 20) // q.shape[1])
    for at in range(0, len(a), step):
        out[at : at + step] = (q[a[at : at + step]] * x[c[at : at + step]]).sum(1)
    return out


def kth_best(q: np.ndarray, own: np.ndarray, seeds: Vectors, k: int) -> np.ndarray:
    """The k-th best score that a few rows give each query, less what rounding may have added."""
    if len(seeds) <= k:
        return np.full(len(own), -np.inf)
    out = np.empty(len(own))
    for at in range(0, len(own), BATCH):
        part = slice(at, at + BATCH)
        s = np.where(own[part, None] == seeds.ids, -np.inf, q[part] @ seeds.x.T)
        out[part] = -np.partition(-s, k - 1, axis=1)[:, k - 1]
    return lowered(out, q, float(np.sqrt((seeds.x * seeds.x).sum(1).max())))


def lowered(least: np.ndarray, q: np.ndarray, longest: float) -> np.ndarray:
    """Thresholds less what rounding may take from a product of this length."""
    return least - 16 * q.shape[1] * np.finfo(float).eps * longest * np.linalg.norm(q, axis=1)


def ranked(found: DataFrame, k: int, score) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))
