"""Centroid clustering in whole numbers, with Drake's adaptive bounds.

Each vector keeps an upper bound of the distance to its own centroid, lower bounds of the
distances to the centroids that were the next nearest, each with its number, and one
remainder bound for all the others. When centroids move, the bounds move with them: the upper
one up by what the own centroid moved, each lower one down by what its centroid moved, the
remainder down by the farthest move of the others. A vector whose upper bound is below all
lower ones stays where it is. Else its distance to its own centroid is computed, then those
to the centroids that it keeps, and only where the remainder bound is reached to all of them,
in whole numbers. How many bounds are kept shrinks to what the vectors needed in the last
round, but for an eighth of the centroids.

A round is one pass over a stored table: tasks read vectors with their bounds, and write them
with the bounds after the round, and one more row with their sums for each cluster. Nothing is
shuffled but those sums: sixteen tasks add them up, so that the driver gets no more than
sixteen tables of the size of the centroids. Centroids go out with the tasks; there are ``k``.

Whole numbers are compared as doubles, 64-bit integers or Python's integers, slice by slice,
whichever is exact there. A distance, or a sum of distances, in the result must fit in a long:
one that doesn't ends the query with the error DISTANCE_OVERFLOW.

Rows without an id, null vectors, and vectors of another length or with null or non-finite
components take no part. Rows that share an id each take part; where they compete for a place
among the first centroids, the one with the smaller bytes is first. With fewer vectors than
``k`` there are as many centroids as vectors. Equal distances go to the centroid with the
smaller number, and a centroid without vectors stays. Other columns, whatever their names, are
not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, task_id
from .topk import whole
from .vectors import clean, matrix

EMPTY = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
#: A row is a vector with its bounds, or (sums) what a task adds up.
STATE = "vec_id long, v binary, own int, upper double, near binary, low binary, rest double, sums string"
LAST = "vec_id long, own int, distance long, sums string"
#: Bounds are rounded outwards by this, far more than the arithmetic may be off.
UP, DOWN = 1 + 1e-12, 1 - 1e-12
#: Vectors that are compared together.
SLICE = 4096


class DistanceOverflow(ArithmeticError):
    """DISTANCE_OVERFLOW: a squared distance, or a sum of them, doesn't fit in a long."""


class Centroids:
    """Whole numbers, exact; also as doubles."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.exact = np.array(rows, dtype=object).reshape(len(rows), -1)
        self.top = max((abs(v) for r in rows for v in r), default=0)

    def __len__(self) -> int:
        return len(self.rows)

    def moves(self, other: Centroids) -> np.ndarray:
        return np.array([float(sum((a - b) ** 2 for a, b in zip(r, s))) ** 0.5 * UP for r, s in zip(self.rows, other.rows)])

    def kind(self, x: np.ndarray):
        """The type in which squared distances to these vectors are exact."""
        most = 4 * x.shape[1] * max(int(np.abs(x).max()), self.top, 1) ** 2
        return np.float64 if most < 2**53 else np.int64 if most < 2**63 else object

    def to_all(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of vectors (whole numbers as doubles) to all centroids."""
        kind = self.kind(x)
        if kind is np.float64:
            c = self.exact.astype(float)
            return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        x, c = as_kind(x, kind), self.exact.astype(kind)
        return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)

    def to_some(self, x: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Squared distances of each vector to the centroids that its row of numbers names."""
        kind = self.kind(x)
        x, c = as_kind(x, kind), self.exact.astype(kind)
        return np.stack([((x - c[numbers[:, j]]) ** 2).sum(1) for j in range(numbers.shape[1])], axis=1)


def as_kind(x: np.ndarray, kind) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape) if kind is object else x.astype(kind)


def roots(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(float))


class Bounds:
    """The bounds of a slice of vectors."""

    def __init__(self, own: np.ndarray, upper: np.ndarray, near: np.ndarray, low: np.ndarray, rest: np.ndarray):
        self.own, self.upper, self.near, self.low, self.rest = own, upper, near, low, rest

    @classmethod
    def scanned(cls, x: np.ndarray, c: Centroids, keep: int) -> Bounds:
        squared = c.to_all(x)
        order = np.argsort(squared, axis=1, kind="stable").astype(np.int32)  # ties: the smaller number
        at = roots(np.take_along_axis(squared, order, 1))
        rest = at[:, 1 + keep] * DOWN if 1 + keep < len(c) else np.full(len(x), np.inf)
        return cls(order[:, 0].copy(), at[:, 0] * UP, order[:, 1 : 1 + keep].copy(), at[:, 1 : 1 + keep] * DOWN, rest)

    def moved(self, move: np.ndarray) -> None:
        others = np.broadcast_to(move, (len(self.own), len(move))).copy()
        np.put_along_axis(others, self.own[:, None], 0.0, 1)
        np.put_along_axis(others, self.near, 0.0, 1)
        self.upper = (self.upper + move[self.own]) * UP
        self.low = self.low * DOWN - move[self.near] * UP
        self.rest = self.rest * DOWN - others.max(1) * UP

    def least(self) -> np.ndarray:
        return np.minimum(self.low.min(1, initial=np.inf), self.rest)

    def settle(self, x: np.ndarray, c: Centroids) -> int:
        """Makes every vector's centroid its nearest; how many of the kept bounds that took."""
        unsure = np.flatnonzero(self.upper >= self.least())
        if not len(unsure):
            return 0
        self.upper[unsure] = roots(c.to_some(x[unsure], self.own[unsure, None]))[:, 0] * UP
        unsure = unsure[self.upper[unsure] >= self.least()[unsure]]
        all_of_them = self.upper[unsure] >= self.rest[unsure]
        needed = 0
        some = unsure[~all_of_them]
        if len(some):
            needed = int((self.low[some] <= self.upper[some, None]).sum(1).max())
            numbers = np.sort(np.c_[self.own[some], self.near[some]], axis=1)
            squared = c.to_some(x[some], numbers)
            order = np.argsort(squared, axis=1, kind="stable")
            numbers, at = np.take_along_axis(numbers, order, 1), roots(np.take_along_axis(squared, order, 1))
            self.own[some], self.upper[some] = numbers[:, 0], at[:, 0] * UP
            self.near[some], self.low[some] = numbers[:, 1:], at[:, 1:] * DOWN
        full = unsure[all_of_them]
        if len(full):
            fresh = Bounds.scanned(x[full], c, self.near.shape[1])
            self.own[full], self.upper[full], self.near[full], self.low[full], self.rest[full] = fresh.own, fresh.upper, fresh.near, fresh.low, fresh.rest
            needed = self.near.shape[1]
        return needed

    def shrink(self, keep: int) -> None:
        """The ``keep`` lowest bounds stay; the others go into the remainder."""
        if keep < self.near.shape[1]:
            order = np.argsort(self.low, axis=1, kind="stable")
            near, low = np.take_along_axis(self.near, order, 1), np.take_along_axis(self.low, order, 1)
            self.near, self.low, self.rest = near[:, :keep], low[:, :keep], np.minimum(self.rest, low[:, keep])


class Sums:
    """What a task, or several, add up for each cluster, in whole numbers."""

    def __init__(self, k: int, width: int):
        self.count, self.total = [0] * k, [[0] * width for _ in range(k)]
        self.inertia, self.needed = [0] * k, 0

    def add(self, own: np.ndarray, x: np.ndarray) -> None:
        exact = 2**53 > len(x) * max(1.0, float(np.abs(x).max()))
        for c in np.unique(own).tolist():
            part = x[own == c]
            got = part.sum(0) if exact else as_kind(part, object).sum(0)
            self.count[c] += len(part)
            self.total[c] = [a + int(b) for a, b in zip(self.total[c], got)]

    def add_distances(self, own: np.ndarray, squared: np.ndarray) -> None:
        whole_numbers = as_kind(squared[:, None], object)[:, 0]
        for c in np.unique(own).tolist():
            self.inertia[c] += sum(whole_numbers[own == c].tolist())

    def merge(self, text: str) -> None:
        other = json.loads(text)
        self.count = [a + b for a, b in zip(self.count, other["count"])]
        self.total = [[a + b for a, b in zip(r, s)] for r, s in zip(self.total, other["total"])]
        self.inertia = [a + b for a, b in zip(self.inertia, other["inertia"])]
        self.needed = max(self.needed, other["needed"])

    def text(self) -> str:
        return json.dumps({"count": self.count, "total": self.total, "inertia": self.inertia, "needed": self.needed})


def added(state: DataFrame, k: int, width: int) -> Sums:
    """The sums of all tasks; sixteen tasks add them up first."""

    def run(batches):
        out = Sums(k, width)
        for b in batches:
            for text in b.column("sums").to_pylist():
                out.merge(text)
        yield pa.RecordBatch.from_arrays([pa.array([out.text()])], names=["sums"])

    out = Sums(k, width)
    rows = state.where("sums IS NOT NULL").select("own", "sums")  # own: the task that wrote the row
    for r in rows.repartition(16, "own").mapInArrow(run, "sums string").collect():
        out.merge(r.sums)
    return out


def _bytes(x: np.ndarray, kind: str) -> pa.Array:
    x = np.ascontiguousarray(x, kind)
    if not x.shape[1]:
        return pa.array([b""] * len(x), pa.binary())
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())


def _array(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).copy()


def _pass(batches, c: Centroids, move: np.ndarray | None, keep: int, width: int):
    """Vectors with the bounds of the round before (none: move is None) to vectors with new ones, and the task's sums."""
    sums = Sums(len(c), width)
    for b in batches:
        b = b.filter(pc.is_valid(b.column("v")))
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            x = matrix(part.column("v"), width)
            if move is None:
                bounds = Bounds.scanned(x, c, keep)
            else:
                bounds = Bounds(part.column("own").to_numpy().copy(), part.column("upper").to_numpy().copy(), _array(part.column("near"), "<i4"), _array(part.column("low"), "<f8"), part.column("rest").to_numpy().copy())
                bounds.moved(move)
                bounds.shrink(keep)
                sums.needed = max(sums.needed, bounds.settle(x, c))
            yield part, x, bounds, sums
    yield None, None, None, sums


def _round(c: Centroids, move: np.ndarray | None, keep: int, width: int):
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("own", pa.int32()), ("upper", pa.float64()), ("near", pa.binary()), ("low", pa.binary()), ("rest", pa.float64()), ("sums", pa.string())])

    def run(batches):
        for part, x, bounds, sums in _pass(batches, c, move, keep, width):
            if part is None:
                if any(sums.count):
                    yield pa.RecordBatch.from_pylist([{"own": task_id(), "sums": sums.text()}], schema=schema)
                continue
            sums.add(bounds.own, x)
            columns = [part.column("vec_id"), part.column("v"), pa.array(bounds.own), pa.array(bounds.upper), _bytes(bounds.near, "<i4"), _bytes(bounds.low, "<f8"), pa.array(bounds.rest), pa.nulls(len(x), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _last(c: Centroids, move: np.ndarray | None, keep: int, width: int):
    schema = pa.schema([("vec_id", pa.int64()), ("own", pa.int32()), ("distance", pa.int64()), ("sums", pa.string())])

    def run(batches):
        for part, x, bounds, sums in _pass(batches, c, move, keep, width):
            if part is None:
                if any(sums.count):
                    yield pa.RecordBatch.from_pylist([{"own": task_id(), "sums": sums.text()}], schema=schema)
                continue
            squared = c.to_some(x, bounds.own[:, None])[:, 0]
            if int(squared.max()) >= 2**63:
                raise DistanceOverflow("DISTANCE_OVERFLOW: a squared distance doesn't fit in a long")
            sums.count = [1] * len(c)
            sums.add_distances(bounds.own, squared)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(bounds.own), pa.array(squared.astype(np.int64)), pa.nulls(len(x), pa.string())], schema=schema)

    return run


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row for each vector.

    First centroids are the ``k`` vectors with the smallest sha256 of ``seed:vec_id``.
    """
    spark = df.sparkSession
    rows = clean(df, id_col, vec_col, lambda x: whole(x, scale), zero=True).where(F.length("v") == 8 * width)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select("v", order.alias("by")).orderBy("by", "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], EMPTY)
    c = Centroids([[int(v) for v in np.frombuffer(bytes(r.v), "<f8")] for r in first])
    k = len(c)
    keep, least = min(-(-k // 4), k - 1), min(-(-k // 8), k - 1)
    state, move = rows, None
    for done in range(rounds):
        after = stored(state.mapInArrow(_round(c, move, keep, width), STATE))
        if done:
            discard(state)
        state = after
        sums = added(state, k, width)
        new = Centroids([[t // sums.count[j] for t in sums.total[j]] if sums.count[j] else c.rows[j] for j in range(k)])
        if done:
            keep = max(least, min(keep, sums.needed))
        move = c.moves(new)
        c, stands = new, new.rows == c.rows
        if stands:  # no later round changes anything
            break
    last = stored(state.mapInArrow(_last(c, move, keep, width), LAST))
    if state is not rows:
        discard(state)
    inertia = added(last, k, width).inertia
    if sum(inertia) >= 2**63:
        raise DistanceOverflow("DISTANCE_OVERFLOW: the sum of all squared distances doesn't fit in a long")
    facts = [(j, inertia[j], sum(inertia), hashlib.sha256(",".join(map(str, c.rows[j])).encode()).hexdigest()) for j in range(k)]
    known = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # k rows
    return last.where("vec_id IS NOT NULL").select("vec_id", F.col("own").alias("cluster"), "distance").join(known, "cluster").select([f.split()[0] for f in EMPTY.split(", ")])
