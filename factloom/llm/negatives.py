"""Hard negatives by bit-sliced integer products.

Vectors are made whole numbers (floor(scale * x)). A candidate's components are cut into
bit-planes (two's complement), and an anchor's inner product with it is built from the most
significant plane down: after each plane the score lies in an interval, between what the
planes so far give with all bits below unset under the anchor's positive components and set
under its negative ones, and the other way round. Each plane halves the interval. A candidate
whose interval can't reach any score that is still wanted is dropped, and takes no part in the
planes below; those that are left after the last plane have their exact score.

1. Positives: for each anchor the best rows of its own label. Wanted are scores that reach the
   last of the best so far.
2. Negatives: for each anchor and positive the best rows of other labels in a range of scores
   that the positive's score gives. Wanted are scores in the range of any of the anchor's
   positives that reach the last of its best so far; both ends of the intervals count.

Candidates are stored in blocks by a hash and never shuffled. Anchors come to them in rounds
of bounded bytes, which are broadcast. In a round a small share of the blocks is passed first
(``waves``): its best give thresholds that the other blocks must reach, so that what tasks hand
over for an anchor grows with the square root of the number of blocks.

Sums are exact: doubles below 2**53, else Python's integers. A score in the result must fit in a
long: one that doesn't ends the query with the error SCORE_OVERFLOW.

Rows without an id, without a label or without a vector, and vectors with null or non-finite
components take no part. A vector's dimension is its own: a shorter one, also an empty one,
counts as filled up with zeros. Rows that share an id are candidates each for itself, and
anchors each for itself, but none is its own id's positive. Ties go to the smaller id, then to
the row that was read first. Anchors without a positive, and positives without a negative,
give no row. Other columns, whatever their names, are not looked at. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, stored
from .topk import as_column, whole
from .vectors import ROUND_BYTES, best, blocks, matrix

EMPTY = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Candidates and anchors that are compared together.
STRETCH, TOGETHER = 2048, 256
#: Rows of a block, at least.
LEAST_BLOCK = 2048


def clean(df: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """Stored rows (row, vec_id, label, v as little-endian doubles, h) of the rows that take part; h spreads them."""
    bounded_batches(df.sparkSession)
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.binary())])

    def run(batches):
        for b in batches:
            ids, labels, out = b.column("vec_id"), b.column("label"), []
            lists = b.column("v")
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<f8", copy=False)  # null components are NaN here
            for i in np.flatnonzero(pc.is_valid(lists).to_numpy(zero_copy_only=False)).tolist():
                x = flat[offsets[i] : offsets[i + 1]]
                if np.isfinite(x).all():
                    out.append((i, whole(x, scale).tobytes()))
            at = pa.array([i for i, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), labels.take(at), pa.array([v for _, v in out], pa.binary())], schema=schema)

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    found = rows.where("vec_id IS NOT NULL AND label IS NOT NULL").mapInArrow(run, "vec_id long, label long, v binary")
    found = found.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v")
    return stored(found.withColumn("h", F.xxhash64("row")))


class Anchors:
    """The anchors of a round: a bounded number of rows."""

    def __init__(self, rows: list, width: int):
        self.row = np.array([r.row for r in rows], dtype=np.int64)
        self.ids = np.array([r.vec_id for r in rows], dtype=np.int64)
        self.label = np.array([r.label for r in rows], dtype=np.int64)
        self.x = matrix(pa.array([bytes(r.v) for r in rows], pa.binary()), width)


def as_integers(x: np.ndarray) -> np.ndarray:
    """Whole numbers held as doubles, in a type that has bits."""
    if not x.size or np.abs(x).max() < 2**62:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


class Sliced:
    """Candidates as bit-planes, most significant first."""

    def __init__(self, x: np.ndarray):
        self.x = as_integers(x)
        most = max((int(v) if v >= 0 else ~int(v) for v in (self.x.max(initial=0), self.x.min(initial=0))))
        self.bits = most.bit_length() + 1  # with the sign
        self.made: dict[int, np.ndarray] = {}

    def plane(self, p: int, exact) -> np.ndarray:
        """Bit ``p`` of each component."""
        if exact is object:
            return ((self.x >> p) & 1).astype(object)
        if p not in self.made:
            self.made[p] = ((self.x >> p) & 1).astype(exact)
        return self.made[p]

    def weight(self, p: int) -> int:
        """What a bit counts; the sign's is negative."""
        return -(1 << p) if p == self.bits - 1 else 1 << p


def products(q: np.ndarray, sliced: Sliced, exact, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(anchor, candidate, score) of the pairs whose score lies between the anchor's ``low`` and ``high``, and how many plane products that took.

    alive: which pairs are wanted at all. q: whole numbers of the type ``exact``; low and high in floats.
    """
    plus, minus = np.where(q > 0, q, 0).sum(1), np.where(q < 0, q, 0).sum(1)
    n, d = sliced.x.shape
    a, c = np.nonzero(alive)
    partial, took = None, 0
    for p in range(sliced.bits - 1, -1, -1):
        plane = sliced.plane(p, exact)
        if len(a) * 32 > alive.size:  # one matrix product is cheaper than picking the pairs
            step = (q @ plane.T)[a, c]
            took += alive.size
        else:
            step = np.empty(len(a), dtype=exact)
            most = max(1, (1 << 20) // max(d, 1))
            for at in range(0, len(a), most):
                i, j = a[at : at + most], c[at : at + most]
                step[at : at + most] = (q[i] * plane[j]).sum(1)
            took += len(a)
        weighted = step * sliced.weight(p)
        score = weighted if partial is None else partial + weighted
        below = (1 << p) - 1  # what the planes below can count for a component
        keep = (score + below * plus[a] >= low[a]) & (score + below * minus[a] <= high[a])
        keep = np.asarray(keep, bool)
        a, c, partial = a[keep], c[keep], score[keep]
        if not len(a):
            break
    return a, c, partial if partial is not None else np.zeros(0, exact), took


def exact_kind(top: float, width: int) -> str:
    """double, or decimal(38,0) for Python's integers. Partial sums and the intervals' ends stay below four times the greatest product."""
    return "double" if 4 * (int(top) + 1) ** 2 * max(width, 1) < 2**53 else "decimal(38,0)"


def lowest(least: np.ndarray) -> np.ndarray:
    """Thresholds for doubles that may have been rounded from greater integers."""
    return np.where(np.isfinite(least), least - 4 * np.finfo(float).eps * np.abs(least), least)


def highest(most: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(most), most + 4 * np.finfo(float).eps * np.abs(most), most)


class Finds:
    """The best finds of each slot so far; a slot is an anchor, or an anchor's positive."""

    def __init__(self, slots: int, k: int, exact, least: np.ndarray):
        self.k, self.low = k, least.copy()
        self.owner, self.ids, self.rows, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, exact)

    def add(self, owner: np.ndarray, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        owner, ids, rows, scores = np.r_[self.owner, owner], np.r_[self.ids, ids], np.r_[self.rows, rows], np.r_[self.scores, scores]
        kept = best(owner, ids, scores, self.k)
        self.owner, self.ids, self.rows, self.scores = owner[kept], ids[kept], rows[kept], scores[kept]
        full, counts = np.unique(self.owner, return_counts=True)
        ends, ok = np.cumsum(counts) - 1, counts == self.k
        self.low[full[ok]] = np.maximum(self.low[full[ok]], lowest(self.scores[ends[ok]].astype(float)))


def passed(candidates: DataFrame, sent, kind: str, width: int, k: int, slots_of: Callable) -> DataFrame:
    """(slot, row, vec_id, score) of each task's best k for each slot.

    slots_of(value of the broadcast) gives (anchors, slot's anchor, slot's low, slot's high, thresholds, same label).
    """

    def run(batches):
        anchors, of, low, high, known, same = slots_of(sent.value)
        exact = np.float64 if kind == "double" else object
        q = anchors.x if kind == "double" else as_integers(anchors.x).astype(object)
        # thresholds in doubles, rounded outwards; what is kept is held against the numbers themselves
        finds = Finds(len(of), k, exact, np.maximum(lowest(low.astype(float)), known))
        ceiling = highest(high.astype(float))
        for b in batches:
            for at in range(0, b.num_rows, STRETCH):
                part = b.slice(at, STRETCH)
                ids, rows, labels = (part.column(n).to_numpy() for n in ("vec_id", "row", "label"))
                sliced = Sliced(matrix(part.column("v"), width))
                for first in range(0, len(anchors.ids), TOGETHER):
                    who = slice(first, first + TOGETHER)
                    lo, hi = np.searchsorted(of, [first, first + TOGETHER])
                    if lo == hi:
                        continue
                    # an anchor wants what any of its slots wants
                    own, starts = np.unique(of[lo:hi], return_index=True)
                    wanted = np.zeros(len(anchors.ids[who]), bool)
                    wanted[own - first] = True
                    least, most = np.full(len(wanted), np.inf), np.full(len(wanted), -np.inf)
                    least[own - first] = np.minimum.reduceat(finds.low[lo:hi], starts)
                    most[own - first] = np.maximum.reduceat(ceiling[lo:hi], starts)
                    alive = (anchors.label[who, None] == labels) == same
                    alive &= wanted[:, None] & (anchors.ids[who, None] != ids)
                    a, c, score, _ = products(q[who], sliced, exact, alive, least, most)
                    if not len(a):
                        continue
                    slots, pairs = spread(a + first, of, lo, hi)
                    s = score[pairs]
                    fits = np.asarray((s >= finds.low[slots]) & (s <= high[slots]) & (s >= low[slots]), bool)
                    finds.add(slots[fits], ids[c[pairs[fits]]], rows[c[pairs[fits]]], s[fits])
        if len(finds.owner):
            yield pa.RecordBatch.from_arrays([pa.array(finds.owner), pa.array(finds.rows), pa.array(finds.ids), as_column(finds.scores, kind)], names=["slot", "row", "vec_id", "score"])

    return candidates.select("row", "vec_id", "label", "v").mapInArrow(run, f"slot long, row long, vec_id long, score {kind}")


def spread(anchor: np.ndarray, of: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of these anchors, (slot, pair) for each of the anchor's slots; slots are sorted by anchor."""
    left, right = np.searchsorted(of[lo:hi], anchor), np.searchsorted(of[lo:hi], anchor, "right")
    spans = right - left
    slots = np.repeat(left + lo, spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
    return slots, np.repeat(np.arange(len(anchor)), spans)


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def wave_ends(blocks_: int) -> list[int]:
    """The hash up to which a first share of the blocks lies: about the square root of their number."""
    if blocks_ < 4:
        return []
    share = max(1, round(blocks_**0.5)) / blocks_
    return [int(-(2**63) + share * 2**64)]


def in_waves(candidates: DataFrame, ends: list[int], spark, value: tuple, kind: str, width: int, k: int, slots_of: Callable, slots: int) -> DataFrame:
    """The best k of each slot over all candidates; what the waves before gave is the threshold of the next."""
    known, before = np.full(slots, -np.inf), None
    bounds = [None, *ends, None]
    for low, high in zip(bounds, bounds[1:]):
        part = candidates if low is None else candidates.where(F.col("h") >= low)
        part = part if high is None else part.where(F.col("h") < high)
        sent = spark.sparkContext.broadcast((*value, known))
        found = passed(part, sent, kind, width, k, slots_of)
        found = ranked(found if before is None else before.drop("rank").unionByName(found), k)
        after = stored(found)
        sent.destroy()
        if before is not None:
            discard(before)
        before = after
        if high is not None:
            known = np.full(slots, -np.inf)
            for r in before.where(F.col("rank") == k).select("slot", "score").toLocalIterator():  # one number a slot
                known[r.slot] = lowest(np.float64(r.score))
    return before


def mine(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label: Column | None = None,
    every: int = 50,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    percent: tuple[int, int] = (50, 95),
    block_rows: int = 200_000,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``. percent: a negative's score lies
    between these shares of the positive's. label: the label's column (default ``label``).
    """
    spark = df.sparkSession
    rows = clean(df, id_col, vec_col, F.col("label") if label is None else label, scale)
    size = rows.agg(F.count("*").alias("n"), F.max(F.length("v")).alias("bytes")).first()
    if not size.n:
        return spark.createDataFrame([], EMPTY)
    width = max(1, size.bytes // 8)
    kind = exact_kind(greatest(rows), width)
    candidates = blocks(rows, size.n, block_rows, LEAST_BLOCK, "h", "row")
    ends = wave_ends(max(1, size.n // block_rows))
    anchors = rows.where(F.col("vec_id") % every == 0)
    rounds = max(1, -(-anchors.count() * 8 * width // round_bytes))
    out = []
    for r in range(rounds):
        held = anchors.where(F.pmod(F.xxhash64("row", F.lit(7)), F.lit(rounds)) == r).orderBy("vec_id", "row").collect()  # round_bytes of vectors
        if held:
            out.append(one_round(spark, candidates, Anchors(held, width), ends, kind, width, positives, negatives, percent))
    if not out:
        return spark.createDataFrame([], EMPTY)
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def greatest(rows: DataFrame) -> float:
    """The greatest component, without its sign."""

    def run(batches):
        top = 0.0
        for b in batches:
            for v in b.column("v").to_pylist():
                if v:
                    top = max(top, float(np.abs(np.frombuffer(v, "<f8")).max()))
        yield pa.RecordBatch.from_arrays([pa.array([top])], names=["top"])

    return rows.select("v").mapInArrow(run, "top double").agg(F.max("top")).first()[0] or 0.0


def one_round(spark, candidates: DataFrame, anchors: Anchors, ends: list[int], kind: str, width: int, positives: int, negatives: int, percent: tuple[int, int]) -> DataFrame:
    n = len(anchors.ids)

    def best_of_label(value):
        held, known = value
        return held, np.arange(n), np.full(n, -np.inf), np.full(n, np.inf), known, True

    found = in_waves(candidates, ends, spark, (anchors,), kind, width, positives, best_of_label, n)
    # a bounded number of rows for each of the round's anchors
    own = sorted((r.slot, r.rank, r.row, r.vec_id, int(r.score)) for r in found.toLocalIterator())
    slots = [s for s in own if low_and_high(s[4], percent)]
    of = np.array([s[0] for s in slots], dtype=np.int64)
    limits = [low_and_high(s[4], percent) for s in slots]
    low, high = (np.array([v[end] for v in limits], dtype=float if kind == "double" else object) for end in (0, 1))

    def in_ranges(value):
        held, of_, low_, high_, known = value
        return held, of_, low_, high_, known, False

    if not slots:
        return spark.createDataFrame([], EMPTY)
    far = in_waves(candidates, ends, spark, (anchors, of, low, high), kind, width, negatives, in_ranges, len(slots))
    facts = [(j, int(anchors.ids[s[0]]), s[3], str(s[4])) for j, s in enumerate(slots)]
    known = spark.createDataFrame(facts, "slot long, anchor_id long, positive_id long, positive string")
    score = lambda c: F.when(c.between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)")), c).otherwise(F.raise_error("SCORE_OVERFLOW: a score doesn't fit in a long")).cast("long")
    both = far.join(known, "slot")
    return both.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        score(F.col("positive").cast("decimal(38,0)")).alias("positive_score"), score(F.col("score").cast("decimal(38,0)")).alias("negative_score"),
    )


def low_and_high(score: int, percent: tuple[int, int]) -> tuple[int, int] | None:
    """The whole numbers n with percent[0] * score <= 100 * n <= percent[1] * score; None where there is none."""
    low, high = -(-percent[0] * score // 100), percent[1] * score // 100
    return (low, high) if low <= high else None
