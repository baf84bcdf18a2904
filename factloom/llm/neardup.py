"""Near-duplicates by min-max hashing, confirmed on full shingle sets.

A document's set holds its distinct shingles of five words. Under each permutation both
the least and the greatest hash are kept: one evaluation gives two values of the
signature, and each agrees for two sets with the probability of their similarity. Bands of
signature values bring candidates together.

1. Documents with one and the same set are a class, a node of the graph; only one row of
   it goes on.
2. Each bucket (a band's value) offers each member its smallest member: one pair a row,
   never all pairs. In two rounds each node's most resembling pair that would join two
   groups is confirmed on the full sets; a few rounds of pointer jumping name the groups.
3. In a bucket that still holds several groups, the members outside its largest group meet
   all the others: these probe, chunk by chunk, the bucket's members, part by part. Chunks
   and parts are bounded in rows and in bytes, so a bucket of N members of which M probe is
   sent out N * chunks + M * parts times, and no task holds it whole. Signatures come first;
   where two nodes of different groups may be alike, their full sets meet, in the first of
   the bands that they share, and a union-find hands over no more links than there are
   groups to join.
4. All links together are joined into components by rounds of hooking and pointer jumping,
   over the groups that are known by then.

A pair at the threshold of 0.75 is missed by every band with a probability of 1e-10 (42 bands
of three values), and by the comparison of signatures (``resemblance``, seven standard
deviations below the threshold) with one of 1e-10; higher similarities far less. Two that share
several bands meet in the first of them, which whole signature values decide. All that the
bands find is decided on the full sets, which are compared by 64-bit hashes of shingles.

Null and empty texts have no shingles, are linked with nothing and are kept. Rows that repeat
an id stand for one document each, but all of them carry the id's component: the id links
them. Rows without an id are linked with nothing: their component is null and they are kept.
Very long texts are read whole. Ties, as of pairs that resemble each other equally, go to the
smaller node; components don't depend on them. Other columns, whatever their names, are
not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, id_text, parallelism, shared_dir, slices, stored, task_id, texts

SIGNED = "doc_id long, n_shingles long, set_key binary, signature binary, bands array<long>"
#: Values of a signature as they are kept: whole, as bands are made of them. With fewer bits two
#: sets may seem to share a band that they don't, and would be passed over where they do meet.
KEPT = np.dtype("<u4")
M64 = np.uint64
MIX = (M64(0xBF58476D1CE4E5B9), M64(0x94D049BB133111EB))
#: Bytes of full sets that a task holds to probe with.
PROBE_BYTES = 32 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> M64(30))) * MIX[0]
    x = (x ^ (x >> M64(27))) * MIX[1]
    return x ^ (x >> M64(31))


class Words(dict):
    """Hashes of words, kept for a bounded number of short ones."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 100_000:
                self.clear()
            self[word] = value
        return value


_WORDS = Words()


def rolled(h: np.ndarray, k: int, short: bool) -> np.ndarray:
    """Hashes of each k words in a row."""
    out = np.zeros(len(h) - k + 1, M64)
    for i in range(k):
        out = mixed(out + h[i : len(h) - k + 1 + i] + M64(i + 1 + (1000 * k if short else 0)))
    return out


def shingle_sets(many: list[str], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles.

    bytes.lower() changes A-Z alone, and bytes.split() parts at the six ASCII white-space
    characters: that is how words are defined here.
    """
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in many]
    h = np.fromiter(map(_WORDS.__getitem__, chain.from_iterable(words)), M64, sum(map(len, words)))
    whole = rolled(h, n, False) if len(h) >= n else np.zeros(0, M64)
    out, at = [], 0
    for own in map(len, words):
        out.append(np.unique(whole[at : at + own - n + 1]) if own >= n else rolled(h[at : at + own], own, True) if own else np.zeros(0, M64))
        at += own
    return out


def shingles(text: str) -> np.ndarray:
    return shingle_sets([text])[0]


def key_of(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


class Signer:
    """permutations of 32-bit hashes; bands of ``rows`` values, least and greatest by turns."""

    def __init__(self, permutations: int = 64, rows: int = 3, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**63, permutations, dtype=np.uint64) * M64(2) + M64(1)
        self.b = rng.integers(0, 2**63, permutations, dtype=np.uint64)
        self.rows = rows
        # the values of a band come from different permutations
        order = np.arange(2 * permutations).reshape(2, permutations)
        order[1] = np.roll(order[1], permutations // 2)
        bands = 2 * permutations // rows
        self.order = order.T.reshape(-1)[: bands * rows].reshape(-1, rows)

    def sign(self, sets: list[np.ndarray], most: int = 1 << 16) -> np.ndarray:
        """A row for each set (none is empty): least values under each permutation, then greatest, 32 bits each."""
        out = np.empty((len(sets), 2 * len(self.a)), np.uint32)
        at = 0
        while at < len(sets):
            end, size = at + 1, len(sets[at])
            while end < len(sets) and size + len(sets[end]) <= most:
                size, end = size + len(sets[end]), end + 1
            flat = np.concatenate(sets[at:end])
            starts = np.cumsum([0, *map(len, sets[at : end - 1])])
            for i, (a, b) in enumerate(zip(self.a, self.b)):
                h = ((flat * a + b) >> M64(32)).astype(np.uint32)
                out[at:end, i] = np.minimum.reduceat(h, starts)
                out[at:end, len(self.a) + i] = np.maximum.reduceat(h, starts)
            at = end
        return out

    def bands(self, signatures: np.ndarray) -> np.ndarray:
        parts = signatures[:, self.order]
        out = np.zeros(parts.shape[:2], M64)
        for j in range(self.rows):
            out = mixed(out + parts[:, :, j].astype(M64) + M64(j + 1))
        return mixed(out + np.arange(parts.shape[1], dtype=M64)).astype(np.int64)


def signed(docs: DataFrame, signer: Signer) -> DataFrame:
    """Per row: size and key of the set, the signature, and the bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for part in slices(batches):
            sets = shingle_sets(texts(part.column(1)))
            full = [i for i, s in enumerate(sets) if len(s)]
            signatures = signer.sign([sets[i] for i in full])
            bands = signer.bands(signatures)
            columns: list[list] = [[None] * len(sets) for _ in range(3)]
            for i, sig, own in zip(full, signatures.astype(KEPT, copy=False), bands.tolist()):
                columns[0][i], columns[1][i], columns[2][i] = key_of(sets[i]), sig.tobytes(), own
            arrays = [part.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(c, t) for c, t in zip(columns, schema.types[2:]))]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return docs.mapInArrow(run, SIGNED)


class Bloom:
    """A set of ids in a bounded number of bits: says yes to all of its ids and to few others."""

    #: Bits for an id, hash functions, and the most bits that there are.
    EACH, TIMES, MOST = 16, 4, 1 << 28

    def __init__(self, size: int):
        self.size = size
        self.bits = np.zeros(size // 8, np.uint8)

    @classmethod
    def sized(cls, ids: int) -> int:
        return min(cls.MOST, max(1 << 16, 1 << (cls.EACH * max(ids, 1) - 1).bit_length()))

    def places(self, ids: np.ndarray) -> Iterator[np.ndarray]:
        x = ids.astype(np.int64).view(M64)
        for n in range(self.TIMES):
            yield mixed(x + M64(0x9E3779B97F4A7C15 * (n + 1) % 2**64)) & M64(self.size - 1)

    def add(self, ids: np.ndarray) -> None:
        for at in self.places(ids):
            np.bitwise_or.at(self.bits, at >> M64(3), np.left_shift(1, at & M64(7)).astype(np.uint8))

    def holds(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids), bool)
        for at in self.places(ids):
            out &= (self.bits[at >> M64(3)] >> (at & M64(7)).astype(np.uint8)) & 1 == 1
        return out


def bloom_of(ids: DataFrame, column: str) -> Bloom:
    """Of a column of ids. Its tasks' bits meet in four tasks and then on the driver, Bloom.MOST bits each at most."""
    size = Bloom.sized(ids.count())

    def first(batches):
        own = Bloom(size)
        for b in batches:
            own.add(b.column(0).to_numpy())
        yield packed(own.bits)

    def second(batches):
        own = Bloom(size)
        for b in batches:
            for data in b.column(1):
                own.bits |= unpacked(data.as_py())
        yield packed(own.bits)

    def packed(bits: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([task_id()], pa.int64()), pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["task", "bits"])

    def unpacked(data: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(data), np.uint8)

    kind = "task long, bits binary"
    found = Bloom(size)
    for r in ids.select(column).coalesce(32).mapInArrow(first, kind).repartition(4, "task").mapInArrow(second, kind).toLocalIterator():
        found.bits |= unpacked(bytes(r.bits))
    return found


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingle_set) of the wanted nodes (node, first, set_key); first is an id of the node's rows.

    Texts aren't shuffled: a Bloom filter of the ids picks those whose sets are computed
    again, whole, and only sets are joined.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bloom_of(wanted, "first"))

    def run(batches):
        for batch in batches:
            picked = batch.filter(pa.array(sent.value.holds(batch.column(0).to_numpy())))
            for part in slices([picked]):
                sets = shingle_sets(texts(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array([key_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_key", "shingle_set"])

    sets = docs.select("doc_id", "text").mapInArrow(run, "set_key binary, shingle_set binary").join(wanted.select("node", "set_key"), "set_key")
    return sets.groupBy("node").agg(F.first("shingle_set").alias("shingle_set"))


def alike(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are alike on their full sets."""

    def run(batches):
        for part in slices(batches, 256):
            out = []
            for a, b, x, y in zip(*(part.column(k).to_pylist() for k in ("a", "b", "x", "y"))):
                x, y = np.frombuffer(x, M64), np.frombuffer(y, M64)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and alike(len(np.intersect1d(x, y, True)), len(x), len(y), percent):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingle_set").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingle_set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def resembling(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs with the share of signature values in which they agree, where that is at least ``least``."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), KEPT).reshape(b.num_rows, -1) for k in ("sa", "sb"))
                close = (a == c).mean(1)
                keep = pa.array(close >= least)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep), pa.array(close).filter(keep)], names=["a", "b", "close"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, close double")


class Union:
    def __init__(self):
        self.up: dict = {}

    def top(self, x):
        while self.up.setdefault(x, x) != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b) -> bool:
        a, b = self.top(a), self.top(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def named(nodes: DataFrame, column: str, label: DataFrame, name: str) -> DataFrame:
    """The rows with the group of a node: its label, or itself where it has none."""
    known = label.select(F.col("node").alias(column), F.col("label").alias("__label"))
    return nodes.join(known, column, "left").withColumn(name, F.coalesce("__label", column)).drop("__label")


def jumped(parents: DataFrame, times: int = 3) -> DataFrame:
    """(node, label) with each label replaced by its own label, so many times; labels are smaller than their nodes."""
    for _ in range(times):
        up = parents.select(F.col("node").alias("label"), F.col("label").alias("above"))
        parents = parents.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"))
    return parents


def grouped(links: DataFrame, label: DataFrame | None) -> DataFrame:
    """Groups after the links (a, b) are added, as far as a few jumps go; nodes of one group are connected.

    Each group is hooked to the smallest group that a link joins it to.
    """
    if label is None:
        return jumped(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    over = named(named(links, "a", label, "la"), "b", label, "lb").where("la <> lb")
    hooks = over.groupBy(F.greatest("la", "lb").alias("node")).agg(F.min(F.least("la", "lb")).alias("label"))
    hooks = jumped(hooks, 2)
    up = hooks.select(F.col("node").alias("label"), F.col("label").alias("above"))
    moved = label.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"))
    return moved.unionByName(hooks.join(label.select("node"), "node", "left_anti"))


def dealt_out(members: DataFrame, signs: DataFrame, most: int) -> DataFrame:
    """Members of the buckets with several groups, in chunks that probe and parts that are probed.

    members: (band, pos, node, label). Rows (band, chunk, part, role, ...): role 0 probes, role 1 is probed.
    """
    sizes = members.join(signs.select("node", "n_shingles"), "node")
    groups = sizes.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("words"))
    buckets = groups.groupBy("band").agg(
        F.count("*").alias("labels"),
        F.sum("n").alias("n"),
        F.max(F.struct("n", "label")).alias("top"),
        F.sum("words").alias("words"),
        F.max_by("words", F.struct("n", "label")).alias("top_words"),
    )
    split = buckets.where("labels > 1").select(
        "band",
        F.col("top.label").alias("many"),
        F.ceil(F.col("n") / most).cast("int").alias("parts"),
        F.greatest(F.ceil((F.col("n") - F.col("top.n")) / most), F.ceil(8 * (F.col("words") - F.col("top_words")) / PROBE_BYTES)).cast("int").alias("chunks"),
    )
    rows = members.join(split, "band")
    probing = rows.where("label <> many").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    probing = probing.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("role", F.lit(0))
    probed = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    probed = probed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("role", F.lit(1))
    wanted = ["band", "chunk", "part", "role", "pos", "node", "label"]
    return probing.select(wanted).unionByName(probed.select(wanted))


PLACE = ("band", "chunk", "part")


def _runs(batches, columns: tuple[str, ...], most: int) -> Iterator[tuple[tuple, int, list[tuple]]]:
    """(place, role, rows) from batches sorted by place and role; the probed come at most ``most`` at a time."""
    last, held = None, []
    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in (*PLACE, "role", *columns))):
            if row[:4] != last or last[3] and len(held) >= most:
                if held:
                    yield last[:3], last[3], held
                last, held = row[:4], []
            held.append(row[4:])
    if held:
        yield last[:3], last[3], held


def _placed(place: tuple, role: int, rows: list[tuple[int, int]]) -> pa.RecordBatch:
    n = len(rows)
    values = [pa.array([place[0]] * n, pa.int64()), *(pa.array([v] * n, pa.int32()) for v in (place[1], place[2], role)), *(pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1))]
    return pa.RecordBatch.from_arrays(values, names=[*PLACE, "role", "node", "label"])


def met(equal: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Which pairs share one of the bands ``before``, and meet there; equal: values in which their signatures agree."""
    return equal[:, before].all(2).any(1) if len(before) else np.zeros(len(equal), bool)


def live_members(rows: DataFrame, signer: Signer, least: float, n: int) -> DataFrame:
    """The rows (place, role, node, label) that a row of the other role and another label resembles, by signature."""

    def run(batches):
        probes = where = labels = sig = live = None

        def finished():
            if probes is not None and live.any():
                yield _placed(where, 0, [probes[i][:2] for i in np.flatnonzero(live)])

        for place, role, held in _runs(batches, ("node", "label", "signature", "pos"), 64):
            if role == 0:
                yield from finished()
                probes, where = held, place
                labels, live = np.array([h[1] for h in held]), np.zeros(len(held), bool)
                sig = np.frombuffer(b"".join(h[2] for h in held), KEPT).reshape(len(held), -1)
                continue
            if place != where:
                continue
            out, before = [], signer.order[: held[0][3]]
            for node, label, signature, _ in held:
                own = np.frombuffer(signature, KEPT)
                near = np.flatnonzero(labels != label)
                equal = sig[near] == own
                close = equal.mean(1) >= least
                near, equal = near[close], equal[close]
                near = near[~met(equal, before)]
                if len(near):
                    live[near] = True
                    out.append((node, label))
            if out:
                yield _placed(place, 1, out)
        yield from finished()

    dealt = rows.repartition(n, *PLACE).sortWithinPartitions(*PLACE, "role", "node")
    return dealt.select(*PLACE, "role", "node", "label", "signature", "pos").mapInArrow(run, "band long, chunk int, part int, role int, node long, label long")


def links_within(rows: DataFrame, percent: int, n: int) -> DataFrame:
    """Links between labels of a place, decided on full sets: at most one for each that merges.

    The probing sets are held, the probed ones stream past them.
    """

    def run(batches):
        where = probes = flat = owner = sizes = union = None
        for place, role, held in _runs(batches, ("node", "label", "shingle_set"), 32):
            if role == 0:
                where, probes, union = place, held, Union()
                sets = [np.frombuffer(h[2], M64) for h in held]
                sizes = np.array([len(s) for s in sets])
                flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
                continue
            if place != where:
                continue
            out = []
            for node, label, data in held:
                if all(union.top(p[1]) == union.top(label) for p in probes):
                    continue
                own = np.frombuffer(data, M64)
                low, high = np.searchsorted(flat, own), np.searchsorted(flat, own, "right")
                spans = high - low
                at = np.repeat(low - np.r_[0, np.cumsum(spans)[:-1]], spans) + np.arange(spans.sum())
                common = np.bincount(owner[at], minlength=len(sizes))
                for i in np.flatnonzero(alike(common, sizes, len(own), percent)).tolist():
                    if union.join(probes[i][1], label):
                        out.append((probes[i][0], node))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    dealt = rows.repartition(n, *PLACE).sortWithinPartitions(*PLACE, "role", "node")
    return dealt.select(*PLACE, "role", "node", "label", "shingle_set").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for each node with a link (a, b); stored.

    Each round points every node at the smallest node among its neighbours' pointers
    (hooking) and at its pointer's pointer (jumping), until nothing changes.
    """
    both = stored(links.union(links.select("b", "a")).toDF("node", "near").where("node <> near").distinct())
    label = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label"))
    before = None
    while True:
        seen = both.join(label.select(F.col("node").alias("near"), "label"), "near").groupBy("node").agg(F.min("label").alias("seen"))
        step = label.join(seen, "node").select("node", "label", F.least("label", "seen").alias("seen"))
        # a node's old pointer learns what the node has learnt
        told = step.where("seen < label").groupBy(F.col("label").alias("node")).agg(F.min("seen").alias("told"))
        step = step.join(told, "node", "left").select("node", "label", F.least("seen", "told").alias("seen"))
        jump = step.select(F.col("node").alias("seen"), F.col("seen").alias("jump"))
        after = stored(step.join(jump, "seen", "left").select("node", F.least("seen", "jump").alias("next"), "label"))
        if before is not None:
            discard(before)
        if after.where("next <> label").isEmpty():
            discard(both)
            return after.select("node", "label")
        before, label = after, after.select("node", F.col("next").alias("label"))


class Graph:
    """What a table's near-duplicates are made of.

    rows: (doc_id, n_shingles, set_key, node, ...) of every row. classes: (node, set_key, first,
    n) of the sets; rows without an id have none. label: (node, label) of the nodes that have
    a partner.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, percent: int, permutations: int, rows: int, resemblance: float, block: int, by_id: bool):
        spark = df.sparkSession
        shared_dir(spark)
        n = parallelism(spark)
        docs = id_text(df, id_col, text_col)
        signer = Signer(permutations, rows)
        made = stored(signed(docs, signer))

        # 1. classes of equal sets; their numbers are hashes, with another seed in the rare case that two meet
        seed = 0
        while True:
            self.rows = made.withColumn("node", F.when(F.col("n_shingles") > 0, F.xxhash64("set_key", F.lit(seed))))
            sized = self.rows.where("node IS NOT NULL AND doc_id IS NOT NULL")
            known = sized.groupBy("node").agg(F.min("set_key").alias("set_key"), F.max("set_key").alias("other"), F.min("doc_id").alias("first"), F.count("*").alias("n"))
            known = stored(known)
            self.classes = known.select("node", "set_key", "first", "n")
            if known.where("set_key <> other").isEmpty():
                break
            discard(known)
            seed += 1

        # 2. buckets of several nodes, and each member with the smallest of its bucket
        bands = sized.select("node", F.posexplode("bands").alias("pos", "band"))
        buckets = bands.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").drop("most")
        members = stored(bands.join(buckets, "band").select("band", "pos", "node", "least").distinct())
        inside = members.select("node").distinct()
        signs = sized.select("node", "n_shingles", "signature").join(inside, "node", "left_semi").groupBy("node").agg(F.max("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
        signs = stored(signs)
        sets = stored(full_sets(docs.where("doc_id IS NOT NULL"), stored(self.classes.join(signs.select("node"), "node", "left_semi"))))
        pairs = members.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
        pairs = pairs.join(signs.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a").join(signs.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
        pairs = stored(resembling(pairs, resemblance))
        links: list[DataFrame] = []
        label = None
        for _ in range(2):
            open_pairs = pairs if label is None else named(named(pairs, "a", label, "la"), "b", label, "lb").where("la <> lb")
            best = open_pairs.groupBy("a").agg(F.min_by("b", F.struct(-F.col("close"), "b")).alias("b"))
            links.append(stored(confirmed(best, sets, percent)))
            old, label = label, stored(grouped(links[-1], label))
            if old is not None:
                discard(old)

        # 3. the buckets that hold more than one group
        inside = stored(named(members.select("band", "pos", "node"), "node", label, "label"))
        placed = dealt_out(inside, signs, block)
        live = stored(live_members(placed.join(signs.select("node", "signature"), "node"), signer, resemblance, n))
        links.append(links_within(live.join(sets, "node"), percent, n))
        if by_id:
            links.append(self.same_ids())

        # 4. components over the groups
        every = links[0]
        for more in links[1:]:
            every = every.unionByName(more)
        over = named(named(every, "a", label, "la"), "b", label, "lb").where("la <> lb").select("la", "lb").distinct().toDF("a", "b")
        top = components(over)
        up = top.select(F.col("node").alias("label"), F.col("label").alias("above"))
        whole = label.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"))
        whole = stored(whole.unionByName(top.join(label.select("node"), "node", "left_anti")))
        roots = whole.select(F.col("label").alias("node")).distinct().join(whole.select("node"), "node", "left_anti")
        self.label = stored(whole.unionByName(roots.withColumn("label", F.col("node"))))
        discard(whole, members, signs, sets, pairs, *links[:2], label, inside, live)

    def repeated(self) -> DataFrame:
        """(doc_id, least): ids whose rows have several sets, or a set and none; the smallest node of each."""
        ids = self.rows.where("doc_id IS NOT NULL").groupBy("doc_id")
        kinds = ids.agg(F.min("node").alias("least"), F.max("node").alias("most"), F.max(F.col("node").isNull()).alias("without"))
        return kinds.where("least <> most OR (without AND least IS NOT NULL)").select("doc_id", "least")

    def same_ids(self) -> DataFrame:
        """Links between the sets of one id."""
        own = self.rows.where("node IS NOT NULL").select("doc_id", "node").join(self.repeated(), "doc_id")
        return own.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()

    def components(self) -> DataFrame:
        """(node, first, component): of nodes with partners or several rows, the smallest id of the component and its node."""
        known = self.classes.join(self.label, "node", "left").where("n > 1 OR label IS NOT NULL").withColumn("label", F.coalesce("label", "node"))
        least = known.groupBy("label").agg(F.min(F.struct("first", "node")).alias("component"))
        return known.join(least, "label").select("node", "first", "component")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 75,
    permutations: int = 64,
    rows: int = 3,
    resemblance: float = 0.48,
    block: int = 2048,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept.

    resemblance: share of agreeing signature values below which two documents aren't compared.
    block: how many members of a bucket probe, and are probed, together.
    """
    g = Graph(df, id_col, text_col, percent, permutations, rows, resemblance, block, by_id=True)
    found = g.components().select("node", F.col("component.first").alias("component_id"))
    # a row without a set takes the component of its id
    out = g.rows.select("doc_id", "n_shingles", "node").join(g.repeated(), "doc_id", "left")
    out = out.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "least"))).join(found, "node", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 75,
    permutations: int = 64,
    rows: int = 3,
    resemblance: float = 0.48,
    block: int = 2048,
) -> DataFrame:
    """The rows, with all their columns, of one document for each group of near-duplicates.

    Groups are made of texts: rows that share an id but not a text are documents of their
    own. Rows without an id can't be compared and stay, as do those without words.
    """
    g = Graph(df, id_col, text_col, percent, permutations, rows, resemblance, block, by_id=False)
    found = g.components()
    kept = g.rows.where("doc_id IS NOT NULL").select("doc_id", "node", "set_key")
    kept = kept.join(found.where(F.col("node") != F.col("component.node")).select("node"), "node", "left_anti")
    # of a set's rows the one with the smallest id stays
    first = kept.join(found.select("node", "first"), "node", "left").where("first IS NULL OR doc_id = first")
    times = g.rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("times"))
    first = stored(first.select("doc_id", "set_key").join(times, "doc_id"))
    key = free_name(df, "__id")
    rows_ = df.join(first.where("times = 1").select(F.col("doc_id").alias(key)), F.col(id_col) == F.col(key), "left_semi").unionByName(df.where(F.col(id_col).isNull()))
    odd = first.where("times > 1")
    if odd.isEmpty():
        return rows_
    # ids that repeat: their rows are told apart by their sets
    mark = free_name(df, "__set")
    several = df.join(odd.select(F.col("doc_id").alias(key)).distinct(), F.col(id_col) == F.col(key), "left_semi")
    several = with_key(several, text_col, mark)
    chosen = odd.where("set_key IS NOT NULL").select(F.col("doc_id").alias(key), F.col("set_key").alias(mark + "_")).distinct()
    whole = several.join(chosen, (F.col(id_col) == F.col(key)) & (F.col(mark) == F.col(mark + "_")), "left_semi").dropDuplicates([id_col, mark])
    empty = several.where(F.col(mark).isNull())
    return rows_.unionByName(whole.drop(mark)).unionByName(empty.drop(mark))


def with_key(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """The rows with the key of their text's set; null where it has no words."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([key_of(s) if len(s) else None for s in shingle_sets(texts(column))], pa.binary())

    return df.withColumn(name, F.arrow_udf(run, "binary")(F.col(text_col)))
