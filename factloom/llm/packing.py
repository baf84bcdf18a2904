"""Packing documents into token windows by multiway differencing.

Every document is encoded, closed with an end id and cut: whole windows come first, and
the remainder is halved again and again. Remainders are gathered, in each task, into
blocks that nearly fill a number of windows, and the Karmarkar-Karp method deals the
pieces of a block: it keeps partial partitions (one sum per window) in a heap by their
spread, and merges the two widest so that the large sums of one meet the small sums of
the other. Sums come out nearly equal. Where a window still exceeds its capacity, the
block is dealt again over one more window.

No row is shuffled: a task packs what it reads, and leaves at most a part of one window
unfilled. Ids of sequences are made of the task and a count, so a task that is run again
makes the same ones.

Null and empty texts give one piece, the end id. Very long texts give whole windows of their
own. Rows with a repeated or null id, and equal texts, are packed each by itself. Partial
partitions of equal spread are merged in the order in which they came up. Other columns,
whatever their names, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, slices, task_id, texts, tokenizer_path

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_tokens long"
)
_ENCODERS: dict = {}
#: One remainder in FINE is halved down to pieces of LEAST_PIECE, the others to COARSE.
FINE, LEAST_PIECE, COARSE = 3, 6, 200


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, and their bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level vocabulary file, equal to those of the tokenizers library.

    The merges run in tiktoken, which reads the same vocabulary as ranks and is several
    times as fast; a dictionary of known words before it costs more than it saves.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in alphabet for c in token)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for token in self.special:
            ranks.pop(token.encode(), None)
        self.core = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def encode(self, text: str) -> np.ndarray:
        plain = lambda x: array("I", self.core.encode_ordinary(x)).tobytes()
        if any(s in text for s in self.special):
            raw = b"".join(array("I", [self.special[x]]).tobytes() if x in self.special else plain(x) for x in self.split.split(text) if x)
        else:
            raw = plain(text)
        return np.frombuffer(raw, dtype="<u4")


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def halved(length: int, least: int) -> list[int]:
    """A remainder as pieces of half, a quarter, an eighth ... of its length."""
    out = []
    while length >= 2 * least:
        out.append((length + 1) // 2)
        length //= 2
    return [*out, length] if length else out


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Items dealt to windows by Karmarkar-Karp multiway differencing; lists of positions."""
    if windows == 1:
        return [list(range(len(sizes)))]
    empty: list = [None] * (windows - 1)
    heap = [(-s, i, [s, *[0] * (windows - 1)], [i, *empty]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a_sums, a_sets = heapq.heappop(heap)
        _, _, b_sums, b_sets = heapq.heappop(heap)
        merged = sorted(
            ((x + y, s if t is None else t if s is None else (s, t)) for x, y, s, t in zip(a_sums, reversed(b_sums), a_sets, reversed(b_sets))),
            key=lambda m: -m[0],
        )
        low = merged[-1][0]  # only differences matter
        tick += 1
        heapq.heappush(heap, (low - merged[0][0], tick, [m[0] - low for m in merged], [m[1] for m in merged]))
    out = []
    for top in heap[0][3] if heap else [None] * windows:
        items, stack = [], [top]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            elif x is not None:
                items.append(x)
        out.append(items)
    return out


def deal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows within capacity: one more window each time that a sum exceeds it."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = differencing(sizes, windows)
        if all(sum(sizes[i] for i in w) <= capacity for w in dealt):
            return [w for w in dealt if w]
        windows += 1


class Packer:
    """Packs the documents of one task."""

    def __init__(self, capacity: int, block_windows: int, slack: int, base: int, end_id: int):
        self.capacity, self.end_id, self.next = capacity, end_id, base
        self.full = block_windows * (capacity - slack)
        self.open: list[tuple] = []
        self.held = self.seen = 0
        self.rows: list[tuple] = []

    def sequence(self, pieces: list[tuple]) -> None:
        total, at = sum(p[2] for p in pieces), 0
        for doc, start, length, ids, tokens in pieces:
            self.rows.append((doc, start, length, zlib.crc32(ids.tobytes()), tokens, self.next, at, total))
            at += length
        self.next += 1

    def block(self) -> None:
        if self.open:
            for window in deal([p[2] for p in self.open], self.capacity):
                self.sequence([self.open[i] for i in sorted(window)])
        self.open, self.held = [], 0

    def add(self, doc, ids: np.ndarray) -> None:
        ids = np.append(ids, np.uint32(self.end_id)).astype("<u4")
        n, at = len(ids), 0
        while n - at >= self.capacity:
            self.sequence([(doc, at, self.capacity, ids[at : at + self.capacity], n)])
            at += self.capacity
        self.seen += 1
        for size in halved(n - at, LEAST_PIECE if self.seen % FINE == 0 else COARSE):
            while size:  # the piece that would overfill the block is cut
                take = min(size, self.full - self.held)
                self.open.append((doc, at, take, ids[at : at + take], n))
                self.held, at, size = self.held + take, at + take, size - take
                if self.held >= self.full:
                    self.block()

    def drain(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = 1024,
    block_windows: int = 12,
    slack: int = 4,
    end_id: int = 0,
) -> DataFrame:
    """Rows of pieces: every token of every document in exactly one sequence.

    block_windows: how many windows are balanced together; slack: tokens that each of them
    may stay short of its capacity, so that near-equal sums fit.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    schema = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])

    def run(batches):
        enc = encoder(path)
        packer = Packer(capacity, block_windows, slack, task_id() << 36, end_id)

        def out():
            rows = packer.drain()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(schema), schema=schema)

        for part in slices(batches):
            for doc, text in zip(part.column(0).to_pylist(), texts(part.column(1))):
                packer.add(doc, enc.encode(text))
            yield out()
        packer.block()
        yield out()

    return id_text(df, id_col, text_col).mapInArrow(run, PIECES)
