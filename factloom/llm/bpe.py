"""BPE with word ends, through a minimal acyclic transducer.

Frequent words are compiled with their ids into an automaton that shares prefixes and
suffixes (built from sorted words, step by step), whose arcs carry counts so that a walk
gives a word's rank, and the rank its ids. The automaton is a few flat arrays in one
file: each worker maps the file into memory. Words that it doesn't hold are merged
exactly, by the library's own BPE model. A word's ids never depend on its neighbours, so
the result equals that of the library on the whole text.

Counts of words cover every document. A task hands over the words that make up at least
``share`` of its own words: a word with that share of all words reaches it in some task.

What a worker has seen is kept in two dictionaries, of short words only and of a bounded number
of them; the automaton's file is a worker's own, mapped and already unlinked, so that its pages
can be dropped under pressure and nothing is left behind.

Null and empty texts have no ids and decode to an empty string. Very long texts are encoded
whole. Rows with a repeated or null id, and equal texts, are encoded each by itself. Words of
equal count enter the automaton in the order of their letters; ids don't depend on that. Other
columns, whatever their names, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import tempfile
import unicodedata
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices, texts, tokenizer_path
from .packing import byte_alphabet

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Fixed by the vocabulary file: how white-space-free text falls into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: str.split() parts text at these too, the vocabulary's white space doesn't have them.
SEPARATORS = "\x1c\x1d\x1e\x1f"


class Transducer:
    """A minimal acyclic automaton over bytes; a word's rank among all words is its output.

    Arrays: each state's first arc; each arc's label, target and the number of words that
    sort before those behind it; whether a state ends a word; ids by rank.
    """

    NAMES = ("first", "label", "target", "skip", "final", "offsets", "ids")
    KINDS = ("<u4", "u1", "<u4", "<u4", "u1", "<u4", "<u4")

    def __init__(self, parts: list[np.ndarray]):
        self.first, self.label, self.target, self.skip, self.final, self.offsets, self.ids = parts
        self._first, self._target, self._skip, self._final = (memoryview(x) for x in (self.first, self.target, self.skip, self.final))
        self._find = self.label.tobytes().find
        self._offsets, self._ids = memoryview(self.offsets), memoryview(self.ids).cast("B")

    @classmethod
    def build(cls, entries: dict[str, list[int]]) -> Transducer:
        """From words to ids; suffixes that are equal become one state."""
        words = sorted((w.encode(), ids) for w, ids in entries.items())
        register: dict = {}
        states: list[tuple] = []  # (final, ((label, state), ...)) of the finished ones

        def finish(node) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path, before = [[False, []]], b""
        for word, _ in words:
            same = len(os.path.commonprefix([before, word]))
            while len(path) > same + 1:
                done = finish(path.pop())
                path[-1][1].append((before[len(path) - 1], done))
            for _ in word[same:]:
                path.append([False, []])
            path[-1][0] = True
            before = word
        while len(path) > 1:
            done = finish(path.pop())
            path[-1][1].append((before[len(path) - 1], done))
        start = finish(path[0])
        behind = []
        for final, arcs in states:  # targets stand before their sources
            behind.append(int(final) + sum(behind[t] for _, t in arcs))
        first, label, target, skip = [0], [], [], []
        for final, arcs in states:
            passed = int(final)
            for x, t in arcs:
                label.append(x)
                target.append(t)
                skip.append(passed)
                passed += behind[t]
            first.append(len(label))
        first.append(start)  # the last entry names the start state
        offsets = np.cumsum([0, *(len(ids) for _, ids in words)])
        flat = [i for _, ids in words for i in ids]
        values = (first, label, target, skip, [f for f, _ in states], offsets, flat)
        return cls([np.array(v, dtype=k) for v, k in zip(values, cls.KINDS)])

    def rank(self, word: bytes) -> int:
        """The word's rank, or -1."""
        first, find, target, skip = self._first, self._find, self._target, self._skip
        state, rank = first[-1], 0
        for c in word:
            arc = find(c, first[state], first[state + 1])
            if arc < 0:
                return -1
            rank += skip[arc]
            state = target[arc]
        return rank if self._final[state] else -1

    def get(self, word: str) -> bytes | None:
        """The ids of a word that it holds, as little-endian bytes."""
        r = self.rank(word.encode())
        return None if r < 0 else bytes(self._ids[4 * self._offsets[r] : 4 * self._offsets[r + 1]])

    def to_bytes(self) -> bytes:
        parts = [getattr(self, n) for n in self.NAMES]
        head = np.array([len(x) for x in parts], dtype="<u4").tobytes()
        return head + b"".join(x.tobytes() + b"\0" * (-x.nbytes % 4) for x in parts)

    @classmethod
    def mapped(cls, data: bytes) -> Transducer:
        """The same, from a file of this worker mapped into memory (and already unlinked)."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at, parts = 4 * len(cls.NAMES), []
        for n, kind in zip(np.frombuffer(view, "<u4", len(cls.NAMES)).tolist(), cls.KINDS):
            parts.append(np.frombuffer(view, kind, n, at))
            at += -(-parts[-1].nbytes // 4) * 4
        return cls(parts)


class Codec:
    """Encodes and decodes whole texts; keeps what it has seen in a bounded dictionary."""

    def __init__(self, path: str, lexicon: Transducer | None, most: int = 300_000):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.token = {i: t for t, i in vocab.items()}
        self.lexicon, self.most, self.known, self.seen = lexicon, most, {}, {}
        self.to_unicode = {b: c for c, b in byte_alphabet().items()}

    def words(self, stretch: str) -> list[str]:
        """The words, in the stand-ins of bytes, of a stretch without white space."""
        if stretch.isascii() and stretch.isprintable():
            return WORDS.findall(stretch.lower())
        if max(stretch) < "ɐ":  # Latin letters fold alike in Python and in the library
            plain = WORDS.findall(unicodedata.normalize("NFC", stretch).lower())
            return ["".join(map(self.to_unicode.__getitem__, w.encode())) for w in plain]
        return [w for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(stretch))]

    def merge(self, word: str) -> list[int]:
        return [t.id for t in self.lib.model.tokenize(word)]

    def _word(self, word: str) -> tuple[bytes, str]:
        ids = self.lexicon.get(word) if self.lexicon else None
        if ids is None:
            ids = array("I", self.merge(word)).tobytes()
        out = ids, self.decode(memoryview(ids).cast("I"))
        if len(word) < 64:
            if len(self.seen) >= self.most:
                self.seen.clear()
            self.seen[word] = out
        return out

    def _learn(self, stretch: str) -> tuple[bytes, str]:
        seen = self.seen
        parts = [seen.get(w) or self._word(w) for w in self.words(stretch)]
        out = parts[0] if len(parts) == 1 else (b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts]))
        if len(stretch) < 64:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[stretch] = out
        return out

    def decode(self, ids) -> str:
        """The tokens parted by spaces, as the library does where a file names no decoder."""
        return " ".join([self.token[i] for i in ids])

    def encode(self, text: str) -> tuple[bytes, str]:
        """Little-endian ids, and the text that they decode to."""
        if any(s in text for s in self.special) or any(c in text for c in SEPARATORS):
            ids = self.lib.encode(text, add_special_tokens=False).ids
            return array("I", ids).tobytes(), self.decode(ids)
        known = self.known
        found = [known.get(w) or self._learn(w) for w in text.split()]
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[1]])


def word_counts(docs: DataFrame, path: str, share: float) -> DataFrame:
    """Counts of frequent words over all documents."""

    def run(batches):
        codec, seen = Codec(path, None), Counter()

        def hand_over():
            own = Counter()
            for stretch, n in seen.items():
                for w in codec.words(stretch):
                    own[w] += n
            seen.clear()
            least = max(2, share * own.total())
            kept = [(w, n) for w, n in own.items() if n >= least]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for part in slices(batches):
            for text in texts(part.column(0)):
                seen.update(text.split())
            if len(seen) > 1_000_000:
                yield hand_over()
        yield hand_over()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, path: str, words: int, share: float) -> Transducer:
    codec = Codec(path, None)
    top = word_counts(docs, path, share).orderBy(F.desc("n"), "word").limit(words).collect()
    return Transducer.build({r.word: codec.merge(r.word) for r in top})


_CODECS: dict = {}


def encode(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    words: int = 50_000,
    share: float = 2e-6,
    with_ids: bool = False,
) -> DataFrame:
    """Digests of each text's ids and of the text that they decode to.

    words: the most words that the transducer holds, which bounds what is broadcast.
    with_ids: also the columns ids (little-endian unsigned 32-bit) and decoded.
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    docs = id_text(df, id_col, text_col)
    data = lexicon(docs, path, words, share).to_bytes()
    key, sent = hashlib.sha256(data).hexdigest(), df.sparkSession.sparkContext.broadcast(data)
    more = [("ids", pa.binary()), ("decoded", pa.string())] if with_ids else []
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *more])

    def run(batches):
        if key not in _CODECS:
            _CODECS.clear()
            _CODECS[key] = Codec(path, Transducer.mapped(sent.value))
        codec = _CODECS[key]
        for part in slices(batches):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), texts(part.column(1))):
                ids, decoded = codec.encode(text)
                rows.append((doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), *((ids, decoded) if with_ids else ())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.mapInArrow(run, ENCODED + (", ids binary, decoded string" if with_ids else ""))
