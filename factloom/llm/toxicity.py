"""Toxicity by compression distance over windows of words.

Two zstandard dictionaries are trained, one on windows of labelled toxic and one on those of
ordinary documents. Every window of a text is compressed against the ordinary content alone
and against it with the toxic content before it; a window that gets shorter by the toxic
content (its gain) is nearer to toxic text. So is a document that all in all gets shorter by a
dictionary of toxic windows than by one of ordinary windows.

Which windows of a toxic document are toxic isn't labelled, so they are found by the same
distance: at first all of them train the dictionary; then, again and again, the dictionary of
one half of the documents says which windows of the other half gain most, and these train the
next, smaller one. Windows of ordinary documents that gain all the same join the ordinary
content. A law's inputs come from dictionaries that haven't seen the document.

Beside the gains stands the evidence of single words, which are often too short to show in a
window's size. A word, or the stem of a few letters that many words begin with, is evidence
if it marks labelled toxic documents: it stands in far more of them than of ordinary ones,
and those documents are otherwise unlike each other (the words of a much copied document
aren't toxic for that). Each weighs by its own log lift, be it frequent or rare.

Gains, the largest and the summed evidence of a window and a document's length become a score
by a logistic law, fitted on labelled rows; a gain never speaks against toxicity.

Null and empty texts have no windows and get the score of no gain. Very long texts are read
whole, window after window. Rows with a repeated or null id, and equal texts, are scored like
any other, each by itself; equal texts get equal scores. An empty table gives an empty result;
without labels of both kinds every score is 0. Other columns, whatever their names, are kept
by keep() and not looked at.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, id_text, words_of
from .labelled import held_out, logistic, probability, sample, with_score

#: Lengths, in characters, of the stems that are looked at.
STEMS = (4, 5, 6, 8)


def units(word: bytes) -> list[str]:
    """A word's stems, shortest first, and then the word itself."""
    w = word.decode("utf-8", "replace")
    return [*(w[:n] for n in STEMS if len(w) > n), w + " "]


class Evidence(dict):
    """The evidence of each word, kept for a bounded number of them."""

    def __init__(self, marked: dict[str, float]):
        self.marked = marked

    def __missing__(self, word: bytes) -> float:
        if len(self) >= 250_000:
            self.clear()
        found = self[word] = max((self.marked.get(u, 0.0) for u in units(word)), default=0.0)
        return found


def windows(words: list[bytes], size: int) -> list[bytes]:
    """Every ``size`` words in a row, a space around each."""
    return [b" " + b" ".join(words[at : at + size]) + b" " for at in range(0, len(words), size)]


def indexed(rows: list[tuple[frozenset, int]]) -> tuple[list[str], list[np.ndarray], np.ndarray]:
    """The units of the documents of label 1, the numbers of those that each document holds, and the labels."""
    number: dict[str, int] = {}
    kinds = np.array([y for _, y in rows])
    sets: list = [None] * len(rows)
    for i in [*np.flatnonzero(kinds == 1).tolist(), *np.flatnonzero(kinds == 0).tolist()]:
        found_units = (u for w in rows[i][0] for u in units(w))
        # what no toxic document holds can't mark one
        own = {number.setdefault(u, len(number)) for u in found_units} if kinds[i] else {number[u] for u in found_units if u in number}
        sets[i] = np.fromiter(own, np.int32, len(own))
    return list(number), sets, kinds


def evidence(names: list[str], sets: list[np.ndarray], kinds: np.ndarray, unlike: float = 0.35, looked_at: int = 32) -> dict[str, float]:
    """The units that mark documents of label 1, most telling first, each with its own log lift.

    Among so many some stand in toxic documents alone by chance; a unit's divergence from
    the sample's share of toxic documents must exceed what chance gives the best of them.
    Nothing else parts them: a word that is rare, or of a rare language, weighs by its lift.
    A unit whose documents are much alike (copies of one text) is left out: their variety is
    compared with that of as many others, of ``looked_at`` documents at most.
    """
    toxic, other = ([s for s, y in zip(sets, kinds) if y == k] for k in (1, 0))
    if not toxic or not other:
        return {}
    in_toxic, in_other = (np.bincount(np.concatenate(some), minlength=len(names)) for some in (toxic, other))
    share, chance = len(toxic) / len(sets), math.log(max(1, (in_toxic > 0).sum())) + 3
    both = in_toxic + in_other
    with np.errstate(divide="ignore", invalid="ignore"):
        found = np.where(in_toxic, in_toxic * np.log(in_toxic / both / share), 0.0) + np.where(in_other, in_other * np.log(in_other / both / (1 - share)), 0.0)
    lift = np.log((in_toxic + 0.5) / (len(toxic) + 1) / ((in_other + 0.5) / (len(other) + 1)))
    kept = np.flatnonzero((lift > 0) & (found >= chance))

    def variety(some: list[np.ndarray]) -> float:
        return len(np.unique(np.concatenate(some))) / sum(map(len, some))

    chosen: dict[str, float] = {}
    for u in sorted(kept.tolist(), key=lambda u: (-found[u], len(names[u]), names[u])):
        # a beginning that weighs as much says all that this one says
        if any(chosen.get(names[u][:n], 0.0) >= lift[u] for n in range(1, len(names[u]))):
            continue
        holders = [s for s in toxic if u in s][:looked_at]
        n = len(holders)
        # as varied, nearly, as other toxic documents in the same number
        if variety(holders) >= unlike * variety(toxic[:: max(1, len(toxic) // n)][:n]):
            chosen[names[u]] = float(lift[u])
    return chosen


def telling_units(rows: list[tuple[frozenset, int]]) -> list[str]:
    """Words and stems that mark documents (sets of words) of label 1, most telling first."""
    return list(evidence(*indexed(rows)))


def packer(content: bytes):
    """Compresses a window against this content, without any frame of its own."""
    import zstandard as z

    how = z.ZstdCompressionParameters(
        window_log=20, hash_log=17, chain_log=17, search_log=4, min_match=4, target_length=0, strategy=z.STRATEGY_LAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    d = z.ZstdCompressionDict(content or b"........", dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=how)
    return z.ZstdCompressor(compression_params=how, dict_data=d).compress


#: Inputs of the law: four of gains, three of words and length.
INPUTS, GAINS = 7, 4


class Model:
    def __init__(self, toxic: bytes, broad: bytes, ordinary: bytes, window: int, marked: dict[str, float] | None = None):
        self.toxic, self.broad, self.ordinary, self.window = toxic, broad, ordinary, window
        self.marked = marked or {}
        self.weights = None
        self._tools = None

    def __getstate__(self):
        return self.__dict__ | {"_tools": None}

    def tools(self):
        if self._tools is None:
            self._tools = (packer(self.toxic + self.ordinary), packer(self.broad), packer(self.ordinary), Evidence(self.marked))
        return self._tools

    def features(self, text: str) -> tuple[float, ...]:
        """Largest and second gain of a window, windows of much gain, gain by the broad dictionary for each byte; largest evidence of a window, its sum, and the number of windows."""
        toxic, broad, ordinary, evidence_of = self.tools()
        words = words_of(text)
        if not words:
            return (0.0,) * INPUTS
        parts = windows(words, self.window)
        plain = [len(ordinary(p)) for p in parts]
        gains = sorted((n - len(toxic(p)) for n, p in zip(plain, parts)), reverse=True)
        wide = sum(n - len(broad(p)) for n, p in zip(plain, parts)) / sum(map(len, parts))
        said = list(map(evidence_of.__getitem__, words))
        weight = sum(said)
        peak = max(sum(said[at : at + self.window]) for at in range(0, len(said), self.window)) if weight else 0.0
        return float(gains[0]), float(gains[1] if len(gains) > 1 else 0), float(sum(g >= 2 for g in gains)), wide, peak, weight, float(len(parts))

    @staticmethod
    def expand(x: np.ndarray) -> np.ndarray:
        return np.c_[x[:, :2], np.log1p(x[:, 2]), 10 * x[:, 3], x[:, 4], np.log1p(x[:, 5:7])]

    def score(self, many: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(many))
        return probability(self.expand(np.array([self.features(t) for t in many]).reshape(-1, INPUTS)), self.weights)


def trained(parts: list[bytes], size: int, **how) -> bytes:
    """A dictionary's content, at most ``size`` bytes."""
    import zstandard as z

    try:
        return z.train_dictionary(size, parts, **how).as_bytes()
    except z.ZstdError:  # too few samples to train on: their text itself
        return b"".join(parts)[-size:]


def contents(toxic: list[list[bytes]], ordinary: list[list[bytes]], dictionary: int, least: int, rounds: int, hard_bytes: int) -> tuple[bytes, bytes, bytes]:
    """Toxic content of chosen windows, of all windows, and ordinary content, from windows of toxic and ordinary documents."""
    # segments of a few letters more than the shortest words, so that many fit
    how = {"k": 16, "d": 6, "f": 20, "accel": 1, "split_point": 1.0, "steps": 1}
    plain = [trained([p for own in ordinary[h::2] for p in own], dictionary) for h in (0, 1)]
    hard = [b"", b""]
    chosen = list(toxic)
    for n in range(rounds):
        size = max(least, 32 * least >> (2 * n))
        marks = [trained([p for own in chosen[h::2] for p in own], size, **how) for h in (0, 1)]
        after = list(chosen)
        for h in (0, 1):
            with_toxic, without = packer(marks[h] + hard[h] + plain[h]), packer(hard[h] + plain[h])
            gain = lambda p: len(without(p)) - len(with_toxic(p))  # noqa: B023, E731
            for i in range(1 - h, len(toxic), 2):
                gains = [gain(p) for p in toxic[i]]
                order = sorted(range(len(gains)), key=lambda j: -gains[j])[: max(2, len(gains) >> (n + 2))]
                after[i] = [toxic[i][j] for j in order if gains[j] >= 1]
            if n == rounds - 1:
                misled = sorted((-gain(p), p) for own in ordinary[1 - h :: 2] for p in own)
                hard[h] = b"".join(p for g, p in misled if g <= -2)[:hard_bytes]
        chosen = after
    broad, plain_content = (trained([p for own in some for p in own], dictionary) for some in (toxic, ordinary))
    return trained([p for own in chosen for p in own], least, **how), broad, b"".join(hard) + plain_content


def rising(x: np.ndarray, y: np.ndarray, gains: int) -> np.ndarray:
    """The law's weights, none of the first ``gains`` below zero.

    The sample's own texts are nearer to their dictionary than any others; that mustn't
    speak against their kind.
    """
    free = list(range(x.shape[1]))
    while True:
        w = logistic(x[:, free], y, ridge=1e-4)
        low = [(v, j) for v, j in zip(w, free) if j < gains and v < 0]
        if not low:
            out = np.zeros(x.shape[1] + 1)
            out[[*free, -1]] = w
            return out
        free.remove(min(low)[1])


def train(rows: list[tuple[str, int]], window: int, dictionary: int, least: int = 1024, rounds: int = 3, hard_bytes: int = 64 << 10) -> Model:
    """The law is fitted on what models of the other documents say of each third of the sample.

    dictionary, least: bytes of ordinary and of toxic content; rounds: how often toxic windows
    are chosen anew; hard_bytes: most bytes of misleading ordinary windows that each adds.
    """
    texts_ = [(t, y) for t, y in dict.fromkeys(rows) if t]
    if len({y for _, y in texts_}) < 2:
        return Model(b"", b"", b"", window)
    names, sets, kinds = indexed([(frozenset(words_of(t)), y) for t, y in texts_])
    cut = [windows(words_of(t), window) for t, _ in texts_]

    def learned(some: np.ndarray) -> Model:
        both = ([cut[i] for i in some if kinds[i] == k] for k in (1, 0))
        return Model(*contents(*both, dictionary, least, rounds, hard_bytes), window, evidence(names, [sets[i] for i in some], kinds[some]))

    third = np.empty(len(kinds), int)
    for k in (0, 1):
        third[kinds == k] = np.arange((kinds == k).sum()) % 3
    x = np.zeros((len(kinds), INPUTS))
    for n in range(3):
        part = learned(np.flatnonzero(third != n))
        for i in np.flatnonzero(third == n):
            x[i] = part.features(texts_[i][0])
    model = learned(np.arange(len(kinds)))
    # kinds weigh as in the sample: a text without evidence is as toxic as texts without it are
    model.weights = rising(model.expand(x), kinds.astype(float), GAINS)
    return model


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 0, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score, predicted. See scored() for the options."""
    rows, name = scored(df.select(id_col, text_col), labels, id_col, text_col, folds=folds, fold=fold, **options)
    return rows.select(
        F.col(id_col).alias("doc_id"),
        held_out(id_col, folds, fold).alias("held_out"),
        F.col(name).alias("score"),
        (F.col(name) >= threshold).cast("int").alias("predicted"),
    )


def keep(df: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, with all their columns, that the classifier doesn't reject."""
    rows, name = scored(df, labels, id_col, text_col, **options)
    return rows.where(F.col(name) < threshold).drop(name)


def scored(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "toxic",
    rows: int = 2000,
    most_bytes: int = 16 << 20,
    folds: int = 5,
    fold: int = 0,
    window: int = 12,
    dictionary: int = 256 << 10,
) -> tuple[DataFrame, str]:
    """The rows with all their columns and a score, and its column's name; nothing is shuffled.

    rows, most_bytes: labelled documents of each kind to learn from, and bytes of their text.
    """
    known = sample(id_text(df, id_col, text_col), labels, label, rows, most_bytes, folds, fold)
    name = free_name(df, "score")
    return with_score(df, text_col, name, train(known, window, dictionary)), name
