"""Licence scans over a positional index of rare words.

Licence texts and notices (licence_texts) are indexed once: for each of their words, the
template and the position. Document frequencies over the whole corpus give each licence word
its weight (IDF). The plain phrases are templates too, of which nothing may be missing.

1. A file's licence words say which templates can be in it at all: those with the words of a
   key phrase, and with enough of their weight.
2. The file's highest-IDF licence words are looked up, the rarest first, until what is left of
   a template's weight can't reach its threshold: wherever the template stands, at least one
   of these words then stands in its place. Each posting (template, position) of such a word
   at place p says that the template begins at p - position.
3. At each such beginning the template's postings are intersected with the file by relative
   position, with a tolerance for words put in or left out; the share of the template's weight
   that is found must reach the threshold.
4. One of the template's mandatory key phrases must stand inside.

``score`` is the largest share found, 0 where there is none.

Words are maximal stretches of letters a-z, digits and non-ASCII characters, after A-Z are
made lower case. Null and empty texts have no words and no labels. Very long texts are
scanned whole. Rows with a repeated or null id, and equal texts, are scanned each by itself.
Words of equal weight are looked up in the order of their letters. Other columns, whatever
their names, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices, texts, words_of
from .licence_texts import PHRASES, TEMPLATES

SCANNED = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double"
)


@dataclass
class Template:
    label: str
    words: list[bytes]
    keys: list[list[bytes]]
    least: float
    slack: int
    base: bool = False
    total: float = 0.0


class Index:
    """Postings of the templates' words, weighted by the corpus."""

    def __init__(self, weights: dict[bytes, float], threshold: float, slack: int):
        self.weights = weights
        self.templates = [Template(label, words_of(p), [words_of(p)], 1.0, 0, True) for p, label in PHRASES.items()]
        self.templates += [Template(label, words_of(text), [words_of(k) for k in keys], threshold, slack) for label, text, keys in TEMPLATES]
        #: word -> template -> positions
        self.postings: dict[bytes, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for t, template in enumerate(self.templates):
            for at, w in enumerate(template.words):
                self.postings[w][t].append(at)
            template.total = sum(weights[w] for w in template.words)
        self.vocabulary = frozenset(self.postings)
        #: the words of each key phrase, and the templates that ask for it
        self.needs: list[tuple[frozenset, int]] = [(frozenset(k), t) for t, template in enumerate(self.templates) for k in template.keys]

    def sought(self, present: set[bytes]) -> dict[bytes, list[int]]:
        """The file's highest-IDF licence words that are to be looked up, each with the templates that need it."""
        possible = {t for words, t in self.needs if words <= present}
        out: dict[bytes, list[int]] = defaultdict(list)
        if not possible:
            return out
        rarest = sorted(present, key=lambda w: (-self.weights[w], w))
        for t in possible:
            template = self.templates[t]
            own = [(w, self.weights[w] * len(self.postings[w][t])) for w in rarest if t in self.postings[w]]
            left, least = sum(x for _, x in own), template.least * template.total * (1 - 1e-9)
            for w, x in own:
                if left < least:
                    break
                out[w].append(t)
                left -= x
        return out

    def share(self, words: list[bytes], t: int, at: int) -> float:
        """Of a template that begins at this word, the weight that stands in its place."""
        template = self.templates[t]
        found = 0.0
        for j, w in enumerate(template.words):
            low = max(0, at + j - template.slack)
            if w in words[low : max(0, at + j + template.slack + 1)]:
                found += self.weights[w]
        return found / template.total

    def stands(self, words: list[bytes], t: int, at: int) -> bool:
        """Whether a mandatory key phrase stands inside."""
        template = self.templates[t]
        window = words[max(0, at - template.slack) : max(0, at + len(template.words) + template.slack)]
        return any(window[i : i + len(k)] == k for k in template.keys for i in range(len(window) - len(k) + 1))

    def scan(self, text: str) -> tuple:
        words = words_of(text)
        sought = {} if self.vocabulary.isdisjoint(words) else self.sought(set(self.vocabulary.intersection(words)))
        votes: dict[int, Counter] = defaultdict(Counter)
        for i, w in enumerate(words) if sought else ():
            for t in sought.get(w, ()):
                for at in self.postings[w][t]:
                    votes[t][i - at] += self.weights[w]
        base, labels, starts, score = set(), set(), [], 0.0
        for t, standings in votes.items():
            template = self.templates[t]
            # beginnings with most weight first
            for at in sorted(standings, key=lambda a: (-standings[a], a)):
                share = self.share(words, t, at)
                if share < template.least * (1 - 1e-9) or not self.stands(words, t, at):
                    continue
                labels.add(template.label)
                score = max(score, min(1.0, share))
                if not template.base:
                    break
                base.add(template.label)
                starts.append(at)
        return (
            len(words),
            len(starts),
            min(starts, default=None),
            max(starts, default=None),
            ",".join(sorted(base)),
            ",".join(sorted(labels)),
            round(score, 6),
        )


def document_frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """In how many documents each licence word stands, over all documents."""
    vocabulary = frozenset(w for text in (*PHRASES, *(t[1] for t in TEMPLATES)) for w in words_of(text))

    def run(batches):
        seen, n = Counter(), 0
        for part in slices(batches):
            for text in texts(part.column(0)):
                seen.update(vocabulary.intersection(words_of(text)))
                n += 1
        rows = [("", n), *((w.decode(), k) for w, k in seen.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64())], names=["word", "n"])

    counts = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r.word: r.n for r in counts.collect()}  # no more rows than the templates have words
    total = found.pop("", 0)
    return total, {w: found.get(w.decode(), 0) for w in vocabulary}


def scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.7,
    slack: int = 2,
) -> DataFrame:
    """Per document: words, places of the plain phrases, and labels with and without the other templates.

    threshold: share of a template's weight that must be found. slack: how many words may be
    put in or left out before a word.
    """
    docs = id_text(df, id_col, text_col)
    total, counts = document_frequencies(docs)
    weights = {w: math.log((total + 1) / (n + 1)) + 1e-3 for w, n in counts.items()}
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
    schema = pa.schema([(x.split()[0], t) for x, t in zip(SCANNED.split(", "), types)])

    def run(batches):
        index = Index(weights, threshold, slack)
        for part in slices(batches):
            rows = [(doc, *index.scan(text)) for doc, text in zip(part.column(0).to_pylist(), texts(part.column(1)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)

    return docs.mapInArrow(run, SCANNED)
