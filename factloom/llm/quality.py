"""Quality by compression: zstandard dictionaries of good and bad text.

Two dictionaries are trained on labelled text. A text is cut into short
stretches, each compressed with either dictionary; the difference of the two sums, over
the text's size, says which kind of text it resembles. A logistic law, fitted on labelled
documents kept out of the dictionaries, turns that difference (with the compressed size
itself, which tells endless repetition) into a score.

Null and empty texts get the score of a text without evidence: the constant of the law
over the mean of its inputs. Very long texts are compressed whole, stretch after stretch.
Rows with a repeated or null id, and equal texts, are scored like any other, each by itself;
equal texts get equal scores. An empty table gives an empty result; without labels of both
kinds every score is 0.5. Other columns, whatever their names, are kept by keep() and not
looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, id_text
from .labelled import held_out, logistic, probability, sample, share_of_ones, with_score

def stretches(raw: bytes, size: int) -> list[bytes]:
    return [raw[i : i + size] for i in range(0, len(raw), size)]


class Model:
    """Dictionaries and calibration; small and picklable."""

    def __init__(self, good: bytes, bad: bytes, level: int, size: int):
        self.good, self.bad, self.level, self.size = good, bad, level, size
        self.weights = self.middle = None
        self._packers = None

    def __getstate__(self):
        return self.__dict__ | {"_packers": None}

    def packers(self):
        if self._packers is None:
            import zstandard as z

            self._packers = []
            for d in (self.good, self.bad):
                d = z.ZstdCompressionDict(d)
                d.precompute_compress(level=self.level)
                self._packers.append(z.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return self._packers

    def features(self, text: str) -> tuple[float, float, float]:
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            return self.middle or (0.0, 0.0, 0.0)
        good, bad = self.packers()
        parts = stretches(raw, self.size)
        a = sum(len(good.compress(p)) for p in parts)
        b = sum(len(bad.compress(p)) for p in parts)
        return (b - a) / len(raw), a / len(raw), b / len(raw)

    @staticmethod
    def expand(x: np.ndarray) -> np.ndarray:
        x = np.clip(x, -2, 2)
        return np.c_[10 * x, 10 * x**2, 10 * x[:, 1] * x[:, 2], 10 * x[:, 0] * x[:, 1]]

    def score(self, many: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(many), 0.5)
        return probability(self.expand(np.array([self.features(t) for t in many]).reshape(-1, 3)), self.weights)


def train(rows: list[tuple[str, int]], level: int, size: int, dictionary: int, share: float | None = None) -> Model:
    """Three in five of the sample make the dictionaries, the rest the calibration.

    share: how many of all labels are 1; the sample's kinds are weighed by it. The sample is
    bounded in rows and bytes; all its stretches are used.
    """
    import zstandard as z

    unique = list(dict.fromkeys((t, y) for t, y in rows if t))  # copies teach nothing more
    shape = unique[0::5] + unique[1::5] + unique[2::5]
    rest = unique[3::5] + unique[4::5]

    def content(label: int) -> bytes:
        raw = [p for t, y in shape if y == label for p in stretches(t.encode("utf-8", "surrogatepass"), size)]
        try:
            return z.train_dictionary(dictionary, raw, level=level).as_bytes()
        except z.ZstdError:  # too few samples to train on: their text itself
            return b"\n".join(raw)[-dictionary:] or b"........"

    model = Model(content(1), content(0), level, size)
    if len({y for _, y in unique}) < 2 or len({y for _, y in rest}) < 2:
        return model
    x = np.array([model.features(t) for t, _ in rest])
    y = np.array([y for _, y in rest], float)
    share = y.mean() if share is None else min(max(share, 0.01), 0.99)
    weights = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.weights = logistic(model.expand(x), y, ridge=1e-4, weights=weights)
    model.middle = tuple(x.mean(0).tolist())
    return model


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, fold: int = 2, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted. See scored() for the options."""
    rows, name = scored(df.select(id_col, text_col), labels, id_col, text_col, folds=folds, fold=fold, **options)
    return rows.select(
        F.col(id_col).alias("doc_id"),
        held_out(id_col, folds, fold).alias("held_out"),
        F.col(name).alias("score"),
        (F.col(name) >= threshold).cast("int").alias("predicted"),
    )


def keep(df: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, with all their columns, that the classifier doesn't reject."""
    rows, name = scored(df, labels, id_col, text_col, **options)
    return rows.where(F.col(name) >= threshold).drop(name)


def scored(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "quality",
    rows: int = 3000,
    most_bytes: int = 16 << 20,
    folds: int = 4,
    fold: int = 2,
    level: int = 3,
    stretch: int = 512,
    dictionary: int = 64 << 10,
) -> tuple[DataFrame, str]:
    """The rows with all their columns and a score, and its column's name; nothing is shuffled.

    rows, most_bytes: labelled documents of each kind to learn from, and bytes of their text.
    """
    known = sample(id_text(df, id_col, text_col), labels, label, rows, most_bytes, folds, fold)
    name = free_name(df, "score")
    return with_score(df, text_col, name, train(known, level, stretch, dictionary, share_of_ones(labels, label, folds, fold))), name
