"""Labelled samples and calibration, shared by the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, bounded_batches, texts


def held_out(id_col, folds: int, fold: int):
    """Rows whose crc32(id as text) leaves this remainder; null ids belong to the rest."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled(labels: DataFrame, label: str, folds: int, fold: int) -> DataFrame:
    """(doc_id, y) of the labels outside the held-out fold."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    return known.where(~held_out("doc_id", folds, fold)).groupBy("doc_id").agg(F.max("y").alias("y"))


def share_of_ones(labels: DataFrame, label: str, folds: int, fold: int) -> float | None:
    """How many of all these labels are 1."""
    return labelled(labels, label, folds, fold).agg(F.avg("y")).head()[0]


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int, folds: int, fold: int) -> list[tuple[str, int]]:
    """(text, label) of at most ``rows`` labelled documents of each class, outside the held-out fold.

    Documents are taken by a hash of their id, whatever the size of the tables, as long as a
    class has no more than ``rows`` of them and ``most_bytes`` of text; texts are whole, and one
    that is longer than that by itself is passed over. Both bounds make the sample fit for the
    driver, and that of ids for a broadcast.
    """
    known = labelled(labels, label, folds, fold)
    order = (F.xxhash64("doc_id"), "doc_id")
    some = known.where("y = 0").orderBy(*order).limit(rows).unionByName(known.where("y = 1").orderBy(*order).limit(rows))
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").where(F.octet_length("text") <= most_bytes)
    by_hash = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    found = found.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= rows)  # ids may repeat
    size = F.sum(F.octet_length("text").cast("long")).over(by_hash.rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("so_far", size).where(F.col("so_far") <= most_bytes).orderBy("place", "y")
    return [(r.text, r.y) for r in found.select("text", "y").collect()]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, weights: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the constant) of a logistic law, by Newton's method with halved steps.

    The ridge, over standardised inputs, keeps weights finite where the kinds part cleanly.
    """
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    sure = np.ones(len(x)) if weights is None else weights
    price = ridge * np.r_[np.ones(x.shape[1]), 0.0] * len(x)

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float((sure * (np.logaddexp(0, m) - y * m)).sum() + 0.5 * (price * w * w).sum())

    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (sure * p * (1 - p))[:, None]).T @ z + np.diag(price + 1e-9), z.T @ (sure * (y - p)) - price * w)
        before, size = loss(w), 1.0
        while size > 1e-6 and loss(w + size * step) > before:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    own = w[:-1] / scale
    return np.r_[own, w[-1] - own @ mean]


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ w, -30, 30)))


def with_score(df: DataFrame, text_col: str, name: str, model) -> DataFrame:
    """The rows with one more column, model.score of the text.

    Only the text goes to Python, and only the score comes back.
    """
    bounded_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            step = max(1, SLICE_BYTES * len(column) // max(1, column.nbytes))
            parts = [sent.value.score(texts(column.slice(at, step))) for at in range(0, len(column), step)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    return df.withColumn(name, F.arrow_udf(run, "double")(F.col(text_col)))
