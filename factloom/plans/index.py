"""An index of texts whose vectors are remembered by content.

Two tables of a lake: ``memo`` (content hash, vector) and ``index`` (chunk_id, content hash).
A text that was ever embedded isn't embedded again, whichever chunk it stands in and whatever
became of that chunk. Texts that are new are embedded once each, in batches of bounded tokens,
and both tables change in one commit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import TEXT_CHARS, Embedder
from ..operators.delta import Lake, Spec
from ..shared import kept

MEMO = Spec(("content",), "content string, vec array<double>, run long")
INDEX = Spec(("chunk_id",), "chunk_id string, content string")
TABLES = {"memo": MEMO, "index": INDEX}


def content(text):
    """What an embedder sees of a text, hashed: texts that it can't tell apart share a vector."""
    return F.sha2(F.substring(F.coalesce(text, F.lit("")), 1, TEXT_CHARS), 256)


def batches(texts: list[str], most_tokens: int) -> Iterator[list[str]]:
    """Texts in order, in batches of at most so many tokens (four characters each), but for a single longer text."""
    held, size = [], 0
    for text in texts:
        own = len(text) // 4 + 1
        if held and size + own > most_tokens:
            yield held
            held, size = [], 0
        held.append(text)
        size += own
    if held:
        yield held


def embedded(texts: DataFrame, make: Callable[[], Embedder], most_tokens: int = 8192) -> DataFrame:
    """(content, vec) of texts (content, text)."""

    def run(frames):
        client = make()
        for f in frames:
            cut = [(t or "")[:TEXT_CHARS] for t in f["text"]]
            vecs = [v for batch in batches(cut, most_tokens) for v in client.embed(batch)]
            yield pd.DataFrame({"content": f["content"], "vec": vecs})

    return texts.select("content", "text").mapInPandas(run, "content string, vec array<double>")


def update(lake: Lake, chunks: DataFrame, make: Callable[[], Embedder], most_tokens: int = 8192) -> dict[str, int]:
    """Brings the index up to the chunks (chunk_id, content); how many are indexed anew, and how many texts were embedded.

    Chunks that the index holds with the same content don't change; chunks that are gone stay
    (``remove``).
    """
    run = lake.manifest()["version"] + 1
    own = chunks.select("chunk_id", "content").groupBy("chunk_id").agg(F.min("content").alias("text")).withColumn("content", content(F.col("text")))
    waiting = kept(own.join(lake.read("index"), ["chunk_id", "content"], "left_anti"), "waiting")
    held = lake.read("memo").select("content")
    counts = {"indexed": waiting.count(), "embedded": waiting.select("content").distinct().join(held, "content", "left_anti").count()}
    if counts["indexed"]:
        unseen = waiting.groupBy("content").agg(F.min("text").alias("text")).join(held, "content", "left_anti")
        with lake.commit() as change:
            # each text goes to the model once, where the memo's folder is written; counts need hashes alone
            change.upsert("memo", embedded(unseen, make, most_tokens).withColumn("run", F.lit(run).cast("long")))
            change.upsert("index", waiting)
    return counts


def remove(lake: Lake, chunks: DataFrame) -> None:
    with lake.commit() as change:
        change.delete("index", chunks)


def read(lake: Lake, version: int | None = None) -> DataFrame:
    """(chunk_id, vec, run): each chunk's vector, and the version in which its text was embedded."""
    version = lake.manifest()["version"] if version is None else version
    return lake.read("index", version).join(lake.read("memo", version), "content").select("chunk_id", "vec", "run")
