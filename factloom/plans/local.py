"""From files, or an expert's documents, to a store that can be asked: one commit and its index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import Completer, Embedder
from ..operators import store
from ..operators.delta import Lake, Spec
from ..shared import kept
from . import index
from . import ingest as steps

TABLES = index.TABLES | {
    "docs": Spec(("document_id",), "document_id string, source_url string, doc_type string, title string"),
    "chunks": Spec(("document_id",), "document_id string, chunk_id string, content string"),
    "facts": Spec(("chunk_id",), "chunk_id string, subj string, rel string, obj string, certainty double"),
}


def texts(files: DataFrame) -> DataFrame:
    """(source_url, doc_type, text) of files that hold text as it is."""
    return files.select("source_url", "doc_type", F.col("content").cast("string").alias("text"))


def ingest(lake: Lake, rows: DataFrame, extractor: Callable[[], Completer], embedder: Callable[[], Embedder], least: float = store.LEAST_CONFIDENCE) -> dict[str, int]:
    """New documents of ``rows`` (source_url, doc_type, text) with their chunks, facts and vectors; how many of each.

    Documents whose address or content is known are left out. Documents, chunks and facts are
    one commit, so that no reader sees a document without its facts; the index follows, and a
    run that ends between the two is made whole by the next.
    """
    docs, chunks = steps.records(rows, lake.read("docs"))
    docs = kept(docs, "docs")
    chunks = kept(chunks.join(docs.select("document_id"), "document_id", "left_semi"), "chunks")
    counts = {"documents": docs.count(), "chunks": chunks.count()}
    if counts["documents"]:
        facts = kept(steps.extracted(chunks.withColumn("extracted_at", F.lit(None).cast("string")), extractor), "facts")
        with lake.commit() as change:
            change.upsert("docs", docs)
            change.replace("chunks", chunks, touched=docs)
            change.replace("facts", facts.where(F.col("certainty") >= least), touched=chunks)
        counts["facts"] = facts.count()
    return counts | index.update(lake, lake.read("chunks").select("chunk_id", "content"), embedder)
