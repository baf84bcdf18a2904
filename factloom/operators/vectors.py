"""Dense vectors: an index as a table of (chunk_id, vec)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a):
    return F.sqrt(dot(a, a))


def normalised(vec):
    """Length 1; a zero vector stays as it is."""
    n = norm(vec)
    return F.transform(vec, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def build(rows: DataFrame) -> DataFrame:
    return rows.select("chunk_id", normalised(F.col("vec")).alias("vec"))


def scores(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(q_id, key, score): cosine of every indexed vector with each of a small batch of queries."""
    q = F.broadcast(queries.select("q_id", normalised(F.col("q_vec")).alias("q_vec")).where(F.exists("q_vec", lambda x: x != 0)))
    return index.join(q, F.lit(True)).select("q_id", "key", F.round(dot(F.col("vec"), F.col("q_vec")), 6).alias("score"))


def top_chunks(mapping: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q_id, chunk_id, score, emb_rank): exact top-k, ties to the smaller chunk_id.

    mapping: chunk_id, key. vectors: key, vec. Many chunks may share a vector, so it is
    scored once; only vectors that can reach the top k go on to their chunks.
    """
    own = scores(vectors.select("key", normalised(F.col("vec")).alias("vec")), queries)
    counts = mapping.groupBy("key").agg(F.count("*").alias("chunks"))
    w = Window.partitionBy("q_id").orderBy(F.desc("score"))
    # rank() leaves a vector out once k chunks stand strictly before it; k vectors bound that
    near = kept(own.join(counts, "key").withColumn("r", F.rank().over(w)).where(F.col("r") <= k).select("q_id", "key", "score"), "near")
    place = Window.partitionBy("q_id").orderBy(F.desc("score"), "chunk_id")
    out = near.join(mapping, "key").withColumn("emb_rank", F.row_number().over(place) - 1)
    return out.where(F.col("emb_rank") < k).select("q_id", "chunk_id", "score", "emb_rank")


def score_chunks(wanted: DataFrame, mapping: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Scores of given chunks; one that isn't indexed gets 0."""
    own = scores(vectors.select("key", normalised(F.col("vec")).alias("vec")), queries)
    known = wanted.join(mapping, "chunk_id", "left").join(own, ["q_id", "key"], "left")
    return known.select("q_id", "chunk_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def merged(index: DataFrame, other: DataFrame) -> DataFrame:
    """The index with what only the other has."""
    return index.unionByName(other.join(index.select("chunk_id"), "chunk_id", "left_anti"))


def update_stats(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """How many chunks there are, how many are indexed, how many are new."""
    own = chunks.select("chunk_id").distinct().join(index.select("chunk_id", F.lit(1).alias("has")).distinct(), "chunk_id", "left")
    return own.agg(F.count("*").alias("total"), F.count("has").alias("already"), F.count_if(F.col("has").isNull()).alias("new"))
