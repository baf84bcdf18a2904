"""A graph for each question, all of them in one plan.

Each question brings its own passages, and nothing that another one brings may reach it. So
the question's number goes along as a part of every key: passages are chunked and extracted
once for all questions that have them, and then the facts are dealt out once, by question. An
anchor is matched among the question's own names, a hop stays within its facts, and its facts are
ranked among themselves, all in windows within a question: none of them moves a fact again. One job
answers all questions, as if each had a store of its own that is dropped afterwards.

A question without passages, without facts or without anchors gives no fact. A passage that
can't be extracted gives none, and its question goes on without it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import Completer, TemplateExtractor
from ..functions.text import query_words
from ..operators import chunking, graph
from . import ingest

#: Between the ids of a document and of a chunk, where both go along as one.
MARK = "\x1f"


def as_hex(name: str) -> Column:
    """A hash as it is written; between shuffles it is half as long."""
    return F.lower(F.hex(name))


def facts(passages: DataFrame, make: Callable[[], Completer] = TemplateExtractor) -> DataFrame:
    """(q_id, subj, rel, obj, chunk_id, certainty) of the questions' passages (q_id, text); chunk_id as bytes.

    What a passage says is extracted once, for whichever questions have it. Texts go to where they
    are extracted, and not to the questions.
    """
    docs = passages.where("trim(coalesce(text, '')) <> ''").select("q_id", F.unhex(F.sha2("text", 256)).alias("key"), "text")
    texts = docs.select("key", "text").distinct().select(as_hex("key").alias("document_id"), "text")
    chunks = chunking.newline_chunks(texts).select(F.concat("document_id", F.lit(MARK), "chunk_id").alias("chunk_id"), "content")
    found = ingest.extracted(chunks.withColumn("extracted_at", F.lit(None).cast("string")), make)
    ids = F.split("chunk_id", MARK)
    found = found.select(F.unhex(ids[0]).alias("key"), F.unhex(ids[1]).alias("chunk_id"), "subj", "rel", "obj", "certainty")
    return docs.select("q_id", "key").distinct().join(found, "key").select("q_id", "subj", "rel", "obj", "chunk_id", "certainty")


def answers(questions: DataFrame, passages: DataFrame, k: int = 20, depth: int = 2, make: Callable[[], Completer] = TemplateExtractor, most_names: int = 20) -> DataFrame:
    """(q_id, place, subj, rel, obj, chunk_id, certainty): each question's best facts within its own graph.

    questions: (q_id, text). Facts of the anchors' chunks, and of their frequent neighbours' (graph.entity_chunks),
    by certainty.
    """
    within = lambda *keys: Window.partitionBy("q_id", *keys)
    asked = questions.groupBy("q_id").agg(F.collect_list(F.struct(F.lower("text").alias("low"), query_words(F.col("text")).alias("qw"))).alias("asked"))
    known = facts(passages, make).repartition("q_id").join(asked, "q_id")
    tier = lambda name: F.array_min(F.transform("asked", lambda a: graph.tier_of(F.col(name), a["low"], a["qw"])))
    known = known.select("*", tier("subj").alias("__s"), tier("obj").alias("__o")).drop("asked")
    known = known.withColumn("__best", F.min(F.least("__s", "__o")).over(within())).where("__best IS NOT NULL")
    known = known.withColumn("__near", F.max(F.least("__s", "__o") == F.col("__best")).over(within("chunk_id")))
    wanted = F.coalesce("__near", F.lit(False))
    if depth >= 2:
        # a row for each end of a fact; names that stand most often in what is near bring the chunks that they stand in
        end = lambda n, name, tier: F.struct(F.lit(n).alias("n"), F.col(name).alias("name"), F.coalesce(F.col(tier) == F.col("__best"), F.lit(False)).alias("anchor"))
        known = known.withColumn("__end", F.explode(F.array(end(0, "subj", "__s"), end(1, "obj", "__o"))))
        known = known.withColumn("__known", F.max("__end.anchor").over(within(F.lower("__end.name"))))
        fresh = wanted & ~F.col("__known") & (F.coalesce("__end.name", F.lit("")) != "")
        known = known.withColumn("__times", F.count_if(fresh).over(within("__end.name")))
        known = known.withColumn("__rank", F.dense_rank().over(within().orderBy(F.desc("__times"), "__end.name")))
        frequent = (F.col("__times") > 0) & (F.col("__rank") <= most_names)
        known = known.withColumn("__more", F.max(frequent).over(within("chunk_id"))).where("__end.n = 0")
        wanted = wanted | F.col("__more")
    best = known.where(wanted).select("q_id", as_hex("chunk_id").alias("chunk_id"), "subj", "rel", "obj", "certainty")
    w = within().orderBy(F.desc("certainty"), "subj", "rel", "obj", "chunk_id")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
