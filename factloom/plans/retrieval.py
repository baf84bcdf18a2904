"""A batch of questions to ranked facts and chunks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import fact_id
from ..operators import graph, harmonic, trust, vectors
from ..shared import kept


@dataclass(frozen=True)
class Options:
    top_chunks: int = 15
    depth: int = 1
    neighbours: int = 20
    paths: int = 0
    weights: trust.Weights = field(default_factory=trust.Weights)
    least_trust: float = 0.0
    harmonic: harmonic.Settings | None = None


@dataclass
class Retrieved:
    """order: (q_id, chunk_id, source, place), where each chunk was found first; sources count from 0."""

    anchors: DataFrame
    hits: DataFrame
    order: DataFrame
    chunks: DataFrame
    facts: DataFrame


def in_order(sources: list[DataFrame]) -> DataFrame:
    """(q_id, chunk_id, source, place): the union of sources; a chunk stands where the first of them has it."""
    every = None
    for n, own in enumerate(sources):
        own = own.select("q_id", "chunk_id", F.struct(F.lit(n).alias("source"), F.coalesce("place", F.lit(2**31 - 1).cast("long")).alias("place")).alias("at"))
        every = own if every is None else every.unionByName(own)
    first = every.groupBy("q_id", "chunk_id").agg(F.min("at").alias("at"))
    return first.select("q_id", "chunk_id", "at.source", "at.place")


def retrieve(edges: DataFrame, chunks: DataFrame, docs: DataFrame, mapping: DataFrame, vecs: DataFrame, questions: DataFrame, q_vecs: DataFrame, opts: Options = Options(), entities: DataFrame | None = None, named: DataFrame | None = None) -> Retrieved:
    """Vector hits, then entity chunks, then path chunks or harmonic ones; their facts scored and ranked.

    Anchors, hits and the chunks that they lead to are few beside the facts; they are written
    once, so that what follows knows their size and reads them again at no cost. With
    ``opts.harmonic`` there is one question, whose neighbourhood is a graph of its own, and
    ``named`` has the vectors (name, vec) of names; harmonic chunks then take the paths' place.
    """
    anchors = kept(graph.match_anchors(graph.entities(edges) if entities is None else entities, questions), "anchors")
    hits = kept(vectors.top_chunks(mapping, vecs, q_vecs, opts.top_chunks).select("q_id", "chunk_id", "emb_rank"), "hits")
    sources = [hits.select("q_id", "chunk_id", F.col("emb_rank").cast("long").alias("place"))]
    none = F.lit(None).cast("long")
    sources.append(graph.entity_chunks(edges, anchors, opts.depth, opts.neighbours).withColumn("place", none))
    if opts.harmonic is not None:
        scored, _ = harmonic.retrieve(edges, anchors, named, opts.harmonic)
        best = harmonic.top_chunks(scored, opts.harmonic.most_chunks)
        sources.append(best.join(questions.select("q_id"), F.lit(True)).select("q_id", "chunk_id", F.col("place").cast("long").alias("place")))
    elif opts.paths:
        sources.append(graph.path_chunks(graph.trust_paths(edges, anchors, opts.paths)).withColumn("place", none))
    order = kept(in_order(sources), "order")
    wanted = order.select("q_id", "chunk_id")
    triples = trust.with_provenance(graph.context_triples(edges, wanted), edges)
    scored = trust.top_k(trust.boosted(trust.composite(triples, opts.weights), questions, opts.weights), opts.weights.top_k)
    deduped = trust.rerank_triples(scored, hits)
    found = graph.context_chunks(chunks, docs, wanted).join(wanted, "chunk_id")
    ranked = trust.rerank_chunks(found, deduped, hits)
    facts = trust.trusted(deduped, opts.least_trust).withColumn("fact_id", fact_id("subj", "rel", "obj", "chunk_id"))
    return Retrieved(anchors, hits, order, ranked, facts)


def top_facts(found: Retrieved, k: int) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("q_id").orderBy(F.desc("composite_trust"), "subj", "rel", "obj", "chunk_id")
    return found.facts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
