"""Entities in questions, hops over facts, trust paths, and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import join_split_letters, query_words, without_initials, words
from ..shared import kept


def entities(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("subj").alias("name"), F.col("subj_type").alias("type"))
    return ends.union(edges.select("obj", "obj_type")).distinct()


def match_anchors(names: DataFrame, questions: DataFrame, least: int = 10, scope: tuple[str, ...] = ()) -> DataFrame:
    """(q_id, name, tier) by four passes; a later one counts only where the earlier found nothing.

    1: the name is a word of the question. 2: the name, with or without middle initials,
    stands in it. (1 and 2 count together.) 3: a word of the name is a word of the
    question. 4: a word of the name begins with one.

    Each pass is a join on equal keys, of names' keys with questions' keys: the name itself with
    the question's words and with its stretches of the lengths that names have, the name's
    words with the question's, and beginnings of the name's words with them. ``scope``, if it is
    q_id, leaves each question the names that have its number (``own_anchors``).
    """
    if scope:
        return own_anchors(names, questions, least)
    q = questions.select("q_id", F.lower("text").alias("low"), query_words(F.col("text")).alias("qw"))
    own = names.select("name").distinct().withColumn("low_name", F.lower("name"))
    long = own.where(F.length("name") >= least).withColumn("bare", F.lower(without_initials(F.col("name"))))
    asked = q.select("q_id", F.explode(F.array_distinct("qw")).alias("key"))

    # 1: a word of the question is the name
    whole = own.where(F.length("name") >= 8).select("name", F.col("low_name").alias("key")).join(asked, "key").select("q_id", "name")
    # 2: a stretch of the question is the name; only lengths that names have are cut out
    keys = long.select("name", F.explode(F.array_distinct(F.array("low_name", "bare"))).alias("key"))
    lengths = keys.select(F.length("key").alias("size")).distinct()
    starts = F.explode(F.sequence(F.lit(1), F.length("low") - F.col("size") + 1))
    fits = F.col("size") <= F.length("low")
    stretches = q.join(lengths, fits).select("q_id", "low", "size", starts.alias("at"))
    stretches = stretches.select("q_id", F.substring(F.col("low"), F.col("at"), F.col("size")).alias("key")).distinct()
    inside = keys.join(stretches, "key").select("q_id", "name")
    # 3: a word of the name is a word of the question
    parts = long.select("name", F.explode(F.array_distinct(words(F.col("low_name")))).alias("w"))
    word = parts.where(F.length("w") >= 4).join(asked.withColumnRenamed("key", "w"), "w").select("q_id", "name")
    # 4: a word of the name begins with a word of the question and is longer
    plain = parts.select("name", F.length("w").alias("size"), F.regexp_replace("w", r"(?U)[^\w]", "").alias("p"))
    plain = plain.where((F.length("p") >= 5) & (F.col("size") > 5))
    begin = plain.select("name", F.explode(F.sequence(F.lit(5), F.least(F.length("p"), F.col("size") - 1))).alias("n"), "p")
    begin = begin.select("name", F.expr("left(p, n)").alias("key")).join(asked.where(F.length("key") >= 5), "key").select("q_id", "name")

    found = [whole.withColumn("tier", F.lit(1)), inside.withColumn("tier", F.lit(1)), word.withColumn("tier", F.lit(2)), begin.withColumn("tier", F.lit(3))]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    every = every.groupBy("q_id", "name").agg(F.min("tier").alias("tier"))
    first = every.groupBy("q_id").agg(F.min("tier").alias("tier"))
    return every.join(first, ["q_id", "tier"]).select("q_id", "name", "tier")


def tier_of(name: Column, low: Column, qw: Column, least: int = 10) -> Column:
    """The pass by which a name fits a question at hand, its text in lower case and its words; null where none does."""
    low_name, long = F.lower(name), F.length(name) >= least
    begins = lambda w, p: (F.length(p) >= 5) & (F.length(w) > 5) & F.exists(qw, lambda k: (F.length(k) >= 5) & (F.length(k) <= F.least(F.length(p), F.length(w) - 1)) & F.startswith(p, k))
    return (
        F.when((F.length(name) >= 8) & F.array_contains(qw, low_name), 1)
        .when(long & (low.contains(low_name) | low.contains(F.lower(without_initials(name)))), 1)
        .when(long & F.exists(words(low_name), lambda w: (F.length(w) >= 4) & F.array_contains(qw, w)), 2)
        .when(long & F.exists(words(low_name), lambda w: begins(w, F.regexp_replace(w, r"(?U)[^\w]", ""))), 3)
    )


def own_anchors(names: DataFrame, questions: DataFrame, least: int = 10) -> DataFrame:
    """match_anchors for names (q_id, name) of which each question has its own.

    They are few, and the question is at hand beside each: whether a name fits is looked up there, row
    by row. Stretches of the question and beginnings of names, which take the place of all pairs
    where names are common to all questions, would be many times the rows.
    """
    q = questions.select("q_id", F.lower("text").alias("low"), query_words(F.col("text")).alias("qw"))
    own = names.select("q_id", "name").distinct().join(q, "q_id")
    tier = tier_of(F.col("name"), F.col("low"), F.col("qw"), least)
    found = own.select("q_id", "name", tier.alias("tier")).where("tier IS NOT NULL").groupBy("q_id", "name").agg(F.min("tier").alias("tier"))
    return found.withColumn("__best", F.min("tier").over(Window.partitionBy("q_id"))).where("tier = __best").drop("__best")


def first_seen(anchors: DataFrame) -> DataFrame:
    """Of names that differ in case alone the first, by place."""
    return anchors.groupBy("q_id", F.lower("name").alias("low")).agg(F.min(F.struct("place", "name")).alias("x")).select("q_id", "x.name", "x.place")


def incident(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(q_id, chunk_id) of the facts at an anchor's either end: one scan of the facts for both ends."""
    ends = edges.where("coalesce(chunk_id, '') <> ''").select("chunk_id", F.explode(F.array("subj", "obj")).alias("name"))
    return ends.join(anchors.select("q_id", "name").distinct(), "name").select("q_id", "chunk_id").distinct()


def frequent_neighbours(edges: DataFrame, chunks: DataFrame, anchors: DataFrame, k: int = 20) -> DataFrame:
    """The k names that stand most often in the chunks' facts, anchors excepted."""
    ends = edges.join(chunks, "chunk_id").select("q_id", F.explode(F.array("subj", "obj")).alias("name"))
    known = anchors.select("q_id", F.lower("name").alias("low")).distinct()
    fresh = ends.where("coalesce(name, '') <> ''").withColumn("low", F.lower("name")).join(known, ["q_id", "low"], "left_anti")
    counts = fresh.groupBy("q_id", "name").agg(F.count("*").alias("n"))
    w = Window.partitionBy("q_id").orderBy(F.desc("n"), "name")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def entity_chunks(edges: DataFrame, anchors: DataFrame, depth: int = 1, k: int = 20) -> DataFrame:
    """Chunks of the anchors' facts and, from depth 2 on, of their frequent neighbours'."""
    near = incident(edges, anchors)
    if depth < 2:
        return near
    return near.union(incident(edges, frequent_neighbours(edges, near, anchors, k))).distinct()


def all_paths(edges: DataFrame, anchors: DataFrame, most_anchors: int = 5) -> DataFrame:
    """Paths of one hop (either direction) and two hops (outgoing), by geometric mean of certainty."""
    w = Window.partitionBy("q_id").orderBy("name")
    first = anchors.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most_anchors).select("q_id", "name")
    real = edges.where("coalesce(chunk_id, '') <> ''").select("subj", "rel", "obj", F.coalesce("certainty", F.lit(0.0)).alias("c"), "chunk_id")
    none = F.lit(None).cast("string")
    step = real.join(first, F.col("subj") == F.col("name")).select("q_id", F.col("name").alias("anchor"), "rel", F.col("obj").alias("target"), "chunk_id", "c")
    back = real.join(first, F.col("obj") == F.col("name")).select("q_id", F.col("name").alias("anchor"), "rel", F.col("subj").alias("target"), "chunk_id", "c")
    one = step.union(back).withColumns({"rel2": none, "target2": none, "chunk2": none, "hops": F.lit(1)}).withColumnRenamed("c", "trust")
    second = real.select(F.col("subj").alias("target"), F.col("rel").alias("rel2"), F.col("obj").alias("target2"), F.col("c").alias("c2"), F.col("chunk_id").alias("chunk2"))
    two = step.join(second, "target").where("anchor <> target2").withColumn("trust", F.round(F.sqrt(F.col("c") * F.col("c2")), 6)).withColumn("hops", F.lit(2))
    return one.unionByName(two.drop("c", "c2"))


def reach(edges: DataFrame) -> DataFrame:
    """Per name the certainty of its best outgoing fact, where that goes, and the best that goes elsewhere."""
    real = edges.where("coalesce(chunk_id, '') <> ''").groupBy("subj", "obj").agg(F.max(F.coalesce("certainty", F.lit(0.0))).alias("c"))
    two = real.withColumn("rn", F.row_number().over(Window.partitionBy("subj").orderBy(F.desc("c"), "obj"))).where("rn <= 2")
    at = lambda n, c: F.max(F.when(F.col("rn") == n, F.col(c)))
    return two.groupBy("subj").agg(at(1, "obj").alias("best_obj"), at(1, "c").alias("best_c"), at(2, "c").alias("other_c"))


def trust_paths(edges: DataFrame, anchors: DataFrame, most: int = 50, most_anchors: int = 5, reaches: DataFrame | None = None) -> DataFrame:
    """The most trusted paths.

    Each tier has its own half of the places; a place that one leaves open isn't filled by
    the other. Paths rank by certainty, or by the product of both, then by the first fact, then
    by the second.

    A path's trust is bounded by its first fact's certainty times the best certainty that goes on
    from there, and some path reaches that bound. So the best k paths begin with one of the k
    first facts whose bounds are best, and for each of those go on with one of the k best facts
    from its target: k * k paths are made for a question, however many there are. Both ranks are
    plain limits, which tasks apply before rows meet, so that hubs are cut where they lie.
    """
    half = most // 2
    w = Window.partitionBy("q_id").orderBy("name")
    first = anchors.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most_anchors).select("q_id", "name")
    real = edges.where("coalesce(chunk_id, '') <> ''").select("subj", "rel", "obj", F.coalesce("certainty", F.lit(0.0)).alias("c"), "chunk_id")
    own = ["q_id", F.col("name").alias("anchor"), "rel"]
    out = real.join(first, F.col("subj") == F.col("name")).select(*own, F.col("obj").alias("target"), "chunk_id", "c")
    back = real.join(first, F.col("obj") == F.col("name")).select(*own, F.col("subj").alias("target"), "chunk_id", "c")
    fact = ["anchor", "rel", "target", "chunk_id"]
    none = F.lit(None).cast("string")

    def top(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)

    one = top(out.unionByName(back), ["q_id"], [F.desc("c"), *fact], half)
    one = one.withColumns({"rel2": none, "target2": none, "chunk2": none, "hops": F.lit(1)}).withColumnRenamed("c", "trust")

    k = most - half
    known = (reach(edges) if reaches is None else reaches).withColumnRenamed("subj", "target")
    onward = F.when(F.col("best_obj") != F.col("anchor"), F.col("best_c")).otherwise(F.col("other_c"))
    begin = out.join(known, "target").withColumn("bound", F.col("c") * onward).where("bound IS NOT NULL")
    begin = top(begin, ["q_id"], [F.desc("bound"), *fact], k).select("q_id", *fact, "c")
    pairs = begin.select("target", "anchor").distinct()
    second = real.select(F.col("subj").alias("target"), F.col("rel").alias("rel2"), F.col("obj").alias("target2"), F.col("c").alias("c2"), F.col("chunk_id").alias("chunk2"))
    second = second.join(pairs, "target").where("anchor <> target2")
    second = top(second, ["target", "anchor"], [F.desc("c2"), "rel2", "target2", "chunk2"], k).drop("place")
    two = begin.join(second, ["target", "anchor"]).withColumn("product", F.col("c") * F.col("c2"))
    two = top(two, ["q_id"], [F.desc("product"), *fact, F.desc("c2"), "rel2", "target2", "chunk2"], k)
    two = two.withColumn("trust", F.round(F.sqrt("product"), 6)).withColumn("hops", F.lit(2)).drop("c", "c2", "product")
    return one.unionByName(two)


def second_degree(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(name, near, degree): neighbours of a name, and theirs, each with the smaller degree."""
    both = edges.select(F.col("subj").alias("a"), F.col("obj").alias("b")).union(edges.select("obj", "subj")).where("a <> b").distinct()
    first = both.join(names.select(F.col("name").alias("a")).distinct(), "a").select(F.col("a").alias("name"), F.col("b").alias("near")).withColumn("degree", F.lit(1))
    second = first.select("name", F.col("near").alias("a")).join(both, "a").where("b <> name").select("name", F.col("b").alias("near")).withColumn("degree", F.lit(2))
    return first.unionByName(second).groupBy("name", "near").agg(F.min("degree").alias("degree"))


def export(edges: DataFrame, most: int = 500) -> DataFrame:
    """The first edges as a simple directed graph: of parallel ones the last wins."""
    order = ["subj", "obj", "rel", "chunk_id"]
    first = edges.orderBy(*order).limit(most)
    return first.groupBy("subj", "obj").agg(F.max_by("rel", F.struct("rel", "chunk_id")).alias("rel"))


def path_chunks(paths: DataFrame) -> DataFrame:
    both = paths.select("q_id", F.explode(F.array("chunk_id", "chunk2")).alias("chunk_id"))
    return both.where("chunk_id IS NOT NULL").distinct()


def context_chunks(chunks: DataFrame, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks with their document; those without one are dropped."""
    own = chunks.join(wanted.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return own.join(docs.select("document_id", F.coalesce("title", F.lit("")).alias("title"), F.expr("nullif(source_url, '')").alias("source_url")), "document_id")


def context_triples(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """The chunks' facts with names set right; a fact from a name to itself is dropped.

    They are written as they are found: else names would be set right, for the filter, in the whole
    table before the join, and whoever counts these facts there couldn't know that they are few.
    """
    out = kept(edges.join(wanted, "chunk_id"), "context").withColumn("subj", join_split_letters(F.col("subj"))).withColumn("obj", join_split_letters(F.col("obj")))
    return out.where(F.lower("subj") != F.lower("obj"))


def _walked(rows: DataFrame, known: DataFrame, radius: int) -> DataFrame:
    """Rows between two nodes that a search has found; an edge between two nodes at the rim is never looked at."""
    ends = rows.join(known.select(F.col("name").alias("subj"), F.col("hop").alias("hs")), "subj").join(known.select(F.col("name").alias("obj"), F.col("hop").alias("ho")), "obj")
    return ends.where(F.least("hs", "ho") < radius).drop("hs", "ho")


def ego(edges: DataFrame, anchors: DataFrame, radius: int = 3, most: int | None = 2000) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, hop) within ``radius`` of the anchors, and the edges among them that were walked.

    One join a hop, from the frontier alone; nodes are taken by (hop, name) up to ``most``.
    Every node set holds no more than ``most`` rows, which is why it may be broadcast. Where
    ``most`` is None all nodes are taken, none is broadcast by a hint, and hops go over distinct pairs of
    names, so that a name with many facts doesn't bring each of them to one task.
    """
    ends = edges.where("coalesce(chunk_id, '') <> ''").select("subj", "obj", "rel", "chunk_id", "certainty")
    few = F.broadcast if most is not None else lambda rows: rows
    first = lambda rows: rows.orderBy("hop", "name").limit(most) if most is not None else rows
    pairs = ends.select("subj", "obj") if most is not None else kept(ends.select("subj", "obj").distinct(), "pairs")
    both = pairs.unionByName(pairs.select(F.col("obj").alias("subj"), F.col("subj").alias("obj"))).toDF("name", "near")
    known = kept(first(anchors.select("name").distinct().withColumn("hop", F.lit(0))), "ego")
    for hop in range(1, radius + 1):
        frontier = few(known.where(F.col("hop") == hop - 1).select("name"))
        near = both.join(frontier, "name").select(F.col("near").alias("name")).where("name IS NOT NULL").distinct()
        new = near.join(few(known.select("name")), "name", "left_anti").withColumn("hop", F.lit(hop))
        known = kept(first(known.unionByName(new)), "ego")
    facts = _walked(ends, few(known), radius) if most is not None else ends.join(_walked(pairs, known, radius), ["subj", "obj"])
    return known, facts.groupBy("subj", "obj", "rel", "chunk_id").agg(F.max("certainty").alias("certainty"))
