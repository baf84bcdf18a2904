"""Prompts as rows of text, and what answers cite."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import fact_label
from ..functions.text import cited_labels, percent


def source_lines(chunks: DataFrame, most: int) -> DataFrame:
    """The first chunks of each question as a source line and a content line."""
    page = F.concat(F.lit("p."), F.coalesce(F.col("page_number").cast("string"), F.lit("?")))
    heading = F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit('§"'), F.col("heading"), F.lit('"')))
    source = F.concat_ws(", ", F.when(F.col("title") == "", "Unknown").otherwise(F.coalesce("title", F.lit("Unknown"))), page, heading)
    line = F.concat(F.lit("Source: "), source, F.lit("\n    "), F.col("content"), F.lit("\n"))
    return chunks.where(F.col("place") <= most).select("q_id", "place", line.alias("line"))


def fact_lines(facts: DataFrame) -> DataFrame:
    """Facts in order, with a label and the signals that they have.

    A fact without an id is labelled by its number, which for small numbers is 000000.
    """
    w = Window.partitionBy("q_id").orderBy(F.desc("composite_trust"), "subj", "rel", "obj", "chunk_id")
    out = facts.withColumn("number", F.row_number().over(w))
    out = out.withColumn("label", fact_label(F.coalesce("fact_id", F.col("number").cast("long"))))
    has = lambda c: F.col(c) if c in facts.columns else F.lit(None).cast("double")
    notes = F.concat_ws(
        ", ",
        F.concat(F.lit("composite="), percent(F.col("composite_trust"))),
        F.concat(F.lit("ingest="), percent(F.col("ingest_certainty"))),
        F.concat(F.lit("rel="), percent(has("relevance_score"))),
        F.when(F.col("provenance_count") > 1, F.concat(F.lit("prov="), F.col("provenance_count").cast("string"), F.lit("x"))),
        F.concat(F.lit("gnd="), percent(has("grounding_score"))),
    )
    text = F.format_string("Fact_%s: %s (%s) --[%s]--> %s (%s)  [%s]", "label", "subj", "subj_type", "rel", "obj", "obj_type", notes)
    return out.select("q_id", "number", "label", "chunk_id", text.alias("line"))


def narrative_lines(facts: DataFrame) -> DataFrame:
    return facts.select("q_id", F.format_string("%s %s %s.", "subj", "rel", "obj").alias("line"))


def context(sources: DataFrame, facts: DataFrame) -> DataFrame:
    """One text for each question. Facts appear only where there are chunks."""
    def text(lines: DataFrame, at: str, name: str) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct(at, "line")))
        return lines.groupBy("q_id").agg(F.array_join(F.transform(items, lambda x: x.line), "\n").alias(name))

    out = text(sources, "place", "c").join(text(facts, "number", "f"), "q_id", "left")
    return out.select("q_id", F.concat_ws("\n", F.lit("## Retrieved Context\n"), "c", F.when(F.col("f").isNotNull(), F.concat(F.lit("## Knowledge Graph Facts\n\n"), F.col("f")))).alias("context"))


def label_chunks(lines: DataFrame) -> DataFrame:
    """Label to chunk; of facts that share a label the last one counts."""
    return lines.groupBy("q_id", "label").agg(F.max_by("chunk_id", "number").alias("chunk_id"))


def citations(answers: DataFrame, lines: DataFrame) -> DataFrame:
    """Cited labels of each answer in the order of first mention, with their chunks; unknown ones go."""
    cited = answers.select("q_id", F.posexplode(cited_labels(F.col("answer"))).alias("pos", "label"))
    return cited.join(label_chunks(lines), ["q_id", "label"])


def persona_tier(strength):
    return F.when(strength <= 0, 0).when(strength <= 0.30, 1).when(strength <= 0.60, 2).when(strength <= 0.90, 3).otherwise(4)


def nudged(strength):
    return strength > 0.30


def warned(answer, cited):
    """An answer that cites nothing is marked as general knowledge."""
    return F.when(cited > 0, answer).otherwise(F.concat(F.lit("⚠️ Not grounded in the knowledge graph. "), answer))


def abstains(energy):
    return energy >= 0.5
