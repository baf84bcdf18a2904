"""From raw documents to packed training sequences, stage by stage.

Each stage reads what its predecessor kept, all of it, and all but the last return the
columns of ``documents``.

Null texts count as empty in every stage. Very long texts are read whole. Other columns than
doc_id and text, null or not and whatever their names, are carried along. An empty table goes
through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import neardup, packing, quality, toxicity
from factloom.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Empty texts get the score of a text without evidence. Rows that repeat an id or a text are
    judged each by itself, equal texts alike; a score equal to the threshold keeps a document.
    """
    return quality.keep(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go.

    Empty texts show no toxicity and stay. Rows that repeat an id or a text are judged each by
    itself, equal texts alike; a score equal to the threshold rejects a document.
    """
    return toxicity.keep(docs, table(spark, sf_dir, "labels"), threshold=0.5)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: of those with the smallest id, one.

    Groups are made of texts. Rows that repeat an id but not its text are documents of their own;
    of equal rows one stays. Rows without words, and rows without an id, stay.
    """
    return neardup.keep_one(docs, percent=75)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 1024 tokens.

    An empty text has its end mark alone. Rows that repeat an id are packed each by itself.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", neardup_stage),
    ("packing", packing_stage),
]

#: Trained classifiers, signatures and token ids can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
