"""Evaluation runs: data sets by profiles, their rows, summaries and manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import exact_match, short_answer, token_f1
from ..operators.evaluation import summary
from ..operators.registry import cross_product
from ..sources.readers import layered


def profiles(settings: dict) -> dict[str, dict]:
    """The enabled profiles, each over the global settings. A file without profiles is an error."""
    if not settings.get("profiles"):
        raise ValueError("the settings name no [profiles]")
    shared = settings.get("global", {})
    return {n: layered(shared, own) for n, own in settings["profiles"].items() if own.get("enabled", True)}


def answered(questions: DataFrame, names: DataFrame, answer) -> DataFrame:
    """Every question under every profile, with its answer (an expression) and how right it is.

    questions: id, question, answers. names: profile (configuration, a few rows).
    """
    out = cross_product(questions, names).withColumn("answer", answer)
    out = out.withColumn("extracted", short_answer(F.lit(None).cast("string"), F.col("answer")))
    return out.withColumn("answer_em", exact_match(F.col("extracted"), F.col("answers"))).withColumn("answer_f1", token_f1(F.col("extracted"), F.col("answers")))


def matrix(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Question by profile: metrics of each profile."""
    return summary(rows, metrics)


def suite(datasets: dict[str, object], run, strict: bool = False) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Runs every data set; what fails is noted unless ``strict``. Returns results and failures."""
    done: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    for name, source in datasets.items():
        try:
            done[name] = run(source)
        except Exception as e:
            if strict:
                raise
            failed[name] = f"{type(e).__name__}: {e}"
    return done, failed
