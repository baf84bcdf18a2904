"""Where results go: reports of profiles, a manifest, an append-only log."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_rows(rows: DataFrame, path: str, by: str = "profile") -> None:
    """Result rows as JSON lines, a folder for each profile; a run replaces only the profiles that it has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).json(path)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Appends JSON lines; what is there is never rewritten."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*")


def write_manifest(spark: SparkSession, path: str, entries: dict) -> None:
    """What a run was made of, as one JSON text through Spark's own file system."""
    spark.createDataFrame([(json.dumps(entries, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
