"""Readers for the shapes in which questions, results, pages and settings come."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File types that a folder of documents may hold. Fixed values.
DOCUMENT_TYPES = ["pdf", "docx", "pptx", "xlsx", "xls", "html", "htm", "md", "adoc"]


def json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON file that is a list, or a dictionary whose first list holds them.

    Spark's own reader parses a list's records one by one. A dictionary is one record; the
    names of its fields say which of them is a list.
    """
    plain = spark.read.option("multiLine", True).json(path)
    wrapped = next((f.name for f in plain.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)), None)
    wanted = T.StructType.fromDDL(schema)
    if wrapped and not set(wanted.names) & set(plain.columns):
        inner = spark.read.option("multiLine", True).schema(T.StructType([T.StructField(wrapped, T.ArrayType(wanted))])).json(path)
        return inner.select(F.explode(wrapped).alias("r")).select("r.*")
    return spark.read.option("multiLine", True).schema(wanted).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def dotted(df: DataFrame, path: str) -> Column:
    """A nested field by its dotted path."""
    return F.col(path)


def as_answers(column: Column, kind: T.DataType) -> Column:
    """One answer or many as a list; nothing is an empty list."""
    own = column if isinstance(kind, T.ArrayType) else F.array(column)
    return F.filter(F.coalesce(own.cast("array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull())


def folder(spark: SparkSession, path: str, recursive: bool = True, types: list[str] = DOCUMENT_TYPES) -> DataFrame:
    """Files of these types with their content; ids are hashes of it. Contents aren't shuffled: rows come in no order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{" + ",".join(types) + "}").load(path)
    return files.select(F.sha2("content", 256).alias("document_id"), F.concat(F.lit("file://"), F.regexp_replace("path", "^file:/*", "/")).alias("source_url"), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("doc_type"), "content")


def page_texts(pages: DataFrame) -> DataFrame:
    """Pages as plain text by expressions alone: scripts and tags go, common references are decoded."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    body = F.regexp_replace("html", r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), "&nbsp;", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        body = F.replace(body, F.lit(name), F.lit(char))
    return pages.select("page_id", "url", title.alias("title"), F.trim(F.regexp_replace(body, r"\s+", " ")).alias("text"))


def sessions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every JSON file of a folder as a row; unreadable ones are skipped."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", True).json(path)
    return rows.where("_bad IS NULL").drop("_bad")


def study_table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A study's questions, agents or stored responses from ``name``.json; without the file, no rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.json")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return json_list(spark, at.toString(), schema)


def settings(name: str, start: str | Path = ".") -> dict:
    """A TOML file found by walking up from ``start``; {} if there is none. Runs on the driver."""
    at = Path(start).resolve()
    for place in (at, *at.parents):
        if (place / name).is_file():
            return tomllib.loads((place / name).read_text(encoding="utf-8"))
    return {}


def layered(*layers: dict) -> dict:
    """Later layers win; nested tables are merged."""
    out: dict = {}
    for layer in layers:
        for k, v in (layer or {}).items():
            out[k] = layered(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def vector_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("chunk_id", "vec")
