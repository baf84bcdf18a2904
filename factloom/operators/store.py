"""Changes to tables, each as a new table: upserts, replacements, stamps, deletions.

Tables are immutable; a change is a DataFrame that a versioned folder then holds
(``Versions``), so that readers never see half of one and a failed run leaves the old one.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_CONFIDENCE = 0.6


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of the table whose key doesn't change, and the latest change of each key."""
    last = changes
    if order:
        cols = [c for c in changes.columns if c not in (key, order)]
        last = changes.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("x")).select(key, "x.*")
    return table.join(last.select(key), key, "left_anti").unionByName(last.select(*table.columns))


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """An upsert by id: equal texts of a document are one chunk."""
    return chunks.groupBy("chunk_id").agg(F.min("document_id").alias("document_id"), F.min("content").alias("content"))


def last_types(mentions: DataFrame) -> DataFrame:
    """Each entity's type is the one that was written last; mentions carry a sequence.

    A name that has one type has it at the end as well: only names with several types, few as a
    rule, are sorted for the last one.
    """
    kinds = mentions.select("name", F.when(F.col("seq").isNotNull(), F.col("type")).alias("type")).distinct()
    seen = kinds.groupBy("name").agg(F.count("*").alias("n"), F.first("type").alias("type"))
    several = seen.where("n > 1").select(F.col("name").alias("__name"))
    last = mentions.join(several, F.col("name").eqNullSafe(F.col("__name")), "left_semi").groupBy("name").agg(F.max_by("type", "seq").alias("type"))
    return seen.where("n = 1").select("name", "type").unionByName(last)


def without_chunk(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    return edges.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti")


def replace_by_chunk(edges: DataFrame, processed: DataFrame, fresh: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Edges of processed chunks go, confident new ones come. A chunk without new ones loses all."""
    kept = without_chunk(edges, processed)
    return kept.unionByName(fresh.where(F.col("certainty") >= least).select(*edges.columns))


def stamp(chunks: DataFrame, done: DataFrame, when) -> DataFrame:
    own = done.select("chunk_id").distinct().withColumn("__done", F.lit(True))
    out = chunks.join(own, "chunk_id", "left")
    return out.withColumn("extracted_at", F.when(F.col("__done"), when).otherwise(F.col("extracted_at"))).drop("__done")


def skip_unextracted(chunks: DataFrame, when) -> DataFrame:
    """Every chunk counts as extracted; unextracted(chunks).count() says how many that skips."""
    return chunks.withColumn("extracted_at", F.coalesce("extracted_at", when))


def unextracted(chunks: DataFrame) -> DataFrame:
    return chunks.where("extracted_at IS NULL")


def without_edges(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks that no edge names."""
    return chunks.join(edges.select("chunk_id").distinct(), "chunk_id", "left_anti")


def backfill_stamps(chunks: DataFrame, edges: DataFrame, when) -> DataFrame:
    """Unstamped chunks that own edges already count as extracted."""
    owners = chunks.where("extracted_at IS NULL").join(edges.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return stamp(chunks, owners, when)


def clear_document(chunks: DataFrame, edges: DataFrame, document) -> tuple[DataFrame, DataFrame]:
    """A document's stamps and edges go; its entities stay, as orphans."""
    own = chunks.where(F.col("document_id") == document)
    at = F.when(F.col("document_id") == document, F.lit(None)).otherwise(F.col("extracted_at"))
    return chunks.withColumn("extracted_at", at), without_chunk(edges, own)


def clear_all(chunks: DataFrame, edges: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    kind = chunks.schema["extracted_at"].dataType
    return chunks.withColumn("extracted_at", F.lit(None).cast(kind)), edges.where("false"), entities.where("false")


def delete_documents(docs: DataFrame, chunks: DataFrame, edges: DataFrame, part: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents whose id holds ``part`` go, with their chunks and those chunks' edges."""
    gone = docs.where(F.col("document_id").contains(part)).select("document_id")
    lost = chunks.join(gone, "document_id", "left_semi")
    return docs.join(gone, "document_id", "left_anti"), chunks.join(gone, "document_id", "left_anti"), without_chunk(edges, lost)


def chunk_counts(docs: DataFrame, chunks: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Chunks of each document; documents without any are left out."""
    out = chunks if only is None else chunks.join(only.select("chunk_id"), "chunk_id", "left_semi")
    return out.join(docs.select("document_id"), "document_id").groupBy("document_id").agg(F.count("*").alias("chunks"))


def next_offset(state: DataFrame, key: str) -> DataFrame:
    return state.where(F.col("query_key") == key).agg(F.coalesce(F.max("next_offset"), F.lit(0)).cast("long").alias("next_offset"))


#: Outcomes after which a record needn't be fetched again.
DONE = ["already_in_graph", "committed", "already_ingested"]


def safe_offsets(seen: DataFrame) -> DataFrame:
    """Per sequence the offset after the longest prefix of records that are done.

    seen: seq_key, seq, status, resume_offset. The first record that isn't done bounds the
    prefix: two aggregations, no window over a whole sequence.
    """
    done = F.col("status").isin(DONE)
    first_bad = seen.groupBy("seq_key").agg(F.min(F.when(~done, F.col("seq"))).alias("bad"))
    prefix = seen.join(first_bad, "seq_key").where("bad IS NULL OR seq < bad")
    best = prefix.groupBy("seq_key").agg(F.max("resume_offset").alias("next_offset"))
    return first_bad.join(best, "seq_key", "left").select("seq_key", F.coalesce("next_offset", F.lit(0)).alias("next_offset"))


class Versions:
    """A table as numbered folders; the newest that was written whole is the table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        root = self.hadoop(self.path)
        if not self.fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and self.fs.exists(self.hadoop(f"{self.path}/{n}/_SUCCESS")))

    def read(self, number: int | None = None) -> DataFrame:
        number = self.numbers()[-1] if number is None else number
        return self.spark.read.parquet(f"{self.path}/v{number}")

    def write(self, df: DataFrame) -> int:
        number = (self.numbers() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        return number

    def reset(self) -> None:
        """No version is left."""
        self.fs.delete(self.hadoop(self.path), True)

    def changed(self, change) -> int:
        """change(table) becomes the newest version; where it fails, the one before stays what readers see."""
        number = (self.numbers() or [0])[-1] + 1
        try:
            return self.write(change(self.read()))
        except Exception:
            self.fs.delete(self.hadoop(f"{self.path}/v{number}"), True)
            raise

    def restore(self, number: int) -> int:
        """An older version becomes the newest."""
        return self.write(self.read(number))


def places(root: str, slug: str) -> dict[str, str]:
    """Where an expert's tables, files and description lie: a folder of its own under ``root``."""
    own = f"{root.rstrip('/')}/{slug}"
    return {"folder": own, "facts": f"{own}/{slug}.facts", "vectors": f"{own}/{slug}.vectors", "downloads": f"{own}/downloads", "description": f"{own}/{slug}.meta.json"}


def now_utc() -> str:
    return datetime.now(timezone.utc).isoformat()
