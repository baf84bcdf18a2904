"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a test-data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where none is set, a temporary folder serves in local mode, where driver and executors
    are one process; on a cluster it would be lost with a machine, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="factloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here.

    Unlike checkpoint() the table is columnar and compressed, so it costs little disk. It
    goes with the driver, or before that by discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at, fs = _file_system(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        at, fs = _file_system(t.sparkSession, t.stored_at)
        fs.delete(at, True)


def parallelism(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def task_id() -> int:
    ctx = TaskContext.get()
    return ctx.partitionId() if ctx else 0


def texts(column) -> list[str]:
    """An Arrow string column as a list; null is empty."""
    return [t or "" for t in column.to_pylist()]


#: Bytes of an Arrow batch on its way to Python, and of what an operator holds as Python objects.
BATCH_BYTES, SLICE_BYTES = 8 << 20, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes, so that long texts don't pile up in the JVM or in Python. The session keeps that setting."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def slices(batches, rows: int = 512):
    """Arrow batches in slices of so many rows, and of no more than SLICE_BYTES but for a single long row."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, min(rows, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies; FACTLOOM_TOKENIZERS overrides the installed folder."""
    folder = os.environ.get("FACTLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def id_text(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns that an operator reads, so that other names can't clash."""
    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_KEEP = {*range(48, 58), *range(97, 123), *range(128, 256)}
#: For bytes.translate: A-Z to lower case, all that parts words to a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEEP else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()
