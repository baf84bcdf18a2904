"""The folder that driver and executors share, and tables that are kept there for a while."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set a temporary one serves, in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or _own_dir(spark.sparkContext.applicationId)


@functools.lru_cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"factloom-{application}-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; it goes with the driver."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{path}/data"


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """A table written and read back: a lineage that a loop would lengthen ends here."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_files(path: str):
    """(file system, path) through which Arrow, in a task, reads what Spark has written there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
