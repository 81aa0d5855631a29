"""Session helpers that behave alike on one machine and on a cluster."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "_verso_shipped"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    made = os.path.join(tempfile.mkdtemp(), "verso_package.zip")
    with zipfile.ZipFile(made, "w") as z:
        for at, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    z.write(path, os.path.join("verso", os.path.relpath(path, top)))
    sc.addPyFile(made)
    setattr(sc, _SHIPPED, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Cap the rows of the session's Arrow batches, where it has Spark's default of 10,000, so that a batch of long texts stays small. For applications: operators don't touch a session's settings."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def trim() -> None:
    """Give freed memory of this process back to the system, as far as its allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and Spark runs in this process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = f"file://{tempfile.mkdtemp()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/verso-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._verso_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._verso_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
