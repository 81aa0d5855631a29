"""The append-only log of steps and items, and timings."""

from __future__ import annotations

from contextlib import contextmanager
from datetime import datetime, timezone
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPLETE = "complete"
STATE = "timestamp string, step string, detail string"
TIMINGS = "step string, started string, seconds double"


def append_state(spark: SparkSession, path: str, step: str, detail: str) -> None:
    rows = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.lit(step).alias("step"), F.lit(detail).alias("detail"))
    rows.write.mode("append").json(path)


def mark_complete(spark: SparkSession, path: str, step: str) -> None:
    append_state(spark, path, step, COMPLETE)


def mark_items(items: DataFrame, path: str, step: str) -> None:
    """Append a row for each finished item (column item)."""
    items.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.lit(step).alias("step"), F.col("item").cast("string").alias("detail")).write.mode("append").json(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The log; empty if nothing has been written."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).json(path)


def is_complete(state: DataFrame, step: str) -> bool:
    return not state.where((F.col("step") == step) & (F.col("detail") == COMPLETE)).limit(1).isEmpty()


def completed_steps(state: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each key and step has a row `complete`."""
    return state.groupBy(*keys, "step").agg(F.coalesce(F.bool_or(F.col("detail") == COMPLETE), F.lit(False)).alias("is_complete"))


def completed_items(state: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct details that aren't `complete`; a null detail counts as one."""
    return state.where(~F.col("detail").eqNullSafe(F.lit(COMPLETE))).select(*keys, "step", "detail").distinct()


@contextmanager
def timed(spark: SparkSession, path: str, step: str):
    """Append a row (step, started, seconds) when the block ends."""
    started, begin = datetime.now(timezone.utc).isoformat(), perf_counter()
    try:
        yield
    finally:
        spark.createDataFrame([(step, started, round(perf_counter() - begin, 2))], TIMINGS).coalesce(1).write.mode("append").json(path)


def with_total(timings: DataFrame) -> DataFrame:
    total = timings.agg(F.lit("TOTAL").alias("step"), F.min("started").alias("started"), F.round(F.sum("seconds"), 2).alias("seconds"))
    return timings.unionByName(total)
