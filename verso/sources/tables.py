"""Parquet tables and what stands in for books, chapters and scripts in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def page_items(spark: SparkSession, folder: str) -> DataFrame:
    """(book, pos, filename, html): pages of a host in the order of their ids."""
    return table(spark, folder, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("book"), F.col("page_id").alias("pos"), F.col("url").alias("filename"), "html")


def script_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(chapter, line_no, speaker, text)."""
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("chapter"), F.col("turn").alias("line_no"), F.col("role").alias("speaker"), "text")


def state_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(book, step, detail) from events: a user's event type is a step; k = 0 marks its completion."""
    k = F.get_json_object("props", "$.k")
    return table(spark, folder, "events").select(F.col("user_id").alias("book"), F.col("event_type").alias("step"), F.when(k == "0", "complete").otherwise(F.concat(F.lit("item "), k)).alias("detail"))
