"""Chapter timelines in milliseconds, interleaved sounds and chapter metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verso.functions.text import display_name, escape_metadata

#: Fixed values, in milliseconds.
AFTER_CHAPTER, AFTER_CHIME, AFTER_ANNOUNCEMENT = 3000, 500, 1000


def timeline(chapters: DataFrame, book: list[str], seq: str) -> DataFrame:
    """chapters: duration_ms, announce_ms and chime_ms (null: there is none). Adds start_ms and end_ms.

    A chapter with both chime and announcement starts with them; its end leaves out the pause that follows it.
    """
    both = F.col("chime_ms").isNotNull() & F.col("announce_ms").isNotNull()
    prelude = F.when(both, F.col("chime_ms") + AFTER_CHIME + F.col("announce_ms") + AFTER_ANNOUNCEMENT).otherwise(0)
    before = W.partitionBy(*book).orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(prelude + F.col("duration_ms") + AFTER_CHAPTER).over(before), F.lit(0))
    return chapters.withColumns({"start_ms": start, "end_ms": start + prelude + F.col("duration_ms")})


def simple_timeline(chapters: DataFrame, book: list[str], seq: str, gap_ms: int = 1000) -> DataFrame:
    before = W.partitionBy(*book).orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("duration_ms") + gap_ms).over(before), F.lit(0))
    return chapters.withColumns({"start_ms": start, "end_ms": start + F.col("duration_ms")})


def interleaved(chapters: DataFrame, seq: str) -> DataFrame:
    """The sounds of each chapter in order: chime, pause, announcement, pause (if it has both), chapter, pause."""
    part = lambda kind, ms: F.struct(F.lit(kind).alias("kind"), ms.cast("long").alias("ms"))
    prelude = F.array(part("chime", F.col("chime_ms")), part("gap", F.lit(AFTER_CHIME)), part("announce", F.col("announce_ms")), part("gap", F.lit(AFTER_ANNOUNCEMENT)))
    body = F.array(part("chapter", F.col("duration_ms")), part("gap", F.lit(AFTER_CHAPTER)))
    both = F.col("chime_ms").isNotNull() & F.col("announce_ms").isNotNull()
    rows = chapters.select("*", F.posexplode(F.when(both, F.concat(prelude, body)).otherwise(body)).alias("k", "_x"))
    return rows.select(*chapters.columns, "k", "_x.kind", "_x.ms")


def metadata_entry(title: Column, start_ms: Column, end_ms: Column) -> Column:
    """One chapter's lines of the metadata file."""
    return F.concat(F.lit("\n[CHAPTER]\nTIMEBASE=1/1000\nSTART="), start_ms.cast("string"), F.lit("\nEND="), end_ms.cast("string"), F.lit("\ntitle="), escape_metadata(title), F.lit("\n"))


def metadata_file(chapters: DataFrame, book: list[str], seq: str) -> DataFrame:
    """One text per book; chapters: title, start_ms, end_ms."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), metadata_entry(F.col("title"), F.col("start_ms"), F.col("end_ms")).alias("t"))))
    return chapters.groupBy(*book).agg(F.concat(F.lit(";FFMETADATA1\n"), F.array_join(F.transform(entries, lambda x: x["t"]), "")).alias("metadata"))


def announcement(title: Column, stem: Column) -> Column:
    return F.format_string("%s. %s.", title, display_name(stem))


def missing_announcements(stems: DataFrame, present: DataFrame, book: list[str]) -> DataFrame:
    """stems: book, title, stem; present: book, stem. (book, stem, speaker, text) of chapters, intros aside, whose announcement isn't there yet."""
    rows = stems.where(is_chapter_audio(F.col("stem")) & ~is_intro(F.col("stem")))
    rows = rows.join(present.select(*book, "stem"), [*book, "stem"], "left_anti")
    return rows.select(*book, "stem", F.lit("narrator").alias("speaker"), announcement(F.col("title"), F.col("stem")).alias("text"))


def is_chapter_audio(stem: Column) -> Column:
    return ~stem.endswith(".announce") & (stem != "chime")


def is_intro(stem: Column) -> Column:
    """The intro file or a chapter of that name."""
    return (stem == "00-intro") | (F.lower(display_name(stem)) == "intro")
