"""From document items to numbered chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verso.functions.text import strip

LEAST_CHARS = 500
CLASSIFIED_CHARS = 1000


def is_substantial(text: Column) -> Column:
    return F.length(strip(text)) >= LEAST_CHARS


def reply_is_content(reply: Column) -> Column:
    """Verdict of a model that answers CONTENT or NONCONTENT."""
    return F.upper(reply).contains("CONTENT") & ~F.upper(reply).contains("NONCONTENT")


def looks_like_content(text: Column) -> Column:
    """Offline stand-in for the model: no licence or rights wording in the part that the model would see."""
    return ~F.lower(F.substring(text, 1, CLASSIFIED_CHARS)).rlike("licen[sc]e|copyright|all rights reserved")


def content_range(items: DataFrame, is_content: Column, book: str, pos: str) -> DataFrame:
    """Rows from a book's first to its last content row, whatever lies between; none if no row is content."""
    w = W.partitionBy(book)
    hit = F.when(is_content, F.col(pos))
    return items.withColumns({"_first": F.min(hit).over(w), "_last": F.max(hit).over(w)}).where(F.col(pos).between(F.col("_first"), F.col("_last"))).drop("_first", "_last")


def numbered(items: DataFrame, book: str, pos: str) -> DataFrame:
    return items.withColumn("number", F.row_number().over(W.partitionBy(book).orderBy(pos)))


def title_or_number(title: Column, number: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Chapter "), number.cast("string")))


def number_duplicate_titles(rows: DataFrame, book: str, seq: str, title: str = "title") -> DataFrame:
    """Titles that a book has more than once get their occurrence's number."""
    same = W.partitionBy(book, title)
    n = F.count("*").over(same)
    return rows.withColumn(title, F.when(n > 1, F.concat_ws(" ", title, F.row_number().over(same.orderBy(seq)).cast("string"))).otherwise(F.col(title)))


def first_chapters(rows: DataFrame, book: str, order: str, n: int) -> DataFrame:
    """The first n rows of each book; 0 means all."""
    if n <= 0:
        return rows
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(book).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    """rows, or an error where there are none. Runs a job."""
    if rows.isEmpty():
        raise ValueError(f"no {what}")
    return rows


def nth_chapter(rows: DataFrame, book: str, order: str, n: int, strict: bool = False) -> DataFrame:
    """The row at place n (from 0) of each book that has it; strict: a book without it is an error."""
    if strict:
        size = rows.groupBy(book).agg(F.count("*").alias("_n"))
        if n < 0 or not size.where(F.col("_n") <= n).isEmpty():
            raise IndexError(f"not every {book} has a chapter {n}")
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(book).orderBy(order)) - 1).where(F.col("_n") == n).drop("_n")


def until_words(rows: DataFrame, book: str, order: str, words: str, target: int) -> DataFrame:
    """Rows of each book until their running words reach the target (the row that reaches it is included)."""
    before = W.partitionBy(book).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("_before", F.coalesce(F.sum(words).over(before), F.lit(0))).where(F.col("_before") < target).drop("_before")


def chapters_by_words(rows: DataFrame, book: str, order: str, words: str, per_chapter: int) -> DataFrame:
    """(book, order, chapter): a book's rows in order; a chapter is full when its words reach per_chapter. One book is folded in one task, two numbers a row."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(words).cast("long").alias("n"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(1).alias("chapter"), F.array().cast(f"array<struct<at:{rows.schema[order].dataType.simpleString()},chapter:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        full = acc["n"] >= per_chapter
        chapter = F.when(full, acc["chapter"] + 1).otherwise(acc["chapter"])
        return F.struct((F.when(full, 0).otherwise(acc["n"]) + x["n"]).cast("long").alias("n"), chapter.alias("chapter"), F.concat(acc["out"], F.array(F.struct(x["at"].alias("at"), chapter.alias("chapter")))).alias("out"))

    folded = rows.groupBy(book).agg(items.alias("_items")).select(book, F.explode(F.aggregate("_items", zero, step)["out"]).alias("_x"))
    return folded.select(book, F.col("_x.at").alias(order), "_x.chapter")


def pick_cover(items: DataFrame, book: str) -> DataFrame:
    """items: pos, kind (file, cover, image), item_id, name, media_type. One row per book that has a cover, with its extension.

    Priority: a file of jpeg, jpg, png; a cover item; the ids cover and cover-image; an image with cover in its name.
    """
    stem = F.lower(F.regexp_extract("name", r"([^/]*?)(?:\.[^./]*)?$", 1))
    extension = F.lower(F.regexp_extract("name", r"\.([^./]+)$", 1))
    rank = (
        F.when((F.col("kind") == "file") & extension.isin("jpeg", "jpg", "png"), F.array_position(F.array(*map(F.lit, ("jpeg", "jpg", "png"))), extension).cast("int"))
        .when(F.col("kind") == "cover", 4)
        .when(F.col("item_id") == "cover", 5)
        .when(F.col("item_id") == "cover-image", 6)
        .when((F.col("kind") == "image") & stem.contains("cover"), 7)
    )
    saved = F.when(F.col("kind") == "file", extension).when(F.coalesce("media_type", F.lit("")).contains("png"), "png").otherwise("jpeg")
    best = items.withColumns({"rank": rank, "extension": saved}).where("rank IS NOT NULL")
    return best.groupBy(book).agg(F.min_by(F.struct("item_id", "name", "extension"), F.struct("rank", "pos")).alias("x")).select(book, "x.*")
