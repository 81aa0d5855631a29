"""Chapter, script and JSON files as tables, and their sinks. Sinks leave finished rows alone: they append what isn't there yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verso.functions import replies
from verso.functions.text import strip


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, number, text) of *.txt files; 00-intro is number 0. Order by number (file names sort 100 before 11)."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    return rows.select("file_name", F.regexp_extract("file_name", r"^(\d+)", 1).cast("int").alias("number"), "text")


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, line_no, speaker, text) of *.jsonl files: one object per line, blank lines skipped."""
    whole = spark.read.option("pathGlobFilter", "*.jsonl").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value")
    lines = whole.select("file_name", F.posexplode(script_lines_of(F.col("value"))).alias("line_no", "x"))
    return lines.select("file_name", "line_no", "x.speaker", "x.text")


def script_lines_of(text: Column) -> Column:
    """Array of (speaker, text) of a script file's text."""
    return F.transform(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), replies.script_line)


def read_json_map(spark: SparkSession, path: str, value: str = "struct<name:string,bio:string,description:string,acoustic:string,voice:string,speed:double>") -> DataFrame:
    """(char_id, and the fields of value) of a JSON document {id: {...}}."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("char_id", "x"))
    return rows.select("char_id", "x.*")


def append_new(rows: DataFrame, path: str, key: list[str], partition: list[str] | None = None) -> None:
    """Append the rows whose key isn't in the Parquet table at `path` yet."""
    spark = rows.sparkSession
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(*key), key, "left_anti")
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def write_texts(rows: DataFrame, path: str) -> None:
    """rows: book, file_name, line_no, line. Text files in a folder for each book and file name; files that are there already stay as they are."""
    if exists(rows.sparkSession, path):
        there = read_texts(rows.sparkSession, path).select("book", "file_name")
        rows = rows.join(there, ["book", "file_name"], "left_anti")
    rows = rows.select(F.col("book").cast("string").alias("book"), "file_name", "line_no", "line")
    rows.repartition("book", "file_name").sortWithinPartitions("book", "file_name", "line_no").select("book", "file_name", "line").write.partitionBy("book", "file_name").mode("append").text(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(book, file_name, text) of what write_texts() wrote."""
    rows = spark.read.schema("text string, book string, file_name string").text(path, wholetext=True)
    return rows.select("book", "file_name", F.regexp_replace("text", r"\n$", "").alias("text"))


def write_chapters(chapters: DataFrame, path: str) -> None:
    """chapters: book, file_name, text. A text file per chapter."""
    write_texts(chapters.select("book", "file_name", F.lit(0).alias("line_no"), F.col("text").alias("line")), path)


def write_scripts(lines: DataFrame, path: str) -> None:
    """lines: book, file_name, line_no, speaker, text. A JSONL file per chapter: an object {speaker: text} a line, in order."""
    write_texts(lines.select("book", "file_name", "line_no", F.to_json(F.create_map("speaker", "text")).alias("line")), path)


def write_documents(documents: DataFrame, path: str, file_name: str) -> None:
    """documents: book, json. A JSON file of that name per book."""
    write_texts(documents.select("book", F.lit(file_name).alias("file_name"), F.lit(0).alias("line_no"), F.col("json").alias("line")), path)


def chapter_rows(intro: DataFrame, chapters: DataFrame) -> DataFrame:
    """intro: book, title, author; chapters: book, number, file_name, text. Adds the intro file to each book."""
    line = F.concat("title", F.lit(" by "), "author", F.lit(", narrated by machine"))
    first = intro.select("book", F.lit(0).alias("number"), F.lit("00-intro.txt").alias("file_name"), line.alias("text"))
    return first.unionByName(chapters.select("book", "number", "file_name", "text"))


def script_text(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One text per chapter: a JSON object {speaker: text} per line, in order."""
    entry = F.struct(F.col("line_no").alias("n"), F.to_json(F.create_map("speaker", "text")).alias("j"))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["j"]), "\n").alias("jsonl"))


def json_document(rows: DataFrame, keys: list[str], char_id: str, fields: list[str]) -> DataFrame:
    """One JSON object per book: {id: {fields}}, ids in order."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(char_id).alias("k"), F.struct(*fields).alias("v"))))
    return rows.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias("json"))
