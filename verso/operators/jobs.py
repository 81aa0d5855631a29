"""Line jobs: speakers, pieces, pending work, batches, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verso.functions.text import MAX_WORDS, split_long_text
from verso.functions.voices import DEFAULT_VOICE

NARRATOR = "narrator"
LEAST_BYTES = 100
BATCH = 40


def with_known_speakers(lines: DataFrame, speakers: DataFrame) -> DataFrame:
    """lines: speaker; speakers: speaker. A speaker that isn't known becomes the narrator; without a narrator that is an error."""
    known = speakers.select(F.col("speaker").alias("_known")).distinct()
    has = known.agg(F.coalesce(F.bool_or(F.col("_known") == NARRATOR), F.lit(False)).alias("_narrator"))
    rows = lines.join(known, F.col("speaker") == F.col("_known"), "left").crossJoin(F.broadcast(has))  # one row
    missing = F.raise_error(F.concat(F.lit("unknown speaker and no narrator: "), F.coalesce("speaker", F.lit("null")))).cast("string")
    speaker = F.when(F.col("_known").isNotNull(), F.col("speaker")).when(F.col("_narrator"), F.lit(NARRATOR)).otherwise(missing)
    return rows.withColumn("speaker", speaker).drop("_known", "_narrator")


def line_pieces(lines: DataFrame, chapter: str, line_no: str, text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """A row per piece of a line, with piece_no and the running sub_idx of the chapter from 0."""
    rows = lines.select("*", F.posexplode(split_long_text(F.col(text), max_words)).alias("piece_no", "piece"))
    return rows.withColumn("sub_idx", F.row_number().over(W.partitionBy(chapter).orderBy(line_no, "piece_no")) - 1)


def out_key(sub_idx: Column) -> Column:
    return F.format_string("%05d.wav", sub_idx)


def voice_entries(voice_map: DataFrame, keys: list[str]) -> DataFrame:
    """voice_map: keys, voice, speed. One row (keys, entry) per key: the least of several; a missing voice or speed is the default one."""
    entry = F.struct(F.coalesce("voice", F.lit(DEFAULT_VOICE)).alias("voice"), F.coalesce(F.col("speed").cast("double"), F.lit(1.0)).alias("speed"))
    return voice_map.groupBy(*keys).agg(F.min(entry).alias("entry"))


def default_entry() -> Column:
    return F.struct(F.lit(DEFAULT_VOICE).alias("voice"), F.lit(1.0).alias("speed"))


def with_voices(jobs: DataFrame, voice_map: DataFrame) -> DataFrame:
    """voice_map: speaker, voice, speed. A speaker without an entry takes the narrator's whole entry, else the default voice at speed 1."""
    entries = voice_entries(voice_map, ["speaker"]).withColumnRenamed("entry", "_own")
    narrator = entries.where(F.col("speaker") == NARRATOR).agg(F.first("_own").alias("_narrator"))
    rows = jobs.join(entries, "speaker", "left").crossJoin(F.broadcast(narrator))  # one row
    rows = rows.withColumn("_entry", F.coalesce("_own", "_narrator", default_entry()))
    return rows.withColumns({"voice": F.col("_entry.voice"), "speed": F.col("_entry.speed")}).drop("_own", "_narrator", "_entry")


def pending(jobs: DataFrame, outputs: DataFrame, key: list[str], size: str = "size") -> DataFrame:
    """Jobs without an output of LEAST_BYTES or more."""
    return jobs.join(outputs.where(F.col(size) >= LEAST_BYTES).select(*key), key, "left_anti")


def _earlier(rows: DataFrame, keys: list[str], order: str, n: str) -> DataFrame:
    """keys and `_before`: the sum of n over the rows with the same keys, but for `order`, that come before by it."""
    w = W.partitionBy(*(k for k in keys if k != order)).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.select(*keys, F.coalesce(F.sum(n).over(w), F.lit(0)).alias("_before"))


def batched(jobs: DataFrame, chapter: str, order: list[str], size: int = BATCH, book: str | None = None) -> DataFrame:
    """Number of the batch of `size` consecutive jobs over all chapters (of all books, if `book` is given).

    Jobs are numbered within their chapter; the jobs of earlier chapters come from a table of one row per chapter, within their
    book, and those of earlier books from one of one row per book.
    """
    keys = [chapter] if book is None else [book, chapter]
    counts = jobs.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = _earlier(counts, keys, chapter, "_n")
    if book is not None:
        books = counts.groupBy(book).agg(F.sum("_n").alias("_n"))
        before = before.join(_earlier(books, [book], book, "_n").withColumnRenamed("_before", "_books"), book).select(*keys, (F.col("_before") + F.col("_books")).alias("_before"))
    rows = jobs.join(before, keys).withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1 + F.col("_before"))
    return rows.withColumn("batch_no", F.floor(F.col("_i") / size)).withColumn("batch_pos", F.col("_i") % size).drop("_i", "_before")


def slice_offsets(items: DataFrame, batch: str, order: list[str], samples: str, gap: int) -> DataFrame:
    """First and end sample of each item in its batch's sound, with a gap after each item."""
    before = W.partitionBy(batch).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col(samples) + gap).over(before), F.lit(0))
    return items.withColumns({"start_sample": start, "end_sample": start + F.col(samples)})


def item_samples(results: DataFrame) -> DataFrame:
    """results: items array, item_samples array. A row per item with its samples; arrays of different lengths are an error."""
    same = F.size("items") == F.size("item_samples")
    zipped = F.when(same, F.arrays_zip("items", "item_samples")).otherwise(F.raise_error(F.lit("as many samples as items are needed")))
    return results.select("*", F.posexplode(zipped).alias("pos", "_x")).select(*[c for c in results.columns if c not in ("items", "item_samples")], "pos", F.col("_x.items").alias("item"), F.col("_x.item_samples").alias("samples"))


def frame_slice(data: Column, start_frame: Column, frames: Column, frame_bytes: Column | int) -> Column:
    """Bytes of a run of frames."""
    width = F.lit(frame_bytes) if isinstance(frame_bytes, int) else frame_bytes
    return F.substring(data, (start_frame * width + 1).cast("int"), (frames * width).cast("int"))


def request_item(text: Column, voice: Column, speed: Column) -> Column:
    return F.struct(text.alias("text"), F.coalesce(voice, F.lit(DEFAULT_VOICE)).alias("voice"), F.coalesce(speed.cast("double"), F.lit(1.0)).alias("speed"))


def groups_largest_first(jobs: DataFrame, order: str, speaker: str = "speaker") -> DataFrame:
    """A row per speaker with its number of jobs and first position, and its rank: most jobs first, then the earlier one."""
    groups = jobs.groupBy(speaker).agg(F.count("*").alias("n_jobs"), F.min(order).alias("first_pos"))
    return groups.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n_jobs"), "first_pos", speaker)))
