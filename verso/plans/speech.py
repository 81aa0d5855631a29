"""From line jobs to sound: batches, a speech engine behind an interface, slices, chapters and the whole book.

An engine takes the items of one batch and gives one sound with a gap after each item. Engines run in the tasks that hold the batches; finished
outputs are left out before by operators.jobs.pending(). The offline engine makes silence as long as the words take.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.cluster import ship
from verso.operators import jobs, timeline
from verso.sources import sound

GAP_SECONDS = 0.25
RESULT = "batch_no long, items array<struct<book:string,number:int,sub_idx:int>>, item_samples array<long>, gap_samples long, data binary"


class Engine(Protocol):
    def speak(self, items: list[dict], gap_seconds: float) -> tuple[list[int], int, bytes]:
        """Samples of each item, samples of the gap, and a WAV file. Items have text, voice and speed."""
        ...


class OfflineEngine:
    def __init__(self, seconds_per_word: float = 0.4, rate: int = sound.RATE) -> None:
        self.seconds_per_word, self.rate = seconds_per_word, rate

    def speak(self, items: list[dict], gap_seconds: float) -> tuple[list[int], int, bytes]:
        samples = [int(len(i["text"].split()) * self.seconds_per_word / i["speed"] * self.rate) for i in items]
        gap = int(gap_seconds * self.rate)
        return samples, gap, sound.wav_bytes(bytes(2 * (sum(samples) + gap * len(samples))), self.rate)


def engine(name: str = "offline", **settings) -> Engine:
    """Engines by name; a deployment registers its own in ENGINES."""
    return ENGINES[name](**settings)


ENGINES: dict[str, type] = {"offline": OfflineEngine}


def spoken_batches(line_jobs: DataFrame, voice: Engine, size: int = jobs.BATCH) -> DataFrame:
    """line_jobs: book, number, sub_idx, text, voice, speed. RESULT rows, one per batch of `size` jobs; a batch is one call."""
    ship(line_jobs.sparkSession)
    rows = jobs.batched(line_jobs, "number", ["sub_idx"], size, book="book")

    def call(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("batch_pos")
        items = frame[["text", "voice", "speed"]].to_dict("records")
        samples, gap, data = voice.speak(items, GAP_SECONDS)
        if len(samples) != len(items):
            raise ValueError("as many samples as items are needed")
        names = frame[["book", "number", "sub_idx"]].to_dict("records")
        return pd.DataFrame({"batch_no": [frame["batch_no"].iloc[0]], "items": [names], "item_samples": [samples], "gap_samples": [gap], "data": [data]})

    return rows.groupBy("batch_no").applyInPandas(call, RESULT)


def voice_samples(cast: DataFrame, voice: Engine, finished: DataFrame | None = None) -> DataFrame:
    """cast: book, char_id, text, voice, speed. (book, char_id, data): a sample of each character's voice that isn't in finished (book, char_id, size) yet."""
    rows = cast if finished is None else jobs.pending(cast, finished, ["book", "char_id"])
    ship(rows.sparkSession)
    rows = rows.select("book", "char_id", "text", "voice", "speed")
    kind = rows.schema["book"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = [voice.speak([i], 0.0)[2] for i in frame[["text", "voice", "speed"]].to_dict("records")]
            yield frame[["book", "char_id"]].assign(data=said)

    return rows.mapInPandas(run, f"book {kind}, char_id string, data binary")


def line_sounds(batches: DataFrame) -> DataFrame:
    """(book, number, sub_idx, data): each item's slice of its batch, as a WAV file; cut and headed in the JVM."""
    parts = batches.withColumn("wav", sound.wav_parts("data")).drop("data")
    rows = parts.select("batch_no", "gap_samples", "wav", F.posexplode(F.arrays_zip("items", "item_samples")).alias("pos", "x"))
    before = jobs.W.partitionBy("batch_no").orderBy("pos").rowsBetween(jobs.W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("x.item_samples") + F.col("gap_samples")).over(before), F.lit(0))
    rows = rows.withColumn("start", start)
    frames = jobs.frame_slice(F.col("wav.frames"), F.col("start"), F.col("x.item_samples"), F.col("wav.sampwidth") * F.col("wav.nchannels"))
    return rows.select("x.items.book", "x.items.number", "x.items.sub_idx", sound.with_header(frames).alias("data"))


def chapter_sounds(lines: DataFrame) -> DataFrame:
    return sound.joined_wavs(lines, ["book", "number"], "sub_idx")


def timed_chapters(chapters: DataFrame, sounds: DataFrame, announcements: DataFrame, chime: bytes | None) -> DataFrame:
    """chapters: book, number, title; sounds and announcements: book, number, data. Chapter times from the sounds' own lengths."""
    length = lambda df, name: df.select("book", "number", F.round(sound.wav_seconds("data") * 1000).cast("long").alias(name))
    rows = chapters.select("book", "number", "title").join(length(sounds, "duration_ms"), ["book", "number"]).join(length(announcements, "announce_ms"), ["book", "number"], "left")
    seconds = None if chime is None else len(sound.read_wav(chime)[3]) // 2 * 1000 // sound.RATE
    return timeline.timeline(rows.withColumn("chime_ms", F.lit(seconds).cast("long")), ["book"], "number")


def book_sound(timed: DataFrame, sounds: DataFrame, announcements: DataFrame, chime: bytes) -> DataFrame:
    """(book, data): chime, announcement, chapter and pauses of all chapters, joined in order."""
    parts = timeline.interleaved(timed, "number").select("book", "number", "k", "kind", "ms")
    parts = parts.join(sounds.withColumnRenamed("data", "own"), ["book", "number"], "left").join(announcements.withColumnRenamed("data", "spoken"), ["book", "number"], "left")
    quiet = sound.with_header(F.unhex(F.repeat(F.lit("00"), (F.col("ms") * (sound.RATE * 2 // 1000)).cast("int"))))
    data = F.when(F.col("kind") == "chapter", F.col("own")).when(F.col("kind") == "announce", F.col("spoken")).when(F.col("kind") == "chime", F.lit(bytearray(chime))).otherwise(quiet)
    ordered = parts.select("book", F.struct("number", "k").alias("_at"), data.alias("data"))
    ordered = ordered.withColumn("at", F.row_number().over(jobs.W.partitionBy("book").orderBy("_at"))).drop("_at")
    return sound.joined_wavs(ordered, ["book"], "at")
