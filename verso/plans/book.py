"""End-to-end plans: items to chapters, chapters to characters, scripts, jobs and a timeline. Each stage is one DataFrame; write it as a table to make it resumable."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verso.cluster import ship, stored
from verso.functions import html, replies, text, voices
from verso.functions.chunks import chunk_text
from verso.operators import entities, jobs, select, timeline
from verso.plans import prompts
from verso.plans.backend import Backend, OfflineBackend, asked, has_lines, has_text
from verso.sources.tables import page_items

MS_PER_WORD = 400
SAMPLE_CHARS = 3000
ATTEMPTS = 6
CHARACTERS_CHARS = 15_000


def chapters(items: DataFrame, is_content=select.looks_like_content) -> DataFrame:
    """items: book, pos, filename, text, title. Gives book, number, title, file_name, text."""
    kept = items.where(select.is_substantial(F.col("text")))
    kept = select.numbered(select.content_range(kept, is_content(F.col("text")), "book", "pos"), "book", "pos")
    title = select.title_or_number(F.col("title"), F.col("number"))
    return kept.select("book", "number", title.alias("title"), text.chapter_file_name(F.col("number"), text.normalize_name(title)).alias("file_name"), "filename", "text")


def chapters_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Web pages as books: a host is a book, a page an item."""
    ship(spark)
    items = page_items(spark, folder)
    # Exploded, so that the filter on the text isn't pushed below the expression, which would then run twice.
    read = items.select("book", "pos", "filename", F.explode(F.array(html.page_parts(F.col("html")))).alias("x")).select("book", "pos", "filename", "x.text", "x.title")
    return chapters(read).select("book", "number", "title", "file_name", "filename", F.length("text").alias("n_chars"))


def chapters_by_model(items: DataFrame, backend: Backend) -> DataFrame:
    """As chapters(), with the model's verdict on each item; replies are written once, as a model may answer differently again."""
    kept = items.where(select.is_substantial(F.col("text")))
    kept = kept.withColumn("prompt", prompts.classify(F.substring("text", 1, select.CLASSIFIED_CHARS)))
    judged = stored(asked(kept, "prompt", "reply", backend).withColumn("is_content", select.reply_is_content(F.col("reply"))).drop("prompt", "reply"))
    kept = select.numbered(select.content_range(judged, F.col("is_content"), "book", "pos"), "book", "pos")
    title = select.title_or_number(F.col("title"), F.col("number"))
    return kept.select("book", "number", title.alias("title"), text.chapter_file_name(F.col("number"), text.normalize_name(title)).alias("file_name"), "filename", "text")


def characters(chapter_rows: DataFrame, backend: Backend, aliases: DataFrame | None = None, invalid: list[str] | None = None, meta: DataFrame | None = None) -> DataFrame:
    """(book, char_id, name, bio, first_pos), with a narrator in each book.

    Characters of all chapters are merged; those that the model takes for one person are folded, one call a book; then known aliases
    (alias, canonical) are applied and ids in `invalid` go. meta: book, title, author.
    """
    rows = chapter_rows.withColumn("prompt", prompts.characters(F.substring("text", 1, CHARACTERS_CHARS)))
    found = stored(asked(rows.select("book", "number", "prompt"), "prompt", "reply", backend).select("book", "number", F.explode(replies.parse_characters(F.col("reply"))).alias("char_id", "c")))
    flat = found.select("book", "char_id", F.col("number").alias("pos"), F.coalesce("c.name", "char_id").alias("name"), F.coalesce(F.nullif("c.details", F.lit("")), "c.bio", F.lit("")).alias("details"))
    merged = entities.merge_characters(flat, ["book"])
    folded = fold_by_model(merged, backend)
    if aliases is not None or invalid:
        known = aliases if aliases is not None else folded.sparkSession.createDataFrame([], "alias string, canonical string")
        folded = entities.apply_known_aliases(folded, known, invalid or [], ["book"])
    return entities.upsert(folded, narrators(chapter_rows, backend, meta), ["book", "char_id"])


def fold_by_model(cast: DataFrame, backend: Backend) -> DataFrame:
    """cast: book, char_id, name, bio, first_pos. Characters that the model takes for one person become one."""
    lines = F.array_sort(F.collect_list(F.struct("first_pos", F.concat("char_id", F.lit(": "), "name").alias("line"))))
    asks = cast.groupBy("book").agg(prompts.same_people(F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("prompt"), F.count("*").alias("n")).where("n > 1")
    groups = stored(asked(asks, "prompt", "reply", backend).select("book", F.posexplode(replies.parse_groups(F.col("reply"))).alias("group_no", "ids")))
    members = groups.select("book", "group_no", F.posexplode("ids").alias("member_no", "char_id"))
    return entities.fold_aliases(cast, entities.alias_map(members, cast, ["book"]), ["book"])


def narrators(chapter_rows: DataFrame, backend: Backend, meta: DataFrame | None = None) -> DataFrame:
    """A narrator for each book, described by the model from title, author and the start of the first chapter; a plain one where its reply can't be read."""
    first = chapter_rows.groupBy("book").agg(F.min_by(F.substring("text", 1, SAMPLE_CHARS), "number").alias("sample"))
    meta = meta if meta is not None else first.select("book", F.col("book").cast("string").alias("title"), F.lit("").alias("author"))
    asks = first.join(meta.select("book", "title", "author"), "book", "left").withColumn("prompt", prompts.narrator(F.col("title"), F.col("author"), F.col("sample")))
    said = stored(asked(asks.select("book", "prompt"), "prompt", "reply", backend).select("book", replies.parse_person(F.col("reply")).alias("x")))
    return said.select("book", F.lit("narrator").alias("char_id"), F.coalesce("x.name", F.lit("Narrator")).alias("name"), F.coalesce("x.bio", F.lit("Tells the story.")).alias("bio"), F.lit(0).alias("first_pos"))


def voice_descriptions(cast: DataFrame, backend: Backend) -> DataFrame:
    """cast: book, char_id, bio. (book, char_id, description): one call each; an empty reply is asked for again."""
    asks = cast.select("book", "char_id", prompts.describe(F.col("char_id"), F.col("bio")).alias("prompt"))
    return stored(asked(asks, "prompt", "description", backend, accept=has_text, attempts=ATTEMPTS).select("book", "char_id", text.strip(F.col("description")).alias("description")))


def acoustic_descriptions(descriptions: DataFrame, backend: Backend) -> DataFrame:
    """descriptions: book, char_id, description. (book, char_id, acoustic): a book's characters in order of their ids, each prompt with the replies so far; so a book is one task."""
    ship(descriptions.sparkSession)
    asks = descriptions.select("book", "char_id", prompts.acoustic(F.col("char_id"), F.col("description")).alias("prompt"))
    kind = asks.schema["book"].dataType.simpleString()

    def talk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("char_id")
        said: list[str] = []
        for prompt in frame["prompt"]:
            said += backend.answer(["\n".join([prompt] if not said else [prompt.partition(prompts.RULE)[0], *said, prompts.RULE.strip(), prompt.partition(prompts.RULE)[2]])])
        return pd.DataFrame({"book": frame["book"], "char_id": frame["char_id"], "acoustic": said})

    return stored(asks.groupBy("book").applyInPandas(talk, f"book {kind}, char_id string, acoustic string"))


def voice_map(cast: DataFrame, backend: Backend) -> DataFrame:
    """(book, speaker, voice, speed): one call per book, so that a cast's voices stay distinct. cast: char_id, bio, and description if there is one."""
    about = F.coalesce("description", "bio") if "description" in cast.columns else F.col("bio")
    lines = F.array_sort(F.collect_list(F.concat("char_id", F.lit(": "), F.coalesce(about, F.lit("")))))
    catalog = F.lit("\n".join(voices.ALL_VOICES))
    asks = cast.groupBy("book").agg(prompts.voices(catalog, F.array_join(lines, "\n")).alias("prompt"))
    answers = stored(asked(asks, "prompt", "reply", backend).select("book", replies.parse_mapping(F.col("reply")).alias("m")))
    rows = cast.join(answers, "book", "left")
    entry = F.try_element_at("m", F.col("char_id"))
    fallback = F.when(F.col("char_id") == "narrator", voices.DEFAULT_NARRATOR).otherwise(voices.DEFAULT_VOICE)
    return rows.select("book", F.col("char_id").alias("speaker"), voices.sanitize_voice(entry["voice"], fallback).alias("voice"), voices.clamp_speed(entry["speed"]).alias("speed"))


def script(chapter_rows: DataFrame, backend: Backend, cast: DataFrame | None = None) -> DataFrame:
    """(book, number, line_no, speaker, text): the title as line 0, then the lines of all chunks in order.

    A chunk is asked for ATTEMPTS times; if no reply has a line, the narrator takes it whole. cast: book, char_id.
    """
    cut = chapter_rows.select("book", "number", F.posexplode(chunk_text(F.col("text"))).alias("chunk_no", "chunk"))
    if cast is None:
        cut = cut.withColumn("speakers", F.lit("narrator"))
    else:
        cut = cut.join(cast.groupBy("book").agg(F.array_join(F.array_sort(F.collect_set("char_id")), ", ").alias("speakers")), "book", "left")
    asks = cut.withColumn("prompt", prompts.script(F.col("chunk"), F.col("speakers"))).drop("speakers")
    answered = stored(asked(asks, "prompt", "reply", backend, accept=has_lines, attempts=ATTEMPTS).drop("prompt"))
    lines = replies.parse_script(F.col("reply"))
    whole = F.array(F.struct(F.lit("narrator").alias("speaker"), F.col("chunk").alias("text")))
    rows = answered.select("book", "number", "chunk_no", F.posexplode(F.when(F.size(lines) > 0, lines).otherwise(whole)).alias("k", "x"))
    titles = chapter_rows.select("book", "number", F.lit(-1).alias("chunk_no"), F.lit(0).alias("k"), F.struct(F.lit("narrator").alias("speaker"), F.col("title").alias("text")).alias("x"))
    w = F.row_number().over(select.W.partitionBy("book", "number").orderBy("chunk_no", "k")) - 1
    return titles.unionByName(rows).select("book", "number", w.alias("line_no"), "x.speaker", "x.text")


def plan_jobs(lines: DataFrame, voice_rows: DataFrame, finished: DataFrame | None = None) -> DataFrame:
    """(book, number, sub_idx, out_key, speaker, voice, speed, text) of all pieces that have no output yet. finished: book, number, out_key, size."""
    pieces = lines.select("book", "number", "line_no", "speaker", F.posexplode(text.split_long_text(F.col("text"))).alias("piece_no", "piece"))
    sub = F.row_number().over(select.W.partitionBy("book", "number").orderBy("line_no", "piece_no")) - 1
    pieces = pieces.withColumn("sub_idx", sub)
    pieces = pieces.withColumn("out_key", jobs.out_key(F.col("sub_idx")))
    entries = jobs.voice_entries(voice_rows, ["book", "speaker"])
    narrator = entries.where("speaker = 'narrator'").select("book", F.col("entry").alias("_narrator"))
    rows = pieces.join(entries, ["book", "speaker"], "left").join(narrator, "book", "left")
    chosen = F.coalesce("entry", "_narrator", jobs.default_entry())
    rows = rows.withColumn("_chosen", chosen).select(
        "book", "number", "sub_idx", "out_key", F.when(F.col("entry").isNull(), "narrator").otherwise(F.col("speaker")).alias("speaker"),
        "_chosen.voice", "_chosen.speed", F.col("piece").alias("text"),
    )
    return rows if finished is None else jobs.pending(rows, finished, ["book", "number", "out_key"])


def plan_chapters(paragraphs: DataFrame, order: str, voice: str, speed: float) -> DataFrame:
    """paragraphs: book, number, title, text and an order. A job for each sentence of a chapter, with the files of its line and of its chapter."""
    rows = paragraphs.select("book", "number", "title", F.col(order).alias("_at"), F.posexplode(text.split_sentences(F.col("text"))).alias("_k", "text"))
    rows = rows.withColumn("idx", F.row_number().over(select.W.partitionBy("book", "number").orderBy("_at", "_k")) - 1)
    chapter = F.format_string("%03d.wav", "number")
    return rows.select("book", "number", "title", "idx", "text", F.lit(voice).alias("voice"), F.lit(speed).alias("speed"), F.format_string(".lines_%03d/%05d.wav", "number", "idx").alias("line_file"), chapter.alias("chapter_file"))


def book_timeline(all_jobs: DataFrame, chapter_rows: DataFrame) -> DataFrame:
    """Chapter times when a word takes MS_PER_WORD."""
    spoken = all_jobs.groupBy("book", "number").agg((F.sum(text.word_count(F.col("text"))) * MS_PER_WORD).alias("duration_ms"))
    rows = chapter_rows.select("book", "number", "title").join(spoken, ["book", "number"])
    rows = select.number_duplicate_titles(rows, "book", "number").withColumns({"chime_ms": F.lit(800).cast("long"), "announce_ms": (text.word_count(F.col("title")) * MS_PER_WORD).cast("long")})
    return timeline.timeline(rows, ["book"], "number").select("book", "number", "title", "start_ms", "end_ms")


def whole_book(items: DataFrame, backend: Backend | None = None) -> dict[str, DataFrame]:
    """All tables of a run."""
    backend = backend or OfflineBackend()
    chapter_rows = chapters_by_model(items, backend)
    cast = characters(chapter_rows, backend)
    described = cast.join(voice_descriptions(cast, backend), ["book", "char_id"], "left")
    voice_rows = voice_map(described, backend)
    lines = script(chapter_rows, backend, cast)
    all_jobs = plan_jobs(lines, voice_rows)
    times = book_timeline(all_jobs, chapter_rows)
    return {"chapters": chapter_rows, "characters": cast, "descriptions": described, "voices": voice_rows, "script": lines, "jobs": all_jobs, "timeline": times, "metadata": timeline.metadata_file(times, ["book"], "number")}
