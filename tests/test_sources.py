from pyspark.sql import functions as F

from verso.operators import select
from verso.plans.book import whole_book
from verso.sources import epub, files, sound
from verso.sources.generator import generated_book
from verso.streaming import events

PARAGRAPH = "It was late. “Who is there?” Anna said, and nobody answered her in the long dark hall of the old house. "


def _books(spark):
    rows = [("b", "Tale & Co", "A. Writer", n, f"Part {n}", [PARAGRAPH * 8, "The end < now."]) for n in (1, 2)]
    return epub.epub_files(spark.createDataFrame(rows, "book string, title string, author string, number int, chapter_title string, paragraphs array<string>"))


def test_epub_round_trip_and_book(spark, tmp_path):
    content = bytes(_books(spark).first()["content"])
    (tmp_path / "b.epub").write_bytes(content)
    items = epub.read_epubs(spark, str(tmp_path))
    assert [tuple(r) for r in epub.metadata(items).collect()] == [("b", "Tale & Co", "A. Writer")]
    docs = epub.candidates(items)
    assert [r["title"] for r in docs.orderBy("pos").collect()] == ["Part 1", "Part 2"]
    assert docs.first()["text"].endswith("The end < now.")
    assert select.pick_cover(epub.cover_items(items), "book").count() == 0
    tables = whole_book(docs)
    assert tables["chapters"].count() == 2
    assert {r["char_id"] for r in tables["characters"].collect()} >= {"narrator"}
    lines = tables["script"].where("number = 1").orderBy("line_no").collect()
    assert lines[0]["text"] == "Part 1" and {r["speaker"] for r in lines} == {"narrator", "speech"}
    spoken = tables["jobs"].collect()
    assert all(len(r["text"].split()) <= 35 for r in spoken) and {r["speaker"] for r in spoken} == {"narrator"}
    assert tables["timeline"].count() == 2 and tables["metadata"].first()["metadata"].count("[CHAPTER]") == 2


def test_script_and_chapter_files(spark, tmp_path):
    (tmp_path / "00-intro.txt").write_text("T by A")
    (tmp_path / "10-x.txt").write_text("ten")
    assert [r["number"] for r in files.read_chapters(spark, str(tmp_path)).orderBy("number").collect()] == [0, 10]
    lines = spark.createDataFrame([("c", 0, "ann", "hé"), ("c", 1, "bob", "yo")], "chapter string, line_no int, speaker string, text string")
    (tmp_path / "01-a.jsonl").write_text(files.script_text(lines, ["chapter"]).first()["jsonl"] + "\n\n", encoding="utf-8")
    assert [tuple(r)[1:] for r in files.read_scripts(spark, str(tmp_path)).orderBy("line_no").collect()] == [(0, "ann", "hé"), (1, "bob", "yo")]
    doc = files.json_document(spark.createDataFrame([("b", "x", "X", "bio")], "book string, char_id string, name string, bio string"), ["book"], "char_id", ["name", "bio"]).first()["json"]
    (tmp_path / "c.json").write_text(doc)
    assert files.read_json_map(spark, str(tmp_path / "c.json")).select("char_id", "bio").first() == ("x", "bio")


def test_finished_rows_are_left_alone(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = lambda v: spark.createDataFrame([("k", v)], "key string, value string")
    files.append_new(rows("PRESERVED"), path, ["key"])
    files.append_new(rows("new"), path, ["key"])
    assert [r["value"] for r in spark.read.parquet(path).collect()] == ["PRESERVED"]


def test_sound(spark):
    a, b = sound.silence(0.5), sound.chime()
    rows = spark.createDataFrame([("c", 1, b), ("c", 0, a)], "chapter string, n int, data binary")
    joined = sound.joined_wavs(rows, ["chapter"], "n")
    assert abs(joined.select(sound.wav_seconds("data")).first()[0] - 1.3) < 1e-3
    parts = joined.select(sound.wav_parts("data").alias("p")).select("p.*")
    again = parts.select(sound.with_header(F.col("frames")).alias("w")).first()["w"]
    assert sound.read_wav(bytes(again))[:3] == (2, 1, 24000)
    assert bytes(again) == bytes(joined.first()["data"])


def test_generator(spark):
    import re

    for pages, n_chapters in ((10, 10), (5, 5), (40, 12)):
        rows = generated_book(spark, pages, 3).orderBy("chapter", "paragraph").collect()
        words = [len(r["text"].split()) for r in rows]
        assert words == [r["words"] for r in rows]
        target, own = pages * 300, max(300, pages * 300 // 12)
        assert target <= sum(words) < target + words[-1] + 1 and rows[-1]["chapter"] <= n_chapters
        by = {}
        for r in rows:
            by.setdefault(r["chapter"], []).append(r["words"])
        assert list(by) == list(range(1, len(by) + 1))
        assert all(sum(v) >= own > sum(v[:-1]) for v in list(by.values())[:-1])
        ends = [len(re.findall(r"(?:[.!?…]+|—)(?= [Jj]|$)", r["text"])) for r in rows]
        assert max(ends) >= 8
    assert generated_book(spark, 10, 3).exceptAll(generated_book(spark, 10, 3)).count() == 0


def test_resampled_sounds(spark):
    import numpy as np

    t = np.arange(4800) / 48_000
    stereo = (np.stack([np.sin(2 * np.pi * 500 * t)] * 2, 1) * 20_000).astype("<i2").tobytes()
    rows = spark.createDataFrame([("c", 0, sound.wav_bytes(stereo, 48_000, 2, 2)), ("c", 1, sound.wav_bytes(bytes([128] * 800), 8000, 1, 1))], "chapter string, n int, data binary")
    width, channels, rate, frames = sound.read_wav(bytes(sound.joined_wavs(rows, ["chapter"], "n", resample=True).first()["data"]))
    x = np.frombuffer(frames, "<i2")
    assert (width, channels, rate, len(x)) == (2, 1, 24_000, 2400 + 2400)
    assert np.abs(x[:2400] - 20_000 * np.sin(2 * np.pi * 500 * np.arange(2400) / 24_000)).max() < 200 and not x[2400:].any()


def test_streams_agree_with_batches(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    table.repartition(1).write.mode("append").parquet(f"{tmp_path}/in/events")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in/events")
    for name, plan in (("tumbling", events.tumbling), ("sliding", events.sliding), ("sessions", events.sessions)):
        mode = "append" if name == "sessions" else "complete"
        q = plan(stream).writeStream.format("memory").queryName(f"w_{name}").outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp_{name}").start()
        q.processAllAvailable()
        q.stop()
        got, want = spark.table(f"w_{name}"), plan(table)
        assert got.exceptAll(want).count() == 0
        assert (want.count() == got.count()) if mode == "complete" else (0 < got.count() <= want.count())


def test_speech(spark):
    from verso.operators import jobs
    from verso.plans import speech

    rows = [("b", n, k, "one two three " * (k + 1), "af_heart", 1.0) for n in (1, 2) for k in range(30)]
    work = spark.createDataFrame(rows, "book string, number int, sub_idx int, text string, voice string, speed double")
    batches = speech.spoken_batches(work, speech.engine("offline"))
    assert batches.count() == 2
    lines = speech.line_sounds(batches).cache()
    got = {(r["number"], r["sub_idx"]): r["s"] for r in lines.select("number", "sub_idx", sound.wav_seconds("data").alias("s")).collect()}
    assert len(got) == 60 and all(abs(s - 1.2 * (k + 1)) < 1e-3 for (_, k), s in got.items())
    chapters = speech.chapter_sounds(lines)
    said = spark.createDataFrame([("b", 1, sound.silence(0.7))], "book string, number int, data binary")
    titles = spark.createDataFrame([("b", 1, "x"), ("b", 2, "y")], "book string, number int, title string")
    timed = speech.timed_chapters(titles, chapters, said, sound.chime())
    rows = timed.orderBy("number").collect()
    assert rows[0]["end_ms"] == 800 + 500 + 700 + 1000 + rows[0]["duration_ms"] and rows[1]["start_ms"] == rows[0]["end_ms"] + 3000
    book = speech.book_sound(timed, chapters, said, sound.chime()).select(sound.wav_seconds("data")).first()[0]
    assert abs(book * 1000 - (rows[1]["end_ms"] + 3000)) < 2
    assert jobs.pending(work, lines.withColumn("size", F.length("data")), ["book", "number", "sub_idx"]).count() == 0


class FakeService:
    """Answers by a script; an OSError in it is raised."""

    def __init__(self, statuses, results):
        self.statuses, self.results, self.submitted = list(statuses), list(results), 0

    def _next(self, queue):
        x = queue.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    def submit(self, kind, params):
        self.submitted += 1
        return f"job{self.submitted}"

    def status(self, job):
        return self._next(self.statuses)

    def result(self, job):
        return self._next(self.results)


def test_remote_jobs():
    import pytest

    from verso.plans.remote import fetched

    waits = []
    service = FakeService(["waiting", OSError(), "waiting", "failed", "done", "done"], [b"short", OSError(), b"x" * 100])
    assert fetched(service, "speak", {}, sleep=waits.append) == b"x" * 100 and service.submitted == 3
    assert waits.count(5) == 2
    with pytest.raises(RuntimeError):
        fetched(FakeService(["failed"] * 3, []), "speak", {}, sleep=waits.append)
    with pytest.raises(OSError):
        fetched(FakeService([OSError()] * 5, []), "speak", {}, sleep=waits.append)


def test_replies_are_asked_for_again(spark):
    from verso.plans.backend import asked, has_lines

    class Stubborn:
        def __init__(self):
            self.calls = 0

        def answer(self, prompts):
            self.calls += 1
            return ['{"narrator": "x"}' if p == "good" or self.calls >= 4 else "no lines" for p in prompts]

    rows = spark.createDataFrame([("good",), ("bad",)], "p string").coalesce(1)
    assert {r["p"]: r["r"] for r in asked(rows, "p", "r", Stubborn(), accept=has_lines, attempts=6).collect()} == {"good": '{"narrator": "x"}', "bad": '{"narrator": "x"}'}
    assert {r["p"]: r["r"] for r in asked(rows, "p", "r", Stubborn(), accept=has_lines, attempts=2).collect()}["bad"] == "no lines"


def test_voices_of_a_cast(spark):
    from verso.plans import book, speech
    from verso.plans.backend import OfflineBackend

    cast = spark.createDataFrame([("b", "ann", "calm"), ("b", "narrator", "clear"), ("c", "bob", None)], "book string, char_id string, bio string")
    described = book.voice_descriptions(cast, OfflineBackend())
    assert all(r["description"] for r in described.collect())
    assert {(r["book"], r["char_id"]) for r in book.acoustic_descriptions(described, OfflineBackend()).collect()} == {("b", "ann"), ("b", "narrator"), ("c", "bob")}
    work = cast.selectExpr("book", "char_id", "'one two' AS text", "'af_heart' AS voice", "1.0D AS speed")
    done = spark.createDataFrame([("b", "ann", 5000), ("c", "bob", 10)], "book string, char_id string, size int")
    samples = speech.voice_samples(work, speech.engine("offline"), done).select("char_id", sound.wav_seconds("data").alias("s")).collect()
    assert {r["char_id"]: round(r["s"], 2) for r in samples} == {"narrator": 0.8, "bob": 0.8}


def test_errors_on_missing_input(spark):
    import pytest

    rows = spark.createDataFrame([("b", 1), ("b", 2), ("c", 1)], "book string, n int")
    assert select.nth_chapter(rows, "book", "n", 0, strict=True).count() == 2
    with pytest.raises(IndexError):
        select.nth_chapter(rows, "book", "n", 1, strict=True)
    with pytest.raises(ValueError, match="no chapters"):
        select.require_rows(rows.where("n > 5"), "chapters")
