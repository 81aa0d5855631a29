import pytest
from pyspark.sql import functions as F

from verso.operators import entities, jobs, select, state, timeline


def test_substantial(spark):
    rows = spark.createDataFrame([("x " * 200,), ("x " * 300,)], "t string").select(select.is_substantial(F.col("t"))).collect()
    assert [r[0] for r in rows] == [False, True]


def test_duplicate_titles(spark):
    titles = ["Intro", "Interlude", "Chapter One", "Interlude", "Chapter Two", "Interlude"]
    rows = spark.createDataFrame([("b", i, t) for i, t in enumerate(titles)], "book string, seq int, title string")
    got = [r["title"] for r in select.number_duplicate_titles(rows, "book", "seq").orderBy("seq").collect()]
    assert got == ["Intro", "Interlude 1", "Chapter One", "Interlude 2", "Chapter Two", "Interlude 3"]


def test_content_range(spark):
    rows = spark.createDataFrame([("a", i, c) for i, c in enumerate([False, True, False, True, False])] + [("b", 0, False)], "book string, pos int, ok boolean")
    assert [(r["book"], r["pos"]) for r in select.content_range(rows, F.col("ok"), "book", "pos").orderBy("pos").collect()] == [("a", 1), ("a", 2), ("a", 3)]
    verdicts = spark.createDataFrame([("Content",), ("noncontent",), ("",)], "r string").select(select.reply_is_content(F.col("r"))).collect()
    assert [r[0] for r in verdicts] == [True, False, False]


def test_limits(spark):
    rows = spark.createDataFrame([("a", i, 10) for i in range(5)], "book string, pos int, n int")
    assert select.first_chapters(rows, "book", "pos", 0).count() == 5 and select.first_chapters(rows, "book", "pos", 2).count() == 2
    assert select.nth_chapter(rows, "book", "pos", 4).count() == 1 and select.nth_chapter(rows, "book", "pos", 5).count() == 0
    assert select.until_words(rows, "book", "pos", "n", 25).count() == 3


def test_entities(spark):
    rows = spark.createDataFrame([("b", 2, "x", "Xa", "two"), ("b", 1, "x", "X", "one"), ("b", 1, "xlong", "X Long", "one")], "book string, pos int, char_id string, name string, details string")
    merged = entities.merge_characters(rows, ["book"])
    assert {r["char_id"]: (r["name"], r["bio"]) for r in merged.collect()} == {"x": ("X", "one two"), "xlong": ("X Long", "one")}
    groups = spark.createDataFrame([("b", 0, 0, "x"), ("b", 0, 1, "xlong"), ("b", 0, 2, "unknown_longest"), ("b", 1, 0, "nobody")], "book string, group_no int, member_no int, char_id string")
    aliases = entities.alias_map(groups, merged, ["book"])
    assert {(r["char_id"], r["canonical"]) for r in aliases.collect()} == {("x", "xlong"), ("xlong", "xlong")}
    folded = entities.fold_aliases(merged, aliases, ["book"]).collect()
    assert len(folded) == 1 and folded[0]["name"] == "X Long" and folded[0]["bio"] in ("one two", "one one two")
    pairs = entities.duplicate_pairs(merged, ["book"]).collect()
    assert len(pairs) == 1


def test_jobs(spark):
    lines = spark.createDataFrame([("c", 0, "ann", "hi"), ("c", 1, "bob", "yo")], "chapter string, line_no int, speaker string, text string")
    known = spark.createDataFrame([("ann",)], "speaker string")
    with pytest.raises(Exception, match="no narrator"):
        jobs.with_known_speakers(lines, known).collect()
    both = known.unionByName(spark.createDataFrame([("narrator",)], "speaker string"))
    assert [r["speaker"] for r in jobs.with_known_speakers(lines, both).orderBy("line_no").collect()] == ["ann", "narrator"]
    no_map = spark.createDataFrame([], "speaker string, voice string, speed double")
    assert {(r["voice"], r["speed"]) for r in jobs.with_voices(lines, no_map).collect()} == {("af_heart", 1.0)}
    done = spark.createDataFrame([("c", 0, 99), ("c", 1, 100)], "chapter string, line_no int, size int")
    assert [r["line_no"] for r in jobs.pending(lines, done, ["chapter", "line_no"]).collect()] == [0]
    with pytest.raises(Exception, match="samples"):
        jobs.item_samples(spark.createDataFrame([(["a"], [1, 2])], "items array<string>, item_samples array<int>")).collect()


def test_timeline_invariants(spark):
    rows = spark.createDataFrame([("b", i, f"t{i}", 1000 * i, 700 if i % 2 else None, 800) for i in range(1, 6)], "book string, seq int, title string, duration_ms long, announce_ms long, chime_ms long")
    got = timeline.timeline(rows, ["book"], "seq").orderBy("seq").collect()
    assert all(a["end_ms"] + 3000 == b["start_ms"] for a, b in zip(got, got[1:]))
    total = timeline.interleaved(rows, "seq").agg(F.sum("ms")).first()[0]
    assert total == got[-1]["end_ms"] + 3000
    meta = timeline.metadata_file(timeline.timeline(rows, ["book"], "seq"), ["book"], "seq").first()["metadata"]
    assert meta.startswith(";FFMETADATA1\n\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=") and meta.count("[CHAPTER]") == 5


def test_state_log(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    assert state.read_state(spark, path).count() == 0
    state.append_state(spark, path, "audio", "item 1")
    assert not state.is_complete(state.read_state(spark, path), "audio")
    state.mark_complete(spark, path, "audio")
    state.mark_items(spark.createDataFrame([("2",)], "item string"), path, "audio")
    log = state.read_state(spark, path)
    assert state.is_complete(log, "audio") and not state.is_complete(log, "other")
    assert {r["detail"] for r in state.completed_items(log, []).collect()} == {"item 1", "2"}
    with state.timed(spark, f"{path}_t", "x"):
        pass
    assert state.with_total(spark.read.schema(state.TIMINGS).json(f"{path}_t")).count() == 2
