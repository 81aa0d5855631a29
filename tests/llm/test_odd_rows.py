"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names, for each operator and stage."""

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from verso.llm import audio, bpe, chats, mixing, near_dups, quality_rules, secrets, substring_dedup, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LONG = "word and more " * 90_000  # longer than a block
ROWS = [(1, "some text here", "en", "a", 1), (1, "some text here", "en", "a", 1), (2, None, None, None, None), (None, "no id", "en", "b", 5), (3, "", "en", "a", 0), (4, " \t\n ", "de", "b", 4), (5, LONG, "en", "a", 9), (6, "x" * 50_000, "en", None, 9), (7, "é ß   日本", "fr", "c", 7)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
MODEL = toxicity.train(["you idiot", "nice day"] * 5, [1, 0] * 5)

OPERATORS = {
    "toxicity": lambda df: toxicity.score_texts(df, MODEL),
    "rules": quality_rules.repetition_rules,
    "substring": substring_dedup.without_repeats,
    "mixing": mixing.mix_plan,
    "secrets": secrets.secret_report,
    "audio": audio.audio_columns,
    "near_dups": near_dups.near_duplicate_classes,
    "bpe": lambda df: bpe.encode_decode(df, VOCABULARY),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("score", "n_words", "kept", "size", "target", "taken", "band", "node", "hub", "hash", "th", "start", "id", "secret_all", "feature", "ids", "mix_copies", "mix_source"):
        df = df.withColumn(c, F.lit("clash"))
    got = OPERATORS[name](df).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
    twins = [tuple(r) for r in got if r["doc_id"] == 1]
    assert twins[0] == twins[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_chats_odd_rows(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 2, "assistant", "<x> \\ \"q\""), (2, 1, "assistant", "")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chats.digests(chats.rendered_messages(chats.events_of_turns(turns.withColumn("seq", F.lit(1)).withColumn("kind", F.lit("edit")))) ).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["loss_chars"] == 9 and got[2]["loss_chars"] == 0
    assert chats.digests(chats.rendered_messages(chats.events_of_turns(turns.limit(0)))).collect() == []


STAGES = {
    "toxicity": lambda df: toxicity.without_toxic(df, df.sparkSession.createDataFrame([], "doc_id long, toxic int")),
    "near_dups": near_dups.one_of_each_class,
    "secrets": secrets.masked,
    "mixing": mixing.mix,
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(spark, name):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("row", "secret_all", "secret_base", "mix_copies", "mix_source", "id", "class_id", "score"):
        df = df.withColumn(c, F.lit("clash"))
    got = STAGES[name](df)
    assert got.columns == df.columns
    rows = got.collect()
    assert {r["row"] for r in rows} == {"clash"} and {r["secret_all"] for r in rows} == {"clash"}
    assert STAGES[name](df.limit(0)).collect() == []
    if name != "mixing":
        assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS}
