import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verso.functions import html, replies, text, voices
from verso.functions.chunks import cut


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw,slug", [("Chapter One", "chapter_one"), ("The Don Salvara Game", "the_don_salvara_game"), ("Hello-World!", "helloworld"), ("Café Münster", "cafe_munster"), ("", ""), (None, None)])
def test_normalize_name(spark, raw, slug):
    assert one(spark, raw, text.normalize_name) == slug


def test_comparable_ids(spark):
    assert one(spark, "The_Don_Ése", text.normalize_for_comparison) == "ese"
    assert one(spark, "dona_the_x", text.normalize_for_comparison) == "the_x"


def test_words_and_white_space(spark):
    assert one(spark, "  a b \n", text.strip) == "a b"
    assert one(spark, " a b c ", text.word_count) == 3
    assert one(spark, "", text.word_count) == 0


def pack(t, most=35):
    if len(t.split()) <= most:
        return [t]
    out, line, n = [], [], 0
    for s in re.split(r"(?<=[.!?])\s+", t):
        k = len(s.split())
        if line and n + k > most:
            out.append(" ".join(line))
            line, n = [], 0
        line.append(s)
        n += k
    return out + [" ".join(line)]


def test_split_long_text(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "bb", "c.", "d!", "e?", "f\n"]) for _ in range(rng.randrange(1, 200))) for _ in range(60)] + ["", "a " * 80, "x. " * 40]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", text.split_long_text(F.col("x")).alias("y")).collect()
    assert {r["i"]: r["y"] for r in rows} == {i: pack(t) for i, t in enumerate(texts)}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=300), st.integers(2, 40))
def test_chunks_are_lossless(t, size):
    parts = cut(t, size)
    assert "".join(parts) == t and all(0 < len(p) <= size + 1 for p in parts)


def test_small_texts(spark):
    assert one(spark, "<THINK>a\nb</think> hi <think>c</think>", text.strip_think) == "hi"
    assert one(spark, " Really?! Yes… no — ok. ", text.split_sentences) == ["Really?!", "Yes…", "no —", "ok."]
    assert one(spark, "01-the_end_of_it", text.display_name) == "The End Of It"
    assert one(spark, "a=b;c#d\\", text.escape_metadata) == r"a\=b\;c\#d\\"
    assert one(spark, "<a & b>", text.escape_html) == "&lt;a &amp; b&gt;"
    assert one(spark, " \"'x'\" ", text.strip_quotes) == "x"
    assert one(spark, 20, text.backoff_seconds, "int") == 60
    assert one(spark, "x" * 81, text.preview) == "x" * 80 + "..."
    assert one(spark, 123, lambda n: text.chapter_file_name(n, F.lit("s" * 50)), "int") == f"123-{'s' * 40}.txt"


def test_html_reader():
    page = "<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><div>in <p>one<br>two<p>three</div><h2> T <b>x</b></h2><h1></h1><blockquote>q &amp; r<!-- no --></blockquote></body></html>"
    assert html.read_blocks(page) == "in one two three\n\none two\n\nthree\n\nT x\n\nq & r"
    assert html.read_title(page) == "Tx"
    assert html.read_title("<p>no</p>") is None and html.read_title("<h1>" + "x" * 200 + "</h1>") is None
    assert html.read_blocks("") == ""


def test_replies(spark):
    body = '{"characters": {"a": {"name": "A", "details": "d"}}}'
    for reply in (body, f"```json\n{body}\n```", f"Sure:\n```\n{body}\n```\nbye", f"so {body} yes"):
        got = one(spark, reply, replies.parse_characters)
        assert list(got) == ["a"] and got["a"]["name"] == "A" and got["a"]["details"] == "d"
    assert one(spark, "", replies.parse_characters) == {} and one(spark, "{broken", replies.parse_characters) == {}
    lines = "```json\n" + '{"speaker_id": "x", "text": "1"}\n{"speaker": "y", "text": "2"}\nwords\n{bad}\n{"z": "3"}' + "\n```"
    assert [tuple(r) for r in one(spark, lines, replies.parse_script)] == [("x", "1"), ("y", "2"), ("z", "3")]
    with pytest.raises(Exception):
        one(spark, "nothing", lambda x: replies.parse_strict(x, "a int"))
    assert one(spark, "x", replies.parse_mapping) == {}


def test_voices(spark):
    assert voices.voice_catalog(spark).count() == 54
    clean = lambda s: one(spark, s, lambda x: voices.sanitize_voice(x, F.lit("f")))
    assert [clean(s) for s in ("af_sky * .5+bm_george", "", None, "af_sky+no", "af_sky*")] == ["af_sky*.5+bm_george", "f", "f", "f", "af_sky"]
    speed = lambda s: one(spark, s, voices.clamp_speed)
    assert [speed(s) for s in ("0.1", "2", "1.23456", "fast", None)] == [0.7, 1.3, 1.235, 1.0, 1.0]
    assert one(spark, "xq_y", voices.describe_voice) == "English male"
