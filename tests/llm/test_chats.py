from hypothesis import given
from hypothesis import strategies as st

from verso.llm import chats


@given(st.text(alphabet='a<>/\\"#\n turn=', max_size=30), st.text(alphabet='a<>/\\"', max_size=5))
def test_turns_read_back(text, role):
    rendered = chats.render(role, text)
    assert chats.read_turn(rendered)[:2] == (role, text)
    both = rendered + chats.render("assistant", text)
    assert [chats.unescape(m[2]) for m in chats.TURN.finditer(both)] == [text, text]


def test_fold(spark):
    log = [
        (1, 0, "message", 0, "user", "hi"), (1, 1, "delta", 1, "assistant", "He"), (1, 2, "delta", 1, "assistant", "llo"),
        (1, 3, "message", 2, "user", "typo"), (1, 4, "edit", 2, "user", "fixed"), (1, 5, "delta", 3, "assistant", "bad"),
        (1, 6, "regenerate", 3, "assistant", None), (1, 7, "delta", 3, "assistant", "go"), (1, 8, "delta", 3, "assistant", "od"),
        (2, 0, "message", 0, "user", "other"),
    ]
    rows = chats.rendered_messages(spark.createDataFrame(log, "conv_id long, seq long, kind string, message_id long, role string, text string")).orderBy("conv_id", "position").collect()
    assert [(r["conv_id"], r["position"], r["role"], r["text"]) for r in rows] == [(1, 0, "user", "hi"), (1, 1, "assistant", "Hello"), (1, 3, "user", "fixed"), (1, 5, "assistant", "good"), (2, 0, "user", "other")]


def test_log_of_turns_uses_every_kind(spark):
    rows = [(1, 0, "user", "one two three"), (1, 0, "user", "one two three"), (1, 1, "assistant", "é"), (1, 2, "assistant", ""), (1, None, None, None), (None, 5, "user", 'a "b" <c> \\')]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chats.events_of_turns(turns)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "delta", "regenerate", "edit"}
    got = chats.rendered_messages(log).select("conv_id", "position.turn", "role", "text").collect()
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted([(c, t, r or "", x or "") for c, t, r, x in rows], key=key)
