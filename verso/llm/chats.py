"""Chat formatting by event-sourced reconstruction.

A log has events (conversation, sequence, kind, message id, role, text). Kinds: `message` starts a message with a text, `delta`
appends to a message (and starts it if need be), `edit` replaces its text, `regenerate` empties it for new deltas. Events of a
message are brought together by conversation and message and folded in the order of their sequence; the position of a
message is the sequence at which it started. So one long conversation is folded by many tasks. Messages are then rendered one by
one and put in order by conversation and position; readers stream them and hold one message and running hashes.

Template: `<turn role="ROLE">TEXT</turn>` and a line feed. Inside roles and texts `\\`, `<` and `"` get a backslash before them, so
no text can open or close a turn and unescaping gives the text back. The loss mask of a turn is its text's span, for assistants.

Edge cases: null roles and texts count as empty; an unknown or null kind counts as `message`; null conversations form one
conversation and null sequences come first; equal sequences go by role, then text, and repeated rows stay; an empty
log gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.cluster import ship

TURN = re.compile(r'<turn role="((?:[^"\\<]|\\.)*)">((?:[^"\\<]|\\.)*)</turn>\n', re.S)
ASSISTANT = "assistant"


def escape(text: str) -> str:
    return re.sub(r'([\\<"])', r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(role: str, text: str) -> str:
    return f'<turn role="{escape(role)}">{escape(text)}</turn>\n'


def read_turn(rendered: str) -> tuple[str, str, tuple[int, int] | None]:
    """Role and text of a rendered turn, and its span under the loss mask."""
    m = TURN.fullmatch(rendered)
    if not m:
        raise ValueError("not one turn")
    role = unescape(m[1])
    return role, unescape(m[2]), m.span(2) if role == ASSISTANT else None


def rendered_messages(events: DataFrame) -> DataFrame:
    """events: conv_id, seq, kind, message_id, role, text. Gives (conv_id, position, role, text, rendered), a row per final message."""
    ship(events.sparkSession)
    rows = events.select("conv_id", "message_id", "seq", *(F.coalesce(c, F.lit("")).alias(c) for c in ("kind", "role", "text")))
    rows = rows.repartition("conv_id", "message_id").sortWithinPartitions("conv_id", "message_id", "seq", "role", "text")
    conv, seq = rows.schema["conv_id"].dataType.simpleString(), rows.schema["seq"].dataType.simpleString()
    names = ["conv_id", "position", "role", "text", "rendered"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, schema = None, [], None

        def close() -> None:
            if now:
                text = "".join(now[4])
                done.append((now[0], now[2], now[3], text, render(now[3], text)))

        def flush() -> pa.RecordBatch:
            kinds = [schema.field("conv_id").type, schema.field("seq").type, pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            schema = batch.schema
            for c, m, s, kind, role, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
                same = now is not None and (now[0], now[1]) == (c, m)
                if same and kind == "delta":
                    now[4].append(text)
                elif same and kind == "edit":
                    now[4] = [text]
                elif same and kind == "regenerate":
                    now[4] = []
                else:
                    close()
                    now = [c, m, s, role, [text]]
            if done:
                yield flush()
                done.clear()
        close()
        if done:
            yield flush()

    return rows.mapInArrow(run, f"conv_id {conv}, position {seq}, role string, text string, rendered string")


def digests(messages: DataFrame) -> DataFrame:
    """From rendered messages: a row per conversation with hashes of what a reader gets back."""
    rows = messages.select("conv_id", "position", "role", "text", "rendered").repartition("conv_id").sortWithinPartitions("conv_id", "position", "role", "text").select("conv_id", "rendered")
    conv = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, kind = None, [], None

        def close() -> None:
            if now:
                done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        def flush() -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv_id, rendered in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now is None or now[0] != conv_id:
                    close()
                    now = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, mask = read_turn(rendered)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                if mask:
                    learnt = unescape(rendered[mask[0] : mask[1]])
                    now[3] += len(learnt)
                    now[4].update(learnt.encode())
                now[5] += len(rendered)
            if done:
                yield flush()
                done.clear()
        close()
        if done:
            yield flush()

    return rows.mapInArrow(run, f"conv_id {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as the log of their making: each turn is a message of its own.

    It starts with a third of its text and a wrong draft; it is regenerated, streamed again with an error, edited, and its last
    third comes as a delta. A sequence is the turn and the step in it.
    """
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("message_id"))
    third = F.floor(F.length("text") / 3).cast("int")
    a, b, c = F.substring("text", F.lit(1), third), F.substring("text", third + 1, third), F.substring("text", third * 2 + 1, F.length("text"))
    steps = [("message", a), ("delta", F.lit(" a wrong <draft>")), ("regenerate", F.lit("")), ("delta", a), ("delta", F.lit(" an error")), ("edit", F.concat(a, b)), ("delta", c)]
    log = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(kind).alias("kind"), text.alias("text")) for i, (kind, text) in enumerate(steps)))
    return rows.select("conv_id", "turn", "message_id", "role", F.explode(log).alias("x")).select("conv_id", F.struct("turn", "x.step").alias("seq"), "x.kind", "message_id", "role", "x.text")


def _sql() -> str:
    """DuckDB SQL for digests() of rendered turns over `conversations` and the conversation -7."""
    esc = lambda c: f"""replace(replace(replace({c}, '\\', '\\\\'), '<', '\\<'), '"', '\\"')"""
    return f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, i, r, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(i, r))
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = '{ASSISTANT}'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = '{ASSISTANT}'), '')) AS loss_sha256,
        sum(length('<turn role="') + length({esc("role")}) + length('">') + length({esc("text")}) + length('</turn>') + 1)::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id"""


SQL = _sql()
