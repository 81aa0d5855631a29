"""Repetition coverage: how many characters of a text lie inside duplicated n-grams and lines.

Rolling 64-bit hashes of words, word n-grams and lines are made in numpy for a block of whole texts at once; an n-gram or
line is duplicated if its hash occurs again in the same text and its words or bytes, which are then compared, are the same. One scan, no shuffle; memory is bounded by a block
(`bytes_np.BLOCK_BYTES`, or one text that is longer) and nothing of a text is left out.

Edge cases: a null text counts as empty (no words, base_failed, not kept); rows with equal or null ids each give a row; an
empty table gives an empty result; further columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verso.cluster import ship
from verso.llm import bytes_np as B

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Largest percentages of a text's word characters inside duplicated n-grams, by n, and inside repeated lines."""

    gram_percent: tuple[tuple[int, int], ...] = ((5, 15), (6, 14), (7, 13), (8, 12), (9, 11), (10, 10))
    line_percent: int = 20
    least_words: int = 10
    repeat_percent: int = 20


def measure(data: np.ndarray, off: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """Counts of each text of a block."""
    n = len(off) - 1
    start, end, first = B.words(data, off)
    word_of = B.owners(first)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    chars = lead[end] - lead[start]
    total = lambda v, of: np.bincount(of, weights=v, minlength=n).astype(np.int64)
    salt = B.mix(np.arange(1, n + 1, dtype=np.uint64))
    out = {"n_words": np.diff(first), "word_chars": total(chars, word_of)}
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    out["n_symbols"] = symbols[off[1:]] - symbols[off[:-1]]

    # Lines: cut at \n; only those with a word count.
    cut = np.flatnonzero(data == 0x0A)
    line_start = np.sort(np.concatenate([off[:-1], cut + 1]))
    line_end = np.sort(np.concatenate([cut, off[1:]]))
    words_at = np.searchsorted(start, line_start)
    full = np.searchsorted(start, line_end) > words_at
    line_start, line_end = line_start[full], line_end[full]
    line_of = word_of[words_at[full]] if len(word_of) else np.zeros(0, np.int64)
    one, two = B.repeated(B.span_hash(data, line_start, line_end) ^ salt[line_of])
    again = np.zeros(len(line_of), bool)
    if (B.same_bytes(data, line_start[one], line_end[one], line_start[two], line_end[two]) & (line_of[one] == line_of[two])).all():
        again[two] = True
    else:
        seen: set[tuple[int, bytes]] = set()
        for i, line in enumerate(zip(line_of.tolist(), (data[x:y].tobytes() for x, y in zip(line_start, line_end)))):
            again[i] = line in seen
            seen.add(line)
    out["n_dup_lines"] = total(again, line_of)
    upto = np.concatenate([[0], np.cumsum(chars)])
    in_line = upto[np.searchsorted(start, line_end)] - upto[np.searchsorted(start, line_start)]
    out["dup_line_chars"] = total(in_line * again, line_of)

    h = B.span_hash(data, start, end)
    number = None
    for size, _ in sorted(rules.gram_percent):
        m = max(0, len(h) - size + 1)
        at = np.flatnonzero(B.inside(first, size, m)) if number is None else candidates[B.inside(first, size, m)[candidates[candidates < m]].nonzero()[0]]
        key = B.window_hash(h, size)[at] ^ salt[word_of[at]]
        one, two = (at[i] for i in B.repeated(key))
        hit = np.zeros(m, bool)
        hit[one] = hit[two] = True
        if number is None:  # equal n-grams have equal hashes, so longer ones that recur lie among these words
            candidates = np.flatnonzero(hit)
            number = np.full(len(h), -1)
            words = np.flatnonzero(B.covered(hit, size, len(h)))
            number[words], _ = B.dictionary(data, start[words], end[words])
        if not ((word_of[one] == word_of[two]).all() and all((number[one + k] == number[two + k]).all() for k in range(size))):
            rows = np.column_stack([word_of[at], *(number[at + k] for k in range(size))])
            _, kind, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
            hit[:] = False
            hit[at[(count[kind.ravel()] > 1) & (rows[:, 1:] >= 0).all(1)]] = True
        inside = B.covered(hit, size, len(h))
        if size == 5:
            out["n_repeat_words"] = total(inside, word_of)
        out[f"dup_chars_{size}"] = total(chars * inside, word_of)
    return out


def verdicts(m: dict[str, np.ndarray], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < rules.least_words) | (100 * m["n_repeat_words"] > rules.repeat_percent * m["n_words"])
    bad = 100 * m["dup_line_chars"] > rules.line_percent * m["word_chars"]
    for size, percent in rules.gram_percent:
        bad |= 100 * m[f"dup_chars_{size}"] > percent * m["word_chars"]
    return failed, ~failed & ~bad


def repetition_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Per row: id, word counts, characters inside duplicated n-grams and lines, base_failed, kept."""
    if 5 not in dict(rules.gram_percent):
        raise ValueError("the base rule needs n-grams of 5 words")
    ship(df.sparkSession)
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["dup_line_chars", *(f"dup_chars_{n}" for n, _ in rules.gram_percent)]
    source = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in B.blocks(batch.column(1)):
                m = measure(data, off, rules)
                failed, kept = verdicts(m, rules)
                cols = [batch.column(0).slice(a, b - a), *(pa.array(m[c], pa.int64()) for c in longs), pa.array(failed), pa.array(kept), *(pa.array(m[c], pa.int64()) for c in more)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *longs, "base_failed", "kept", *more])

    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in longs) + ", base_failed boolean, kept boolean, " + ", ".join(f"{c} long" for c in more)
    return source.mapInArrow(run, schema)


def _sql() -> str:
    """DuckDB SQL for repetition_rules() with the default rules over `documents`."""
    rules = Rules()
    sizes = [n for n, _ in rules.gram_percent]
    grams = "\n".join(
        f""", g{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
            SELECT doc_id, i, list_slice(ws, i, i + {n - 1}) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM d WHERE len(ws) >= {n})))
        , m{n} AS (SELECT DISTINCT doc_id, i + k AS i FROM g{n}, range({n}) r(k) WHERE c > 1)
        , s{n} AS (SELECT m.doc_id, count(*) AS n, sum(length(d.ws[m.i])) AS ch FROM m{n} m JOIN d USING (doc_id) GROUP BY 1)"""
        for n in sizes
    )
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
    , lines AS (SELECT doc_id, line, sum(length(w)) AS ch, i FROM (
        SELECT doc_id, i, ls[i] AS line, unnest(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS w
        FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d))) GROUP BY doc_id, line, i)
    , dl AS (SELECT doc_id, count(*) AS n, sum(ch) AS ch FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM lines) WHERE k > 1 GROUP BY 1)
    {grams}
    , a AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines,
        coalesce(s5.n, 0)::BIGINT AS n_repeat_words, coalesce(dl.ch, 0)::BIGINT AS dup_line_chars,
        {", ".join(f"coalesce(s{n}.ch, 0)::BIGINT AS dup_chars_{n}" for n in sizes)}
        FROM d LEFT JOIN dl USING (doc_id) {" ".join(f"LEFT JOIN s{n} USING (doc_id)" for n in sizes)})
    , b AS (SELECT *, n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.repeat_percent} * n_words AS base_failed FROM a)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND 100 * dup_line_chars <= {rules.line_percent} * word_chars AND {" AND ".join(f"100 * dup_chars_{n} <= {p} * word_chars" for n, p in rules.gram_percent)} AS kept,
        dup_line_chars, {", ".join(f"dup_chars_{n}" for n in sizes)} FROM b"""


SQL = _sql()
