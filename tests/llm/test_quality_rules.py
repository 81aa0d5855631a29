"""Repetition counts against plain Python, on texts that hashes could confuse too."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.conftest import doubled
from verso.llm import bytes_np as B
from verso.llm import quality_rules

SIZES = [n for n, _ in quality_rules.Rules().gram_percent]


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text))}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    out["n_dup_lines"] = len(again)
    out["dup_line_chars"] = sum(len(re.sub(r"[\x20\x09-\x0D]", "", x)) for x in again)
    for n in SIZES:
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        count = Counter(grams)
        inside = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(n)}
        out[f"dup_chars_{n}"] = sum(len(w[i]) for i in inside)
        if n == 5:
            out["n_repeat_words"] = len(inside)
    return out


def measured(texts, most=B.BLOCK_BYTES):
    out = []
    for a, b, data, off in B.blocks(pa.array(texts, pa.string()), most):
        m = quality_rules.measure(data, off, quality_rules.Rules())
        out += [{k: int(v[i]) for k, v in m.items()} for i in range(b - a)]
    return out


def texts():
    rng = random.Random(3)
    words = ["a", "bb", "é#", "line", "$x", "日本"]
    made = ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "  \t"]) for _ in range(rng.randrange(120))) for _ in range(150)]
    return [*made, "", " \n", "x" * 3000 + "\n" + "x" * 3000, "same line here\n" * 40, *("\n".join(doubled("ab", "ba", "")) for _ in range(1)), " ".join(doubled("alpha", "beta"))]


def test_against_brute_force():
    rows = texts()
    assert measured(rows) == measured(rows, 64) == [brute(t) for t in rows]


def test_when_all_hashes_collide(monkeypatch):
    """Equal hashes alone decide nothing: bytes and words are compared."""
    rows = [t for t in texts() if len(t) < 400]
    monkeypatch.setattr(B, "window_hash", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    assert measured(rows) == [brute(t) for t in rows]
    monkeypatch.setattr(B, "span_hash", lambda data, start, end, seed=0: np.zeros(len(start), np.uint64))
    assert measured(rows) == [brute(t) for t in rows]
