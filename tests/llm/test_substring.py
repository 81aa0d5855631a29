import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from verso.llm import bytes_np as B
from verso.llm import queries, substring_dedup


def brute(rows, window=50):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in texts:
        for k in range(len(w) - window + 1):
            h = tuple(w[k : k + window])
            if i is not None:
                least[h] = min(i, least.get(h, i))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_planted_passages(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(4000)}é"
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 120, 2500)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(0, 200))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(max(1, len(p) // 3))
            w += p[a : a + rng.choice([60, 200, len(p)])] + [word() for _ in range(rng.randrange(3))]
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(70 + i, rows[3][1]) for i in range(10)]  # copies
    rows += [(90, "same " * 300), (91, "same " * 120 + "a b " * 60), (92, "a b " * 100), (93, "same " * 49)]
    rows += [(None, rows[3][1]), (5, rows[6][1]), (5, rows[5][1]), (94, None), (95, "")]
    rng.shuffle(rows)
    got = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute(rows)


def test_test_tables(spark, sf, con):
    rows = con.sql("SELECT doc_id, text FROM documents").fetchall()
    got = queries.op4_substring_dedup(spark, sf).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute(rows)


def test_a_passage_in_all_documents(spark):
    rng = random.Random(4)
    shared = [f"s{rng.randrange(900)}" for _ in range(400)]
    rows = [(i, " ".join([f"d{i}_{k}" for k in range(rng.randrange(40))] + shared[rng.randrange(30) :] + [f"e{i}"])) for i in range(300)]
    got = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute(rows)


def test_words_are_compared_where_hashes_agree(monkeypatch):
    """A shard whose window hashes all collide still finds the equal windows only."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(50)}"
    passages = [[word() for _ in range(rng.randrange(50, 90))] for _ in range(6)]
    regions = [p[rng.randrange(20) :] + [word() for _ in range(60)] + rng.choice(passages) for p in passages for _ in range(3)]
    monkeypatch.setattr(B, "window_hash", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))

    def block(rows):
        data, off = B.strings(pa.array([" ".join(r) for r in rows]))
        start, end, first = B.words(data, off)
        codes, values = B.dictionary(data, start, end)
        return first, codes, values.to_pylist(), B.span_hash(data, start, end)

    machine = substring_dedup.Automaton()
    machine.add(list(range(len(passages))), *block(passages))
    machine.compile()
    first, codes, values, h = block(regions)
    got = [False] * len(h)
    for a, b in zip(*machine.occurrences([None] * len(regions), first, codes, values, h)):
        got[a:b] = [True] * (b - a)
    known = {tuple(p[i : i + 50]) for p in passages for i in range(len(p) - 49)}
    want = []
    for r in regions:
        mark = [False] * len(r)
        for i in range(len(r) - 49):
            if tuple(r[i : i + 50]) in known:
                mark[i : i + 50] = [True] * 50
        want += mark
    assert got == want and any(want) and not all(want)
