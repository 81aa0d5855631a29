"""Queries with SQL against DuckDB on the smallest tables; the others by brute force, round trips or held-out accuracy."""

import hashlib
import zlib

import pytest

from verso.llm import audio, queries, toxicity


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, sf, con, name):
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    mine = got.select(*columns).collect()
    theirs = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, mine), key=key) == sorted(theirs, key=key)


def test_toxicity_scores_every_row_and_learns(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op1_toxicity(spark, sf).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.88
    # Most of both labels, so a constant answer fails.
    caught = [a for a, b in held if b == 1]
    assert len(caught) >= 5 and sum(caught) / len(caught) > 0.6
    assert sum(a == 0 for a, b in held if b == 0) / sum(b == 0 for _, b in held) > 0.85


def test_toxicity_model():
    clean = [f"the {a} {b} went to the {c}" for a in ("old", "young") for b in ("man", "dog", "cat", "girl") for c in ("shop", "house", "river")]
    toxic = [t.replace("went", w) for t in clean for w in ("idiot", "moron")]
    m = toxicity.train(clean + toxic, [0] * len(clean) + [1] * len(toxic))

    def score(*texts):
        import numpy as np
        import pyarrow as pa
        from verso.llm import bytes_np as B

        parts = [m.score(d, o) for _, _, d, o in B.blocks(pa.array(texts), 40)]
        return np.concatenate(parts).tolist()

    assert min(score("You IDIOT!", "what an idiott", "such morons", "quiet words " * 500 + "moron" + " quiet words" * 500)) > 0.5
    assert max(score("the young cat went to the house", "the " * 400)) < 0.5
    assert len(set(score("you idiot", "x", "you idiot"))) == 2
    alone = toxicity.train(["a"], [0])
    assert alone.score(*__import__("verso.llm.bytes_np", fromlist=["x"]).strings(__import__("pyarrow").array(["b", ""]))).max() < 1e-6


def test_toxicity_scores_by_brute_force():
    """The best window's logit, word by word and n-gram by n-gram in plain Python."""
    import math
    import random
    import re

    import numpy as np
    import pyarrow as pa

    from verso.llm import bytes_np as B

    settings = toxicity.Settings()
    rng = np.random.default_rng(1)
    m = toxicity.Model(settings, rng.integers(-(1 << 21), 1 << 21, 1 << settings.bits), 0.25)

    def bucket(gram):
        h = len(gram) * 0x9E3779B1 & 0xFFFFFFFF
        for b in gram:
            h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
        h ^= h >> 15
        return (h * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - settings.bits)

    def score(text):
        low = re.sub("[A-ZÀ-ÖØ-Þ]", lambda c: c[0].lower(), text)
        words = [w.encode() for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", low)]
        last, kept = {}, []
        for i, w in enumerate(words):
            if i - last.get(w, -99) >= settings.window:
                kept.append(w)
            last[w] = i
        sums = []
        for w in kept:
            marked = b" " + w + b" "
            grams = [marked[i : i + n] for n in settings.grams for i in range(len(marked) - n + 1)]
            sums.append(sum(int(m.weights[bucket(g)]) for g in grams) // len(grams))
        size = min(settings.window, len(sums))
        top = max((sum(sums[i : i + size]) for i in range(len(sums) - size + 1)), default=0)
        return 1 / (1 + math.exp(-(m.bias + (top / size / (1 << 20) if size else 0))))

    words = ["a", "I", "the", "Idiot", "É", "straße", "x1", "verylongword", "日本"]
    pick = random.Random(2)
    texts = ["".join(pick.choice(words) + pick.choice([" ", ", ", "\n"]) for _ in range(pick.randrange(40))) for _ in range(120)]
    got = np.concatenate([m.score(d, o) for _, _, d, o in B.blocks(pa.array(texts), 300)])
    assert np.allclose(got, [score(t) for t in texts], atol=1e-12)


def test_long_labelled_texts_are_read_in_stretches(spark):
    text = "".join(chr(0x4E00 + i % 20_000) for i in range(30_000))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None), (None, "x"), (4, "twice"), (6, "no label")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (4, 0), (4, 1), (6, None)], "doc_id long, toxic int")
    settings = toxicity.Settings(most_chars=5000)
    texts, marks = toxicity.training_rows(docs, labels, settings)
    known = {i: m for i, m in {1: 1, 2: 0, 3: 0, 4: 1}.items() if zlib.crc32(str(i).encode()) % 5}
    assert sorted(marks) == sorted(known.values())
    if 1 in known:
        long = next(t for t in texts if t and len(t) > 100)
        assert len(long) == 5000 + 99 and long[:50] == text[:50] and long[-50:] == text[-50:]


def test_audio(spark, sf, con):
    rows = {r["doc_id"]: r for r in queries.op7_audio_features(spark, sf).collect()}
    for i, text in con.sql("SELECT doc_id, text FROM documents").fetchall():
        raw = (text or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        media = audio.to_wav(full)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest()) and audio.from_wav(media)[1] == full


def test_audio_features():
    import numpy as np
    import pyarrow as pa

    t = np.arange(40_000) / audio.RATE
    loud = np.where((t > 0.5) & (t < 1.5), np.sin(2 * np.pi * 1000 * t), 0.01 * np.sin(2 * np.pi * 90 * t))
    samples = (loud * 100 + 128).astype(np.uint8).tobytes()
    # Resampling block by block equals resampling at once, and keeps a tone's frequency.
    x = np.frombuffer(samples, np.uint8)
    whole = audio.resampled(x, 0, 30_000)
    assert np.array_equal(whole[7001:9000], audio.resampled(x, 7001, 9000))
    spectrum = np.abs(np.fft.rfft(whole[8000:16_000] * np.hanning(8000)))
    assert abs(spectrum.argmax() * audio.RATE * 3 / 4 / 8000 - 1000) < 3
    stream, n, frames = audio.features(samples)
    table = pa.ipc.open_stream(stream).read_all()
    assert n == table.num_rows == 1 and abs(table["start_s"][0].as_py() - 0.5) < 0.05 and abs(table["end_s"][0].as_py() - 1.5) < 0.05
    assert table.schema.field("tensor").type.shape == [audio.POOLED, audio.FILTERS]


def test_log_mel_by_brute_force():
    """Resampling, windows, spectra, filters, hysteresis and pooling, number by number."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    raw = rng.integers(0, 256, 3000).astype(np.uint8)
    raw[900:2200] = 128 + rng.integers(-3, 4, 1300)
    x = [(int(v) - 128) / 128 for v in raw]
    n = audio.UP * audio.TAPS
    h = [audio.UP / audio.DOWN * np.sinc((i - (n - 1) / 2) / audio.DOWN) * (0.54 - 0.46 * np.cos(2 * np.pi * i / (n - 1))) for i in range(n)]
    y = []
    for m in range(-(-len(x) * audio.UP // audio.DOWN)):
        at, phase = divmod(m * audio.DOWN, audio.UP)
        y.append(sum(h[phase + audio.UP * k] * x[at - k] for k in range(audio.TAPS) if 0 <= at - k < len(x)))
    frames = 1 + max(0, len(y) - audio.WINDOW) // audio.HOP
    y += [0.0] * audio.WINDOW
    mel = []
    rate = audio.RATE * audio.UP / audio.DOWN
    scale = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (scale(rate / 2) * i / (audio.FILTERS + 1) / 2595) - 1) for i in range(audio.FILTERS + 2)]
    for f in range(frames):
        part = [y[f * audio.HOP + i] * (0.5 - 0.5 * np.cos(2 * np.pi * i / (audio.WINDOW - 1))) for i in range(audio.WINDOW)]
        power = np.abs(np.fft.rfft(part)) ** 2
        freq = [k * rate / audio.WINDOW for k in range(audio.WINDOW // 2 + 1)]
        mel.append([np.log(1e-6 + sum(p * max(0, min((q - a) / (b - a), (c - q) / (c - b))) for p, q in zip(power, freq))) for a, b, c in zip(edges, edges[1:], edges[2:])])
    got = audio.log_mel(raw)
    assert got.shape == (frames, audio.FILTERS) and np.abs(got - mel).max() < 2e-3
    energy = got.mean(axis=1)
    on, spans = False, []
    for i, e in enumerate(energy):
        on = True if e > energy.mean() + 0.5 * energy.std() else False if e < energy.mean() - 0.5 * energy.std() else on
        if on and (not spans or spans[-1][1] != i):
            spans.append([i, i + 1])
        elif on:
            spans[-1][1] = i + 1
    stream, n_segments, n_frames = audio.features(raw.tobytes())
    table = pa.ipc.open_stream(stream).read_all()
    assert (n_segments, n_frames) == (len(spans), frames) and n_segments >= 1
    step = audio.HOP * audio.DOWN / audio.UP / audio.RATE
    assert np.allclose(table["start_s"].to_numpy(), [a * step for a, _ in spans])
    tensors = table["tensor"].combine_chunks().to_numpy_ndarray()
    for (a, b), t in zip(spans, tensors):
        for q in range(audio.POOLED):
            low = min(a + (b - a) * q // audio.POOLED, b - 1)
            high = max(a + (b - a) * (q + 1) // audio.POOLED, low + 1)
            assert np.abs(t[q] - got[low:high].mean(axis=0)).max() < 2e-3


@pytest.mark.parametrize("weights", [1, 3, 4, 6])
def test_targets_by_brute_force(spark, weights):
    import random

    from verso.llm import mixing

    rng = random.Random(weights)
    for _ in range(3):
        sizes = {f"s{i:02d}": rng.choice([0, 3, 4, 5, 8, 40, 300]) for i in range(rng.randrange(1, 9))}
        if weights == 4:
            sizes = dict(zip("abcdefg", (3, 40, 5, 8, 4, 5, 4)))
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(rows, weights).collect()}
        weight = {s: i % weights + 1 for i, s in enumerate(sorted(sizes))}
        want, open_, left = {}, set(sizes), float(sum(sizes.values()))
        while open_:
            share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            over = {s for s in open_ if share[s] > 3 * sizes[s] + 1e-9}
            want |= {s: 3.0 * sizes[s] for s in over} if over else share
            left -= sum(3 * sizes[s] for s in over)
            open_ = open_ - over if over else set()
        assert got == pytest.approx(want)


def test_mix_comes_near_its_targets(spark):
    rows = queries.op5_mixing(spark, "/root/testdata/sf0.01").collect()
    by = {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        s = by.setdefault((r["source_size"], r["target"]), [0])
        s[0] += r["taken"]
    total, want = sum(s[0] for s in by.values()), sum(t for _, t in by)
    assert abs(total - want) < 0.1 * want
    assert abs(want - sum(r["size"] for r in rows)) < 1e-6 * want
