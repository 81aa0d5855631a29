"""Importance resampling by brute force: tokens, models, noise and top-k of a table in plain Python; held-out accuracy; odd tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from verso.llm import bytes_np as B
from verso.llm import quality_classifier as Q
from verso.llm import queries


def bag(text, buckets):
    low = re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text or "")
    tokens = re.findall(r"[A-Za-z0-9_\x80-\U0010FFFF]+|[^A-Za-z0-9_\x80-\U0010FFFF\x20\x09-\x0D]+", low)
    one = [int(B.span_hash(d, np.array([0]), np.array([len(d)]))[0]) for d in (np.frombuffer(t.encode(), np.uint8) for t in tokens)]
    two = [int(B.window_hash(np.array(p, np.uint64), 2)[0]) for p in zip(one, one[1:])]
    return Counter((h >> 32) * buckets >> 32 for h in one + two)


def test_against_brute_force(spark, sf, con):
    docs = con.sql("SELECT doc_id, text FROM documents").fetchall()
    labels = dict(con.sql("SELECT doc_id, quality FROM labels").fetchall())
    bags = {i: bag(t, 10_000) for i, t in docs}
    train = {i: q for i, q in labels.items() if zlib.crc32(str(i).encode()) % 5}
    target, raw = Counter(), Counter()
    for i, b in bags.items():
        raw += b
        if train.get(i) == 1:
            target += b
    ratio = {k: math.log((target[k] + 1) / (target.total() + 10_000) * (raw.total() + 10_000) / (raw[k] + 1)) for k in raw}
    got = queries.op3_quality_classifier(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(bags)
    for r in got:
        assert abs(r["log_weight"] - sum(n * ratio[k] for k, n in bags[r["doc_id"]].items())) < 1e-6 * (1 + bags[r["doc_id"]].total())
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    # Gumbel top-k: the largest keys, of which there are the labels' share.
    noise = {r["doc_id"]: (((r["h"] % (1 << 64)) >> 12) + 0.5) / 2**52 for r in spark.createDataFrame([(i,) for i in bags], "doc_id long").selectExpr("doc_id", "xxhash64(3, doc_id) h").collect()}
    key = {r["doc_id"]: r["log_weight"] - math.log(-math.log(noise[r["doc_id"]])) for r in got}
    k = round(len(docs) * sum(q == 1 for q in train.values()) / len(train))
    assert {r["doc_id"] for r in got if r["kept"]} == set(sorted(key, key=key.get)[-k:])


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["kept"], labels[r["doc_id"]] == 1) for r in queries.op3_quality_classifier(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    print(len(held), Counter(held))
    assert sum(a == b for a, b in held) / len(held) > 0.9


def test_blocks_and_rows_agree():
    texts = ["One two, two!", None, "", "ÀB àb $$$ x_1", "end"]
    of, bucket = Q.features(*B.strings(pa.array(texts)), 1000)
    assert [Counter(bucket[of == i].tolist()) for i in range(len(texts))] == [bag(t, 1000) for t in texts]


def test_kth_largest(spark):
    keys = [-(1 << 61), -5, -5, 0, 3, 3, 3, 1 << 61]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    assert [Q.kth_largest(df, k) for k in range(0, 10)] == [None, *sorted(keys, reverse=True), None]


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    rows = [(1, "a b"), (1, "a b"), (2, None), (None, "c"), (None, ""), (3, "!!")]
    df = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (3, 0), (2, 0)], "doc_id long, quality int")
    assert Q.resample(df.limit(0), labels).collect() == []
    got = Q.resample(df, labels).collect()
    assert len(got) == len(rows) and len({tuple(r) for r in got if r["doc_id"] == 1}) == 1
    assert all(r["log_weight"] == 0 and r["kept"] for r in Q.resample(df, labels.limit(0)).collect())
    assert not any(r["kept"] for r in Q.resample(df, labels, Q.Settings(share=0.0)).collect())
