"""The pipeline's stages against plain Python, stage by stage on what the one before kept."""

import hashlib
import random
import re

from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_dups import classes, members_and_neighbours
from tests.llm.test_secrets import base
from verso.llm import mixing, toxicity


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secret_scan", "mixing", "bpe_codec"]
    rows = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        rows.append(docs.collect())
        docs = spark.createDataFrame(rows[-1], docs.schema)
        if k < 4:
            assert docs.columns == columns
    raw, mild, single, clean, mixed, coded = rows

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    table = spark.createDataFrame(raw, "doc_id long, text string, lang string, source string, n_chars long")
    bad = {r["doc_id"] for r in toxicity.toxicity(table, labels).collect() if r["predicted"]}
    assert [r for r in raw if r["doc_id"] not in bad] == sorted(mild, key=lambda r: r["doc_id"])
    want = classes([(r["doc_id"], r["text"]) for r in mild])
    assert {r["doc_id"] for r in single} == {i for i, c in want.items() if i == c}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in single}
    before = {r["doc_id"]: r["text"] for r in single}
    for r in clean:
        assert not base(r["text"]) and (base(before[r["doc_id"]]) or r["text"] == before[r["doc_id"]] or "<secret>" in r["text"])
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(spark.createDataFrame(clean, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert sorted(r["doc_id"] for r in mixed) == sorted(i for i, n in plan.items() for _ in range(n))
    library = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    texts = {r["doc_id"]: r["text"] for r in mixed}
    assert len(coded) == len(mixed)
    for r in coded:
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert all(re.fullmatch("[0-9a-f]{64}", r["ids_sha256"]) for r in coded)


def test_one_text_stays_of_a_class_whose_buckets_are_refined(spark, sf):
    """1,500 texts near to the first one, and 1,500 that are each near to one of these only: one class, so one row stays."""
    base = [f"w{i}" for i in range(200)]
    first, second = members_and_neighbours(random.Random(5), base, 1500, "p")
    rows = [(i, " ".join(w), "en", "web", 0) for i, w in enumerate([base, *first, *second])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()] == [0]
