"""A corpus pipeline of five stages over `documents`: each stage reads, as its docs, what the one before wrote.

Stages: toxic texts go; one document of each near-duplicate class stays; secrets in texts are replaced by a mark; sources are
mixed to their target weights, so documents are dropped or repeated; texts are encoded and decoded by a BPE vocabulary. All but
the last return the columns of documents (n_chars follows the text).

Nulls: a null text scores as an empty one and is no near-duplicate, has no secret and size 0; a mix gives it no other weight than its
source has; it is encoded as the empty text. Rows with a null id are never near-duplicates and draw alike in the mix; a null source is a
source of its own. Empty texts are no near-duplicates of each other and stay. Very long texts are worked on whole, a text at a
time. Ties: of a class the least id stays; equal texts get equal scores, spans and ids. Repeated rows (equal ids) are one document
for near_duplicates, so all of them stay or go, and each is mixed and encoded by itself. An empty table gives an empty result. Further
columns, whatever their names, pass through all stages but the last, which returns its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verso.cluster import small_batches, stored
from verso.llm import bpe, mixing, near_dups, secrets, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier doesn't take for toxic. Null and empty texts have the score of no words; without labels all rows stay."""
    small_batches(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with the least id of each class. Rows with a null id, a null text or no words stay, and so do all rows of an id that stays."""
    small_batches(spark)
    return near_dups.one_of_each_class(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with each secret in their texts replaced by a mark, overlapping ones once; a null text stays null, with null n_chars."""
    clean = secrets.masked(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: none to three times; rows of size 0 or of a null source like any other."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row's text, with the digests of ids and decoded text; a row for each row, null texts as empty ones."""
    small_batches(spark)
    return bpe.encode_decode(docs, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("bpe_codec", encode),
]

#: SQL can't express the classifier, the classes or the encoding: tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
