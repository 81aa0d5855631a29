"""Quality classification by importance resampling: the ratio of two hashed n-gram generative models, and Gumbel top-k.

A text is a bag of its tokens (runs of letters, digits and bytes over 127, or runs of other signs; lower case) and of its pairs of
neighbouring tokens, each hashed to one of `buckets`. The target model has the frequencies of the buckets in all labelled texts of
quality 1, the raw model those in all texts of the table, each smoothed by `smoothing` a bucket. The logarithm of a text's
importance is the sum of log(target / raw) over its tokens and pairs. With Gumbel noise added, the k largest keys are a sample
without replacement in proportion to importance; k is `share` of the rows, or the share of quality 1 among the labels.

Both models are sums of whole numbers over scans of the table; a bucket weighs one fixed-point number when texts are scored, so
results don't depend on batches. Noise comes from a hash of the id. The k-th largest key is found exactly, by counting
keys in ever finer bins, and no text and no row is gathered.

Edge cases: null texts count as empty; a text without tokens has importance 1 (logarithm 0), and so has every text without
labelled texts of quality 1; without any label all rows are kept; a null label, a null id or a held-out id (crc32 of the id as text
mod 5 is 0) is not used for the target; of several labels of an id the largest counts; noise of a null id comes from its text;
rows whose key equals the k-th largest are kept, so equal rows are kept or left alike; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.cluster import ship, stored
from verso.llm import bytes_np as B

U64 = np.uint64
_ONE = 1 << 20  # fixed point of weights
_KEY = 1 << 32  # fixed point of keys
_BINS = 4096
_PARTS = 16  # rows that a task's counts are cut into, for summing

_KIND = np.full(256, 2, np.uint8)
_KIND[B.SPACE] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


@dataclass(frozen=True)
class Settings:
    buckets: int = 10_000
    smoothing: float = 1.0
    share: float | None = None
    seed: int = 3


def features(data: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of each token and of each pair of neighbouring tokens of a block."""
    low = data.copy()
    low[(low >= 0x41) & (low <= 0x5A)] += 0x20
    if len(low) > 1:  # capitals of Latin-1 are C3 80 to C3 9E
        low[np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1] += 0x20
    kind = _KIND[low]
    edge = np.ones(len(low) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[off] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    full = kind[start] != 0
    start, end = start[full], end[full]
    first = np.searchsorted(start, off)
    of = B.owners(first)
    h = B.span_hash(low, start, end)
    two = np.flatnonzero(B.inside(first, 2, max(0, len(h) - 1)))
    key = np.concatenate([h, B.window_hash(h, 2)[two]])
    return np.concatenate([of, of[two]]), ((key >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def bucket_counts(texts: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """texts: one column. How often each bucket occurs in all of them; each task counts its texts, counts are summed in parts."""
    ship(texts.sparkSession)
    size = -(-settings.buckets // _PARTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * _PARTS, np.int64)
        for batch in batches:
            for _, _, data, off in B.blocks(batch.column(0)):
                total += np.bincount(features(data, off, settings.buckets)[1], minlength=len(total))
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array([t.tobytes() for t in total.reshape(_PARTS, size)], pa.binary())], ["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for counts in table.column("counts"):
            total += np.frombuffer(counts.as_py(), np.int64)
        return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((_PARTS, size), np.int64)
    for r in texts.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        out[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()[: settings.buckets]


def log_ratio(target: np.ndarray, raw: np.ndarray, settings: Settings = Settings()) -> np.ndarray:
    """Fixed-point logarithm of the models' ratio for each bucket."""
    if not target.any():
        return np.zeros(len(raw), np.int64)
    share = lambda c: (c + settings.smoothing) / (c.sum() + settings.smoothing * len(c))
    return np.rint(np.log(share(target) / share(raw)) * _ONE).astype(np.int64)


def train(df: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """Weights of the buckets, and the share of rows to keep."""
    marks = labels.select(labels[id_col].alias("k"), labels[label_col].alias("y")).where("k IS NOT NULL AND y IS NOT NULL AND crc32(cast(k AS string)) % 5 != 0").groupBy("k").agg((F.max("y") == 1).alias("good"))
    n, good = marks.agg(F.count("*"), F.count_if("good")).first()
    docs = df.select(df[id_col].alias("k"), df[text_col].alias("text"))
    # Labels grow with the documents, so they are never broadcast: texts are shuffled once, at any size.
    target = bucket_counts(docs.join(marks.where("good").select("k").hint("merge"), "k", "left_semi").select("text"), settings)
    weights = log_ratio(target, bucket_counts(docs.select("text"), settings), settings)
    return weights, settings.share if settings.share is not None else good / n if n else 1.0


def log_importance(df: DataFrame, weights: np.ndarray, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, log_weight, key (fixed-point log_weight with Gumbel noise)."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(weights)  # 80 KB
    source = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    seed = F.lit(settings.seed)
    noise = F.when(F.col("doc_id").isNull(), F.xxhash64(seed, "text")).otherwise(F.xxhash64(seed, "doc_id"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            for a, b, data, off in B.blocks(batch.column(3)):
                of, bucket = features(data, off, settings.buckets)
                order = np.argsort(of, kind="stable")
                upto = np.concatenate([[0], np.cumsum(weights[bucket[order]])])
                cut = np.searchsorted(of[order], np.arange(b - a + 1))
                log_weight = (upto[cut[1:]] - upto[cut[:-1]]) / _ONE
                u = ((batch.column(2).slice(a, b - a).to_numpy().view(U64) >> U64(12)).astype(np.float64) + 0.5) * 2.0**-52
                key = np.rint((log_weight - np.log(-np.log(u))) * _KEY).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(log_weight), pa.array(key)], ["doc_id", "held_out", "log_weight", "key"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.select("doc_id", held_out.alias("held_out"), noise.alias("noise"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, log_weight double, key long")


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of a column `key` of whole numbers; None if there are fewer or k is 0. At most _BINS counts are gathered at a time."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not 0 < k <= n:
        return None
    while low < high:
        width = (high - low) // _BINS + 1
        place = F.expr(f"(key - {low}L) div {width}L").alias("place")
        counts = keys.where(F.col("key").between(low, high)).groupBy(place).count().collect()
        for r in sorted(counts, key=lambda r: -r["place"]):
            if k <= r["count"]:
                low, high = low + r["place"] * width, min(high, low + (r["place"] + 1) * width - 1)
                break
            k -= r["count"]
    return low


def resample(df: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, held_out, log_weight, kept."""
    weights, share = train(df, labels, settings)
    rows = stored(log_importance(df, weights, settings))
    least = kth_largest(rows, round(share * rows.count()))
    kept = F.lit(False) if least is None else F.col("key") >= least
    return rows.select("doc_id", "held_out", "log_weight", kept.alias("kept"))
