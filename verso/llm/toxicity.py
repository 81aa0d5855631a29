"""Toxicity scores: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a run of letters, digits and bytes over 127; its vector is the mean of the vectors of its hashed character n-grams
(with marks at its ends), so an unseen misspelling shares vectors with the words it resembles. A window of consecutive words
is the mean of its words' vectors, and a linear softmax reads it. A text scores as its most toxic window does, so a
few words in a long text count as they do in a short one. Embeddings and softmax are fitted together by Adagrad; windows
are chosen anew in each round by the model so far.

Since the softmax is linear, each n-gram weighs one fixed-point number when texts are scored: sums are of integers and
don't depend on batches, and equal texts get equal scores. Scoring is one scan without a shuffle; the model is of fixed size.

Training reads a bounded sample: at most `most_toxic` and `most_clean` labelled rows, in the order of a hash of the id. Of a text of over
`most_chars` characters it reads 100 stretches, spread evenly and so many characters in all. It sees the text and nothing else.

Edge cases: null texts count as empty; a text without words scores as the softmax's bias; without labelled rows of both
classes every score is the share of label 1 (0 without any label); a null label or an id that is null is not used for
training; of several labels of an id the largest counts; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.cluster import ship, trim
from verso.llm import bytes_np as B

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_ONE = 1 << 20  # fixed point


@dataclass(frozen=True)
class Settings:
    grams: tuple[int, ...] = (3, 4, 5)
    bits: int = 18
    dims: int = 8
    window: int = 6
    rounds: int = 4
    passes: int = 2  # through the windows of a round, or as many as make `steps` batches
    steps: int = 150
    batch: int = 64
    rate: float = 0.3
    damping: float = 1e-3  # the larger, the less an n-gram weighs that few windows hold
    seed: int = 20
    most_toxic: int = 2000
    most_clean: int = 5000
    most_chars: int = 1_000_000


def _normal(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with a blank for whatever is no word, and four blanks after each text; the texts' new offsets."""
    n = len(off) - 1
    at = off + 4 * np.arange(n + 1) + 4
    out = np.full(at[-1] + 8, 0x20, np.uint8)
    low = np.where(_WORD[data], data, 0x20).astype(np.uint8)
    low[(low >= 0x41) & (low <= 0x5A)] += 0x20
    if len(low) > 1:  # capitals of Latin-1 are C3 80 to C3 9E
        second = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[second] += 0x20
    out[np.arange(len(low)) + np.repeat(4 * np.arange(n) + 4, np.diff(off))] = low
    return out, at


def _words(buf: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block, and the texts' offsets among them. A word that a text repeats within `window` words counts once there."""
    full = buf != 0x20
    edge = np.diff(full.view(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    key = B.span_hash(buf, start, end) ^ B.mix(np.searchsorted(at, start, "right").astype(np.uint64))
    order = np.argsort(key, kind="stable")
    near = (key[order[1:]] == key[order[:-1]]) & (order[1:] - order[:-1] < window)
    keep = np.ones(len(start), bool)
    keep[order[1:][near]] = False
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(start, at)


def _buckets(buf: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hash bucket of the n bytes at each position."""
    m = len(buf) - n + 1
    h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for j in range(n):
        h = (h ^ buf[j : m + j]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)


def _starts(start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First position and number of the n-grams of each word between its marks."""
    return start - 1, np.maximum(0, end - start + 3 - n)


class Model:
    """weights: a fixed-point number for each bucket; bias: the logit of no words."""

    def __init__(self, settings: Settings, weights: np.ndarray, bias: float) -> None:
        self.settings, self.weights, self.bias = settings, weights, bias

    def word_sums(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        for n in self.settings.grams:
            upto = np.zeros(len(buf) - n + 2, np.int64)
            np.cumsum(self.weights[_buckets(buf, n, self.settings.bits)], out=upto[1:])
            a, k = _starts(start, end, n)
            total += upto[np.minimum(a + k, len(upto) - 1)] - upto[a]
            count += k
        return total // np.maximum(1, count)

    def windows(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: the logit and the first word (among all words of the block) of its most toxic window."""
        size, n = self.settings.window, len(off) - 1
        buf, at = _normal(data, off)
        start, end, first = _words(buf, at, size)
        upto = np.concatenate([[0], np.cumsum(self.word_sums(buf, start, end))])
        count = np.diff(first)
        logit, where = np.full(n, self.bias), first[:-1].copy()
        short = (count > 0) & (count <= size)
        logit[short] += (upto[first[1:][short]] - upto[first[:-1][short]]) / count[short] / _ONE
        long = np.flatnonzero(count > size)
        if len(long):
            sums = upto[size:] - upto[:-size]
            edges = np.column_stack([first[long], first[long + 1] - size + 1]).ravel()
            top = np.maximum.reduceat(np.append(sums, np.iinfo(np.int64).min), edges)[::2]
            logit[long] += top / size / _ONE
            spread = np.repeat(np.arange(len(long)), count[long] - size + 1)
            index = np.arange(len(spread)) - np.repeat(np.cumsum(count[long] - size + 1) - (count[long] - size + 1), count[long] - size + 1) + first[long][spread]
            hit = np.flatnonzero(sums[index] == top[spread])
            _, one = np.unique(spread[hit], return_index=True)
            where[long] = index[hit[one]]
        return logit, where

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.windows(data, off)[0]))


def _features(settings: Settings, buf: np.ndarray, start: np.ndarray, end: np.ndarray, last: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, weights and window numbers of the n-grams of windows that start at the words `pick`; last: end of each pick's text."""
    stop = np.minimum(pick + settings.window, last)
    size = stop - pick
    owner = np.repeat(np.arange(len(pick)), size)
    word = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + pick[owner]
    count = sum(_starts(start[word], end[word], n)[1] for n in settings.grams)
    ids, weights, seg = [], [], []
    for n in settings.grams:
        a, k = _starts(start[word], end[word], n)
        of = np.repeat(np.arange(len(word)), k)
        ids.append(_buckets_at(buf, a[of] + np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k), n, settings.bits))
        weights.append(1 / count[of] / size[owner[of]])
        seg.append(owner[of])
    return np.concatenate(ids), np.concatenate(weights), np.concatenate(seg)


def _buckets_at(buf: np.ndarray, at: np.ndarray, n: int, bits: int) -> np.ndarray:
    h = np.full(len(at), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for j in range(n):
        h = (h ^ buf[at + j]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)


def train(texts: list[str | None], labels: list[int], settings: Settings = Settings()) -> Model:
    """Fit embeddings and softmax to labelled texts."""
    y = np.array(labels, int)
    weights = np.zeros(1 << settings.bits, np.int64)
    if len(set(labels)) < 2:
        share = float(np.mean(y)) if len(y) else 0.0
        return Model(settings, weights, float(np.log((share + 1e-300) / (1 - share + 1e-300))))
    rng = np.random.default_rng(settings.seed)
    column = pa.array(texts, pa.string())
    parts, bytes_before, words_before = [], 0, 0
    for _, _, data, off in B.blocks(column):
        buf, at = _normal(data, off)
        start, end, first = _words(buf, at, settings.window)
        parts.append((buf, start + bytes_before, end + bytes_before, first[:-1] + words_before, np.diff(first)))
        bytes_before, words_before = bytes_before + len(buf), words_before + len(start)
    buf, start, end, first, count = (np.concatenate([x[i] for x in parts]) for i in range(5))
    del parts
    used = np.flatnonzero(count > 0)
    d = settings.dims
    emb = np.zeros((1 << settings.bits, d))
    soft, bias = rng.normal(0, 1, (d, 2)), np.zeros(2)
    seen = [np.full(1 << settings.bits, settings.damping**2), np.zeros((d, 2)), np.zeros(2)]
    model = Model(settings, weights, 0.0)

    for turn in range(settings.rounds):
        free = np.maximum(1, count[used] - settings.window + 1)
        doc, pick = [], []
        for _ in range(4 if turn == 0 else 1):  # windows anywhere: of every text at first, later of clean ones
            own = used if turn == 0 else used[y[used] == 0]
            doc.append(own)
            pick.append(first[own] + (rng.random(len(own)) * (free if turn == 0 else free[y[used] == 0])).astype(int))
        if turn:
            doc.append(used)
            pick.append(np.concatenate([model.windows(data, off)[1] + first[a] for a, _, data, off in B.blocks(column)])[used])
        doc, pick = np.concatenate(doc), np.concatenate(pick)
        share = np.bincount(y[doc], minlength=2) / len(doc)
        for _ in range(max(settings.passes, -(-settings.steps // -(-len(doc) // settings.batch)))):
            order = rng.permutation(len(doc))
            for i in range(0, len(order), settings.batch):
                o = order[i : i + settings.batch]
                ids, w, seg = _features(settings, buf, start, end, first[doc[o]] + count[doc[o]], pick[o])
                uniq, inv = np.unique(ids, return_inverse=True)
                rows = emb[uniq]
                hidden = np.stack([np.bincount(seg, weights=w * rows[inv, j], minlength=len(o)) for j in range(d)], 1)
                z = hidden @ soft + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                g = p.copy()
                g[np.arange(len(o)), y[doc[o]]] -= 1
                g *= (0.5 / share[y[doc[o]]])[:, None] / len(o)
                back = g @ soft.T
                grad = np.stack([np.bincount(inv, weights=w * back[seg, j], minlength=len(uniq)) for j in range(d)], 1)
                for value, slot, step in ((soft, seen[1], hidden.T @ g), (bias, seen[2], g.sum(0))):
                    slot += step**2
                    value -= settings.rate * step / np.sqrt(slot + 1e-12)
                seen[0][uniq] += (grad**2).mean(1)
                emb[uniq] = rows - settings.rate * grad / np.sqrt(seen[0][uniq] + 1e-12)[:, None]
        model = Model(settings, np.rint(emb @ (soft[:, 1] - soft[:, 0]) * _ONE).astype(np.int64), float(bias[1] - bias[0]))
    return model


def training_rows(df: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str | None], list[int]]:
    """The bounded sample: at most most_toxic and most_clean labelled ids whose crc32 mod 5 is not 0, in the order of a hash.

    Ids are chosen from the labels alone and sent to the scan of the texts (a broadcast of at most as many rows).
    """
    marks = labels.select(labels[id_col].alias("k"), labels[label_col].alias("y")).where("k IS NOT NULL AND y IS NOT NULL AND crc32(cast(k AS string)) % 5 != 0").groupBy("k").agg((F.max("y") == 1).cast("int").alias("y"))
    order = F.xxhash64("k")
    chosen = marks.where("y = 1").orderBy(order, "k").limit(settings.most_toxic).unionByName(marks.where("y = 0").orderBy(order, "k").limit(settings.most_clean))
    stretch = max(1, settings.most_chars // 100)
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.substring("text", (i * (F.length("text") - stretch) / 99).cast("int") + 1, F.lit(stretch))), " ")
    texts = df.select(df[id_col].alias("k"), df[text_col].alias("text")).withColumn("text", F.when(F.length("text") > settings.most_chars, spread).otherwise(F.col("text")))
    rows = texts.join(F.broadcast(chosen), "k").select("k", "y", "text", order.alias("h")).orderBy("h", "k", "text").limit(settings.most_toxic + settings.most_clean).collect()
    return [r["text"] for r in rows], [r["y"] for r in rows]


def score_texts(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out (crc32 of the id as text mod 5 is 0; false for a null id), score, predicted."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.settings, model.weights.astype(np.int32), model.bias))  # 1 MB at 18 bits
    source = df.select(df[id_col].alias("doc_id"), F.coalesce(F.crc32(df[id_col].cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), df[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settings, weights, bias = shared.value
        model = Model(settings, weights, bias)
        for batch in batches:
            for a, b, data, off in B.blocks(batch.column(2)):
                score = model.score(data, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def fitted(df: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of the bounded sample; the driver's memory for it is given back."""
    model = train(*training_rows(df, labels, settings, id_col, text_col), settings)
    trim()
    return model


def toxicity(df: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Train on the labelled rows and score every row."""
    return score_texts(df, fitted(df, labels, settings))


def without_toxic(df: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df whose text isn't predicted toxic, with df's columns. One scan: the text is scored where it is read."""
    spark = df.sparkSession
    ship(spark)
    model = fitted(df, labels, settings, id_col, text_col)
    shared = spark.sparkContext.broadcast((model.settings, model.weights.astype(np.int32), model.bias))
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            for a, b, data, off in B.blocks(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(model.score(data, off) < 0.5))

    return df.mapInArrow(run, df.schema)
