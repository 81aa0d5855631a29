"""Repeated-phrase automata: remove passages that an earlier document holds already.

A word goes if a window of `window` words that covers it also starts in a document with a smaller id.

1. Every window of a text keeps the least hash of its word n-grams as its anchor; equal windows have equal anchors. A text has few
   anchors, about one for fifteen words; those of two documents or more mark the regions that may recur. A text without a
   recurring anchor holds no recurring window, so it isn't moved.
2. The windows of those regions (of one region for all copies of it) are counted by two hashes of 64 bits. Windows of two documents
   or more are confirmed; the document with the least id owns them, and its consecutive ones form a recurring passage.
3. Documents are dealt into shards by a hash of their id. A shard gets each passage once that has an anchor in common with one of
   its documents, so what a shard compiles is bounded by its own documents' words, and a passage that a third of all documents
   share costs each shard one row.
4. A shard numbers the words of its passages and compiles them into an Aho-Corasick automaton: a pattern is the first `PATTERN` words of
   each aligned half window, and any window of a passage holds an aligned half whole. All regions are streamed through it. Where
   it hits, windows are looked up among the passages' windows and compared with them word by word; those that are equal are
   removed from all documents but the owner.

Windows are judged on the input. Nothing is collected to the driver; intermediate tables are written to the shared folder.

Edge cases: null texts count as empty and have no words; rows with a null id are compared with nothing and keep all words; rows
with equal ids don't count as each other's predecessors and keep their own texts; texts shorter than a window keep all
words; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.cluster import dropped, ship, stored
from verso.llm import bytes_np as B

WINDOW = 50
ANCHOR = 20
PIECE = 400  # words of a passage in one row, but for the overlap
SHARD_WORDS = 500_000  # words of regions in a shard, about; the larger, the fewer copies of a common passage and the more memory


def sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values."""
    have = 1
    while have * 2 <= width:
        g = np.minimum(g[:-have], g[have:])
        have *= 2
    rest = width - have
    return np.minimum(g[: len(g) - rest], g[rest:]) if rest else g


def anchors(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of the window at each word, and which words start a window of one text."""
    if len(h) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    return sliding_min(B.window_hash(h, ANCHOR), WINDOW - ANCHOR + 1), B.inside(first, WINDOW, len(h) - WINDOW + 1)


def runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _hashed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start, end, first = B.words(data, off)
    return start, end, first, B.span_hash(data, start, end)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, th, text -> doc_id, th, n_words, whole (digest of all words), anchors."""
    for batch in batches:
        for a, b, data, off in B.blocks(batch.column(2)):
            start, end, first, h = _hashed(data, off)
            text, at = B.joined(data, off, start, end, first, np.ones(len(start), bool))
            least, ok = anchors(h, first)
            of = B.owners(first)[: len(least)][ok]
            mine = least[ok]
            new = np.ones(len(mine), bool)
            new[1:] = (mine[1:] != mine[:-1]) | (of[1:] != of[:-1])
            of, mine = of[new], mine[new]
            upto = np.searchsorted(of, np.arange(b - a + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(upto), pa.array(mine.view(np.int64)))
            whole = pa.array([hashlib.sha256(text[x:y].tobytes()).hexdigest() for x, y in zip(at[:-1], at[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(first), pa.int64()), whole, lists], ["doc_id", "th", "n_words", "whole", "anchors"])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, th, text, recurring anchors -> doc_id, th, start, words, text of each region."""
    for batch in batches:
        lists = batch.column(3)
        for a, b, data, off in B.blocks(batch.column(2)):
            start, end, first, h = _hashed(data, off)
            least, ok = anchors(h, first)
            if not len(least):
                continue
            of = B.owners(first)
            salt = B.mix(np.arange(1, b - a + 1, dtype=np.uint64))
            mine = lists.slice(a, b - a)
            size = np.asarray(mine.value_lengths())
            known = np.asarray(mine.flatten()).view(np.uint64) ^ np.repeat(salt, size)
            mark = ok & np.isin(least ^ salt[of[: len(least)]], known)
            starts_text = np.zeros(len(mark) + 1, bool)
            starts_text[first[:-1][first[:-1] < len(mark)]] = True
            lo, hi = runs(mark)
            if not len(lo):
                continue
            # Windows of two texts never touch: the last windows of a text are not ok.
            text, at = B.joined(data, off, start, end, first, np.ones(len(start), bool))
            size = end - start
            begin = np.cumsum(size + 1) - (size + 1)  # if all words stood in one line with blanks
            begin = begin - begin[np.minimum(first[:-1], len(begin) - 1)][of] + at[:-1][of]
            stop = hi - 1 + WINDOW
            left, right = begin[lo], begin[stop - 1] + size[stop - 1]
            raw = text.tobytes()
            owner = of[lo]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a).take(pa.array(owner)), batch.column(1).slice(a, b - a).take(pa.array(owner)),
                    pa.array(lo - first[owner], pa.int64()), pa.array(stop - lo, pa.int64()),
                    pa.array([raw[x:y] for x, y in zip(left.tolist(), right.tolist())], pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "th", "start", "words", "text"],
            )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, th, start, last_doc, text -> doc_id, th, start, last_doc, pos, two hashes of each window."""
    for batch in batches:
        for a, b, data, off in B.blocks(batch.column(4)):
            begin, end, first, h = _hashed(data, off)
            pos = np.flatnonzero(B.inside(first, WINDOW, max(0, len(h) - WINDOW + 1)))
            keys = [pa.array(B.window_hash(x, WINDOW)[pos].view(np.int64)) for x in (h, B.span_hash(data, begin, end, 1))]
            owner = B.owners(first)[pos]
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a).take(take) for i in range(4)), pa.array(pos - first[owner], pa.int64()), *keys], ["doc_id", "th", "start", "last_doc", "pos", "hash", "hash2"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, th, start, text, positions of confirmed windows -> owner, place, text, anchors of each passage."""
    for batch in batches:
        owner, place, texts, lists = [], [], [], []
        for i in range(len(batch)):
            data, off = B.strings(batch.column(3).slice(i, 1))
            start, end, first, h = _hashed(data, off)
            least, _ = anchors(h, first)
            mark = np.zeros(len(least), bool)
            mark[np.asarray(batch.column(4)[i].values)] = True
            for lo, hi in zip(*runs(mark)):
                for x in range(lo, hi, PIECE):
                    y = min(hi, x + PIECE)
                    owner.append(i)
                    place.append(x)
                    texts.append(data[start[x] : end[y - 2 + WINDOW]].tobytes())
                    lists.append(np.unique(least[x:y].view(np.int64)))
        take = pa.array(owner, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(place, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lists, pa.list_(pa.int64()))],
            ["owner", "th", "start", "place", "text", "anchors"],
        )


class Automaton:
    """What a shard compiles: its passages' words as numbers, an Aho-Corasick automaton of patterns from them, and a table of their windows by hash."""

    HALF = WINDOW // 2
    PATTERN = 10

    def __init__(self) -> None:
        import ahocorasick

        self.tree = ahocorasick.Automaton()
        self.number: dict[bytes, int] = {}
        self.documents: dict = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.compiled = False

    @staticmethod
    def letters(words: np.ndarray) -> str:
        """Three letters of 7 bits for each word (an automaton's nodes are searched letter by letter, so there must be few); unknown words have one of their own."""
        out = np.stack([(words >> 14) & 127, (words >> 7) & 127, words & 127], 1)
        out[words < 0] = 255
        return out.astype(np.uint8).tobytes().decode("latin-1")

    def add(self, owners: list, first: np.ndarray, codes: np.ndarray, values: list[bytes], h: np.ndarray) -> None:
        """A block of passages: owners, offsets of their words, the words as numbers into values, their hashes."""
        words = np.array([self.number.setdefault(v, len(self.number)) for v in values] or [0])[codes]
        line = self.letters(words)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            for at in range(a, b - self.HALF + 1, self.HALF):
                self.tree.add_word(line[3 * at : 3 * (at + self.PATTERN)], 1)
        who = np.array([self.documents.setdefault(o, len(self.documents)) for o in owners])
        pos = np.flatnonzero(B.inside(first, WINDOW, max(0, len(h) - WINDOW + 1)))
        self.parts.append((words.astype(np.int32), pos, B.window_hash(h, WINDOW)[pos], who[B.owners(first)[pos]]))

    def compile(self) -> None:
        self.compiled = True
        if not len(self.tree):
            return
        self.tree.make_automaton()
        base = np.cumsum([0, *(len(p[0]) for p in self.parts)])
        self.words = np.concatenate([p[0] for p in self.parts])
        pos, keys, who = np.concatenate([p[1] + b for p, b in zip(self.parts, base)]), np.concatenate([p[2] for p in self.parts]), np.concatenate([p[3] for p in self.parts])
        order = np.argsort(keys)
        self.keys, self.at, self.who = keys[order], pos[order], who[order]
        self.parts = []

    def _equal(self, words: np.ndarray, window: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Whether all words of each window are those of its entry; windows are in order."""
        place = self.at[entry]
        new = np.ones(len(window), bool)
        new[1:] = (np.diff(window) != 1) | (np.diff(place) != 1)
        run = np.flatnonzero(new)
        size = np.diff(np.append(run, len(window))) + WINDOW - 1
        base = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(base, size)
        differ = words[np.repeat(window[run], size) + step] != self.words[np.repeat(place[run], size) + step]
        upto = np.concatenate([[0], np.cumsum(differ)])
        own = np.cumsum(new) - 1
        at = base[own] + window - window[run][own]
        return upto[at + WINDOW] == upto[at]

    def occurrences(self, documents: list, first: np.ndarray, codes: np.ndarray, values: list[bytes], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end words of the stretches of a block of regions that lie in passages of other documents."""
        m = len(h) - WINDOW + 1
        none = np.zeros(0, np.int64)
        if m <= 0 or not len(self.tree):
            return none, none
        words = np.array([self.number.get(v, -1) for v in values] or [0])[codes]
        last = np.fromiter((at for at, _ in self.tree.iter(self.letters(words))), np.int64)
        half = last[last % 3 == 2] // 3 - self.PATTERN + 1
        edge = np.bincount(np.clip(half - WINDOW + self.HALF, 0, m), minlength=m + 1) - np.bincount(np.clip(half + 1, 0, m), minlength=m + 1)
        window = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & B.inside(first, WINDOW, m))
        keys = B.window_hash(h, WINDOW)[window]
        entry = np.searchsorted(self.keys, keys)
        who = np.array([self.documents.get(d, -1) for d in documents])[B.owners(first)[window]]
        hit = np.zeros(m, bool)
        while len(window):
            known = np.flatnonzero(entry < len(self.keys))
            known = known[self.keys[entry[known]] == keys[known]]
            window, keys, entry, who = window[known], keys[known], entry[known], who[known]
            same = self._equal(words, window, entry)
            hit[window[same & (self.who[entry] != who)]] = True
            window, keys, entry, who = window[~same], keys[~same], entry[~same] + 1, who[~same]  # another window of the same hash
        mark = B.covered(hit, WINDOW, len(h))
        label = np.where(mark, B.owners(first) + 1, 0)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], label, [0]])))
        begin, end = edge[:-1], edge[1:]
        real = label[begin] > 0 if len(begin) else np.zeros(0, bool)
        return begin[real], end[real]


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows shard, is_region, doc_id, th, start, text: passages, then regions of each shard -> doc_id, th, first, end."""
    shard, machine = None, Automaton()
    for batch in batches:
        numbers, regions = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        change = np.flatnonzero((numbers[1:] != numbers[:-1]) | (regions[1:] != regions[:-1])) + 1
        for low, high in zip([0, *change.tolist()], [*change.tolist(), len(batch)]):
            if low == high:
                continue
            if numbers[low] != shard:
                shard, machine = numbers[low], Automaton()
            part = batch.slice(low, high - low)
            for a, b, data, off in B.blocks(part.column(5)):
                start, end, first, h = _hashed(data, off)
                codes, values = B.dictionary(data, start, end)
                rows = part.slice(a, b - a)
                ids = rows.column(2).to_pylist()
                if not regions[low]:
                    machine.add(ids, first, codes, values.to_pylist(), h)
                    continue
                if not machine.compiled:
                    machine.compile()
                x, y = machine.occurrences(ids, first, codes, values.to_pylist(), h)
                if len(x):
                    owner = B.owners(first)[x]
                    take, shift = pa.array(owner), rows.column(4).to_numpy()[owner] - first[owner]
                    yield pa.RecordBatch.from_arrays([rows.column(2).take(take), rows.column(3).take(take), pa.array(x + shift), pa.array(y + shift)], ["doc_id", "th", "first", "end"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, spans [(first, end)] -> doc_id, n_words, n_removed, kept."""
    for batch in batches:
        for a, b, data, off in B.blocks(batch.column(1)):
            start, end, first = B.words(data, off)
            spans = batch.column(2).slice(a, b - a)
            size = np.asarray(spans.value_lengths().fill_null(0))
            flat = spans.flatten()
            base = np.repeat(first[:-1], size)
            edge = np.zeros(len(start) + 1, np.int64)
            np.add.at(edge, np.asarray(flat.field(0)) + base, 1)
            np.add.at(edge, np.asarray(flat.field(1)) + base, -1)
            gone = np.cumsum(edge[:-1]) > 0
            text, at = B.joined(data, off, start, end, first, ~gone)
            raw = text.tobytes()
            n_removed = np.bincount(B.owners(first), weights=gone, minlength=b - a).astype(np.int64)
            kept = pa.array([raw[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first), pa.int64()), pa.array(n_removed), kept], ["doc_id", "n_words", "n_removed", "kept"])


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scanned, texts, spans): per row (doc_id, th, n_words, whole); texts that may recur; the stretches (doc_id, th, first, end) of words to remove. th: hash of the text."""
    ship(df.sparkSession)
    docs = df.select(df[id_col].alias("doc_id"), F.xxhash64(F.coalesce(df[text_col], F.lit(""))).alias("th"), df[text_col].alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = stored(docs.mapInArrow(_scan, f"doc_id {kind}, th long, n_words long, whole string, anchors array<long>"))
    pairs = scanned.where("doc_id IS NOT NULL").select("doc_id", "th", F.explode("anchors").alias("anchor"))
    often = pairs.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    marked = stored(pairs.join(often, "anchor").groupBy("doc_id", "th").agg(F.collect_set("anchor").alias("anchors")))
    texts = stored(docs.join(marked, ["doc_id", "th"]).select("doc_id", "th", "text", "anchors"))
    regions = stored(texts.mapInArrow(_regions, f"doc_id {kind}, th long, start long, words long, text string"))

    named = regions.withColumn("rh", F.sha2("text", 256))
    one = named.groupBy("rh").agg(F.min(F.struct("doc_id", "th", "start")).alias("x"), F.max("doc_id").alias("last_doc")).select("x.*", "last_doc")
    key = ["doc_id", "th", "start"]
    first = stored(regions.dropDuplicates(key).join(one, key).select(*key, "last_doc", "text"))
    windows = first.mapInArrow(_windows, f"doc_id {kind}, th long, start long, last_doc {kind}, pos long, hash long, hash2 long")
    confirmed = windows.groupBy("hash", "hash2").agg(F.min(F.struct(*key, "pos")).alias("x"), F.max("last_doc").alias("last_doc")).where("x.doc_id < last_doc").select("x.*")
    owned = confirmed.groupBy(*key).agg(F.collect_list("pos").alias("positions"))
    passages = stored(first.join(owned, key).select(*key, "text", "positions").mapInArrow(_passages, f"owner {kind}, th long, start long, place long, text string, anchors array<long>"))
    dropped(first)

    words = regions.agg(F.sum("words")).first()[0] or 0
    shards = max(1, -(-words // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard")
    wanted = marked.select(F.explode("anchors").alias("anchor"), shard).distinct()
    place = ["owner", "th", "start", "place"]
    sent = passages.select(*place, F.explode("anchors").alias("anchor")).join(wanted, "anchor").select(*place, "shard").distinct()
    sent = sent.join(passages.select(*place, "text"), place).select("shard", F.lit(False).alias("is_region"), F.col("owner").alias("doc_id"), "th", "start", "text")
    every = sent.unionByName(regions.select(shard, F.lit(True).alias("is_region"), "doc_id", "th", "start", "text"))
    spans = stored(every.repartition("shard").sortWithinPartitions("shard", "is_region").mapInArrow(_locate, f"doc_id {kind}, th long, first long, end long"))
    dropped(marked, regions, passages)
    return scanned.drop("anchors"), texts.drop("anchors"), spans


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256."""
    scanned, texts, spans = repeated_spans(df, id_col, text_col)
    kind = scanned.schema["doc_id"].dataType.simpleString()
    grouped = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    cut = texts.join(grouped, ["doc_id", "th"]).select("doc_id", "text", "spans").mapInArrow(_removed, f"doc_id {kind}, n_words long, n_removed long, kept string")
    cut = cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    rest = scanned.join(spans.select("doc_id", "th").distinct(), ["doc_id", "th"], "left_anti")
    return cut.unionByName(rest.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("whole").alias("kept_sha256")))


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
, w AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) >= {WINDOW}))
, r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS m FROM w) WHERE m < doc_id)
, g AS (SELECT DISTINCT doc_id, i + k AS i FROM r, range({WINDOW}) x(k))
, t AS (SELECT d.doc_id, p.i, d.ws[p.i] AS word FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i FROM d) p JOIN d USING (doc_id))
, k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s, count(*) AS n FROM t ANTI JOIN g USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
