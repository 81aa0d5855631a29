"""Near-duplicate classes by DartMinHash, banded joining and exact checks.

A document is a weighted set: its shingles of five words (all its words if it has fewer), each weighing as often as it occurs.
DartMinHash throws darts into the region of each element: the plane of weight and rank is cut into cells by weight
level and rank strip, a hash gives each cell a Poisson number of darts, and a dart counts if it lies under the element's
weight. A text throws about k ln k + 2k darts in all, however long it is, and keeps the earliest dart of each of k
coordinates; a text with an empty coordinate throws up to twice the rank. Two texts agree at a coordinate with a
probability of their weighted Jaccard similarity. `bands` groups of `rows` coordinates are the keys of the banded join.

Texts with equal words (by a 128-bit BLAKE2 digest) are one node from the start, so copies are counted before any join. In a bucket each
node is compared with one hub, its least node; similarities are exact, from both texts. A bucket stays open if some node isn't linked to
its hub. The triangle inequality of the distance 1 - similarity tells which of its nodes may still be linked to one another; these are
compared exactly, without a row for each pair: a task gets two blocks of texts, a product of matrices gives all their similarities,
and only links that connect them are returned. An open bucket of over `most` nodes is first refined: its nodes are dealt anew by `rows`
further coordinates, in `splits` ways, up to `depth` times; parts of at most `most` nodes are compared in blocks, larger ones with a hub.
Parts only find classes sooner, since a pair may share none: afterwards the whole bucket is compared in blocks, all its nodes outside
its largest class with one another and with that class, so each pair that shares a bucket is in one class or has been compared.
A pair of similarity 0.8 shares no bucket with a probability under 2e-4. Links stay distributed; classes are connected components.

Edge cases: null texts and texts without words are in no group; rows with a null id have a null class and are never
removed; rows of equal ids are one document; a class is named by its least id; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.cluster import dropped, ship, stored, trim
from verso.llm import bytes_np as B
from verso.llm.components import components

U64 = np.uint64
BLOCK = 1 << 19
COLUMNS = 1024  # of a product of matrices at a time
ROWS = 256  # of its result at a time


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    bands: int = 30
    rows: int = 6
    percent: int = 80
    most: int = 1024  # nodes of an open bucket; a larger one is refined
    splits: int = 8
    depth: int = 3
    block_bytes: int = 1 << 20  # of texts, on average; a text counts as 512 bytes at least

    @property
    def k(self) -> int:
        return self.bands * self.rows


def elements(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of texts: text, hash and weight of each distinct shingle, sorted by text and hash."""
    start, end, first = B.words(data, off)
    h = B.span_hash(data, start, end)
    of = B.owners(first)
    m = max(0, len(h) - size + 1)
    at = np.flatnonzero(B.inside(first, size, m))
    text, key = [of[at]], [B.window_hash(h, size)[at]]
    count = np.diff(first)
    for few in range(1, size):
        own = np.flatnonzero(count == few)
        if len(own):
            text.append(own)
            key.append(B.mix(B.window_hash(h, few)[first[own]] + U64(few)))
    text, key = np.concatenate(text), np.concatenate(key)
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    where = np.flatnonzero(new)
    weight = np.diff(np.append(where, len(key)))
    return text[where], key[where], weight


def digests(data: np.ndarray, off: np.ndarray) -> list[bytes]:
    """16 bytes that name the words of each text of a block."""
    start, end, first = B.words(data, off)
    line, at = B.joined(data, off, start, end, first, np.ones(len(start), bool))
    raw = line.tobytes()
    return [hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(at[:-1].tolist(), at[1:].tolist())]


_POISSON = np.cumsum(np.exp(-1) / np.concatenate([[1.0], np.cumprod(np.arange(1.0, 16.0))]))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U64(11)).astype(np.float64) * 2.0**-53


def throw(text: np.ndarray, key: np.ndarray, weight: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, rank and 64-bit name of all darts with a rank under the limit of each element's text."""
    out = []
    level = 0
    while len(text):
        width = float(1 << level)  # weights from width - 1 to 2 * width - 1, in strips of rank 1 / width: area 1
        strips = np.ceil(limit[text] * width).astype(np.int64)
        cell_of = np.repeat(np.arange(len(text)), strips)
        strip = np.arange(len(cell_of)) - np.repeat(np.cumsum(strips) - strips, strips)
        cell = B.mix(key[cell_of] + B.mix(strip.astype(U64) * U64(64) + U64(level)))
        darts = np.searchsorted(_POISSON, _unit(cell))
        of = np.repeat(np.arange(len(cell)), darts)
        number = np.arange(len(of)) - np.repeat(np.cumsum(darts) - darts, darts)
        name = B.mix(cell[of] + (number + 1).astype(U64) * U64(0x9E3779B97F4A7C15))
        height = width - 1 + width * _unit(B.mix(name + U64(1)))
        rank = (strip[of] + _unit(B.mix(name + U64(2)))) / width
        element = cell_of[of]
        hit = (height < weight[element]) & (rank < limit[text[element]])
        out.append((text[element[hit]], rank[hit], name[hit]))
        level += 1
        more = weight > 2 * width - 1
        text, key, weight = text[more], key[more], weight[more]
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3))


def signatures(text: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The names of the earliest darts of each coordinate, n x k, and each text's total weight. Texts without elements have zeros."""
    total = np.bincount(text, weights=weight, minlength=n)
    out = np.zeros((n, k), U64)
    darts = k * np.log(k) + 2 * k
    todo = total > 0
    while todo.any():
        mine = todo[text]
        limit = np.where(todo, darts / np.maximum(total, 1), 0)
        of, rank, name = throw(text[mine], key[mine], weight[mine], limit)
        slot = of.astype(np.int64) * k + ((name >> U64(32)) * U64(k) >> U64(32)).astype(np.int64)
        best = np.full(n * k, np.inf)
        np.minimum.at(best, slot, rank)
        won = rank == best[slot]
        full = np.isfinite(best.reshape(n, k)).all(1) & todo
        keep = won & full[slot // k]
        out.ravel()[slot[keep]] = name[keep]
        todo &= ~full
        darts *= 2
    return out, total.astype(np.int64)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    n, k = sig.shape
    parts = sig.reshape(n, bands, k // bands)
    h = np.broadcast_to(B.mix(np.arange(1, bands + 1, dtype=U64)), (n, bands)).copy()
    for j in range(parts.shape[2]):
        h = B.mix(h * U64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return h


def signature_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Per row with words and an id: id, words_key (16 bytes, equal for equal words), bands."""
    ship(df.sparkSession)
    source = df.select(df[id_col].alias("id"), df[text_col].alias("text")).where("id IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in B.blocks(batch.column(1), BLOCK):
                text, key, weight = elements(data, off, settings.shingle)
                sig, total = signatures(text, key, weight, b - a, settings.k)
                keep = np.flatnonzero(total > 0)
                bands = band_keys(sig[keep], settings.bands).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(keep)),
                        pa.array(digests(data, off), pa.binary()).take(pa.array(keep)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * settings.bands), pa.array(bands)),
                    ],
                    ["id", "words_key", "bands"],
                )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, words_key binary, bands array<long>")


def similarities(pairs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """pairs (a, b, text_a, text_b): exact (a, b, shared, whole), the sums of the smaller and of the larger weights."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                sides = [elements(*B.strings(part.column(i)), settings.shingle) for i in (2, 3)]
                text, key, weight = (np.concatenate([s[i] for s in sides]) for i in range(3))
                order = np.lexsort((key, text))
                text, key, weight = text[order], key[order], weight[order]
                same = np.flatnonzero((key[1:] == key[:-1]) & (text[1:] == text[:-1]))
                shared = np.bincount(text[same], weights=np.minimum(weight[same], weight[same + 1]), minlength=len(part)).astype(np.int64)
                whole = np.bincount(text, weights=weight, minlength=len(part)).astype(np.int64) - shared
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shared), pa.array(whole)], ["a", "b", "shared", "whole"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}, shared long, whole long")


def _checked(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return similarities(pairs.join(left, "a").join(right, "b"), settings)


def _buckets(members: DataFrame) -> DataFrame:
    """members (node, band): rows (band, node, hub) of the buckets with two nodes or more; hub: the least node of the bucket."""
    heads = members.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("most")).where("hub < most").select("band", "hub")
    return members.join(heads, "band").select("band", "node", "hub")


def _links(records: DataFrame, settings: Settings) -> DataFrame:
    return records.where(F.col("shared") * 100 >= F.col("whole") * settings.percent).select("a", "b")


def _open(buckets: DataFrame, records: DataFrame, settings: Settings) -> DataFrame:
    """(unit, node, comp, inside) of the nodes, but for hubs, that may have links to others of their bucket which no hub tells. inside: linked to the hub, which then is comp; else comp is the node."""
    slack = 1 - settings.percent / 100 + 1e-9
    rated = records.select(F.col("a").alias("node"), F.col("b").alias("hub"), (1 - F.col("shared") / F.col("whole")).alias("far"), (F.col("shared") * 100 >= F.col("whole") * settings.percent).alias("inside"))
    rated = buckets.where("hub < node").join(rated, ["node", "hub"]).select("band", "node", "hub", "far", "inside")
    sides = rated.groupBy("band").agg(F.count_if(~F.col("inside")).alias("n_out"), F.min(F.when(~F.col("inside"), F.col("far"))).alias("nearest_out"), F.max(F.when(F.col("inside"), F.col("far"))).alias("furthest_in"), F.count("*").alias("n"))
    sides = sides.where("n_out > 0 AND n > 1")
    wanted = F.when(F.col("inside"), F.col("far") >= F.col("nearest_out") - slack).otherwise((F.col("n_out") > 1) | (F.col("far") <= F.col("furthest_in") + slack))
    return rated.join(sides, "band").where(wanted).select(F.col("band").alias("unit"), "node", F.when(F.col("inside"), F.col("hub")).otherwise(F.col("node")).alias("comp"), "inside")


def _refined(large: DataFrame, texts: DataFrame, level: int, settings: Settings) -> DataFrame:
    """large (unit, node, comp, inside): the same nodes under units that share `rows` more coordinates, in `splits` ways."""
    nodes = large.select(F.col("node").alias("id")).distinct().join(texts, "id").select("id", "text")
    kind = nodes.schema["id"].dataType.simpleString()
    picks = [np.random.default_rng([level, j]).choice(settings.k, settings.rows, replace=False) for j in range(settings.splits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in B.blocks(batch.column(1), BLOCK):
                sig, _ = signatures(*elements(data, off, settings.shingle), b - a, settings.k)
                keys = np.concatenate([band_keys(sig[:, p], 1) for p in picks], axis=1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * settings.splits), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["node", "parts"])

    keys = nodes.mapInArrow(run, f"node {kind}, parts array<long>")
    parts = large.join(keys, "node").select("unit", "node", "comp", "inside", F.posexplode("parts").alias("way", "part"))
    return parts.select(F.xxhash64("unit", "way", "part").alias("unit"), "node", "comp", "inside")


def _units(members: DataFrame, texts: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame | None, list[DataFrame]]:
    """members in units of two nodes and `most` nodes at most; parts that refining leaves larger; the units that were refined, None if there is none; what is stored for them."""
    done, whole = [], None
    members = [stored(members)]
    while True:
        sizes = members[-1].groupBy("unit").agg(F.count("*").alias("n"), F.count_if(~F.col("inside")).alias("n_out")).where("n > 1 AND n_out > 0").select("unit", "n")
        sized = members[-1].join(sizes, "unit")
        done.append(sized.where(F.col("n") <= settings.most).drop("n"))
        large = sized.where(F.col("n") > settings.most).drop("n")
        level = len(members) - 1
        if level == settings.depth or large.isEmpty():
            break
        whole = whole or large
        members.append(stored(_refined(large, texts, level, settings)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, large, whole, members


def _hub_links(units: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) of the nodes of a unit to its least node, but between those that are inside."""
    heads = units.groupBy("unit").agg(F.min(F.struct("node", "inside")).alias("hub"))
    pairs = units.join(heads, "unit").where("node > hub.node AND NOT (inside AND hub.inside)").select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()
    return _links(_checked(pairs, texts, settings), settings)


def _undecided(units: DataFrame, comps: DataFrame) -> DataFrame:
    """(unit, node, comp, inside) of the units whose nodes are of several classes by comps (node, comp). inside: of the class with most nodes there."""
    known = units.select("unit", "node").join(comps, "node", "left").select("unit", "node", F.coalesce("comp", "node").alias("comp"))
    sides = known.groupBy("unit", "comp").agg(F.count("*").alias("n")).groupBy("unit").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("classes"))
    return known.join(sides.where("classes > 1"), "unit").select("unit", "node", "comp", (F.col("comp") == F.col("main")).alias("inside"))


def forest(total: np.ndarray, text: np.ndarray, key: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, comp: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between texts of `left` and of `right` (numbers) that differ in comp, as few of them as connect the same texts: (text, least text it reaches)."""
    n = len(total)
    level = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    text, key = np.repeat(text, weight), B.mix(np.repeat(key, weight) + level.astype(U64) * U64(0x9E3779B97F4A7C15))
    _, column, count = np.unique(key, return_inverse=True, return_counts=True)
    text, column = text[count[column] > 1], column[count[column] > 1]  # min(a, b) is the number of levels that both texts have
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    text, column = text[order], column[order]
    shared, row = np.zeros((len(left), len(right))), np.full((2, n), -1)
    row[0, left], row[1, right] = np.arange(len(left)), np.arange(len(right))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        sides = []
        for own, size in zip(row, shared.shape):
            x = np.zeros((size, int(column[b - 1]) - at + 1), np.float32)
            mine = own[text[a:b]] >= 0
            x[own[text[a:b][mine]], column[a:b][mine] - at] = 1
            sides.append(x)
        shared += sides[0] @ sides[1].T
    link = np.zeros(shared.shape, bool)
    some = [slice(at, at + ROWS) for at in range(0, len(left), ROWS)]  # rows at a time: no further matrix of all pairs
    for r in some:
        link[r] = (shared[r] * 100 >= (total[left[r]][:, None] + total[right] - shared[r]) * percent) & (comp[left[r]][:, None] != comp[right])
    del shared
    least = np.arange(n)
    while True:
        before = least.copy()
        for r in some:
            least[left[r]] = np.minimum(least[left[r]], np.where(link[r], least[right], n).min(1, initial=n))
            least[right] = np.minimum(least[right], np.where(link[r], least[left[r]][:, None], n).min(0, initial=n))
        if (least == before).all():
            break
    moved = np.flatnonzero(least < np.arange(n))
    return moved, least[moved]


def _block_links(members: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """members (unit, node, comp, inside): links (a, b) between comps that connect all those with near nodes in a unit. Nodes inside are of one comp and aren't compared with each other."""
    kind = members.schema["node"].dataType.simpleString()
    units = members.join(texts.select(F.col("id").alias("node"), F.greatest(F.octet_length("text"), F.lit(512)).alias("size")), "node")
    blocks = lambda size: F.ceil(F.coalesce(F.sum(size), F.lit(0)) / settings.block_bytes).cast("int")
    many = units.groupBy("unit").agg(blocks("size").alias("m"), blocks(F.when(~F.col("inside"), F.col("size"))).alias("m_out"), blocks(F.when(F.col("inside"), F.col("size"))).alias("m_in"))
    # blocks 0 to m_out - 1 hold the nodes outside, further ones those inside; a unit of one block stays whole
    many = many.select("unit", F.when(F.col("m") == 1, 1).otherwise(F.col("m_out")).alias("m_out"), F.when(F.col("m") == 1, 0).otherwise(F.col("m_in")).alias("m_in"))
    apart = F.col("inside") & (F.col("m_in") > 0)
    hashed = F.xxhash64("node")
    own = F.when(apart, F.col("m_out") + F.pmod(hashed, F.greatest("m_in", F.lit(1)))).otherwise(F.pmod(hashed, F.col("m_out"))).cast("int")
    others = F.sequence(F.lit(0), F.when(apart, F.col("m_out")).otherwise(F.col("m_out") + F.col("m_in")) - 1)
    placed = members.join(many, "unit").select("unit", "node", "comp", "inside", own.alias("own"), F.explode(others).alias("other"))
    placed = placed.select("unit", "node", "comp", "inside", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    sent = placed.join(texts.select(F.col("id").alias("node"), "text"), "node").select("unit", "i", "j", "own", "comp", "inside", "text")

    def run(table: pa.Table) -> pa.Table:
        parts, n = [], len(table)
        for a, _, data, off in B.blocks(pa.concat_arrays(table.column("text").chunks), BLOCK):
            text, key, weight = elements(data, off, settings.shingle)
            parts.append((text + a, key, weight))
        text, key, weight = (np.concatenate([p[i] for p in parts]) for i in range(3))
        total = np.bincount(text, weights=weight, minlength=n)
        own = table.column("own").to_numpy()
        comp = table.column("comp").combine_chunks()
        left = np.flatnonzero((own == table.column("i")[0].as_py()) & ~table.column("inside").to_numpy())
        right = np.flatnonzero(own == table.column("j")[0].as_py())
        a, b = forest(total, text, key, weight, left, right, comp.dictionary_encode().indices.to_numpy(), settings.percent)
        del parts, text, key, weight
        if n > 512:
            trim()
        return pa.table({"a": comp.take(pa.array(a)), "b": comp.take(pa.array(b))})

    return sent.groupBy("unit", "i", "j").applyInArrow(run, f"a {kind}, b {kind}")


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, class_id (the least id of its class; its own id if it is alone)."""
    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    rows = stored(signature_rows(df, id_col, text_col, settings))
    nodes = stored(rows.groupBy("words_key").agg(F.min(F.struct("id", "bands")).alias("x")).select("words_key", F.col("x.id").alias("node"), F.col("x.bands").alias("bands")))
    buckets = stored(_buckets(nodes.select("node", F.explode("bands").alias("band"))))
    texts = stored(source.join(buckets.select(F.col("node").alias("id")).distinct(), "id", "left_semi"))
    pairs = buckets.where("hub < node").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    records = stored(_checked(pairs, texts, settings))
    units, crowded, whole, kept = _units(_open(buckets, records, settings), texts, settings)
    more = stored(_block_links(units, texts, settings))
    links = _links(records, settings).unionByName(more)
    if whole is not None:
        hubs = stored(_hub_links(crowded, texts, settings))
        links = links.unionByName(hubs)
        kept.append(hubs)
    comps = components(links)
    placed = nodes.select("words_key", "node").join(comps, "node", "left").select("words_key", F.coalesce("comp", "node").alias("comp"))
    if whole is not None:
        rest = stored(_undecided(whole, comps))
        joined = components(_block_links(rest, texts, settings)).withColumnRenamed("comp", "least")
        kept.append(rest)
        placed = placed.join(joined, placed["comp"] == joined["node"], "left").select("words_key", F.coalesce("least", "comp").alias("comp"))
    dropped(buckets, texts, records, more, *kept)
    placed = rows.select("id", "words_key").join(placed, "words_key").groupBy("id").agg(F.min("comp").alias("class_id"))
    return source.select("id").join(placed, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"))


def one_of_each_class(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """df without the rows whose class has a smaller id; rows with a null id stay."""
    gone = near_duplicate_classes(df, id_col, text_col, settings).where("class_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    return df.join(gone, id_col, "left_anti").select(*df.columns)
