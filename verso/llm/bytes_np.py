"""Word spans and rolling hashes over UTF-8 buffers, in numpy.

A block is a run of whole texts that lie in one uint8 array; `off` has the n + 1 byte offsets of its n texts.
Every function works on all texts of a block at once, so no Python code runs per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 1 << 20
#: Multiplier of the rolling hash (odd, so that it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C55

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Spans of more bytes are hashed one by one.
LONG_SPAN = 256
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary column; nulls count as empty."""
    if column.null_count:
        empty = pa.scalar(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "", column.type)
        column = column.fill_null(empty)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    off = off.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into blocks of about `most` bytes; a longer text is a block of its own. Yields first row, end row, bytes, offsets."""
    data, off = strings(column)
    at, n = 0, len(off) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, end, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words `[^\\x20\\x09-\\x0D]+`, and the n + 1 offsets of the texts' words among them."""
    space = SPACE[data]
    n = len(data)
    before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
    before[1:] = space_or_end = np.append(space, True)[:n]
    before[off] = True
    after[: n - 1 if n else 0] = space_or_end[1:]
    full = off[1:][off[1:] > off[:-1]]
    after[full - 1] = True
    start = np.flatnonzero(~space & before[:n])
    end = np.flatnonzero(~space & after[:n]) + 1
    return start, end, np.searchsorted(start, off)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1), writeable=False)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of the bytes of each span, wherever it lies: eight bytes at a time, each step mixed; long spans by BLAKE2. Each seed has its own."""
    size = end - start
    eight = _eights(data)
    h = size.astype(U64) + U64(seed * BASE % (1 << 64))
    todo, at = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(todo):
        left = np.minimum(size[todo] - at, 8)
        part = np.ascontiguousarray(eight[start[todo] + at]).view("<u8").ravel() & _MASKS[left]
        h[todo] = mix(h[todo] * U64(BASE) + mix(part + U64(at + 1)))
        at += 8
        todo = todo[size[todo] > at]
    for i in np.flatnonzero(size > LONG_SPAN):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest(), "little")
    return mix(h)


def same_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether each span has the bytes of the other span at its place."""
    same = end - start == other_end - other_start
    for i in np.flatnonzero(same & (end - start > LONG_SPAN)):
        same[i] = np.array_equal(data[start[i] : end[i]], data[other_start[i] : other_end[i]])
    todo, at = np.flatnonzero(same & (end > start) & (end - start <= LONG_SPAN)), 0
    eight = _eights(data)
    while len(todo):
        mask = _MASKS[np.minimum(end[todo] - start[todo] - at, 8)]
        one, two = (np.ascontiguousarray(eight[s[todo] + at]).view("<u8").ravel() & mask for s in (start, other_start))
        same[todo[one != two]] = False
        at += 8
        todo = todo[(one == two) & (end[todo] - start[todo] > at)]
    return same


def dictionary(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each span's bytes among the different ones, which follow. Bytes are compared, not only hashes. Spans don't overlap."""
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    off = np.empty(2 * len(start), np.int64)
    off[0::2], off[1::2] = start, end
    kept = pa.Array.from_buffers(pa.large_binary(), 2 * len(start) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])
    coded = kept.take(pa.array(np.arange(0, len(kept), 2))).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of each n consecutive values of h: len(h) - n + 1 values (windows may cross texts; see `inside`).

    It is a polynomial modulo 2**64, whose known collisions need windows of a thousand values and more: n is at most 100.
    """
    if n > 100:
        raise ValueError("windows of more than 100 words")
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    up, down = powers(len(h) + 1)
    pre = np.zeros(len(h) + 1, U64)
    np.cumsum(h * up[: len(h)], out=pre[1:])
    return mix((pre[n:] - pre[:m]) * down[:m])


def inside(first: np.ndarray, n: int, m: int) -> np.ndarray:
    """Which of the m windows of n words lie in one text; first has the texts' word offsets."""
    ok = np.ones(m, bool)
    for back in range(1, n):
        cut = first[1:-1] - back
        ok[cut[(cut >= 0) & (cut < m)]] = False
    return ok


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values that occur again, next to each other by value and in order: a place, and the next place of the same value."""
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    return order[same], order[same + 1]


def covered(hit: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of `total` words lie in a window of n words that is marked in hit."""
    edge = np.zeros(total + 1, np.int32)
    at = np.flatnonzero(hit)
    edge[at] += 1
    edge[at + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def joined(data: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text joined by one blank: bytes and offsets."""
    of = owners(first)
    kept = np.flatnonzero(keep)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start[kept]] += 1
    edge[end[kept]] -= 1
    take = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    follows = kept[1:][of[kept[1:]] == of[kept[:-1]]]
    blank = start[follows] - 1
    out = data.copy()
    out[blank] = 0x20
    take[blank] = True
    upto = np.concatenate([[0], np.cumsum(take)])
    return out[take], upto[off]
