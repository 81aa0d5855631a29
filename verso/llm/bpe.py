"""Byte-level BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can't lie inside a token of any encoding, so it marks a certain cut.
Texts are cut at the boundaries of the vocabulary's pre-tokens and at those pairs; each fragment is encoded by itself, the
answers are kept in a bounded table, and the fragments' ids are concatenated. The result equals that of the tokenizers
library, special tokens inside texts included. Decoding gathers token bytes by id and reads them as UTF-8.

One scan, no shuffle. Edge cases: a null text counts as empty (no ids, decoded to the empty text); rows with equal or null
ids each give a row; an empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verso.cluster import ship
from verso.llm import bytes_np as B

#: Fragments that a worker keeps; past this the table starts anew.
MOST_FRAGMENTS = 300_000
#: Bytes of text that are encoded at once.
BLOCK = 2 << 20

#: Classes of code points in the pre-token pattern, and its contractions.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level BPE without a normalizer)."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level BPE without a normalizer or prefix space")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(_byte_letters()))
        of = {c: b for b, c in self.letters.items()}
        ordinary = {i: bytes(of[c] for c in s) for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("only plain special tokens")
        tokens = ordinary | {i: s for s, i in self.special.items()}
        size = max(tokens) + 1
        self.token_len = np.array([len(tokens.get(i, b"")) for i in range(size)], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        self.blob = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)
        joined = np.zeros((256, 256), bool)
        for t in ordinary.values():
            if len(t) > 1:
                b = np.frombuffer(t, np.uint8)
                joined[b[:-1], b[1:]] = True
        #: Of each two bytes a, b at a * 256 + b: never adjacent inside a token.
        self.certain = ~joined.ravel()
        self.kinds = self._kinds()
        self.table: dict[bytes, bytes] = {}

    def _kinds(self) -> np.ndarray:
        kinds = np.zeros(0x110000, np.uint8)
        by = {"L": LETTER, "N": NUMBER}
        for c in range(0x110000):
            kinds[c] = by.get(unicodedata.category(chr(c))[0], OTHER)
        kinds[WHITE_SPACE] = SPACE
        return kinds

    def boundaries(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Byte offsets at which fragments start, over a block of texts; special tokens are fragments of their own."""
        n = len(data)
        begins = np.zeros(n + 1, bool)
        raw = data.tobytes()
        code = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        m = len(code)
        kind = self.kinds[code]
        hard = np.zeros(n + 1, bool)  # a text or special token starts or ends here: nothing reaches across
        hard[off] = True
        inner = []
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                text = np.searchsorted(off, at, "right")
                if at + len(token) <= off[text]:
                    hard[[at, at + len(token)]] = True
                    inner.append((at, at + len(token)))
                    at = raw.find(token, at + len(token))
                else:
                    at = raw.find(token, at + 1)
        wall = np.append(hard[lead], True)  # by code point
        start = np.ones(m + 1, bool)
        start[1:m] = (kind[1:] != kind[:-1]) | wall[1:m]
        run = np.flatnonzero(start)  # runs of one class; the last is the end
        if m:
            begin, end = run[:-1], run[1:]
            k, size = kind[begin], run[1:] - run[:-1]
            # The last of several spaces before something leaves the run, and a blank joins what follows it.
            s = k == SPACE
            followed = s & ~wall[end]
            last = end - 1
            long = followed & (size > 1)
            start[last[long]] = True
            blank = followed & (code[last] == 0x20)
            start[end[blank]] = False
            # A contraction: an apostrophe alone that no blank has joined, and the letters after it.
            lone = np.flatnonzero((k == OTHER) & (size == 1) & (code[begin] == 0x27) & start[begin])
            lone = lone[lone + 1 < len(begin)]
            lone = lone[(k[lone + 1] == LETTER) & ~wall[begin[lone + 1]]]
            for c in CONTRACTIONS:
                at = begin[lone] + 1
                fits = size[lone + 1] >= len(c)
                for j, x in enumerate(c):
                    fits &= code[np.minimum(at + j, m - 1)] == ord(x)
                hit = at[fits]
                start[hit] = False
                start[hit + len(c)] = True
                lone = lone[~fits]
        begins[lead[start[:m]]] = True
        begins[1:n] |= self.certain[data[:-1].astype(np.int32) * 256 + data[1:]]
        for a, b in inner:
            begins[a + 1 : b] = False
            begins[b] = True
        return np.flatnonzero(begins[:n])

    def _encode(self, fragment: bytes) -> bytes:
        if fragment in self.special:
            ids = [self.special[fragment]]
        else:
            ids = [t.id for t in self.model.tokenize(fragment.decode("latin-1").translate(self.letters))]
        if len(self.table) >= MOST_FRAGMENTS:
            self.table.clear()
        self.table[fragment] = out = array("I", ids).tobytes()
        return out

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, and the n + 1 offsets of the texts among them."""
        at = self.boundaries(data, off)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        # Equal fragments of the block, by their bytes, are looked up once.
        kept = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        kind = kept.indices.to_numpy()
        get, encode = self.table.get, self._encode
        parts = [get(f) or encode(f) for f in kept.dictionary.to_pylist()]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        known = np.frombuffer(b"".join(parts), np.uint32)
        begin = (np.cumsum(size) - size)[kind]
        size = size[kind]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = known[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(at, off)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and the n + 1 offsets of the texts among them."""
        size = self.token_len[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        index = np.repeat(self.token_at[ids] - upto[:-1], size) + np.arange(upto[-1])
        return self.blob[index], upto[first]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Per row: id, n_tokens, ids (if asked for), ids_sha256 and decoded_sha256; the text is encoded whole and decoded again.

    vocabulary: path of the file, the same on every machine.
    """
    ship(df.sparkSession)
    source = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            for a, b, data, off in B.blocks(batch.column(1), BLOCK):
                tokens, first = c.encode(data, off)
                back, at = c.decode(tokens, first)
                texts = [back[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(at[:-1], at[1:])]
                cols = [
                    batch.column(0).slice(a, b - a),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array([hashlib.sha256(tokens[x:y].tobytes()).hexdigest() for x, y in zip(first[:-1], first[1:])], pa.string()),
                    pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(tokens.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
