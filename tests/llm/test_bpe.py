import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from tests.llm.conftest import doubled
from verso.llm import bytes_np as B
from verso.llm.bpe import Codec

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return Codec(PATH)


def run(codec, texts, block=B.BLOCK_BYTES):
    ids, back = [], []
    for _, _, data, off in B.blocks(pa.array(texts, pa.string()), block):
        tokens, first = codec.encode(data, off)
        out, at = codec.decode(tokens, first)
        ids += [tokens[x:y].tolist() for x, y in zip(first[:-1], first[1:])]
        back += [out[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(at[:-1], at[1:])]
    return ids, back


def test_equals_the_library(codec, sf):
    import duckdb

    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'LL", "é", "1", "²", "Ⅷ", "!", "?", "<|endoftext|>", "<|endoftext", "|>", " ", "　", "日", "\U0001f600", "́", "\x1c", "\x85", "don't", " '", "\r\n", "_", "​"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(15))) for _ in range(5000)]
    texts += [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet'").fetchall()] + ["", None]
    library = Tokenizer.from_file(PATH)
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for block in (64, B.BLOCK_BYTES):
        ids, back = run(codec, texts, block)
        assert ids == want
        assert back == [library.decode(i, skip_special_tokens=False) for i in want]


def test_cuts_are_certain(codec):
    """No token holds a pair that is marked as a certain cut."""
    pairs = np.flatnonzero(codec.certain)
    assert len(pairs)
    for i in range(len(codec.token_len)):
        t = codec.blob[codec.token_at[i] : codec.token_at[i] + codec.token_len[i]].astype(int)
        if i not in codec.special.values():
            assert not codec.certain[t[:-1] * 256 + t[1:]].any()


def test_the_table_is_bounded(codec, monkeypatch):
    from verso.llm import bpe

    monkeypatch.setattr(bpe, "MOST_FRAGMENTS", 3)
    texts = ["one two three four five six", "seven eight nine one two"]
    ids, back = run(codec, texts)
    assert back == texts and len(codec.table) <= 3


@pytest.mark.parametrize("pair", ["ab", "in", "01", "=-"])
def test_texts_that_polynomial_hashes_confuse(codec, pair):
    texts = list(doubled(*pair, joint=""))
    library = Tokenizer.from_file(PATH)
    ids, back = run(codec, texts)
    assert ids == [library.encode(t, add_special_tokens=False).ids for t in texts] and back == texts
