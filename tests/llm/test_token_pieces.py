"""Token ids of pieces against those of whole texts, and the coder's groups and damaged heads."""

import random

import numpy as np
import pytest

from sitelens.llm import tokenfile


class _Counting:
    """The library, with the characters that it was given."""

    def __init__(self):
        self.own, self.given = tokenfile._tokenizer(tokenfile.BYTE_BPE), 0

    def __getattr__(self, name):
        return getattr(self.own, name)

    def encode_batch_fast(self, texts, **kw):
        self.given += sum(map(len, texts))
        return self.own.encode_batch_fast(texts, **kw)


def test_words_are_encoded_once(monkeypatch):
    counting = _Counting()
    monkeypatch.setattr(tokenfile, "_tokenizer", lambda name: counting)
    import pyarrow as pa

    texts = ["The same words, again and again.\n" * 50] * 200
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], names=["doc_id", "text"])
    got = list(tokenfile._encoded(tokenfile.BYTE_BPE, [batch]))
    want = [*counting.own.encode(texts[0], add_special_tokens=False).ids, tokenfile.END_ID]
    assert all(ids.tolist() == want for _, ids in got) and len(got) == 200
    assert counting.given < 10_000  # of 330,000


PARTS = ["a", "b", "é", "'s", "'ll", "'", " ", "  ", "\n", " \n", "\t", "\x1c", "\x85", "᠎", "​", "\xa0", "﻿", "　", "1", "²", "½", "٣", "ª", "µ", "×", "÷", "ß", "ÿ", "Ā", "ж", "中", "😀", "é"]
PARTS += ["!", "..", "-", "_", "<|", "|>", "endoftext", "<|endoftext|>", "word", "The", "\r\n", "\x00", "—", "’s", "don't", "I'm", "x'", "'9"]


@pytest.mark.parametrize("remembered", [0, 40, 1 << 18])
def test_pieces_are_those_of_the_library(monkeypatch, remembered):
    monkeypatch.setattr(tokenfile, "PIECES", remembered)
    lib, rng = tokenfile._tokenizer(tokenfile.BYTE_BPE), random.Random(remembered)
    pieces = tokenfile._Pieces(lib)
    for _ in range(300):
        texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(8)]
        assert [x.tolist() for x in pieces.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_no_group_is_small():
    sizes = [b - a for a, b in tokenfile._groups(tokenfile.LANES + 5)]
    assert sum(sizes) == tokenfile.LANES + 5 and min(sizes) > tokenfile.LANES // 3
    assert tokenfile._groups(0) == []


@pytest.mark.parametrize("kind", ["one id", "all different", "falls", "a period"])
def test_extreme_blocks(kind):
    n = 3 * tokenfile.BLOCK + 17
    ids = {"one id": np.full(n, 7), "all different": np.arange(n) * 61, "falls": np.arange(n)[::-1], "a period": np.arange(n) % 3 * 90_000}[kind].astype(np.uint32)
    assert np.array_equal(tokenfile.decode_blocks(tokenfile.encode_blocks(ids)), ids)


def test_a_length_that_no_block_has():
    (block,) = tokenfile.encode_blocks(np.arange(9, dtype=np.uint32))
    magic, _, crc, words = tokenfile._HEADER.unpack_from(block)
    with pytest.raises(ValueError, match="a block has"):
        tokenfile.decode_blocks([tokenfile._HEADER.pack(magic, tokenfile.BLOCK + 1, crc, words) + block[tokenfile._HEADER.size :]])
