"""Encoding segment by segment equals the library, whatever the segments; decoding chunk by chunk too."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitelens.llm import bpe, mixing
from sitelens.llm.common import shared_dir


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("segment", [1, 7, 100])
def test_segments_do_not_matter(monkeypatch, name, segment):
    own, lib = bpe.load(name), Tokenizer.from_file(bpe.tokenizer_path(name))
    lib.no_truncation()
    lib.no_padding()
    monkeypatch.setattr(bpe, "SEGMENT_CHARS", segment)
    rng = random.Random(segment)
    parts = ["word", "Ωμέγα ΣΑΣ", " ", "  ", "\n\n\t", "é", "́", "42", "don't", "<|endoftext|>", "<|", "日本", "\x85", "　x", "👍🏽", "..."]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(60)] + ["", " ", "a ́b", "x" * 50 + " y"]
    for t in texts:
        expected = lib.encode(t, add_special_tokens=False).ids
        chunks = list(own.encode_chunks(t))
        assert np.frombuffer(b"".join(chunks), "<u4").tolist() == expected
        machine = bpe.Decoder(own)
        assert "".join(map(machine.feed, chunks)) + machine.end() == lib.decode(expected, skip_special_tokens=False) == own.decode(b"".join(chunks))


def test_special_tokens_come_from_the_vocabulary(monkeypatch):
    own = bpe.load("byte_bpe_50k.json")
    monkeypatch.setattr(own, "special", {"[[stop here]]": 7})
    import re

    monkeypatch.setattr(own, "_special", re.compile(re.escape("[[stop here]]")))
    plain = own.encode("a") + (7).to_bytes(4, "little") + own.encode(" b")
    assert own.encode("a[[stop here]] b") == plain


def test_very_long_text_leaves_in_chunks(spark):
    own = bpe.load(bpe.WORD_BPE)
    text = "Streaming words, 12 at a time. " * 100_000
    chunks = list(own.encode_chunks(text))
    assert len(chunks) > 10 and max(map(len, chunks)) < 4 * bpe.SEGMENT_CHARS
    got = spark.createDataFrame([(text,)], "t string").select(bpe.round_trip(F.col("t"), keep_ids=False).alias("d")).first()["d"]
    assert got["ids_sha256"] == hashlib.sha256(b"".join(chunks)).hexdigest() and got["ids"] is None


def test_sizes_of_sources_are_read_once(spark):
    path = shared_dir(spark, "m")
    spark.createDataFrame([(i, "tiny" if i == 0 else "big", "x" * (3 if i == 0 else 4000)) for i in range(200)], "doc_id long, source string, text string").write.parquet(path)
    out = mixing.mix(spark.read.parquet(path))
    assert out.filter("source = 'tiny'").count() > 200  # more copies of a document than a fixed table of steps would have
