"""The context-mixing coder against a plain order-0 model, and files of many segments."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import tokenfile
from sitelens.llm.common import shared_dir


def _order0_bytes(ids, block=tokenfile.BLOCK):
    """Ideal code length of adaptive counts with an escape (as many as there are distinct ids), reset every block."""
    bits = 0.0
    for at in range(0, len(ids), block):
        counts, n = {}, 0
        for x in ids[at : at + block].tolist():
            d = len(counts)
            if x in counts:
                bits -= math.log2(counts[x] / (n + d))
                counts[x] += 1
            else:
                bits -= math.log2(d / (n + d) if n else 1) - math.log2(50_257)
                counts[x] = 1
            n += 1
    return bits / 8


@pytest.fixture(scope="module")
def real_ids(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    return np.concatenate([ids for _, ids in _ids_of([(r["doc_id"], r["text"] or "") for r in rows])])


def _ids_of(rows):
    lib = tokenfile._tokenizer(tokenfile.BYTE_BPE)
    return [(i, np.array([*lib.encode(t, add_special_tokens=False).ids, 0], np.uint32)) for i, t in rows]


def test_mixing_beats_its_lowest_order(real_ids):
    blocks = tokenfile.encode_blocks(real_ids)
    assert sum(map(len, blocks)) < 0.95 * _order0_bytes(real_ids)  # headers and checksums included
    assert np.array_equal(tokenfile.decode_blocks(blocks), real_ids)


def test_higher_orders_pay():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 50_000, 40)
    order1 = np.empty(4096, np.int64)
    order1[0] = 0
    for t in range(1, 4096):  # what follows an id is one of two
        order1[t] = (order1[t - 1] * 7 + 3 + 11 * int(rng.integers(0, 2))) % 40
    shuffled = rng.permutation(order1)
    size = lambda x: sum(map(len, tokenfile.encode_blocks(base[x])))
    assert size(order1) < 0.6 * size(shuffled)


@pytest.mark.parametrize("lanes", [1, 3, 64])
def test_lanes_do_not_matter(monkeypatch, lanes):
    ids = (np.random.default_rng(lanes).zipf(1.3, 9000) % 50_257).astype(np.uint32)
    plain = tokenfile.encode_blocks(ids)
    monkeypatch.setattr(tokenfile, "LANES", lanes)
    assert tokenfile.encode_blocks(ids) == plain and np.array_equal(tokenfile.decode_blocks(plain), ids)


def test_edges_of_the_id_range():
    ids = np.array([0, tokenfile.MAX_ID, 0, tokenfile.MAX_ID, 1, 2, 3] * 5)
    assert np.array_equal(tokenfile.decode_blocks(tokenfile.encode_blocks(ids)), ids)
    with pytest.raises(ValueError, match="ids must lie"):
        tokenfile.encode_blocks(np.array([5, tokenfile.MAX_ID + 1]))


def test_every_damage_is_found():
    ids = (np.random.default_rng(1).zipf(1.2, 3000) % 50_257).astype(np.uint32)
    whole = b"".join(tokenfile.encode_blocks(ids))
    assert np.array_equal(tokenfile.decode_blocks(tokenfile.split_blocks(whole)), ids)
    rng = random.Random(2)
    for _ in range(60):
        broken = bytearray(whole)
        broken[rng.randrange(len(whole))] ^= 1 << rng.randrange(8)
        try:
            found = tokenfile.decode_blocks(tokenfile.split_blocks(bytes(broken)))
        except ValueError:
            continue
        assert np.array_equal(found, ids)  # the last bits of a payload need not matter


@pytest.mark.parametrize(("segment", "chars"), [(1, 200), (700, 10**9), (10**9, 3000)])
def test_files_and_segments_do_not_matter(spark, monkeypatch, segment, chars):
    rng = random.Random(segment)
    words = ["alpha", "beta", "Gamma", "δ", "epsilon\n", "  "]
    rows = [(rng.choice([None, 5, -7, *range(100, 160)]), rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 300)))])) for _ in range(200)]
    rows += [(5, "same " * 20 + c) for c in "edcba"] + [(6, "very long text " * 60_000)]
    monkeypatch.setattr(tokenfile, "SEGMENT", segment)
    monkeypatch.setattr(tokenfile, "FILE_CHARS", chars)
    path = shared_dir(spark, "t")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("file", F.lit("extra")).repartition(5)
    tokenfile.write(docs, path)
    got = sorted(map(tuple, tokenfile.read(spark, path).collect()), key=lambda r: r[1])
    want, at = [], 0
    for i, ids in _ids_of(sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))):
        want.append((i, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert spark.read.parquet(path).select("file").distinct().count() > (20 if chars == 200 else 1)
