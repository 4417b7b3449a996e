"""Very long texts, and groups without a doc_id, in the operators whose other tests have none."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sitelens.llm import langid, mixing, quality, simhash

_rng = random.Random(3)
_WORDS = ["".join(_rng.choice("abcdefghij") for _ in range(_rng.randint(2, 8))) for _ in range(500)]
LONG = " ".join(_rng.choices(_WORDS, k=200_000))


def test_simhash_of_a_long_text(spark):
    w = LONG.split()
    h = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    docs = spark.createDataFrame([(5, LONG), (6, LONG + " x"), (7, "short")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert got[5]["fp"] % 2**64 == want and got[6]["component_id"] == 5 and got[7]["component_id"] == 7


def test_component_of_nameless_rows(spark):
    docs = spark.createDataFrame([(None, "only nameless rows say this"), (None, "only nameless rows say this"), (3, "another text altogether, of other words")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == {(None, None): 2, (3, 3): 1}


def test_language_of_a_long_text():
    sample = {"aa": (2, ["some letters here"] * 2), "bb": (2, ["xyzzy plugh quux"] * 2)}
    model = langid.Classifier(sample)
    late = "some letters here " * 50 + "xyzzy plugh quux " * 60_000
    assert model.predict(late)[0] == "bb" and model.predict("some letters here " * 60_000)[0] == "aa"


def test_quality_of_a_long_text(spark):
    lines = "\n".join([LONG[k : k + 100] for k in range(0, len(LONG), 100)] + [LONG[:100]] * 3)
    row = quality.surface_rules(spark.createDataFrame([(1, lines)], "doc_id long, text string")).first()
    w = lines.split()
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    assert (row["n_words"], row["word_chars"], row["n_dup_lines"], row["n_repeat_words"]) == (len(w), sum(map(len, w)), 3, len(covered))


def test_mixing_moves_long_texts_whole(spark):
    docs = spark.createDataFrame([(k, "s", LONG if k == 1 else "tiny") for k in range(40)], "doc_id long, source string, text string")
    out = mixing.mix(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_copies").alias("c"), F.min(F.length("text")).alias("short"), F.max(F.length("text")).alias("long")).collect()
    assert out and all(r["n"] == r["c"] and r["short"] == r["long"] == (len(LONG) if r["doc_id"] == 1 else 4) for r in out)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200])
def test_pairs_in_planes_are_all_pairs(n):
    fps = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64) | np.uint64(0xFFFFFFFF << 30)
    bucket = np.sort(np.random.default_rng(n + 1).integers(0, 4, n))
    got = {(i, j) for a, b in simhash.near_pairs(bucket, fps, 14) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if bucket[i] == bucket[j] and int(fps[i] ^ fps[j]).bit_count() <= 14}
