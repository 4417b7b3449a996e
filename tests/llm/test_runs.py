"""Periodic runs against every period at every place; edits, odd inputs, very long texts."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import queries, runs


def _brute(words):
    """All maximal stretches of every period, the smallest period of each."""
    found = {}
    for p in range(1, len(words)):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(6, 4 * p):
                found.setdefault((start, i + p), p)
            i = max(i, start + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def _made(rng, n):
    words = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(n)]
    for _ in range(rng.randrange(3) if n else 0):
        a, p = rng.randrange(n), rng.randrange(1, 12)
        for i in range(a + p, min(n, a + rng.randrange(90))):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("probes", [1 << 20, 40])
def test_runs_against_brute_force(monkeypatch, probes):
    monkeypatch.setattr(runs, "PROBES", probes)  # few grid points at a time: periods in many parts
    rng, total = random.Random(probes), 0
    for _ in range(1500):
        words = _made(rng, rng.randrange(120))
        got = runs.find_runs(np.array(words, np.int64))
        assert got == _brute(words)
        total += len(got)
    assert total > 1000


@pytest.mark.parametrize("words, n", [(np.zeros(300_000, np.int64), 1), (np.tile(np.arange(700), 400), 1), (np.arange(200_000), 0), (np.arange(300_000) // 6, 50_000)])
def test_very_long_texts(words, n):
    got = runs.find_runs(words)
    assert len(got) == n
    for s, n, q in got[:5]:
        assert np.array_equal(words[s : s + n - q], words[s + q : s + n])


def test_strongest_and_collapse():
    rng = random.Random(5)
    for _ in range(400):
        words = _made(rng, rng.randrange(80))
        found = _brute(words)
        drop = {i for s, n, q in found for i in range(s + q, s + n)}
        assert runs.collapse([b"%d" % w for w in words], found) == [b"%d" % w for i, w in enumerate(words) if i not in drop]
        assert runs.strongest(found) == (min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None)


def _edited(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_registered_query_against_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs) and sum(r["n_runs"] > 0 for r in got.values()) > 20
    for d in docs:
        words = _edited(d["doc_id"], d["text"])
        found = _brute(words)
        drop = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
        r = got[d["doc_id"]]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest()


def test_odd_rows_and_columns(spark):
    texts = [None, "", " \t\n", "a b c", "ha " * 6, "é\x85é " * 6, "x y " * 7]
    rows = spark.createDataFrame([(i if i else None, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, runs string").withColumn("_found0", F.lit("mine"))
    out = runs.find(rows.union(rows))
    assert out.columns == ["doc_id", "text", "runs", "_found0", "strongest", "collapsed"]
    got = {r["text"]: r for r in out.collect()}
    assert out.count() == 2 * len(texts) and all(r["_found0"] == "mine" for r in got.values())
    assert [len(got[t]["runs"]) for t in texts] == [0, 0, 0, 0, 1, 1, 1]
    assert got["ha " * 6]["collapsed"] == "ha" and tuple(got["ha " * 6]["strongest"]) == (0, 6, 1)
    assert got["x y " * 7]["collapsed"] == "x y" and got[None]["collapsed"] == ""  # only ASCII white space parts words
    assert runs.find(rows.limit(0)).count() == 0
    edited = rows.select("doc_id", runs.with_period(F.col("doc_id"), F.col("text")).alias("e"), "text").collect()
    assert all(r["e"] == r["text"] for r in edited if r["doc_id"] is None)
