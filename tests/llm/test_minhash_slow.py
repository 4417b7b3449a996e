"""Operator 10 value by value against pure Python, long texts in pieces, and the recall of its classes."""

import hashlib
import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from sitelens.llm import minhash, neardup, queries

M = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def _mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def _word(w):
    return _mix((sum((c + 1) * pow(BASE, i, 1 << 64) for i, c in enumerate(w)) + len(w)) & M)


def _shingles(text):
    words = [_word(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode())]
    out = []
    for i in range(len(words)):
        h = words[i]
        for k in range(1, 5):
            h = _mix((h * 0xD6E8FEB86659FD93 + (words[i - k] if i >= k else k)) & M)
        out.append(h)
    return out


def _fingerprint(text):
    h = _shingles(text)
    functions = zip(minhash._MULTIPLY.tolist(), minhash._ADD.tolist(), strict=True)
    return "".join(f"{min(((x * m + a & M) >> 32 for x in h), default=M >> 32) & 0xFFFF:04x}" for m, a in functions)


def _places(f):
    return [f[i : i + 4] for i in range(0, len(f), 4)]


def _alike(a, b):
    return sum(x == y for x, y in zip(_places(a), _places(b), strict=True)) / minhash.PERMUTATIONS


def _class_of(texts):
    """The first text of each one's class."""
    sets, parent = [set(_shingles(t)) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(texts))]


def test_every_column_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, rng.choice([None, "", " \n", "one", "Zwei wörter 👍", " ".join(rng.choices(words, k=rng.randint(1, 90)))])) for k in range(0, 160, 2)]
    rows += [(201, rows[30][1]), (203, (rows[31][1] or "a b c d e f g h i j k l m n o p q r s t u v w x y z") + " more"), (203, "of one id"), (None, "nameless"), (None, "nameless")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash.edit_report(docs, neardup.classes(docs, neardup.PADDED)).collect()
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    first = _class_of([t for _, t in ordered])
    least = defaultdict(list)
    for k, (i, _) in enumerate(ordered):
        if i is not None:
            least[first[k]].append(i)
    want = []
    for k, (i, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own, changed, other = map(_fingerprint, (text, edited, after))
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, _alike(own, changed), _alike(own, other), min(least[first[k]], default=None)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_classes_of_the_query_find_the_links(spark):
    """Recall against all pairs at sf0.001: every pair of 0.8 or more is in one class, and no class has an unlinked document."""
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    ids = sorted(texts)
    first = _class_of([texts[i] for i in ids])
    got = {r["doc_id"]: r["class_id"] for r in queries.op10_minhash(spark, d).collect()}
    linked = [k for k, f in enumerate(first) if f != k]
    assert linked and sum(got[ids[k]] == ids[first[k]] for k in linked) / len(linked) >= 0.9
    assert all(got[ids[k]] == ids[k] for k in range(len(ids)) if first[k] == k)


@pytest.mark.parametrize(("kind", "slow"), [(neardup.PADDED, 4), (neardup.PLAIN, 0)])
def test_long_texts_in_pieces(monkeypatch, kind, slow):
    rng = random.Random(1)
    text = "".join(rng.choice(["word", "Other", "x" * 30, "é"]) + rng.choice([" ", "\n\t ", "  "]) for _ in range(3000)).encode()
    texts = [b"short one", text, b"", text[:500], b"y" * 5000, text + b"end"]
    whole, sets = minhash.signatures(texts, *kind), minhash.shingle_sets(texts, *kind)
    for size in (40, 777, 9000):
        monkeypatch.setattr(minhash, "CHUNK_BYTES", size)
        assert np.array_equal(minhash.signatures(texts, *kind), whole)
        assert all(np.array_equal(a, b) for a, b in zip(minhash.shingle_sets(texts, *kind), sets, strict=True))
    assert kind[1] == slow


def test_very_long_text():
    text = b"some words that repeat " * 900_000
    assert len(text) > 4 * minhash.CHUNK_BYTES
    assert np.array_equal(minhash.signatures([text])[0], minhash.signatures([text[: 23 * 40]])[0])
