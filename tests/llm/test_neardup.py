"""The pipeline's near-dedup stage: 5-word shingles and a Jaccard similarity of 0.8 or more."""

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from sitelens.llm import minhash, neardup, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _shingles(text):
    w = (text or "").translate(LOWER).encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _first(rows):
    """Smallest doc_id of each row's component, by brute force."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [_shingles(t) for _, t in rows]
    for i, j in combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return sorted((rows[i][0], min(rows[j][0] for j in range(len(rows)) if find(j) == find(i))) for i in range(len(rows)))


def _corpus():
    """Copies with more or fewer words changed, at the start too, short texts and a large group around 0.8."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    texts = [None, "", " \n", "one", "One", "one two", "a b c d e", "A B c d e", "a b c d f"]
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(20, 150))
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randint(1, 4)):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
        texts.append(" ".join(["other", *base[1:]]))
    base = rng.choices(words, k=100)
    for _ in range(60):
        copy = list(base)
        for at in rng.sample(range(100), 2):
            copy[at] = rng.choice(words)
        texts.append(" ".join(copy))
    return list(enumerate(texts))


@pytest.mark.parametrize("cell", [neardup.CELL, 8])
def test_near_copies_against_brute_force(spark, cell):
    rows = _corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, neardup.near_copies(docs, cell).collect())) == _first(rows)


def test_stage_drops_near_copies_that_simhash_keeps(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = {r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, d).collect()}
    assert kept == {i for i, first in _first(rows) if i == first}
    assert kept < {r["doc_id"] for r in simhash.keep_first(docs).collect()}


def test_stage_keeps_nameless_rows(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "A b c")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in neardup.keep_first(docs).collect()) == [0, 0, 1]


def test_shingles_of_chunks(monkeypatch):
    texts = [(t or "").encode() for _, t in _corpus()]
    assert [len(s) for s in neardup.shingle_sets(texts)] == [len(_shingles(t)) for _, t in _corpus()]
    whole = [s.tolist() for s in neardup.shingle_sets(texts)]
    monkeypatch.setattr(minhash, "CHUNK_BYTES", 100)
    assert [s.tolist() for s in neardup.shingle_sets(texts)] == whole


def test_cells_side_by_side_and_filter_by_fingerprint(monkeypatch):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    texts, cells = [], []
    for c in range(30):
        base = rng.choices(words, k=rng.choice([3, 8, 60, 200]))
        for _ in range(rng.randint(1, 40)):
            copy = list(base)
            for at in rng.sample(range(len(copy)), min(len(copy), rng.randint(0, 3))):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy).encode())
            cells.append(c)
    sets = list(neardup.shingle_sets(texts))
    alone = []
    for c in range(30):
        own = [i for i, x in enumerate(cells) if x == c]
        alone += [own[g] for g in neardup.alike_groups([sets[i] for i in own])]
    assert neardup.alike_groups(sets, cells=np.array(cells)).tolist() == alone
    monkeypatch.setattr(neardup, "SMALL", 10**9)  # everything verified
    assert neardup.alike_groups(sets, cells=np.array(cells)).tolist() == alone


def test_radius_holds_alike_sets():
    rng = np.random.default_rng(1)
    far = 0
    for n in (24, 30, 60, 300):
        for _ in range(500):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            lost = int(n * 0.2)  # a similarity of 0.8 at the least
            far = max(far, (simhash.majority_bits(a) ^ simhash.majority_bits(a[lost:])).bit_count())
    assert far <= neardup.RADIUS
