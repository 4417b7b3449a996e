"""Katz scores do not depend on blocks, ranges or relays; keys are whole."""

import random

import numpy as np
import pytest

from sitelens.llm import katz
from sitelens.llm.common import shared_dir

U = np.uint64


def _corpus(spark):
    """A word in every other place, a long text, repeated rows."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(w if k % 2 else "the" for k, w in enumerate(rng.choices(words, k=rng.randint(0, 60)))) for _ in range(150)]
    texts += ["very long " * 1200 + " ".join(words), None, "", texts[3], "the the the"]
    path = shared_dir(spark, "katz")
    spark.createDataFrame([(i if i % 50 else None, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, to string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def _scores(docs):
    found = katz.score_documents(docs)
    return sorted(((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in found.collect()))


@pytest.mark.parametrize(("block", "range_tokens", "fanout", "group"), [(300, 300, 10**6, 1024), (300, 400, 2, 3), (10**6, 300, 2, 1024), (100, 500, 2, 2)])
def test_plans_do_not_matter(spark, monkeypatch, block, range_tokens, fanout, group):
    docs = _corpus(spark)
    plain = _scores(docs)
    for name, value in (("BLOCK_TOKENS", block), ("RANGE_TOKENS", range_tokens), ("FANOUT", fanout), ("GROUP", group)):
        monkeypatch.setattr(katz, name, value)
    plans = []
    made = katz.Plan.__init__
    monkeypatch.setattr(katz.Plan, "__init__", lambda self, *a: (made(self, *a), plans.append(self))[0])
    assert _scores(docs) == plain and len(plain) == docs.count()
    assert plans[0].ranges > 8 and plans[0].two_levels == (fanout == 2) and plans[0].salts.max() > 1


def test_no_rows(spark, monkeypatch):
    monkeypatch.setattr(katz, "FANOUT", 0)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score_documents(docs).count() == 0
    one = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert [(r["n_tokens"], r["train_tokens"]) for r in katz.score_documents(one).collect()] == [(1, 1)]


def test_many_contexts_keep_their_keys():
    """More contexts than 24 bits tell apart, and seconds that differ in their lowest bits only."""
    n = (1 << 24) + 5
    context = np.arange(n, dtype=U) * U(1 << 20)
    second = np.zeros(n, U)
    second[-1] = 1
    context[-1] = context[0]
    first, which = katz.distinct(context, second)
    assert len(first) == n and np.array_equal(first[which], np.arange(n))


def _unshifted(y, k):
    """The x with x ^ (x >> k) == y."""
    x = y
    for _ in range(64 // k + 1):
        x = y ^ (x >> k)
    return x


def test_keys_that_share_a_mixed_number():
    a, b, m = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, (1 << 64) - 1
    keys = [(_unshifted(5 + k * b & m, 29), _unshifted(9 - k * a & m, 32)) for k in range(3)]
    context, second = (np.array([k[i] for k in keys + keys], U) for i in (0, 1))
    first, which = katz.distinct(context, second)
    assert sorted(first.tolist()) == [0, 1, 2] and np.array_equal(context[first][which], context) and np.array_equal(second[first][which], second)


def test_entries_round_trip():
    rng = np.random.default_rng(1)
    context, second, count = (rng.integers(0, 1 << 63, 50, dtype=U) * U(2) + U(1) for _ in range(3))
    context = np.sort(rng.choice(context[:10], 50))
    got = katz.unpack_entries([katz.pack_entries(context, second, count >> U(8)), katz.pack_entries(context[:0], second[:0], count[:0])])
    assert np.array_equal(got[0], context) and np.array_equal(got[1], second) and np.array_equal(got[2], (count >> U(8)).astype(np.int64)) and got[3] == [50, 0]


def test_answers_fit_owners_of_hot_contexts():
    plan = katz.Plan(0, 10, 64)
    hot = np.array([3 << 62, 1], U)
    plan.spread(hot, np.array([500, 900]), 1000)
    assert plan.salts.tolist() == [64, 64] and plan.hot.tolist() == sorted(hot.tolist())
    second = np.random.default_rng(2).integers(0, 1 << 63, 5000, dtype=U)
    owner = plan.owner(np.full(5000, hot[0]), second)
    assert len(set(owner.tolist())) == 64 and owner.max() < 64
