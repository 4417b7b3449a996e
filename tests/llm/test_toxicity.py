"""Toxicity: the pruned model against Kneser-Ney as it is written down; held-out accuracy; odd inputs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import queries, toxicity

BAD = ["vile", "rotten", "nasty"]


def _texts(seed, n, toxic):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to", "in", "is"]
    out = []
    for _ in range(n):
        words = [rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("abcdeo") for _ in range(rng.randint(3, 5))) for _ in range(rng.randint(20, 80))]
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", ".", "!"]))
        out.append(" ".join(words))
    return out


def _words(text):
    found = re.findall(r"[^\W\d_]+", (text or "").lower())
    return [w for i, w in enumerate(found) if not i or found[i - 1] != w]


def _slow(rows, discount):
    """A function (v, w) -> log ratio, from (text, toxic) rows."""
    count = {True: Counter(), False: Counter()}
    for text, toxic in rows:
        found = _words(text)
        count[toxic].update(set(zip(["", *found], found)))
    shared, total = Counter(w for _, w in {*count[True], *count[False]}), len({*count[True], *count[False]})
    follow = {c: Counter(w for _, w in count[c]) for c in count}
    n_words = len(shared) + 1

    def base(w):
        return (max(shared[w] - toxicity.SHARED, 0) + sum(min(x, toxicity.SHARED) for x in shared.values()) / n_words) / total

    def single(c, w):
        lost = sum(min(x, discount) for x in follow[c].values())
        return (max(follow[c][w] - discount, 0) + lost * base(w)) / sum(follow[c].values())

    def pair(c, v, w):
        after = [x for (u, _), x in count[c].items() if u == v]
        if not after:
            return single(c, w)
        return (max(count[c][v, w] - discount, 0) + sum(min(x, discount) for x in after) * single(c, w)) / sum(after)

    return lambda v, w: math.log(pair(True, v, w) / pair(False, v, w))


def _slow_window(ratio, text):
    found = _words(text)
    each = [ratio(v, w) for v, w in zip(["", *found], found)]
    size = min(toxicity.WINDOW, len(each))
    return max([0.0, *(sum(each[k : k + size]) / size for k in range(len(each) - size + 1))]) if each else 0.0


@pytest.mark.parametrize("discount", [0.75, 2.5, 6.0])
def test_model_against_the_formulas(spark, discount):
    rows = [(t, True) for t in _texts(1, 12, True)] + [(t, False) for t in _texts(2, 30, False)]
    pairs = toxicity.counted(spark.createDataFrame(rows, "text string, toxic boolean"))
    model = toxicity.learn(pairs, [0.6, discount, 7.0])[1]
    ratio = _slow(rows, discount)
    for text in [*_texts(3, 3, True), *_texts(4, 3, False), "vile", "the the of", "unheard words", "", None, "Of THE nasty, nasty"]:
        assert model.strongest(text) == pytest.approx(_slow_window(ratio, text), abs=1e-9)


@pytest.fixture(scope="module")
def tables(spark):
    texts = [(i, t, int(bad)) for bad, n in ((True, 120), (False, 400)) for i, t in enumerate(_texts(10 + bad, n, bad), 1000 * bad)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, x) for i, _, x in texts], "doc_id long, toxic int")


def test_held_out_documents(tables):
    docs, labels = tables
    out = toxicity.score_documents(docs, docs.filter(~toxicity.held_out()), labels.filter(~toxicity.held_out()))
    rows = out.filter(toxicity.held_out()).join(labels, "doc_id").collect()
    bad, good = ([r for r in rows if r["toxic"] == x] for x in (1, 0))
    assert sum(r["predicted"] for r in bad) >= 0.9 * len(bad) and sum(r["predicted"] for r in good) <= 0.05 * len(good)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_a_toxic_passage_of_a_long_text_counts(tables):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    long = " ".join(_texts(77, 400, False))
    at = len(long) // 2
    assert model.score(long) < 0.7 <= model.score(long[:at] + " vile rotten nasty " + long[at:])
    assert model.score("vile rotten nasty") >= 0.7 > model.score("") == model.score(None) == model.score("12 + 3")


def test_what_is_learned_from(spark, tables):
    docs, labels = tables
    again = docs.union(docs.filter("doc_id % 7 = 0")).union(spark.createDataFrame([(1000, "zz last of two texts"), (None, "no id")], docs.schema))
    more = labels.union(labels).union(spark.createDataFrame([(None, 1), (3, None), (9999, 1), (5, 1)], labels.schema))
    got = {r["doc_id"]: r for r in toxicity.training_sample(again, more).collect()}
    assert len(got) == docs.count() and got[5]["toxic"] and not got[3]["toxic"] and not got[1000]["text"].startswith("zz")
    few = toxicity.training_sample(docs, labels, most=50)
    assert few.count() == 50 and few.exceptAll(toxicity.training_sample(docs, labels)).count() == 0


@pytest.mark.parametrize("toxic, score", [([], 0.0), ([1, 1], 1.0), ([0, 0, 0], 0.0)])
def test_a_class_that_is_missing(spark, toxic, score):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(["a b", None, "c"])], "doc_id long, text string, score string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    out = toxicity.score_documents(docs, docs, labels)
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    assert [(r["score"], r["predicted"]) for r in out.collect()] == [(score, int(score))] * 3
    assert toxicity.score_documents(docs.limit(0), docs, labels).count() == 0


def test_few_documents_serve_both_parts(spark):
    docs = spark.createDataFrame([(0, "vile vile thing"), (1, "a fine thing")], "doc_id long, text string")
    out = toxicity.score_documents(docs, docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"))
    score = {r["doc_id"]: r["score"] for r in out.collect()}
    assert score[0] >= score[1]


def test_logistic_fit():
    rng = np.random.default_rng(1)
    x = rng.random(4000) * 3
    y = (rng.random(4000) < 1 / (1 + np.exp(3 - 2 * x))).astype(float)
    a, b, loss = toxicity.fit_logistic(x, y)
    p = 1 / (1 + np.exp(-a - b * x))
    assert abs((p - y).sum()) < 0.01 and abs(((p - y) * x).sum()) < 0.01 and abs(a + 3) < 0.3 and abs(b - 2) < 0.2
    assert toxicity.fit_logistic(x, 1 - y)[1] == 0 and toxicity.fit_logistic(x, np.zeros(4000))[1] >= 0


def test_registered_query(spark, sf):
    out = queries.op12_toxicity(spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) == 200 and all(0 <= r["score"] <= 1 for r in rows)
    assert out.filter(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 3 == 1)).count() == 0
