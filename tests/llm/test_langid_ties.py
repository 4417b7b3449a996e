"""Texts tied between two languages are rejected, however many are learned."""

import random

import pytest
from pyspark.sql import functions as F

from sitelens.llm import langid


def _words(seed, letters):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(300)]


_WORDS = {"aa": _words(1, "abcdefg"), "bb": _words(2, "hijklmn"), "cc": _words(3, "opqrstu")}


def _text(lang, seed, n=60):
    return " ".join(random.Random(seed).choices(_WORDS[lang], k=n))


@pytest.mark.parametrize("langs", [["aa", "bb"], ["aa", "bb", "cc"]])
def test_two_language_tie_is_rejected(spark, langs):
    train = spark.createDataFrame([(100 * k + i, x, _text(x, i)) for k, x in enumerate(langs) for i in range(40)], "doc_id long, lang string, text string")
    model = langid.Classifier(langid.training_sample(train))
    # letters that no language was learned from, and a text cut where both of two languages lead by nothing
    rows = [(0, "xyz zyx"), (1, _text("aa", 900)), (2, _text("bb", 901)), (3, _text("aa", 5, 1))]
    mixed = [" ".join([_text("aa", s, n), _text("bb", s, 40 - n)]) for s in range(60) for n in range(15, 26)]
    tied = [t for t in mixed if model.predict(t)[2] < 0.51]
    assert tied and all(model.predict(t)[1] >= langid.MIN_SCORE for t in tied)
    rows += [(10 + i, t) for i, t in enumerate(tied)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), train).collect()}
    assert not any(got[10 + i]["accepted"] for i in range(len(tied))) and not got[0]["accepted"]
    assert got[1]["accepted"] and got[1]["lang_pred"] == "aa" and got[2]["accepted"] and got[2]["lang_pred"] == "bb"


def test_one_language_and_columns(spark):
    train = spark.createDataFrame([(i, "aa", _text("aa", i)) for i in range(20)], "doc_id long, lang string, text string")
    out = langid.identify(train.withColumn("lead", F.lit("own")), train)
    assert out.columns == ["doc_id", "lang", "text", "lead", "lang_pred", "score", "accepted"]
    assert all(r["accepted"] and r["lead"] == "own" for r in out.collect())
