"""Language identification against a slow reference; whole documents in the sample; ties and very long texts."""

import random
import re

import pytest
import zstandard
from pyspark.sql import functions as F

from sitelens.llm import langid

LETTERS = {"aa": "abcdefg", "bb": "efghijk", "cc": "opqrstu", "dd": "opqrstv"}


def _text(lang, seed, n=40):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))


def _fold(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    return f" {' '.join(words)} ".encode() if words else b""


def _size(data, dictionary, level):
    p = zstandard.ZstdCompressionParameters.from_level(level, source_size=1024, dict_size=len(dictionary), min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)
    total = 0
    for at in range(0, len(data), 1024):
        fresh = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p)
        total += len(fresh.compress(data[at : at + 1024]))
    return total


def _slow(sample, text):
    """(language, bytes of the best two) by compressing with each dictionary."""
    data = _fold(text)
    if not data:
        return "und"
    by_name = sorted(sample, key=lambda x: (-sample[x][0], x))
    parts = {x: [b"".join(map(_fold, sample[x][1][k :: langid.PARTS])) for k in range(langid.PARTS)] for x in by_name}
    sizes = [_size(data, parts[x][0], langid.LEVEL) for x in by_name]
    if sorted(sizes)[1] - min(sizes) < langid.NARROW:
        sizes = [sum(_size(data, p, langid.DEEP_LEVEL) for p in parts[x]) for x in by_name]
    return by_name[sizes.index(min(sizes))]


@pytest.fixture(scope="module")
def train(spark):
    rows = [(1000 * k + i, x, _text(x, i)) for k, x in enumerate(LETTERS) for i in range(30 + 5 * (x == "bb"))]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def test_predictions_against_the_slow_reference(spark, train):
    sample = langid.training_sample(train)
    texts = [None, "", "12 + 3", "xyz", "e", "ef", "op", "o", "Ä ö", *(_text(x, s, n) for x in LETTERS for s in (900, 901) for n in (1, 2, 5, 40)), _text("aa", 7, 9000), "EFGH " + _text("aa", 3, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, train).collect()}
    assert got == {i: _slow(sample, t) for i, t in enumerate(texts)}


def test_ties_go_to_more_documents_then_names():
    same = ["one text of letters"] * 2
    for sample, best in (({"b": (5, same), "a": (5, same)}, "a"), ({"b": (6, same), "a": (5, same)}, "b")):
        lang, score, lead = langid.Classifier(sample).predict("some letters")
        assert lang == best and score == lead == 0.5


def test_sampled_documents_are_whole(spark, train):
    long = "abcd efgh " * 4000 + "zebra"
    extra = spark.createDataFrame([(9000, "aa", long), (9000, "aa", long)], "doc_id long, lang string, text string")
    sample = langid.training_sample(train.union(extra), docs=1000)
    assert sorted(sample["aa"][1]) == sorted([long, *(_text("aa", i) for i in range(30))]) and sample["aa"][0] == 32
    model = langid.Classifier(sample)
    own = model.parts[model.langs.index("aa")]
    assert sum(map(len, own)) == sum(len(_fold(t)) for t in sample["aa"][1])
    assert any(b"zebra" in p for p in own)
    drawn = langid.training_sample(train, docs=5)
    assert all(len(t) == 5 and n >= 30 for n, t in drawn.values())


def test_sample_bound_leaves_out_whole_documents(monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 30)
    assert langid.Classifier._deal(["a" * 40, "b" * 10]) == [b" " + b"a" * 40 + b" "]
    assert langid.Classifier._deal(["a" * 20, "b" * 10, "c" * 5]) == [b" " + b"a" * 20 + b" ", b" ccccc "]


def test_too_many_languages(spark, train, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 3)
    with pytest.raises(ValueError, match="languages"):
        langid.training_sample(train)


def test_clashing_columns(spark, train):
    docs = train.limit(3).withColumn("_found0", F.lit("mine")).withColumn("score", F.lit("gone"))
    out = langid.identify(docs, train)
    assert set(out.columns) == {"doc_id", "lang", "text", "_found0", "score", "lang_pred", "accepted"}
    assert {r["_found0"] for r in out.collect()} == {"mine"}


def test_a_language_of_repeated_rows_is_learned(spark):
    spanish, english = "el perro come y la casa es grande", "the dog eats and the house is large"
    same = [(1, "es", spanish)] * 3000
    many = [(10 + i, "es", spanish) for i in range(3000)]
    other = [(10_000 + i, "en", f"{english} {'abcdefghij'[i % 10] * (1 + i // 10)}") for i in range(300)]
    for rows, distinct in ((same, 1), (many, langid.SAMPLE_DOCS)):
        train = spark.createDataFrame(rows + other, "doc_id long, lang string, text string")
        sample = langid.training_sample(train)
        assert {k: (n, len(t)) for k, (n, t) in sample.items()} == {"es": (3000, distinct), "en": (300, langid.SAMPLE_DOCS)}
        model = langid.Classifier(sample)
        assert model.predict("la casa es grande")[0] == "es" and model.predict("the house is large")[0] == "en"
