"""Operator 3, language identification by compression with per-language dictionaries.

A language is PARTS raw-content zstandard dictionaries, to which the sampled
training documents are dealt whole.  A text is folded to lower-case letters and
single spaces and compressed, block by block over its whole length, with the
first dictionary of each language; the language that gives the fewest bytes wins.
Where the lead is short (short texts, mostly) all dictionaries and a deeper search
decide.  Equal sizes go to the language with more training documents, then to the
first by name.

The training sample is bounded: at most SAMPLE_DOCS documents of a language,
drawn by hash, each whole, and at most SAMPLE_BYTES of them; a document that
would pass that is left out whole (the first one drawn never is).

Defined results: null texts and texts without a letter are ``und`` with score 0
and are not accepted; with nothing to learn from every text is ``und``; a single
language has no second to lead and is accepted; repeated rows are each classified
and are one document in the sample; rows with null lang are never learned from; over MAX_LANGS languages
are an error.  Extra columns pass through, those named like a computed one are
replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

UND = "und"
#: Bound of the training sample: documents of a language, and bytes of their folded texts.
SAMPLE_DOCS = 64
SAMPLE_BYTES = 1 << 18
#: Languages that can be learned.
MAX_LANGS = 500
#: Dictionaries of a language.
PARTS = 4
BLOCK = 1024
LEVEL = 6
DEEP_LEVEL = 12
#: With a lead under so many bytes all dictionaries are asked.
NARROW = 12
#: Sharpness of the score, in bits per byte of lead.
SHARPNESS = 0.8
#: Margins whose score is lower are rejected.
MIN_SCORE = 0.4
#: So are those whose best language, against the second alone, scores lower (a tie: 0.5).
MIN_LEAD = 0.6

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Lower-case letters, anything between them one space (empty without a letter)."""
    folded = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return f" {folded} " if any(map(str.isalpha, folded)) else ""


def training_sample(train: DataFrame, docs: int = SAMPLE_DOCS) -> dict[str, tuple[int, list[str]]]:
    """Per language: its number of training documents and at most ``docs`` distinct ones, whole, by a hash of doc_id and text.

    Equal rows have one place, wherever they count.  Counts are one aggregate over
    places.  A threshold leaves about 3 x ``docs`` places of each language, whatever
    the size of the corpus and however often a row is repeated; the smallest ones
    are ranked in Spark, and only those rows reach the driver.
    """
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62))
    rows = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", place.alias("place"))
    each = rows.groupBy("lang", "place").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["lang"]: (r["n"], r["places"]) for r in each.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("places")).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages to learn")
    if not sizes:
        return {}
    bound = F.lit(0).cast("long")
    for lang, (_, places) in sorted(sizes.items()):
        # a language of few places is drawn whole: no threshold can miss it
        share = 1 << 62 if places <= 16 * docs else math.ceil((1 << 62) * 3 * docs / places)
        bound = F.when(F.col("lang") == lang, F.lit(share)).otherwise(bound)
    drawn = rows.filter(F.col("place") < bound).groupBy("lang", "place").agg(F.min("text").alias("text"))
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).filter(F.col("rank") <= docs)
    out: dict[str, tuple[int, list[str]]] = {lang: (n, []) for lang, (n, _) in sizes.items()}
    for r in ranked.orderBy("lang", "rank").collect():
        out[r["lang"]][1].append(r["text"])
    return out


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    own = {"write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
    how = zstandard.ZstdCompressionParameters.from_level(level, source_size=BLOCK, dict_size=len(dictionary), min_match=3, **own)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)


class Classifier:
    """The learned dictionaries; picklable, compressors are built where it is used."""

    def __init__(self, sample: dict[str, tuple[int, list[str]]]):
        self.langs = sorted(sample, key=lambda x: (-sample[x][0], x))
        self.parts = [self._deal(sample[x][1]) for x in self.langs]
        self._ready = None

    @staticmethod
    def _deal(texts: list[str]) -> list[bytes]:
        """Whole documents, in turn, to at most PARTS dictionaries."""
        taken, size = [], 0
        for data in filter(None, (fold(t).encode() for t in texts)):
            if not taken or size + len(data) <= SAMPLE_BYTES:
                taken.append(data)
                size += len(data)
        return [b"".join(taken[k::PARTS]) for k in range(min(PARTS, len(taken)))] or [b" "]

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _compressors(self):
        if self._ready is None:
            # languages with fewer dictionaries repeat them, so that sums compare
            self._ready = [(_compressor(p[0], LEVEL), [_compressor(p[k % len(p)], DEEP_LEVEL) for k in range(PARTS)]) for p in self.parts]
        return self._ready

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """The language, its score among all and its score against the second alone."""
        folded = fold(text) if text else ""
        if not folded or not self.langs:
            return UND, 0.0, 0.0
        data = folded.encode()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        own = self._compressors()
        sizes = [sum(len(fast.compress(b)) for b in blocks) for fast, _ in own]
        ranked = sorted(sizes)
        scale = 1.0
        if len(sizes) > 1 and ranked[1] - ranked[0] < NARROW:
            sizes = [sum(len(c.compress(b)) for c in deep for b in blocks) for _, deep in own]
            scale = 1 / PARTS
        best = min(sizes)
        shares = sorted((2.0 ** (-SHARPNESS * scale * (s - best)) for s in sizes), reverse=True)
        return self.langs[sizes.index(best)], 1 / sum(shares), 1 / sum(shares[:2])


_RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("lead", DoubleType())])


def predict(model: Classifier, text: Column) -> Column:
    """(lang_pred, score, lead) of a text column."""

    @F.arrow_udf(_RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [model.predict(t) for t in texts.to_pylist()]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.StructArray.from_arrays(columns, names=["lang_pred", "score", "lead"])

    return run(text)


def held_out(fold_no: int = 2, folds: int = 4) -> Column:
    """Rows whose crc32(doc_id as text) mod ``folds`` is ``fold_no`` (false for a null id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold_no, F.lit(False))


def identify(docs: DataFrame, train: DataFrame) -> DataFrame:
    """``docs`` with lang_pred, score and accepted (a language was found, and its margins over all others and over the second are not narrow)."""
    model = Classifier(training_sample(train))
    found = next(n for k in range(len(docs.columns) + 1) if (n := f"_found{k}") not in docs.columns)
    out = docs.withColumn(found, predict(model, F.col("text")))
    lang, score = F.col(f"{found}.lang_pred"), F.col(f"{found}.score")
    clear = (lang != UND) & (score >= MIN_SCORE) & (F.col(f"{found}.lead") >= MIN_LEAD)
    return out.withColumns({"lang_pred": lang, "score": score, "accepted": clear}).drop(found)
