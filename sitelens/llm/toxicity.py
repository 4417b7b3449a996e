"""Operator 12, toxicity: class-conditional Kneser-Ney models of word pairs.

Two bigram models, of toxic and of ordinary documents, are learned from labelled
rows.  A pair is counted once a document, an immediately repeated word is one
word.  Pairs back off to their class's continuation counts (after how many
different words a word was seen), those to the continuation counts of both
classes together: an expression that is rare in a class is smoothed by the shared
counts, and tells nothing.  What is rare follows the number of toxic documents:
the discount is the one of SHARES of them under which labelled documents that were not
counted are predicted best.

A text is scored in windows of WINDOW words: the difference of its two
log-likelihoods over a window, divided by the window's length.  The score is a
logistic function of the greatest window, at least 0, fitted on labelled documents
that were not counted, so a toxic passage of a long ordinary text counts, and 0.7
means that seven of ten such documents are labelled toxic.

The sample that is learned from is bounded: the labelled documents of the SAMPLE_DOCS
smallest hashes of doc_id, each whole.  Of the counts only what exceeds a discount
can differ between the classes by more than a factor that is known per context, so
only that leaves the cluster: at most the pairs in over a thousandth of the
sample's documents.  Scoring is a map over whole texts.

Defined results: null and empty texts, and texts without a letter, have a window of 0, like
any ordinary text; repeated rows are each scored; several texts of one doc_id are
learned from as the smallest one, contradictory labels as toxic, rows with null
doc_id or null label not at all; without documents of both classes every score is the
toxic share of those that there are, or 0.  Extra columns pass through, those named
like a computed one are replaced.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .common import materialise, remove_table

#: Bound of the training sample: labelled documents.
SAMPLE_DOCS = 20_000
#: Discounts that are tried, as shares of the toxic documents that were counted; no less than LEAST of all of them, and than LOWEST.
SHARES = (1 / 40, 1 / 20, 1 / 10)
LEAST = 1 / 1000
LOWEST = 0.75
#: Discount of the continuation counts of both classes.
SHARED = 0.75
WINDOW = 4
#: One labelled document in PARTS calibrates, the others are counted.
PARTS = 4
#: Scores of at least this are predicted toxic.
THRESHOLD = 0.7

_WORDS = re.compile(r"[^\W\d_]+")
#: Context of the first word; no word.
START = ""


def words(text: str | None) -> list[str]:
    """Lower-case letter sequences, immediate repetitions once."""
    return [w for w, _ in itertools.groupby(_WORDS.findall((text or "").lower()))]


_PAIRS = ArrayType(StructType([StructField("v", StringType()), StructField("w", StringType())]))
#: Texts whose pairs are in memory at a time.
SLICE = 64


def _pair_lists(texts: pa.Array) -> pa.Array:
    ends, before, after = [0], [], []
    for text in texts:
        found = words(text.as_py())
        for v, w in sorted(set(zip([START, *found], found))):
            before.append(v)
            after.append(w)
        ends.append(len(before))
    both = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], names=["v", "w"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both)


@F.arrow_udf(_PAIRS)
def _pairs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.concat_arrays([_pair_lists(texts.slice(at, SLICE)) for at in range(0, max(len(texts), 1), SLICE)])


def training_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, text, toxic, calibrates) of the ``most`` labelled documents with the smallest hashes of doc_id; one row each.

    The draw is made on the labels alone, so ``docs`` meets a side of at most ``most`` rows.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    each = usable.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    drawn = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id")
    one = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return one.withColumn("calibrates", F.pmod(F.xxhash64(F.lit("calibrates"), "doc_id"), F.lit(PARTS)) == 0)


class Model:
    """Log ratios of the two classes, for what exceeds the discounts; everything else has a default.

    The ratio of a pair (v, w) is ``pairs[v, w]`` where the pair itself exceeds a
    discount, else ``contexts[v]`` (0 by default) plus ``single[w]`` (``rare`` by default).
    """

    def __init__(self, pairs: dict[tuple[str, str], float], contexts: dict[str, float], single: dict[str, float], rare: float):
        self.rare, self.a, self.b = rare, 0.0, 0.0
        known = sorted({*contexts, *single, *itertools.chain.from_iterable(pairs)} - {START})
        self.number = {w: k for k, w in enumerate(known, 2)} | {START: 1}  # 0: any other word
        self.single = np.full(len(known) + 2, rare)
        self.contexts = np.zeros(len(known) + 2)
        for w, x in single.items():
            self.single[self.number[w]] = x
        for v, x in contexts.items():
            self.contexts[self.number[v]] = x
        keys = np.array([self._key(self.number[v], self.number[w]) for v, w in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.pairs = np.r_[keys[order], np.iinfo(np.int64).max], np.r_[np.array(list(pairs.values()), float)[order], 0.0]

    @staticmethod
    def _key(v, w):
        return v << 32 | w

    def strongest(self, text: str | None) -> float:
        """The greatest mean log ratio of a window (of all words, where there are fewer), at least 0."""
        found = words(text)
        if not found:
            return 0.0
        number = self.number
        ids = np.fromiter((number.get(w, 0) for w in found), np.int64, len(found))
        before = np.r_[1, ids[:-1]]
        ratio = self.contexts[before] + self.single[ids]
        keys = self._key(before, ids)
        at = np.searchsorted(self.keys, keys)
        ratio = np.where(self.keys[at] == keys, self.pairs[at], ratio)
        size = min(WINDOW, len(ratio))
        return max(0.0, float(sum(ratio[k : len(ratio) - size + 1 + k] for k in range(size)).max()) / size)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a + self.b * self.strongest(text), -500, 500))))


class Constant:
    """The score where a class cannot be learned."""

    def __init__(self, share: float):
        self.share = share

    def score(self, text: str | None) -> float:
        return self.share


def counted(sample: DataFrame) -> DataFrame:
    """(v, w, toxic, ordinary): in how many documents of each class a pair of words is."""
    rows = sample.select("toxic", F.explode(_pairs(F.col("text"))).alias("p"))
    toxic, ordinary = F.sum(F.col("toxic").cast("int")), F.sum((~F.col("toxic")).cast("int"))
    return rows.groupBy("p.v", "p.w").agg(toxic.alias("toxic"), ordinary.alias("ordinary"))


def discounts(n_toxic: int, n: int) -> list[float]:
    return [max(LOWEST, share * n_toxic, LEAST * n) for share in SHARES]


def learn(pairs: DataFrame, tried: list[float]) -> list[Model]:
    """A model for each discount, from counted pairs: three aggregates in Spark, then what exceeds the discounts."""
    both = ("toxic", "ordinary")

    def kept(c: str, k: int) -> Column:
        return F.sum(F.least(F.col(c), F.lit(tried[k])))

    every = range(len(tried))
    over = F.greatest(*both) > tried[0]
    # continuation counts of a word, and what each discount takes of them
    single = pairs.groupBy("w").agg(*(F.sum((F.col(c) > 0).cast("int")).alias(c) for c in both), F.count(F.lit(1)).alias("shared"), F.sum(over.cast("int")).alias("over"))
    sums = [F.sum(c).alias(c) for c in (*both, "shared")]
    lost = [kept(c, k).alias(f"{c}{k}") for c in both for k in every]
    totals = single.agg(*sums, *lost, F.sum(F.least("shared", F.lit(SHARED))).alias("shared_lost"), F.count(F.lit(1)).alias("n_words")).first()
    contexts = {r["v"]: r for r in pairs.groupBy("v").agg(*(F.sum(c).alias(c) for c in both), *lost, F.max(over).alias("over")).filter("over").collect()}
    singles = {r["w"]: r for r in single.filter((F.greatest(*both) > tried[0]) | (F.col("over") > 0)).collect()}
    listed = pairs.filter(over).collect()
    n_words = totals["n_words"] + 1

    models = []
    for k, d in enumerate(tried):

        def p_single(c: str, w: str, d=d, k=k) -> float:
            row = singles[w]
            shared = (max(row["shared"] - SHARED, 0) + totals["shared_lost"] / n_words) / totals["shared"]
            return (max(row[c] - d, 0) + totals[f"{c}{k}"] * shared) / totals[c]

        def back_off(c: str, v: str, k=k) -> float:
            return contexts[v][f"{c}{k}"] / contexts[v][c] if contexts[v][c] else 1.0

        def p_pair(c: str, r, d=d) -> float:
            seen = max(r[c] - d, 0) / contexts[r["v"]][c] if contexts[r["v"]][c] else 0.0
            return seen + back_off(c, r["v"]) * p_single(c, r["w"])

        rare = np.log(totals[f"toxic{k}"] / totals["toxic"]) - np.log(totals[f"ordinary{k}"] / totals["ordinary"])
        models.append(
            Model(
                {(r["v"], r["w"]): float(np.log(p_pair("toxic", r) / p_pair("ordinary", r))) for r in listed if max(r["toxic"], r["ordinary"]) > d},
                {v: float(np.log(back_off("toxic", v) / back_off("ordinary", v))) for v in contexts},
                {w: float(np.log(p_single("toxic", w) / p_single("ordinary", w))) for w, r in singles.items() if max(r["toxic"], r["ordinary"]) > d},
                float(rare),
            )
        )
    return models


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float, float]:
    """(a, b, mean log loss) of P(y) = logistic(a + b x), b >= 0, by damped Newton steps on the slightly penalised likelihood."""
    design, beta = np.c_[np.ones(len(x)), x], np.zeros(2)

    def loss(beta: np.ndarray) -> float:
        z = design @ beta
        return float(np.sum(np.logaddexp(0, z) - y * z) + ridge * beta @ beta / 2)

    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        slope = design.T @ (p - y) + ridge * beta
        if np.abs(slope).max() < 1e-9 * max(1, len(x)):
            break
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), slope)
        size = 1.0
        while size > 1e-8 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
    if beta[1] < 0:
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        return float(np.log(share / (1 - share))), 0.0, float(-(y * np.log(share) + (1 - y) * np.log(1 - share)).mean())
    return float(beta[0]), float(beta[1]), loss(beta) / len(x)


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | Constant:
    """The model whose discount predicts the calibrating documents best (ties: the greatest discount), calibrated on them.

    Where a class has no document in one of the two parts, all documents serve both.
    """
    sample = materialise(training_sample(docs, labels, sample_docs), "toxicity")
    sizes = {(r["toxic"], r["calibrates"]): r["n"] for r in sample.groupBy("toxic", "calibrates").agg(F.count(F.lit(1)).alias("n")).collect()}
    ordinary, toxic = (sum(n for (c, _), n in sizes.items() if c is wanted) for wanted in (False, True))
    if not (ordinary and toxic):
        remove_table(sample)
        return Constant(toxic / (ordinary + toxic) if ordinary + toxic else 0.0)
    counting, calibrating = sample, sample
    if len(sizes) == 4:
        counting, calibrating = sample.filter(~F.col("calibrates")), sample.filter("calibrates")
        ordinary, toxic = sizes[False, False], sizes[True, False]
    pairs = materialise(counted(counting), "toxicity-pairs")
    models = learn(pairs, discounts(toxic, ordinary + toxic))
    rows = calibrating.select("toxic", _strongest(models, F.col("text")).alias("x")).collect()
    remove_table(pairs)
    remove_table(sample)
    y, x = np.array([r["toxic"] for r in rows], float), np.array([r["x"] for r in rows], float)
    a, b, _, k = min(((*fit_logistic(x[:, k], y), k) for k in reversed(range(len(models)))), key=lambda f: f[2])
    models[k].a, models[k].b = a, b
    return models[k]


def _strongest(models: list[Model], text: Column) -> Column:
    @F.arrow_udf(ArrayType(DoubleType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([[m.strongest(t.as_py()) for m in models] for t in texts], pa.list_(pa.float64()))

    return run(text)


def scored(model: Model | Constant, text: Column) -> Column:
    """The score of a text column."""

    @F.arrow_udf(DoubleType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return run(text)


def held_out(fold_no: int = 1, folds: int = 3) -> Column:
    """Rows whose crc32(doc_id as text) mod ``folds`` is ``fold_no`` (false for a null id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold_no, F.lit(False))


def score_documents(docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 where the score is at least THRESHOLD)."""
    model = train(train_docs, labels)
    out = docs.withColumn("score", scored(model, F.col("text")))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
