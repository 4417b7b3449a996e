"""Operator 8, quality rules: hashed n-gram log-likelihood ratio (DataFrame functions only).

Two multinomials over hashed n-gram buckets are counted over whole texts: one
from trusted documents (labelled good and not toxic), one from the raw corpus.
A document's verdict is its summed log-likelihood ratio divided by its number of
n-grams, compared with one fixed threshold.  Surface rules (too few words, too
many repeated word windows) are computed beside it.

Defined results: null text has no words, fails the surface rules and is not
kept; repeated rows are each scored; with no trusted document at all both
multinomials are flat, every ratio is 0 and only the surface rules decide.
Extra columns pass through; those named like a computed column are replaced, and
names that begin with an underscore are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS

#: Buckets of the hashed n-gram space; also the bound of the weight vector.
BUCKETS = 1 << 16
#: At most so many trusted documents fit the target multinomial (8 bytes each are broadcast).
TRUSTED_MAX = 20_000
#: Add-alpha smoothing of both multinomials.
ALPHA = 0.5
#: Kept from this length-normalised ratio on.
THRESHOLD = -0.6
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Fixed by the contract.
SYMBOLS = "[#*$%&|<>]"
#: A character of a word, and one that is none.
WORD_CLASS, SPACE_ONE = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"

#: Runs of letters or digits, and runs of anything else that is not white space.
PIECE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def _repeat_words(hashes: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more.

    Windows are sorted by (hash, place); equal neighbours are repeats.  Their
    places, in order, cover min(5, gap to the next) words each, the last one 5.
    """
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, x, i, step: F.coalesce(F.get(s, i + step)["h"] == x["h"], F.lit(False))
    repeats = F.transform(F.array(ranked), lambda s: F.filter(s, lambda x, i: ((i > 0) & same(s, x, F.greatest(i, F.lit(1)), -1)) | same(s, x, i, 1)))
    places = F.transform(repeats, lambda s: F.sort_array(F.transform(s, lambda x: x["i"])))
    widths = F.transform(places, lambda s: F.transform(s, lambda p, i: F.least(F.coalesce(F.get(s, i + 1) - p, F.lit(5)), F.lit(5))))
    return F.aggregate(F.flatten(widths), F.lit(0).cast("long"), lambda a, w: a + w)


def surface_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", F.filter(F.split(t, SPACE_CLASS), lambda w: w != ""))
    # words are hashed once; a window's hash is that of five word hashes
    out = out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    window = F.transform(
        F.slice(F.col("_hashes"), 1, F.greatest(F.size("_hashes") - 4, F.lit(0))),
        lambda w, i: F.xxhash64(w, *(F.get(F.col("_hashes"), i + k) for k in range(1, 5))),
    )
    out = out.withColumn("_windows", window).withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CLASS)))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": (F.length(t) - F.regexp_count(t, F.lit(SPACE_ONE))).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), _repeat_words(F.col("_windows"))).otherwise(F.lit(0).cast("long")),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_words", "_hashes", "_windows", "_lines")


def _bucket(buckets: int, *parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the unigrams and bigrams of a text's pieces (the last piece's bigram is its unigram)."""
    bucket = lambda *parts: _bucket(buckets, *parts)
    pieces = F.array(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), 0))
    return F.flatten(F.transform(pieces, lambda p: F.concat(F.transform(p, lambda x: bucket(x)), F.transform(p, lambda x, i: bucket(x, F.get(p, i + 1))))))


def trusted_ids(labels: DataFrame, most: int = TRUSTED_MAX) -> DataFrame:
    """At most ``most`` doc_ids labelled good and not toxic, the same ones on every run."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, alpha: float = ALPHA) -> DataFrame:
    """One row, column ``weights``: log p_target - log p_raw of each bucket.

    Counts cover all texts.  ``trusted`` is broadcast: it has TRUSTED_MAX rows at most.
    Partial counts are made before the shuffle, which carries ``buckets`` rows a task at most.
    """
    known = F.broadcast(trusted.select(F.col("doc_id").alias("_trusted")))
    hit = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_trusted"), "left")
    # pieces beside the piece after each, as rows: unlike array functions these run in generated code
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(PIECE), 0)
    hit = hit.select(F.col("_trusted").isNotNull().cast("long").alias("t"), pieces.alias("p"))
    pairs = hit.select("t", F.explode(F.arrays_zip(F.col("p").alias("x"), F.slice("p", F.lit(2), F.size("p")).alias("y"))).alias("g"))
    hit = pairs.select("t", F.explode(F.array(_bucket(buckets, F.col("g.x")), _bucket(buckets, F.col("g.x"), F.col("g.y")))).alias("b"))
    counts = hit.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    cells = docs.sparkSession.range(buckets, numPartitions=1).select(F.col("id").cast("int").alias("b")).join(F.broadcast(counts), "b", "left").na.fill(0, ["raw", "target"])
    rows = cells.agg(F.sort_array(F.collect_list(F.struct("b", "raw", "target"))).alias("c"), F.sum("raw").alias("nr"), F.sum("target").alias("nt"))
    log_p = lambda n, total: F.log((n + F.lit(alpha)) / (total + F.lit(alpha * buckets)))
    ratio = F.transform("c", lambda x: log_p(x["target"], F.col("nt")) - log_p(x["raw"], F.col("nr")))
    flat = F.transform("c", lambda x: F.lit(0.0))
    return rows.select(F.when(F.col("nt") > 0, ratio).otherwise(flat).alias("weights"))


def score(docs: DataFrame, weights: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``llr``: the length-normalised log-likelihood ratio (null without n-grams)."""
    # The one-row weights enter as a scalar subquery, which the optimiser inlines below.
    out = docs.withColumn("_b", ngram_buckets(F.col("text"), buckets)).withColumn("_w", weights.scalar())
    total = F.get(F.transform(F.array("_w"), lambda w: F.aggregate(F.col("_b"), F.lit(0.0), lambda a, b: a + F.get(w, b))), F.lit(0))
    return out.withColumn("llr", F.when(F.size("_b") > 0, total / F.size("_b"))).drop("_b", "_w")


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_on: DataFrame | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with the surface counts, ``llr``, ``base_failed`` and ``kept``."""
    weights = bucket_weights(docs if fit_on is None else fit_on, trusted_ids(labels))
    out = surface_rules(score(docs, weights))
    verdict = ~F.col("base_failed") & (F.coalesce(F.col("llr"), F.lit(float("-inf"))) >= threshold)
    # The row number makes this projection a barrier: a filter on ``kept`` would otherwise be
    # pushed below it and repeat the nested array expressions for every element.
    return out.withColumn("kept", F.when(F.monotonically_increasing_id() >= 0, verdict))
