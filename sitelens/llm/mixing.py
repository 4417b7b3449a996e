"""Operator 5, mixing sources to target weights by Poisson replication (DataFrame functions).

A source's mean repetition rate is its target share of the output divided by
its size.  Each document gets a uniform number from a hash of the seed and its
doc_id, which is put through the inverse Poisson distribution of its source's
rate; it is exploded by that count and all copies are dealt to partitions, and
sorted there, by a second hash.  Nothing depends on row order or partitioning,
so a lost task redoes the same rows.

Defined results: a null source is a source of its own; null texts have size 0;
a source of size 0 or weight 0 gives no copies; a null doc_id is hashed as an
empty string; repeated rows get equal counts; empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions_for

SEED = 2024
#: Default target: shares proportional to size ** POWER (1: as found, 0: all alike).
POWER = 0.5
#: Up to so many sources the table of rates is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def uniform(*parts: Column, seed: int = SEED) -> Column:
    """52 bits of an MD5 over the seed and ``parts``, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 13), 16, 10).cast("long")


def poisson_steps(rate: Column) -> Column:
    """Cumulative probabilities of a Poisson distribution, far enough that what is left is below 1e-16."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    first = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("steps"))

    def add(s: Column, k: Column) -> Column:
        log_p = s["log_p"] + F.log(rate) - F.log(k)
        c = s["c"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), c.alias("c"), F.concat(s["steps"], F.array(c)).alias("steps"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), first, add, lambda s: s["steps"])).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, power: float = POWER) -> DataFrame:
    """(source, size, rate): code points of each source and its mean repetition rate.

    ``weights`` maps sources to target shares of ``total`` code points (default:
    as many as come in); without it shares follow size ** power.
    """
    # written, a row for each source: texts are read once for it
    sizes = materialise(docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("size")), "sizes")
    if weights is None:
        wish = F.pow(F.col("size").cast("double"), F.lit(float(power)))
    else:
        wish = F.lit(0.0)
        for source, w in weights.items():
            wish = F.when(F.col("source").eqNullSafe(source), F.lit(float(w))).otherwise(wish)
    sized = sizes.withColumn("wish", F.when(F.col("size") > 0, wish).otherwise(0.0))
    sums = sized.agg(F.sum("wish").alias("wishes"), F.sum("size").alias("total")).withColumn("total", F.coalesce(F.lit(total), F.col("total")))
    got = sums.first()
    rate = F.when((F.col("size") > 0) & F.lit(bool(got["wishes"])), F.col("wish") / F.lit(got["wishes"] or 1.0) * F.lit(float(got["total"] or 0)) / F.col("size")).otherwise(0.0)
    return sized.select("source", "size", rate.alias("rate"))


def mix_rows(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, power: float = POWER, seed: int = SEED) -> DataFrame:
    """(document, rate, n_copies, copy_no, place): copies of documents, each a struct of all its columns, in a random global order.

    ``place`` orders the copies of one partition; partitions are dealt by its hash.
    """
    rates = source_rates(docs, weights, total, power).select("source", "rate", poisson_steps(F.col("rate")).alias("steps"))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    whole = docs.select(F.struct(*docs.columns).alias("document"))
    joined = whole.join(rates, F.col("document.source").eqNullSafe(F.col("source")), "left")
    drawn = joined.withColumn("u", uniform(F.col("document.doc_id"), seed=seed) / F.lit(float(16**13))).filter(F.get("steps", F.lit(0)) <= F.col("u"))
    counted = drawn.withColumn("n_copies", F.size(F.filter("steps", lambda c: c <= F.col("u"))))
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    placed = copies.select("document", "rate", "n_copies", "copy_no", uniform(F.col("document.doc_id"), F.col("copy_no"), seed=seed + 1).alias("place"))
    return placed.repartition(partitions_for(docs.sparkSession), "place").sortWithinPartitions("place", F.col("document.doc_id"), "copy_no")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``mix_rows`` with the documents' columns spread out; a column named like a computed one is replaced."""
    computed = ("rate", "n_copies", "copy_no", "place")
    kept = [c for c in docs.columns if c.lower() not in computed]
    return mix_rows(docs, **options).select(*(F.col("document")[c].alias(c) for c in kept), *computed)


#: The same in DuckDB's SQL, for the query with default parameters.
MIX_SQL = f"""
WITH sized AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS size FROM documents GROUP BY source
), wished AS (
  SELECT source, size, CASE WHEN size > 0 THEN power(CAST(size AS DOUBLE), {POWER}) ELSE 0 END AS wish FROM sized
), rated AS (
  SELECT source, CASE WHEN size > 0 THEN wish / (SELECT sum(wish) FROM wished) * CAST((SELECT sum(size) FROM wished) AS DOUBLE) / size ELSE 0 END AS rate FROM wished
), drawn AS (
  SELECT d.doc_id, d.source, d.text, r.rate,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / CAST({16**13} AS DOUBLE) AS u
  FROM documents d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
), steps AS (
  SELECT s.source, k.k, sum(exp(-s.rate + k.k * ln(s.rate) - lgamma(k.k + 1))) OVER (PARTITION BY s.source ORDER BY k.k) AS c
  FROM rated s, unnest(range(0, CAST(ceil(s.rate + 12 * sqrt(s.rate) + 20) AS BIGINT) + 1)) AS k(k) WHERE s.rate > 0
), counted AS (
  SELECT d.doc_id, d.source, d.text, d.u, count(s.c) AS n_copies
  FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.c <= d.u GROUP BY ALL
)
SELECT doc_id, source, text, CAST(n_copies AS INTEGER) AS n_copies, CAST(i.i AS INTEGER) AS copy_no,
       CAST('0x' || substr(md5('{SEED + 1}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(i.i AS VARCHAR)), 1, 13) AS BIGINT) AS place
FROM counted, unnest(range(1, n_copies + 1)) AS i(i)
"""
