"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet to the shared folder and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import bpe, langid, mixing, neardup, quality
from sitelens.llm.common import packed, remove, shared_dir, table, write_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go, repeated rows are each judged."""
    return quality.quality_rules(packed(docs, "doc_id", "text"), table(spark, sf_dir, "labels")).filter("kept").select("document.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with a clear margin; texts without a letter go, repeated rows are each judged."""
    return langid.identify(packed(docs, "text"), docs.filter(~langid.held_out())).filter("accepted").select("document.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the smallest doc_id: SimHash fingerprints of 5-word shingles compared in bit planes, pairs verified at a Jaccard similarity of 0.8 or more.

    Rows without a doc_id stay; of repeated rows of a doc_id one stays; null texts and texts without words are alike.
    """
    return neardup.keep_first(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target source shares, in random order; texts of size 0 go, repeated rows get equal counts."""
    return mixing.mix_rows(docs).select("document.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the digests of a decoded round trip, per copy of a document; null and empty texts have no ids."""
    out = docs.select("doc_id", "source", "lang", bpe.round_trip(F.col("text")).alias("d"))
    return out.select("doc_id", "source", "lang", "d.ids", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


STAGES = [
    ("quality rules", quality_stage),
    ("language id", language_stage),
    ("simhash near-dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

#: No SQL can express the compression and encoding stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_dir(spark, name.replace(" ", "-"))
        write_table(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
