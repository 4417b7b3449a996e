"""Incremental job: candidates for place names in reports.

    python -m jobs.name_candidates --reports PATH --output DIR --checkpoint DIR [--config jobs/name_candidates.json]

A gazetteer grows by names that reports mention and that have no coordinates yet.
The job reads report files as they arrive, takes from each text the capitalised
words inside a sentence, and keeps

``<output>/mentions``     a row a mention, in a folder a language; appended
``<output>/candidates``   mentions, reports and sources by language and comparable name; made anew from the mentions

``PATH`` is a folder of Parquet files or a pattern of file names.  A file stream with a checkpoint takes only files that no earlier run took, all of
them, in steps of ``files`` files, and ends (availableNow).  The sink's log makes
every step count once, also after a run that was broken off; a run without new
files leaves the mentions as they are.  Names that the gazetteer spells alike count as
one (``functions.text.normalised_site``, asked once for each distinct name).

Reports without a text have no mentions; repeated reports are mentions of their own.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.text import normalised_site

log = logging.getLogger("name_candidates")

#: A capitalised word of four letters or more after a lower-case letter or comma and a space.
NAME = r"[\p{Ll},] (\p{Lu}\p{Ll}{3,})"
REPORT = "doc_id long, text string, lang string, source string"
MENTION = "doc_id long, source string, name string, lang string"


def mentions(reports: DataFrame) -> DataFrame:
    """A row for each mention; stateless."""
    names = F.regexp_extract_all("text", F.lit(NAME), F.lit(1))
    return reports.select("doc_id", "source", F.explode(names).alias("name"), "lang")


def candidates(found: DataFrame) -> DataFrame:
    """Names by language: their comparable form, first spelling, mentions and reports.

    Mentions are added up within a report first, so no group holds the rows of a frequent name.
    """
    keyed = found.withColumn("key", normalised_site(F.col("name")))
    by_report = keyed.groupBy("lang", "key", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))
    return by_report.groupBy("lang", "key").agg(F.min("name").alias("name"), F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("reports"))


def take_new(spark: SparkSession, reports: str, sink: str, checkpoint: str, files: int) -> int:
    """Append the mentions of report files that no earlier run took; how many reports were new."""
    arriving = spark.readStream.schema(REPORT).option("maxFilesPerTrigger", files).parquet(reports)
    stream = mentions(arriving).writeStream.format("parquet").partitionBy("lang").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
    finally:
        stream.stop()
    steps = [p for p in stream.recentProgress if p["numInputRows"]]
    for p in steps:
        log.info("step %d: read %d reports from %s", p["batchId"], p["numInputRows"], reports)
    return sum(p["numInputRows"] for p in steps)


def run(spark: SparkSession, reports: str, output: str, checkpoint: str, files: int = 1000) -> DataFrame:
    """Take the new report files of ``reports`` and write mentions and candidates below ``output``; all candidates as they stand afterwards."""
    sink, result = f"{output}/mentions", f"{output}/candidates"
    new = take_new(spark, reports, sink, checkpoint, files)
    table = candidates(spark.read.schema(MENTION).parquet(sink))
    table.select("key", "name", "mentions", "reports", "lang").write.mode("overwrite").partitionBy("lang").parquet(result)
    out = spark.read.schema("key string, name string, mentions long, reports long, lang string").parquet(result)
    log.info("read %d new reports from %s, written to %s: %d candidates", new, reports, result, out.count())
    return out


if __name__ == "__main__":
    from jobs.common import main

    main("name_candidates", run, ("reports", "output", "checkpoint"))
