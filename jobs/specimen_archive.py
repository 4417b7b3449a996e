"""Batch job: the audited specimen archive and its zone by period table.

    python -m jobs.specimen_archive --tables DIR --output DIR [--config jobs/specimen_archive.json]

Before a study every isotope record is asked three things: is it located, inside the
study's box, and is its collagen sound?  The job answers them for every record of
the given tables, with the first reason against it, dates it (period) and places
it (zone), and keeps what passed and what did not side by side:

``<output>/specimens``   every record with ``status``, in a folder a period
``<output>/table``       counts, sites and value means by zone, in a folder a period, of the records kept

With ``periods`` in the configuration only those folders are made anew, the others
stay as they are (dynamic partition overwrite).  Periods follow from the rows
alone and every folder is replaced whole, so a second run leaves the same rows,
also after a run that was broken off.  A record without a period is in the folder of
the null period, which ``null`` in ``periods`` names.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens import fixtures
from sitelens.functions.text import taxon_group, with_human
from sitelens.operators import enrich, summary

log = logging.getLogger("specimen_archive")

KEPT = "kept"
COLUMNS = ("orderkey", "line", "site", "lon", "lat", "region", "taxon_group", "bp_upper", "bp_lower", "d13C_coll", "d15N_coll", "CN", "zone", "status", "period")


def audit(bbox: tuple[float, float, float, float], cn: tuple[float, float]) -> Column:
    """``kept``, or the first reason against a record."""
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    inside = F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3])
    sound = F.col("CN").isNull() | F.col("CN").between(*cn)
    values = F.col("d13C_coll").isNotNull() & F.col("d15N_coll").isNotNull()
    return F.when(~located, "no coordinates").when(~inside, "outside the box").when(~sound, "C:N out of range").when(~values, "no collagen values").otherwise(KEPT)


def specimens(spark: SparkSession, tables: str, bbox, cn) -> DataFrame:
    """Every record of the given tables, audited, dated and placed; no shuffle but the joins of its lookups."""
    rows = fixtures.fixture(spark, tables, "fx_specimen").withColumnsRenamed({"d13c_coll": "d13C_coll", "d15n_coll": "d15N_coll", "cn": "CN"})
    human = F.when(F.col("taxon") == "Human", "human").otherwise("animal")
    rows = rows.withColumn("taxon_group", with_human(human, taxon_group(F.col("taxon"))))
    rows = enrich.assign_zone(enrich.assign_period(rows))
    return rows.withColumn("status", audit(tuple(bbox), tuple(cn))).select(*COLUMNS)


def _of_periods(df: DataFrame, periods: list[str | None] | None) -> DataFrame:
    if periods is None:
        return df
    named = F.col("period").isin([p for p in periods if p is not None])
    return df.filter(F.coalesce(named, F.lit(False)) | (F.col("period").isNull() if None in periods else F.lit(False)))


def run(spark: SparkSession, tables: str, output: str, bbox=(105.0, 33.0, 141.0, 56.0), cn=(2.9, 3.6), min_n: int = 3, periods: list[str | None] | None = None) -> DataFrame:
    """Write the archive and the table below ``output``; the archive as it stands afterwards."""
    whole = periods is None

    def write(df: DataFrame, where: str) -> DataFrame:
        df.write.mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic").partitionBy("period").parquet(where)
        return spark.read.schema(df.schema).parquet(where)

    archive = write(_of_periods(specimens(spark, tables, bbox, cn), periods), f"{output}/specimens")
    found = _of_periods(archive, periods)
    for r in found.groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy("status").collect():
        log.info("read from %s, written to %s/specimens: %d records: %s", tables, output, r["n"], r["status"])
    table = summary.zone_period_table(found.filter(F.col("status") == KEPT), ["d13C_coll", "d15N_coll"], min_n=min_n, places=None)
    written = _of_periods(write(table.select(*(c for c in table.columns if c != "period"), "period"), f"{output}/table"), periods)
    log.info("written to %s/table: %d rows", output, written.count())
    return archive


if __name__ == "__main__":
    from jobs.common import main

    main("specimen_archive", run, ("tables", "output"))
