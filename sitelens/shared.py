"""Folders that driver and executors share, for results of iterations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes a write's shuffle files when the write is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt anew where its files make fewer tasks than half the cores; larger inputs are read as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() <= cores else df


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, an error, but for a session on one machine, which has the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> None:
    """Write as Parquet; the shuffle files that it took are gone afterwards."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write and read back: lineage ends at files that survive lost executors."""
    path = shared_dir(df.sparkSession, what)
    write_table(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def remove_table(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote; nothing may read ``df`` any more."""
    remove(df.sparkSession, df._written_to)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file systems."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
