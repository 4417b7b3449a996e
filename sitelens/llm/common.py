"""Helpers shared by the corpus operators: table access, word rules, shared folders."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`, as bytes and as SQL/Java classes.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, by Spark's reader only (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt anew where its files make fewer tasks than half the cores: a small file is one task, however long its texts take.

    Larger inputs, which have more files than that, are read as they lie.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() <= cores else df


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder under ``spark.checkpoint.dir`` that driver and executors share.

    The setting is read from the session, or is the context's checkpoint folder.
    Without either there is no folder that is known to be shared: an error, but
    for a session on one machine, which has the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = context_dir.get() if context_dir.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Spark deletes a write's shuffle files when the write is done, not when garbage collection finds them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet; the shuffle files that it took are gone afterwards."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    write_table(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def remove_table(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote; nothing may read ``df`` any more."""
    remove(df.sparkSession, df._written_to)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a shared folder through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions_for(spark: SparkSession, at_least: int = 1) -> int:
    """Shuffle width: the session's, never under ``at_least``."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts`` - 1 ascending values that cut a column into ranges of like size."""
    if parts < 2:
        return []
    shares = [k / parts for k in range(1, parts)]
    return sorted(set(df.select(F.percentile_approx(column, shares, 20 * parts)).first()[0] or []))


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at or below a value, by binary search; null: 0."""
    if not bounds:
        return F.lit(0)
    cuts = F.array(*(F.lit(b) for b in bounds))

    def halve(cuts: Column, s: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        open_ = s["lo"] < s["hi"]
        below = open_ & (F.get(cuts, middle) <= value)
        return F.struct(F.when(below, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~below, middle).otherwise(s["hi"]).alias("hi"))

    first = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    found = F.get(F.transform(F.array(cuts), lambda c: F.aggregate(steps, first, lambda s, _: halve(c, s), lambda s: s["lo"])), F.lit(0))
    return F.when(value.isNull(), 0).otherwise(found)


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns beside ``document``, a struct of all columns: no computed name can clash with an extra one."""
    return docs.select(*needed, F.struct(*docs.columns).alias("document"))
