"""Driver-side file access through Hadoop's file systems."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is missing."""
    fs, where = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_range(spark: SparkSession, path: str, start: int, size: int) -> bytes:
    """``size`` bytes of a file from ``start`` on, fewer at its end: for headers."""
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        stream.seek(start)
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def write_chunks(spark: SparkSession, path: str, chunks: Iterable[bytes]) -> None:
    """One file from parts that arrive one after the other; it has its name only when it is whole."""
    fs, where = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    part = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    try:
        for chunk in chunks:
            out.write(bytearray(chunk))
    except BaseException:
        out.close()
        fs.delete(part, False)
        raise
    out.close()
    if fs.exists(where):
        fs.delete(where, False)
    fs.rename(part, where)


def binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files; executors parse them, one task for each file or more."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first of some paths that exists."""
    return next((c for c in candidates if exists(spark, c)), None)


def status(spark: SparkSession, paths: dict[str, list[str]]) -> DataFrame:
    """(name, path, found) of every configured input."""
    rows = [(name, (hit := first_existing(spark, options)) or (options[0] if options else None), hit is not None) for name, options in paths.items()]
    return spark.createDataFrame(rows, "name string, path string, found boolean")


def list_datasets(spark: SparkSession, folders: list[str], suffix: str = ".csv") -> list[str]:
    """Paths of the datasets in some folders, the folders in the order given."""
    return [f"{folder.rstrip('/')}/{name}" for folder in folders for name in listing(spark, folder) if name.endswith(suffix)]
