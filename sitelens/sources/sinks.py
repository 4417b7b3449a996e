"""Result sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import write_bytes


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """Delimited text with a header; ``bom`` marks the first header for spreadsheet programs."""
    first = df.columns[0]
    out = df.withColumnRenamed(first, "﻿" + first) if bom else df
    out.write.mode("overwrite").csv(path, header=True)


def json_rows(df: DataFrame) -> DataFrame:
    """(value): each row as JSON; NaN becomes null."""
    clean = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.withColumns(clean).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def table_json(df: DataFrame, drop: tuple[str, ...] = ("model",), most: int = 1_000_000) -> str:
    """A whole result as {columns, rows}; one of over ``most`` rows is an error and belongs in ``json_rows``."""
    shown = df.drop(*drop)
    rows = [json.loads(r[0]) for r in json_rows(shown.limit(most + 1)).collect()]
    if len(rows) > most:
        raise ValueError(f"over {most} rows for one JSON text; write json_rows instead")
    return json.dumps({"columns": shown.columns, "rows": [[r.get(c) for c in shown.columns] for r in rows]}, ensure_ascii=False)


def preview(df: DataFrame, rows: int = 300) -> DataFrame:
    return df.limit(rows)


def write_summary(spark: SparkSession, values: dict, path: str) -> None:
    """A few scalars as one JSON file."""
    write_bytes(spark, path, json.dumps(values, ensure_ascii=False, indent=2).encode())
