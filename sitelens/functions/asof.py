"""The latest earlier slice of each row, without a window that holds a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import array_of, position


def asof_join(rows: DataFrame, slices: DataFrame, keys: list[str], time: str, values: list[str], slice_time: str | None = None, ranges: int | None = None) -> DataFrame:
    """Adds to ``rows`` the ``values`` of the slice of the same keys whose time is the latest at or before the row's.

    Times are numbers.  Rows and slices are dealt by key and range of time, so a
    key of many rows is in many parts; within a part a window carries the last
    slice on, and what came before it is the last slice of the key's earlier ranges
    (a row for each key and range).  No earlier slice, a null key or a null time:
    nulls.  Slices of one key and time count as one, the greatest of their values in order.
    Repeated rows are each answered; columns of ``rows`` named like a value are replaced.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.col(time).cast("double")
    bounds = sorted(set(rows.select(F.percentile_approx(at, [k / n for k in range(1, n)], 10 * n)).first()[0] or [])) if n > 1 else []
    part = lambda t: F.coalesce(position(t, array_of([float(b) for b in bounds]), len(bounds)), F.lit(0)) if bounds else F.lit(0)
    names = [f"_k{i}" for i in range(len(keys))]
    by = lambda df: [F.col(f"`{k}`").alias(a) for k, a in zip(keys, names, strict=True)]

    known = slices.select(*by(slices), F.col(slice_time or time).cast("double").alias("_t"), F.struct(*values).alias("_v")).dropna("any", subset=[*names, "_t"])
    known = known.groupBy(*names, "_t").agg(F.max("_v").alias("_v")).withColumn("_r", part(F.col("_t")))
    asked = rows.select(*by(rows), at.alias("_t"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"))
    unanswerable = F.col("_t").isNull()
    for a in names:
        unanswerable = unanswerable | F.col(a).isNull()
    placed = asked.filter(~unanswerable).withColumn("_r", part(F.col("_t")))

    last = known.groupBy(*names, "_r").agg(F.max_by("_v", "_t").alias("_last"))
    every = last.unionByName(placed.select(*names, "_r").distinct(), allowMissingColumns=True).groupBy(*names, "_r").agg(F.first("_last", ignorenulls=True).alias("_last"))
    before = Window.partitionBy(*names).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = every.select(*names, "_r", F.last("_last", ignorenulls=True).over(before).alias("_before"))

    own = Window.partitionBy(*names, "_r").orderBy("_t", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = placed.unionByName(known, allowMissingColumns=True).withColumn("_here", F.last("_v", ignorenulls=True).over(own)).filter(F.col("_row").isNotNull())
    found = met.join(carried, [*names, "_r"], "left").select("_row", F.coalesce("_here", "_before").alias("_v"))
    out = found.unionByName(asked.filter(unanswerable).select("_row"), allowMissingColumns=True)
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in rows.columns if c not in values), *(F.col(f"_v.{v}").alias(v) for v in values))
