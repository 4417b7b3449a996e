"""Binary search in bounded arrays and running totals without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reference distributions up to this many values travel as literals in the plan; larger ones are joined.
MAX_REFERENCE = 1_000


def array_of(values: list[float]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<double>")


def position(value: Column, ascending: Column, size: int, right: bool = True) -> Column:
    """How many of ``size`` ascending array entries are <= value (or < value); null stays null."""
    steps = F.sequence(F.lit(1), F.lit(max(1, size.bit_length())))
    start = F.struct(F.lit(0).alias("lo"), F.lit(size).alias("hi"))

    def halve(v: Column, a: Column, s: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        inside = s["lo"] < s["hi"]
        below = inside & ((F.get(a, mid) <= v) if right else (F.get(a, mid) < v))
        return F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(inside & ~below, mid).otherwise(s["hi"]).alias("hi"))

    bound = F.array(F.struct(value.alias("v"), ascending.alias("a")))
    found = F.get(F.transform(bound, lambda b: F.aggregate(steps, start, lambda s, _: halve(b["v"], b["a"], s), lambda s: s["lo"])), F.lit(0))
    return F.when(value.isNotNull(), found)


def running_totals(df: DataFrame, order: str, sums: dict[str, str], ranges: int | None = None) -> DataFrame:
    """Adds, for each ``out: column``, the sum of ``column`` over all rows up to this one in ``order``.

    ``order`` must be distinct (aggregate ties first).  Rows are cut into value
    ranges; each range has its own window, and the totals of the ranges before
    it (a row for each range) are joined in.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(df.select(F.percentile_approx(order, [k / n for k in range(1, n)], 10 * n)).first()[0] or [])) if n > 1 else []
    place = F.coalesce(position(F.col(order), array_of([float(b) for b in bounds]), len(bounds)), F.lit(0)) if bounds else F.lit(0)
    placed = df.withColumn("_range", place)
    totals = placed.groupBy("_range").agg(*(F.sum(c).alias(f"_t_{o}") for o, c in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = totals.select("_range", *(F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums))
    own = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(F.broadcast(offsets), "_range")
    return out.withColumns({o: F.sum(c).over(own) + F.col(f"_b_{o}") for o, c in sums.items()}).drop("_range", *(f"_b_{o}" for o in sums))


def ranks(df: DataFrame, column: str, reference: DataFrame, ref_column: str | None = None, below: str = "below", upto: str = "upto", most: int = MAX_REFERENCE) -> DataFrame:
    """Adds how many reference values are less than, and at or below, ``column`` (null where it is).

    A bounded reference is searched as a sorted literal.  A larger one is counted
    by distinct value, added up over value ranges together with the values asked
    for, and joined back on the value.
    """
    ref = reference.select(F.col(ref_column or column).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    value = F.col(column).cast("double")
    if ref.limit(most + 1).count() <= most:
        known = sorted(r[0] for r in ref.collect())
        a, n = array_of(known), len(known)
        return df.withColumns({below: position(value, a, n, right=False), upto: position(value, a, n)})
    counted = ref.groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
    asked = df.select(value.alias("_v")).filter(F.col("_v").isNotNull()).distinct().withColumn("_c", F.lit(0).cast("long"))
    every = counted.unionByName(asked).groupBy("_v").agg(F.sum("_c").alias("_c"))
    table = running_totals(every, "_v", {upto: "_c"}).select("_v", (F.col(upto) - F.col("_c")).alias(below), upto)
    return df.join(table, value == F.col("_v"), "left").drop("_v")
