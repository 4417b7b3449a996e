"""Aggregates and windows over the specimen table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import PERIODS
from ..functions.stats import chi2_sf, mann_whitney
from ..schema import half_even
from .enrich import period_rank

PERIOD_KEYS = tuple(p.key for p in PERIODS)


def _named(grouped: DataFrame, count: str, *keys: str) -> DataFrame:
    """Groups whose keys are all known.

    Keys are passed on through a test of a count, so that neither this filter nor
    one inferred from a later join can be pushed below the aggregate: there it
    would repeat the keys' expressions (periods and zones are long ones) beyond
    what the JVM compiles.
    """
    held = {k: F.when(F.col(count) > 0, F.col(k)) for k in keys}
    return grouped.withColumns(held).dropna("any", subset=list(keys))


def site_summary(df: DataFrame, by: list[str] | None = None, places: int | None = 2) -> DataFrame:
    """Samples, sites and value means and deviations of each group; a null key is a group."""
    by = by or ["period", "taxon_group"]
    r = (lambda c: c) if places is None else (lambda c: half_even(c, places))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("site").alias("sites"),
        r(F.avg("d13C_coll")).alias("d13C_mean"),
        r(F.stddev_samp("d13C_coll")).alias("d13C_sd"),
        r(F.avg("d15N_coll")).alias("d15N_mean"),
        r(F.stddev_samp("d15N_coll")).alias("d15N_sd"),
        r(F.avg("d13C_ap")).alias("d13C_ap_mean"),
        r(F.avg("d18O_ap")).alias("d18O_ap_mean"),
    )


def site_means(df: DataFrame, value: str) -> DataFrame:
    """Mean, count and deviation of a value at each located site."""
    rows = df.filter(F.col(value).isNotNull() & F.col("site").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return rows.groupBy("site", "lat", "lon").agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("n"), F.stddev_samp(value).alias("sd"))


def zone_period_table(df: DataFrame, values: list[str], min_n: int = 3, places: int | None = 2) -> DataFrame:
    """Rows, sites and each value's count, mean and deviation by zone and period with ``min_n`` rows or more."""
    r = (lambda c: c) if places is None else (lambda c: half_even(c, places))
    parts = [F.count(F.lit(1)).alias("n"), F.countDistinct("site").alias("sites")]
    for v in values:
        parts += [F.count(v).alias(f"{v}_n"), r(F.avg(v)).alias(f"{v}_mean"), r(F.stddev_samp(v)).alias(f"{v}_sd")]
    return _named(df.groupBy("zone", "period").agg(*parts), "n", "zone", "period").filter(F.col("n") >= min_n)


def cross_tab(df: DataFrame, row: str, distinct: str | None = "site") -> DataFrame:
    """Periods across: distinct ``distinct`` (or rows) of each ``row`` value, 0 where there is none."""
    count = F.count(F.lit(1)) if distinct is None else F.countDistinct(distinct)
    return df.filter(F.col(row).isNotNull()).groupBy(row).pivot("period", list(PERIOD_KEYS)).agg(count).na.fill(0, list(PERIOD_KEYS))


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("samples"), F.countDistinct("site").alias("sites"))


def isoscape_record(means: DataFrame) -> DataFrame:
    """One row over site means: sites, samples, and mean, least and most of the means."""
    return means.agg(F.count(F.lit(1)).alias("sites"), F.sum("n").alias("samples"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value) of every distinct non-null value, sorted within a field."""
    stacked = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns))).alias("x")).select("x.*")
    return stacked.filter(F.col("value").isNotNull()).distinct().orderBy("field", "value")


def detrend_by_zone(df: DataFrame, value: str, out: str = "detrended") -> DataFrame:
    """Value less its zone's mean; null without a zone.

    Zone means are aggregated first and joined back (a row for each zone), so a
    zone with most rows is no hot partition.
    """
    means = df.groupBy("zone").agg(F.avg(value).alias("_mean"))  # a null zone joins nothing
    return df.join(means, "zone", "left").withColumn(out, F.col(value) - F.col("_mean")).drop("_mean")


def continuous_runs(table: DataFrame, min_periods: int = 2) -> DataFrame:
    """(zone, periods, run_length): maximal runs of consecutive periods of each zone."""
    keys = table.select("zone", "period").distinct().withColumn("o", period_rank(F.col("period"))).filter(F.col("o").isNotNull())
    island = F.col("o") - F.row_number().over(Window.partitionBy("zone").orderBy("o"))
    runs = keys.withColumn("_i", island).groupBy("zone", "_i").agg(F.sort_array(F.collect_list(F.struct("o", "period"))).alias("p"))
    return runs.select("zone", F.concat_ws(",", F.transform("p", lambda x: x["period"])).alias("periods"), F.size("p").alias("run_length")).filter(F.col("run_length") >= min_periods)


def _counted(df: DataFrame, value: str) -> DataFrame:
    """(zone, period, v, c): rows of each distinct value; what the tests below are built on, so they scan once."""
    return _named(df.groupBy("zone", "period", F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c")), "c", "zone", "period", "v")


def _midranks(pooled: DataFrame, keys: list[str]) -> DataFrame:
    """Adds _rank to distinct values with their counts _c: windows hold values, not rows."""
    w = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pooled.withColumn("_rank", F.sum("_c").over(w) - F.col("_c") + (F.col("_c") + 1) / 2)


def adjacent_changes(df: DataFrame, value: str, min_n: int = 3, test: bool = True) -> DataFrame:
    """Change of a value between consecutive periods inside a zone, with a Mann-Whitney test."""
    counted = _counted(df, value).withColumn("o", period_rank(F.col("period"))).filter(F.col("o").isNotNull())
    cells = counted.groupBy("zone", "o", "period").agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    a, b = cells.alias("a"), cells.alias("b")
    pairs = a.join(b, (F.col("a.zone") == F.col("b.zone")) & (F.col("a.o") + 1 == F.col("b.o"))).filter((F.col("a.n") >= min_n) & (F.col("b.n") >= min_n))
    out = pairs.select(F.col("a.zone").alias("zone"), F.col("a.o").alias("o"), F.col("a.period").alias("from_period"), F.col("b.period").alias("to_period"), F.col("a.n").alias("from_n"), F.col("b.n").alias("to_n"), F.col("a.mean").alias("from_mean"), F.col("b.mean").alias("to_mean"), (F.col("b.mean") - F.col("a.mean")).alias("delta"))
    if not test:
        return out.drop("o")
    # a value counts as a later one for the period before and as an earlier one for its own
    sides = F.explode(F.array(F.struct(F.col("o").alias("o"), F.col("c").alias("first")), F.struct((F.col("o") - 1).alias("o"), F.lit(0).cast("long").alias("first"))))
    both = counted.select("zone", "v", "c", sides.alias("s")).groupBy("zone", F.col("s.o").alias("o"), "v").agg(F.sum("s.first").alias("first"), F.sum("c").alias("_c"))
    sums = _midranks(both, ["zone", "o"]).groupBy("zone", "o").agg(F.sum(F.col("first") * F.col("_rank")).alias("_r"), F.sum(F.pow("_c", F.lit(3)) - F.col("_c")).alias("ties"))
    tested = out.join(sums, ["zone", "o"]).withColumn("u", F.col("_r") - F.col("from_n") * (F.col("from_n") + 1) / 2)
    return tested.withColumn("p", mann_whitney(F.col("u"), F.col("from_n"), F.col("to_n"), F.col("ties"))).drop("o", "_r")


def kruskal(df: DataFrame, value: str, min_n: int = 4, alpha: float = 0.05) -> DataFrame:
    """Kruskal-Wallis over the periods of each zone that have ``min_n`` values or more; labels are in order of name.

    ``p_shown`` is p to three significant digits.
    """
    every = _counted(df, value)
    groups = every.groupBy("zone", "period").agg(F.sum("c").alias("n")).filter(F.col("n") >= min_n)
    counted = every.join(groups, ["zone", "period"])
    ranks = _midranks(counted.groupBy("zone", "v").agg(F.sum("c").alias("_c")), ["zone"])
    sums = counted.join(ranks, ["zone", "v"]).groupBy("zone", "period").agg(F.sum(F.col("c") * F.col("_rank")).alias("r"), F.first("n").alias("n"))
    ties = ranks.groupBy("zone").agg(F.sum(F.pow("_c", F.lit(3)) - F.col("_c")).alias("ties"))
    total = sums.groupBy("zone").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.pow("r", F.lit(2)) / F.col("n")).alias("q"), F.array_join(F.sort_array(F.collect_list("period")), ", ").alias("periods"))
    n = F.col("n").cast("double")
    h = (F.lit(12.0) / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / F.nullif(1 - F.col("ties") / (n * n * n - n), F.lit(0.0))
    out = total.filter("k >= 2").join(ties, "zone").withColumn("h", h)
    p = chi2_sf(F.col("h"), F.col("k") - 1)
    tested = out.select("zone", "periods", F.col("k").alias("groups"), "n", "h", p.alias("p"))
    return tested.withColumns({"p_shown": significant_digits(F.col("p"), 3), "significant": F.col("p") < alpha})


def significant_digits(c: Column, digits: int) -> Column:
    """A number cut to so many significant digits, by rounding."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, 0.0).otherwise(F.rint(c * scale) / scale)


def diet_class(value: Column) -> Column:
    """C3 below -18, C4 above -12, mixed between, unknown without a value."""
    return F.when(value.isNull() | F.isnan(value), "unknown").when(value < -18, "C3").when(value > -12, "C4").otherwise("mixed")
