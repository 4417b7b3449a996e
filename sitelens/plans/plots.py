"""Plot-ready tables: what each figure of a study draws, without a drawing library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import niche, scenario
from ..operators.enrich import period_rank
from ..operators.grid import Grid, geographic_bounds
from ..operators.maxent import Maxent
from ..operators.summary import site_summary, zone_period_table


def suitability_map(surface: DataFrame, value: str = "value") -> DataFrame:
    """Cells of a surface with a 2 to 98 percent stretch for colours."""
    return scenario.stretch(surface, value)


def overlay(surface: DataFrame, g: Grid, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(cells with a 2 to 98 percent stretch, the grid's box in degrees): what a web map lays over its tiles."""
    return scenario.stretch(surface, value), geographic_bounds(surface.sparkSession, g)


def panel_maps(surfaces: dict[str, DataFrame], value: str = "value") -> DataFrame:
    """(panel, row, col, value, scaled): several surfaces on one colour scale, from 2 to 98 percent of all their values."""
    stacked = [s.select(F.lit(name).alias("panel"), "row", "col", value) for name, s in surfaces.items()]
    return scenario.stretch(reduce(DataFrame.unionByName, stacked), value)


def response_curves(model: Maxent, rows: DataFrame) -> DataFrame:
    """(band, x, y) of every band's response."""
    out = None
    for band in model.spec.low:
        one = model.response_curve(rows, band).withColumn("band", F.lit(band))
        out = one if out is None else out.unionByName(one)
    return out


def importance_bars(spark, importance: list[tuple[str, float]]) -> DataFrame:
    return spark.createDataFrame(importance, "band string, percent double").orderBy(F.desc("percent"))


def biplot(df: DataFrame, group: str = "period", x: str = "d13C_coll", y: str = "d15N_coll") -> DataFrame:
    """(group, x, y) of rows with both values."""
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(group).alias("group"), F.col(x).alias("x"), F.col(y).alias("y"))


def time_series(df: DataFrame, by: str = "taxon_group") -> DataFrame:
    """Means and deviations by period in order of time."""
    return site_summary(df.filter(F.col("period").isNotNull()), ["period", by]).withColumn("ordinal", period_rank(F.col("period"))).orderBy(by, "ordinal")


def zone_trajectories(df: DataFrame, value: str, min_n: int = 3) -> DataFrame:
    """Each zone's means in order of time."""
    return zone_period_table(df, [value], min_n).withColumn("ordinal", period_rank(F.col("period"))).orderBy("zone", "ordinal")


def site_map(df: DataFrame) -> DataFrame:
    """Distinct located sites with their zone and number of rows."""
    return df.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).groupBy("site", "lon", "lat", "zone").agg(F.count(F.lit(1)).alias("n"))


def zone_taxon_biplot(df: DataFrame, x: str = "d13C_coll", y: str = "d15N_coll") -> DataFrame:
    """Mean and deviation of both values by zone and taxon."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col("zone").isNotNull())
    return rows.groupBy("zone", "taxon_group").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("x"), F.stddev_samp(x).alias("x_sd"), F.avg(y).alias("y"), F.stddev_samp(y).alias("y_sd"))


def niche_ellipses(df: DataFrame, keys: list[str], x: str = "d13C_coll", y: str = "d15N_coll") -> DataFrame:
    """Outline points of each group's standard ellipse."""
    return niche.outline(niche.ellipses(df, keys, x, y).filter("n >= 3"))
