"""Slope, aspect and ruggedness of an elevation band, by windows over grid lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import Grid


def neighbours(cells: DataFrame, band: str) -> DataFrame:
    """Columns n_<dr>_<dc> of the 3 x 3 window, its edge repeated at the border and at cells that are not there.

    A neighbour that exists without a value stays null.
    """
    along_row, along_col = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    wide = cells.withColumns({"_w": F.lag(band, 1).over(along_row), "_e": F.lead(band, 1).over(along_row), "_first": ~F.lag("col", 1).over(along_row).eqNullSafe(F.col("col") - 1), "_last": ~F.lead("col", 1).over(along_row).eqNullSafe(F.col("col") + 1)})
    wide = wide.withColumns({"n_0_m": F.when(F.col("_first"), F.col(band)).otherwise(F.col("_w")), "n_0_p": F.when(F.col("_last"), F.col(band)).otherwise(F.col("_e")), "n_0_0": F.col(band)})
    wide = wide.withColumns({"_top": ~F.lag("row", 1).over(along_col).eqNullSafe(F.col("row") - 1), "_bottom": ~F.lead("row", 1).over(along_col).eqNullSafe(F.col("row") + 1)})
    out = {}
    for c in ("m", "0", "p"):
        mid = f"n_0_{c}"
        out[f"n_m_{c}"] = F.when(F.col("_top"), F.col(mid)).otherwise(F.lag(mid, 1).over(along_col))
        out[f"n_p_{c}"] = F.when(F.col("_bottom"), F.col(mid)).otherwise(F.lead(mid, 1).over(along_col))
    return wide.withColumns(out).drop("_w", "_e", "_first", "_last", "_top", "_bottom")


def _n(at: str) -> Column:
    return F.col(f"n_{at}")


def slope_aspect(cells: DataFrame, band: str, grid: Grid, compass: bool = False) -> DataFrame:
    """Adds slope and aspect in degrees (Horn); a flat cell's aspect is 180.

    Aspect runs from east counter-clockwise, as the published values do;
    ``compass`` gives north as 0, clockwise, instead.
    """
    width, height = grid.cell_metres()
    near = neighbours(cells, band)
    dx = ((_n("m_p") + 2 * _n("0_p") + _n("p_p")) - (_n("m_m") + 2 * _n("0_m") + _n("p_m"))) / (8 * width)
    dy = ((_n("p_m") + 2 * _n("p_0") + _n("p_p")) - (_n("m_m") + 2 * _n("m_0") + _n("m_p"))) / (8 * height)
    out = near.withColumns({"_dx": dx, "_dy": dy})
    angle = F.degrees(F.atan2(F.col("_dy"), -F.col("_dx")))
    aspect = F.when((F.col("_dx") == 0) & (F.col("_dy") == 0), F.lit(180.0)).otherwise(F.when(angle < 0, angle + 360).otherwise(angle))
    if compass:
        aspect = F.pmod(450 - aspect, F.lit(360.0))
    out = out.withColumns({"slope": F.degrees(F.atan(F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")))), "aspect": aspect})
    return out.drop("_dx", "_dy", *(c for c in out.columns if c.startswith("n_")))


def northness_eastness(df: DataFrame) -> DataFrame:
    """Cosine and sine of the aspect."""
    return df.withColumns({"northness": F.cos(F.radians("aspect")), "eastness": F.sin(F.radians("aspect"))})


def ruggedness(cells: DataFrame, band: str, out: str = "tri") -> DataFrame:
    """Root of the summed squared differences to the eight neighbours."""
    near = neighbours(cells, band)
    total = F.lit(0.0)
    for at in ("m_m", "m_0", "m_p", "0_m", "0_p", "p_m", "p_0", "p_p"):
        d = _n(at) - F.col(band)
        total = total + d * d
    out_df = near.withColumn(out, F.sqrt(total))
    return out_df.drop(*(c for c in out_df.columns if c.startswith("n_")))


def add_terrain(cells: DataFrame, band: str, grid: Grid, include=("slope", "northness", "eastness", "tri")) -> DataFrame:
    """The chosen terrain bands."""
    out = northness_eastness(slope_aspect(cells, band, grid))
    if "tri" in include:
        out = ruggedness(out, band)
    return out.drop(*({"slope", "aspect", "northness", "eastness"} - set(include)))
