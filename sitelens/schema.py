"""Standard table layouts and missing-value hygiene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

_TEXT = {"source", "group", "site", "region", "culture", "taxon", "taxon_group"}
STANDARD_COLUMNS = ("source", "group", "site", "lat", "lon", "region", "culture", "bp_upper", "bp_lower", "bp_mid", "taxon", "taxon_group", "d13C_coll", "d15N_coll", "CN", "d13C_ap", "d18O_ap")
SPECIMEN = StructType([StructField(c, StringType() if c in _TEXT else DoubleType()) for c in STANDARD_COLUMNS])
VALUE_COLUMNS = ("d13C_coll", "d15N_coll", "d13C_ap", "d18O_ap")


def no_nan(c: Column) -> Column:
    """NaN to null, so that aggregates skip it."""
    return F.when(~F.isnan(c), c)


def finalise(df: DataFrame) -> DataFrame:
    """The standard columns in order: bp_mid is the mean of both bounds, absent columns are null."""
    have = {c.lower(): c for c in df.columns}
    if "bp_mid" not in have and {"bp_upper", "bp_lower"} <= set(have):
        df = df.withColumn("bp_mid", (F.col("bp_upper") + F.col("bp_lower")) / 2)
        have["bp_mid"] = "bp_mid"
    return df.select(*((F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SPECIMEN.fields))


def half_even(c: Column, places: int) -> Column:
    """Rounding to even, as numeric Python libraries do."""
    return F.bround(c, places)


def stable(c: Column, places: int = 6) -> Column:
    """Rounded for comparison across engines: exact halves always go up."""
    scale = float(10**places)
    return F.floor(c * F.lit(scale) + F.lit(0.50001)) / F.lit(scale)
