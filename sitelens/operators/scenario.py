"""Projection, extrapolation, range change and dispersal over cell tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import CLIMATE_SLICES, CURRENT_BP, DIRECTIONS, PALEO_SLICES, SCALE10_BIOS, first_case
from ..functions.search import ranks
from ..shared import materialise, remove_table, shared_dir, write_table
from .grid import Grid, cell_area_km2


def complete(bands: list[str]) -> Column:
    """Whether every band has a value."""
    ok = F.lit(True)
    for b in bands:
        ok = ok & F.col(b).isNotNull()
    return ok


def mess(cells: DataFrame, reference: DataFrame, bands: list[str]) -> DataFrame:
    """Adds ``mess``, the least four-branch similarity to a reference over the bands; null unless every band has a value.

    It is negative where a band lies outside the reference's range.
    """
    ref = reference.select(*(F.col(b).cast("double").alias(b) for b in bands)).dropna()
    ends = ref.agg(F.count(F.lit(1)).alias("n"), *(f(b).alias(f"{k}{i}") for i, b in enumerate(bands) for k, f in (("lo", F.min), ("hi", F.max)))).first()
    if not ends["n"]:
        raise ValueError("the reference is empty")
    out, each = cells, []
    for i, b in enumerate(bands):
        low, high = ends[f"lo{i}"], ends[f"hi{i}"]
        span = (high - low) or 1.0
        out = ranks(out, b, ref, below=f"_b{i}", upto=f"_u{i}")
        f, v = F.col(f"_u{i}") / F.lit(float(ends["n"])) * 100, F.col(b).cast("double")
        each.append(F.when(f == 0, (v - low) / span * 100).when(f <= 50, 2 * f).when(f < 100, 2 * (100 - f)).otherwise((high - v) / span * 100))
    least = F.least(*each) if len(each) > 1 else each[0]
    return out.withColumn("mess", F.when(complete(bands), least)).drop(*(f"_{k}{i}" for i in range(len(bands)) for k in "bu"))


def extrapolated_share(cells: DataFrame) -> DataFrame:
    """Percent of all cells with a negative mess."""
    return cells.agg((F.avg(F.when(F.col("mess") < 0, 1.0).otherwise(0.0)) * 100).alias("percent"))


def p10_threshold(presence: DataFrame, score: str = "score") -> DataFrame:
    """The interpolated tenth percentile of presence predictions."""
    return presence.agg(F.percentile(score, F.lit(0.1)).alias("threshold"))


def stretch(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Adds ``scaled``: value between two percentiles, cut to 0 and 1."""
    ends = df.agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("q")).first()["q"]
    if ends is None:
        return df.withColumn("scaled", F.lit(None).cast("double"))
    span = (ends[1] - ends[0]) or 1.0
    return df.withColumn("scaled", F.least(F.greatest((F.col(value) - ends[0]) / span, F.lit(0.0)), F.lit(1.0)))


def in_range(value: Column, threshold: float) -> Column:
    """Suitability at or above a threshold; a missing value counts as 0."""
    return F.coalesce(value, F.lit(0.0)) >= threshold


def range_change(before: DataFrame, after: DataFrame, grid: Grid) -> DataFrame:
    """Areas and centroid shift between two binary ranges (row, col, x, y, present), one row."""
    a = before.select("row", "col", "x", "y", F.col("present").alias("p0"))
    b = after.select("row", "col", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("present").alias("p1"))
    both = a.join(b, ["row", "col"], "full").select(F.coalesce("x", "x1").alias("x"), F.coalesce("y", "y1").alias("y"), F.coalesce("p0", F.lit(False)).alias("p0"), F.coalesce("p1", F.lit(False)).alias("p1"))
    return _change(both.groupBy(), grid).drop()


def _change(grouped, grid: Grid) -> DataFrame:
    area = cell_area_km2(grid, F.col("y"))
    total = lambda on, name: F.coalesce(F.sum(F.when(on, area)), F.lit(0.0)).alias(name)
    p0, p1 = F.col("p0"), F.col("p1")
    sums = grouped.agg(
        total(p0, "before_km2"),
        total(p1, "after_km2"),
        total(p0 & p1, "kept_km2"),
        total(p0 & ~p1, "lost_km2"),
        total(~p0 & p1, "gained_km2"),
        *(F.avg(F.when(p, F.col(c))).alias(f"{c}{i}") for i, p in enumerate((p0, p1)) for c in ("x", "y")),
    )
    if grid.geographic:
        dx = (F.col("x1") - F.col("x0")) * 111.32 * F.cos(F.radians((F.col("y0") + F.col("y1")) / 2))
        dy = (F.col("y1") - F.col("y0")) * 110.57
    else:
        dx, dy = (F.col("x1") - F.col("x0")) / 1000, (F.col("y1") - F.col("y0")) / 1000
    out = sums.withColumns({"change_percent": (F.col("after_km2") - F.col("before_km2")) / F.greatest(F.col("before_km2"), F.lit(1.0)) * 100, "_dx": dx, "_dy": dy})
    bearing = F.pmod(F.degrees(F.atan2("_dx", "_dy")) + 360, F.lit(360.0))
    sector = F.floor(F.pmod(bearing + 22.5, F.lit(360.0)) / 45).cast("int")
    out = out.withColumns({"shift_km": F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")), "direction": F.get(F.array(*(F.lit(d) for d in DIRECTIONS)), sector)})
    return out.drop("_dx", "_dy", "x0", "y0", "x1", "y1")


def summarise_series(surfaces: DataFrame, names: list[str], threshold: float, grid: Grid) -> DataFrame:
    """Range change between each slice and the next, over (slice, row, col, x, y, value); one pass for all pairs."""
    marked = surfaces.filter(F.col("slice").isin(*names)).groupBy("row", "col", "x", "y").pivot("slice", names).agg(F.first("value"))
    pairs = F.explode(F.array(*(F.struct(F.lit(f"{a}→{b}").alias("step"), in_range(F.col(f"`{a}`"), threshold).alias("p0"), in_range(F.col(f"`{b}`"), threshold).alias("p1")) for a, b in zip(names, names[1:], strict=False))))
    rows = marked.select("x", "y", pairs.alias("s")).select("x", "y", "s.*")
    return _change(rows.groupBy("step"), grid)


def occupancy_counts(frames: DataFrame) -> DataFrame:
    """Occupied cells of each step."""
    return frames.groupBy("step").agg(F.count(F.lit(1)).alias("occupied")).orderBy("step")


def suitable_counts(series: list[DataFrame], steps: int, threshold: float) -> DataFrame:
    """(step, suitable): cells at or above the threshold at each step between the surfaces, from step 1 on; one pass."""
    field = _field(series)
    marks = {t: in_range(_suitability(t, steps), threshold) for t in range(1, (len(series) - 1) * steps + 1)}
    counted = field.agg(*(F.count(F.when(on, 1)).alias(f"s{t}") for t, on in marks.items()))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(t).alias("step"), F.col(f"s{t}").alias("suitable")) for t in marks))).alias("s")).select("s.*")


def occupancy_curve(frames: DataFrame, series: list[DataFrame], steps: int, threshold: float) -> DataFrame:
    """(step, occupied, suitable): the first step has no suitable count."""
    return occupancy_counts(frames).join(suitable_counts(series, steps, threshold), "step", "left")


def interpolate(a: Column, b: Column, weight: Column | float) -> Column:
    """Suitability between two times; null if either is."""
    return (1 - weight) * a + weight * b


def disk(radius: int) -> list[tuple[int, int]]:
    """Offsets of cells within a radius, the centre left out."""
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if (i or j) and i * i + j * j <= radius * radius]


def _field(series: list[DataFrame]) -> DataFrame:
    """(row, col, v0, v1, ...) of surfaces on one grid."""
    named = [v.select("row", "col", F.col("value").alias(f"v{i}")) for i, v in enumerate(series)]
    return reduce(lambda a, b: a.join(b, ["row", "col"], "full"), named)


def _suitability(step: int, steps: int) -> Column:
    """Suitability at a step counted from 1, ``steps`` of them between a surface and the next."""
    i = (step - 1) // steps
    return interpolate(F.col(f"v{i}"), F.col(f"v{i + 1}"), ((step - 1) % steps + 1) / steps)


def dispersal(surface_a: DataFrame, surface_b: DataFrame, start: DataFrame, steps: int, threshold: float, radius: int = 1, p_colonise: float = 0.6, p_survive: float = 0.2, seed: int = 42) -> DataFrame:
    """``dispersal_series`` between two surfaces."""
    return dispersal_series([surface_a, surface_b], start, steps, threshold, radius, p_colonise, p_survive, seed)


def dispersal_series(series: list[DataFrame], start: DataFrame, steps: int, threshold: float, radius: int = 1, p_colonise: float = 0.6, p_survive: float = 0.2, seed: int = 42) -> DataFrame:
    """(step, row, col) of occupied cells: a stochastic automaton whose draws are hashes of seed, step and cell.

    There are ``steps`` steps between a surface and the next, with suitability
    interpolated.  A step reaches cells within the radius of occupied ones,
    colonises those that are suitable with a chance that grows with suitability,
    and keeps occupied cells that are suitable or lucky.  Every step is written to
    the shared folder; only occupied cells are carried on.
    """
    spark = series[0].sparkSession
    root = shared_dir(spark, "dispersal")
    field = materialise(_field(series), "field")
    draw = lambda t, k: F.pmod(F.xxhash64(F.lit(seed), F.lit(t), F.lit(k), "row", "col"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    reach = F.explode(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("own")), *(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(False).alias("own")) for i, j in disk(radius))))
    occupied = start.select("row", "col").distinct().join(field.filter(F.col("v0").isNotNull()).select("row", "col"), ["row", "col"], "left_semi")
    write_table(occupied.withColumn("step", F.lit(0)), f"{root}/step=0")
    last = (len(series) - 1) * steps
    for t in range(1, last + 1):
        occupied = spark.read.parquet(f"{root}/step={t - 1}").select("row", "col")
        near = occupied.withColumn("k", reach).groupBy((F.col("row") + F.col("k.i")).alias("row"), (F.col("col") + F.col("k.j")).alias("col")).agg(F.max("k.own").alias("own"))
        met = near.join(field, ["row", "col"]).withColumn("s", F.coalesce(_suitability(t, steps), F.lit(0.0)))
        good = F.col("s") >= threshold
        chance = p_colonise * F.least(F.greatest(F.col("s") / max(threshold, 1e-9), F.lit(0.0)), F.lit(1.0))
        stays = F.col("own") & (good | (draw(t, 1) < p_survive))
        comes = ~F.col("own") & good & (draw(t, 0) < chance)
        write_table(met.filter(stays | comes).select("row", "col", F.lit(t).alias("step")), f"{root}/step={t}")
    remove_table(field)
    return spark.read.parquet(*(f"{root}/step={t}" for t in range(last + 1))).select("step", "row", "col")


# -- climate choice -------------------------------------------------------------------------------


def paleo_slice(ka: Column) -> Column:
    """Palaeoclimate slice of a date in ka: the first whose inclusive bounds hold it, LH in any gap."""
    return F.coalesce(first_case(((ka <= old) & (ka >= young), name) for name, old, young in PALEO_SLICES), F.lit("LH"))


def nearest_climate(bp: Column, slices: tuple[str, ...] = ("mid",)) -> Column:
    """Climate of a date: the candidate nearest in time, a palaeo slice before the current one if equal."""
    options = [(n, float(y)) for n, y in CLIMATE_SLICES if n in slices] + [("current", CURRENT_BP)]
    ranked = F.sort_array(F.array(*(F.struct(F.abs(bp - y).alias("gap"), F.lit(i).alias("o"), F.lit(n).alias("slice")) for i, (n, y) in enumerate(options))))
    first = F.get(ranked, F.lit(0))
    return F.struct(first["slice"].alias("slice"), first["gap"].alias("gap"))


def bio_scale(number: Column) -> Column:
    """What a bioclimatic layer of the 1.4 release is divided by."""
    return F.when(number.isin(*SCALE10_BIOS), 10.0).otherwise(1.0)
