"""Filters, period, zone and coordinate assignment, and source merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import ALL_ANIMALS, ALL_TAXA, COORD_QUALITY, HUMAN_TAXON, NO_QUALITY, PERIODS, REGION_CENTROIDS, ZONES, first_case, period_order
from ..functions.text import any_of, normalised_site, taxon_group, with_human
from ..schema import no_nan
from ..shared import materialise

#: A lookup side is broadcast up to this many rows and joined by shuffle beyond.
BROADCAST_ROWS = 100_000
#: So many rows of a name and a period are, some hundred bytes each.
BROADCAST_NAMES = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; counted first, so for what is cheap to read."""
    return F.broadcast(df) if is_small(df, rows) else df


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def _join_sites(rows: DataFrame, lookup: DataFrame, how: str = "left") -> DataFrame:
    """Rows with the lookup of their ``_key`` (a row for each key, written once: it is counted, then joined).

    Beyond a size that can be broadcast the unnamed sites, which share the empty
    key, are answered by themselves: they may be most rows.
    """
    held = materialise(lookup, "lookup")
    if is_small(held):
        return rows.join(F.broadcast(held), "_key", how)
    unnamed = F.broadcast(held.filter(F.col("_key") == "").drop("_key"))  # one row at most
    named = rows.filter(F.col("_key") != "").join(held.filter(F.col("_key") != ""), "_key", how)
    return named.unionByName(rows.filter(F.col("_key") == "").join(unnamed, F.lit(True), how), allowMissingColumns=True)


def _join_names(rows: DataFrame, modes: DataFrame, site: str) -> DataFrame:
    """Rows with the mode (_site, _key, _mode: a row for each written name) of their site, null where it has none.

    Beyond a size that can be broadcast the written forms of no name are answered
    by themselves: they may be most rows.
    """
    held = materialise(modes, "modes")
    same = F.col(site).eqNullSafe(F.col("_site"))
    if is_small(held, BROADCAST_NAMES):
        return rows.join(F.broadcast(held.drop("_key")), same, "left").drop("_site")
    marked = rows.join(F.broadcast(held.filter(F.col("_key") == "").drop("_key").withColumn("_none", F.lit(True))), same, "left").drop("_site")
    named = marked.filter(F.col("_none").isNull() & F.col(site).isNotNull()).drop("_mode").join(held.filter(F.col("_key") != "").drop("_key"), F.col(site) == F.col("_site"), "left").drop("_site")
    return named.unionByName(marked.filter(F.col("_none").isNotNull() | F.col(site).isNull())).drop("_none")


# -- filters -----------------------------------------------------------------------------


def filter_region(df: DataFrame, bbox: tuple[float, float, float, float] | None = None, regions: list[str] | None = None) -> DataFrame:
    """Rows with coordinates, inside an inclusive box (lon_min, lat_min, lon_max, lat_max) and matching any region pattern."""
    out = df.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    if bbox:
        out = out.filter(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3]))
    if regions:
        out = out.filter(F.coalesce(F.col("region").rlike("(?i)" + "|".join(regions)), F.lit(False)))
    return out


def quality_filter(df: DataFrame, cn_range: tuple[float, float] = (2.9, 3.6), require: str = "any") -> DataFrame:
    """Rows whose C:N ratio is in range or unknown; ``require`` collagen or apatite values."""
    out = df.filter(F.col("CN").isNull() | F.col("CN").between(*cn_range))
    if require == "collagen":
        return out.filter(F.col("d13C_coll").isNotNull() & F.col("d15N_coll").isNotNull())
    if require == "apatite":
        return out.filter(F.col("d13C_ap").isNotNull() | F.col("d18O_ap").isNotNull())
    if require != "any":
        raise ValueError(f"require must be any, collagen or apatite, not {require!r}")
    return out


def select_rows(df: DataFrame, taxon: str | None = None, periods: list[str] | None = None, zones: list[str] | None = None) -> DataFrame:
    """A slice of the dataset; two names stand for all taxa and for all animals."""
    out = df
    if taxon == ALL_ANIMALS:
        out = out.filter(F.col("taxon_group") != HUMAN_TAXON)
    elif taxon and taxon != ALL_TAXA:
        out = out.filter(F.col("taxon_group") == taxon)
    for name, chosen in (("period", periods), ("zone", zones)):
        if chosen:
            out = out.filter(F.col(name).isin(*chosen))
    return out


def distinct_sites(df: DataFrame) -> DataFrame:
    """Distinct complete (site, lat, lon)."""
    return df.select("site", "lat", "lon").dropna().distinct()


def valid_samples(df: DataFrame) -> DataFrame:
    """Rows with a usable sample id."""
    return df.filter(F.col("sample_id").isNotNull() & ~F.col("sample_id").isin("", "nan", "None"))


def pooled_animals(df: DataFrame, pooled: str = ALL_ANIMALS) -> DataFrame:
    """Animal rows, each once under its own group and once under the pooled one (one scan, no union)."""
    animals = df.filter(F.col("taxon_group") != HUMAN_TAXON)
    return animals.withColumn("taxon_group", F.explode(F.array(F.col("taxon_group"), F.lit(pooled))))


def bounding_box(df: DataFrame, buffer: float = 3.0, ratio: float | None = None) -> DataFrame:
    """One row: the box of all points, widened by degrees or by a share of its extent."""
    box = df.agg(*(f(c).alias(f"{c}_{n}") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))))
    pad = lambda c: F.lit(buffer) if ratio is None else (F.col(f"{c}_max") - F.col(f"{c}_min")) * ratio
    return box.select(*((F.col(f"{c}_{n}") + sign * pad(c)).alias(f"{c}_{n}") for c in ("lon", "lat") for n, sign in (("min", -1), ("max", 1))))


# -- periods --------------------------------------------------------------------------------


def any_midpoint() -> Column:
    """Middle of both bounds, or the bound there is."""
    up, low = F.col("bp_upper"), F.col("bp_lower")
    return F.coalesce((up + low) / 2, up, low)


def period_by_date(mid: Column, periods=PERIODS) -> Column:
    """First period that holds a date: one comparison for each bound, from the oldest on."""
    bounds = sorted({float(b) for p in periods for b in (p.bp_start, p.bp_end)}, reverse=True)
    out = F.when(mid > bounds[0], F.lit(None).cast("string"))
    for older, younger in zip(bounds, bounds[1:], strict=False):
        holds = next((p.key for p in periods if younger >= p.bp_end and older <= p.bp_start), None)
        out = out.when(mid > younger, F.lit(holds).cast("string"))
    return out


def period_by_culture(culture: Column, periods=PERIODS) -> Column:
    """First period one of whose keywords the culture contains."""
    s = F.lower(F.coalesce(culture, F.lit("")))
    return first_case((s.rlike(any_of(p.keywords)), p.key) for p in periods if p.keywords)


def assign_period(df: DataFrame, periods=PERIODS, culture: str = "culture", out: str = "period") -> DataFrame:
    """Period by date, else by culture (also for dates outside all periods)."""
    by_date = period_by_date(any_midpoint(), periods)
    return df.withColumn(out, F.coalesce(by_date, period_by_culture(F.col(culture), periods)) if culture in df.columns else by_date)


def inherit_period(df: DataFrame, period: str = "period", site: str = "site", unnamed: bool = True) -> DataFrame:
    """Rows without a period take their site's most frequent one (the first by name of equals).

    Unnamed sites count as one site unless ``unnamed`` is false.  Rows are counted
    by the name as it is written: names are normalised once each, not row by row,
    and the lookup has a row for each.
    """
    # rows without a period are counted too, then left out: a filter would repeat the period's expression below
    written = df.groupBy(F.col(site).alias("_site"), F.col(period).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    named = materialise(written.withColumn("_key", normalised_site(F.col("_site"))), "site-periods")
    counted = named.groupBy("_key", "_p").agg(F.sum("_n").alias("_n"))
    if not unnamed:
        counted = counted.filter(F.col("_key") != "")
    known = F.when(F.col("_n") > 0, F.col("_p"))
    top = counted.groupBy("_key").agg(F.min_by(known, F.when(known.isNotNull(), F.struct(-F.col("_n"), known))).alias("_mode"))
    modes = named.select("_site", "_key").distinct().join(top.filter(F.col("_mode").isNotNull() | (F.col("_key") == "")), "_key")
    out = _join_names(df, modes, site)
    need = F.col(period).isNull() & F.col("_mode").isNotNull()
    return out.withColumn("inherited", need).withColumn(period, F.coalesce(period, "_mode")).drop("_mode")


def period_rank(period: Column) -> Column:
    """Ordinal of a period key."""
    return F.element_at(period_order(), period)


# -- zones and coordinates ----------------------------------------------------------------------


def assign_zone(df: DataFrame, zones=ZONES, out: str = "zone") -> DataFrame:
    """First zone whose inclusive box holds the point: a CASE, so no range join."""
    inside = lambda z: F.col("lon").between(z[1], z[3]) & F.col("lat").between(z[2], z[4])
    return df.withColumn(out, first_case((inside(z), z[0]) for z in zones))


def build_gazetteer(df: DataFrame, source: str = "name_match", order: str | None = None) -> DataFrame:
    """(key, site, lat, lon, coord_source): median coordinates and first name of each normalised site."""
    place = F.col(order) if order else F.monotonically_increasing_id()
    named = df.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("site", "lat", "lon", place.alias("_o")).withColumn("key", normalised_site(F.col("site"))).filter(F.col("key") != "")
    return named.groupBy("key").agg(F.min_by("site", "_o").alias("site"), F.median("lat").alias("lat"), F.median("lon").alias("lon")).withColumn("coord_source", F.lit(source))


def merge_gazetteers(*gazetteers: DataFrame) -> DataFrame:
    """All entries; of one key that of the earliest gazetteer."""
    tagged = [g.withColumn("_p", F.lit(i)) for i, g in enumerate(gazetteers)]
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return first_by(joined, ["key"], [F.col("_p")]).drop("_p")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order; ties go by the columns in the order of their names, nulls last, so partitions do not matter."""
    ties = [F.col(f"`{f.name}`").asc_nulls_last() for f in sorted(df.schema.fields, key=lambda f: f.name) if f.name not in keys and "map<" not in f.dataType.simpleString()]
    w = Window.partitionBy(*keys).orderBy(*order, *ties)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def resolve_coordinates(df: DataFrame, gazetteer: DataFrame | None, use_approx: bool = False) -> DataFrame:
    """Fill both coordinates where either is missing: by site name, then (optionally) by region.

    Adds coord_source and coord_quality.  Given coordinates count as exact.
    """
    have = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    if "coord_source" not in df.columns:
        df = df.withColumn("coord_source", F.lit(None).cast("string"))
    out = df.withColumn("_have", have).withColumn("coord_source", F.when(have, F.coalesce("coord_source", F.lit("exact"))).otherwise(F.col("coord_source")))
    if gazetteer is not None:
        known = gazetteer.select(F.col("key").alias("_key"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.coalesce("coord_source", F.lit("manual")).alias("_source"))
        out = out.withColumn("_key", normalised_site(F.col("site"))).transform(lambda d: _join_sites(d, known))
        need = ~F.col("_have") & F.col("_lat").isNotNull()
        out = out.withColumns({"lat": F.when(need, F.col("_lat")).otherwise(F.col("lat")), "lon": F.when(need, F.col("_lon")).otherwise(F.col("lon")), "coord_source": F.when(need, F.col("_source")).otherwise(F.col("coord_source"))}).drop("_key", "_lat", "_lon", "_source")
    if use_approx:
        region = F.lower(F.trim("region"))
        centre = lambda k: first_case((region == name, float(point[k])) for name, point in REGION_CENTROIDS.items())
        fill = (F.col("lat").isNull() | F.col("lon").isNull()) & centre(0).isNotNull()
        out = out.withColumn("_fill", fill)
        out = out.withColumns({"lat": F.when(F.col("_fill"), centre(0)).otherwise(F.col("lat")), "lon": F.when(F.col("_fill"), centre(1)).otherwise(F.col("lon")), "coord_source": F.when(F.col("_fill"), F.lit("approx")).otherwise(F.col("coord_source"))}).drop("_fill")
    quality = first_case((F.col("coord_source") == s, label) for s, label in COORD_QUALITY.items())
    return out.drop("_have").withColumn("coord_quality", F.coalesce(quality, F.lit(NO_QUALITY)))


def unresolved_sites(df: DataFrame) -> DataFrame:
    """Distinct (site, region, key) that still lack a coordinate."""
    return df.filter(F.col("lat").isNull() | F.col("lon").isNull()).select("site", "region", normalised_site(F.col("site")).alias("key")).distinct()


# -- merging sources ------------------------------------------------------------------------------


def merge_apatite(collagen: DataFrame, apatite: DataFrame, order: str = "ord") -> DataFrame:
    """Collagen rows with the first apatite values of their sample, then apatite rows that matched none.

    Keys are (site, sample_id, group), and missing sites match.  Apatite rows
    with an unusable sample id or without values never match and are appended.
    """
    keys = ["site", "sample_id", "group"]
    usable = valid_samples(apatite.filter(F.col("d13C_ap").isNotNull() | F.col("d18O_ap").isNotNull()))
    one = first_by(usable, keys, [F.col(order)]).select(*(F.col(k).alias(f"_{k}") for k in keys), "d13C_ap", "d18O_ap")
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    merged = collagen.join(one, same, "left").drop(*(f"_{k}" for k in keys))
    matched = merged.filter(F.col("d13C_ap").isNotNull() | F.col("d18O_ap").isNotNull()).select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    alone = apatite.join(matched, same, "left_anti")
    return merged.unionByName(alone, allowMissingColumns=True)


def union_sources(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def join_extra(points: DataFrame, table: DataFrame, on: str, suffix: str = "_iso") -> DataFrame:
    """Left join; columns that both sides have get ``suffix`` on the right."""
    taken = {c.lower() for c in points.columns if c != on}
    renamed = table.select(*(F.col(c).alias(c + suffix if c != on and c.lower() in taken else c) for c in table.columns))
    return points.join(renamed, on, "left")


def calendar_to_bp(low: Column, high: Column) -> tuple[Column, Column]:
    """(bp_upper, bp_lower) of two calendar years in either order; one may be missing."""
    return 1950 - F.least(low, high), 1950 - F.greatest(low, high)


def with_taxon_group(df: DataFrame) -> DataFrame:
    return df.withColumn("taxon_group", with_human(F.col("group"), taxon_group(F.col("taxon"))))


def clean_numbers(df: DataFrame, columns) -> DataFrame:
    """NaN to null in number columns."""
    return df.withColumns({c: no_nan(F.col(c)) for c in columns})


def available_models(models: DataFrame, sites: Column | int) -> DataFrame:
    """Models with a flag and, for those that need more sites, the reason."""
    n = F.lit(sites) if isinstance(sites, int) else sites
    ok = n >= F.col("min_sites")
    reason = F.when(~ok, F.concat(F.lit("needs "), F.col("min_sites").cast("string"), F.lit(" sites, has "), n.cast("string")))
    return models.withColumn("available", ok).withColumn("reason", reason)
