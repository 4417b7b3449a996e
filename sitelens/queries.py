"""Registered queries of the habitat and isotope operators, each with its DuckDB oracle."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dims, fixtures
from .functions import text
from .operators import enrich, grid, isoscape, maxent, models, niche, scenario, summary, terrain, validate
from .schema import stable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

GRID = grid.Grid(a=0.5, c=105.0, e=-0.5, f=56.0, height=46, width=72)
SEED = 42


# -- building blocks of the oracles --------------------------------------------------------


def _r(expression: str) -> str:
    return f"floor(({expression}) * 1e6 + 0.50001e0) / 1e6"


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _case(branches, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {default} END"


_S = "lower(trim(taxon))"
_TAXON = f"CASE WHEN {_S} IS NULL OR {_S} IN ('', 'nan') THEN {_q(dims.OTHER_TAXON)} ELSE coalesce(" + ", ".join(
    [
        _case([(f"{_S} IN ({', '.join(map(_q, names))})", _q(g)) for g, names in dims.TAXA]),
        _case([(" OR ".join(f"contains({_S}, {_q(n)})" for n in names), _q(g)) for g, names in dims.TAXA]),
        _q(dims.OTHER_TAXON),
    ]
) + ") END"
_BY_DATE = _case([(f"anymid <= {p.bp_start} AND anymid > {p.bp_end}", _q(p.key)) for p in dims.PERIODS])
_BY_CULTURE = _case([(" OR ".join(f"contains(lower(coalesce(culture, '')), {_q(k)})" for k in p.keywords), _q(p.key)) for p in dims.PERIODS])
_ZONE = _case([(f"lon BETWEEN {a} AND {c} AND lat BETWEEN {b} AND {d}", _q(z)) for z, a, b, c, d in dims.ZONES])
_ORDINAL = lambda c: _case([(f"{c} = {_q(p.key)}", str(i)) for i, p in enumerate(dims.PERIODS)])

_BASE = {
    **{name: sql for name, sql in fixtures.ALL.items()},
    "spec": f"""SELECT *, CASE WHEN taxon = 'Human' THEN 'human' ELSE 'animal' END AS grp, CASE WHEN orderkey % 3 = 0 THEN 'A' ELSE 'B' END AS source,
        (bp_upper + bp_lower) / 2 AS bp_mid, coalesce((bp_upper + bp_lower) / 2, bp_upper, bp_lower) AS anymid,
        CASE WHEN taxon = 'Human' THEN {_q(dims.HUMAN_TAXON)} ELSE {_TAXON} END AS taxon_group FROM fx_specimen""",
    "en": f"SELECT *, coalesce({_BY_DATE}, {_BY_CULTURE}) AS period, {_ZONE} AS zone FROM spec",
    "cells": "SELECT CAST(row_id AS INTEGER) AS row, CAST(col_id AS INTEGER) AS col, x, y, elev, bio1, bio12 FROM fx_cell",
    "means": "SELECT site, lat, lon, avg(d13c_coll) AS value, count(*) AS n, stddev_samp(d13c_coll) AS sd FROM fx_specimen WHERE d13c_coll IS NOT NULL AND site IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL GROUP BY ALL",
    "located": "SELECT DISTINCT site, CAST(floor((56e0 - lat) / 0.5e0) AS INTEGER) AS row, CAST(floor((lon - 105e0) / 0.5e0) AS INTEGER) AS col FROM fx_site",
    "extracted": "SELECT l.site, l.row, l.col, c.x, c.y, c.elev, c.bio1, c.bio12 FROM located l JOIN cells c ON l.row = c.row AND l.col = c.col WHERE c.elev IS NOT NULL AND c.bio1 IS NOT NULL AND c.bio12 IS NOT NULL",
    "thinned": "SELECT * FROM extracted QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY site) = 1",
    "surf": "SELECT row, col, x, y, CASE WHEN bio12 IS NULL THEN NULL ELSE (CAST(elev AS BIGINT) % 100) / 100e0 END AS a, ((CAST(elev AS BIGINT) * 7) % 100) / 100e0 AS b FROM cells",
    "every_background": "SELECT row, col, x, y, elev, bio1, bio12 FROM cells WHERE bio1 IS NOT NULL AND bio12 IS NOT NULL",
    "background": f"""SELECT row, col, x, y, elev, bio1, bio12 FROM cells WHERE bio1 IS NOT NULL AND bio12 IS NOT NULL
        ORDER BY (((CAST(row AS BIGINT) * 73856093 + CAST(col AS BIGINT) * 19349663 + {SEED}) % 2147483647) * 48271 + 11) % 2147483647, row, col LIMIT 500""",
}
_NEEDS = {"spec": ["fx_specimen"], "en": ["spec"], "cells": ["fx_cell"], "means": ["fx_specimen"], "located": ["fx_site"], "extracted": ["located", "cells"], "thinned": ["extracted"], "surf": ["cells"], "background": ["cells"], "every_background": ["cells"]}


def _with(*names: str, recursive: bool = False) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{n} AS ({_BASE[n]})" for n in order) + " "


def query(name: str, oracle: str | None = None):
    """Register a query and its oracle."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture in the standard layout, with its row key."""
    rows = fixtures.fixture(spark, sf_dir, "fx_specimen")
    rows = rows.withColumnsRenamed({"d13c_coll": "d13C_coll", "d15n_coll": "d15N_coll", "cn": "CN"})
    rows = rows.withColumns({"group": F.when(F.col("taxon") == "Human", "human").otherwise("animal"), "source": F.when(F.col("orderkey") % 3 == 0, "A").otherwise("B"), "d13C_ap": F.lit(None).cast("double"), "d18O_ap": F.lit(None).cast("double")})
    return enrich.with_taxon_group(rows)


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.assign_zone(enrich.assign_period(_specimens(spark, sf_dir)))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.fixture(spark, sf_dir, "fx_cell").select(F.col("row_id").cast("int").alias("row"), F.col("col_id").cast("int").alias("col"), "x", "y", "elev", "bio1", "bio12")


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.fixture(spark, sf_dir, "fx_site")


def _surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir)
    e = F.col("elev").cast("long")
    return c.select("row", "col", "x", "y", F.when(F.col("bio12").isNotNull(), (e % 100) / F.lit(100.0)).alias("a"), ((e * 7) % 100 / F.lit(100.0)).alias("b"))


def _background(spark: SparkSession, sf_dir: str, n: int = 500) -> DataFrame:
    return grid.sample_background(_cells(spark, sf_dir), n, ["bio1", "bio12"], rank=grid.lcg_rank(SEED))


def _thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.presence_matrix(_sites(spark, sf_dir), _cells(spark, sf_dir), GRID, ["elev", "bio1", "bio12"])


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: stable(F.col(c)) for c in columns})


# -- filters and projections ------------------------------------------------------------------


@query("region_filter", _with("fx_specimen") + "SELECT orderkey, line, lon, lat, region FROM fx_specimen WHERE lon BETWEEN 112 AND 134 AND lat BETWEEN 36 AND 50 AND regexp_matches(region, '(?i)nation_1|_2$')")
def _(spark, d):
    return enrich.filter_region(_specimens(spark, d), (112, 36, 134, 50), ["nation_1", "_2$"]).select("orderkey", "line", "lon", "lat", "region")


@query("quality_filter", _with("fx_specimen") + "SELECT orderkey, line, cn FROM fx_specimen WHERE (cn IS NULL OR cn BETWEEN 2.9e0 AND 3.6e0) AND d13c_coll IS NOT NULL AND d15n_coll IS NOT NULL")
def _(spark, d):
    return enrich.quality_filter(_specimens(spark, d), require="collagen").select("orderkey", "line", F.col("CN").alias("cn"))


@query("dataset_slice", _with("en") + f"SELECT orderkey, line, taxon_group, period, zone FROM en WHERE taxon_group <> {_q(dims.HUMAN_TAXON)} AND period IN ('EIA', 'HAN') AND zone IN ({_q(dims.ZONES[2][0])}, {_q(dims.ZONES[6][0])})")
def _(spark, d):
    return enrich.select_rows(_enriched(spark, d), dims.ALL_ANIMALS, ["EIA", "HAN"], [dims.ZONES[2][0], dims.ZONES[6][0]]).select("orderkey", "line", "taxon_group", "period", "zone")


@query("distinct_sites", _with("fx_specimen") + "SELECT DISTINCT site, lat, lon FROM fx_specimen WHERE site IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
def _(spark, d):
    return enrich.distinct_sites(_specimens(spark, d))


@query("dated_rows", _with("en") + "SELECT orderkey, line, period FROM en WHERE period IS NOT NULL")
def _(spark, d):
    return _enriched(spark, d).filter(F.col("period").isNotNull()).select("orderkey", "line", "period")


@query("valid_samples", _with("fx_collagen") + "SELECT ord, sample_id FROM fx_collagen WHERE sample_id IS NOT NULL AND sample_id NOT IN ('', 'nan', 'None')")
def _(spark, d):
    return enrich.valid_samples(fixtures.fixture(spark, d, "fx_collagen")).select("ord", "sample_id")


@query("pooled_animals", _with("en") + f"SELECT taxon_group, count(*) AS n FROM (SELECT taxon_group FROM en WHERE taxon_group <> {_q(dims.HUMAN_TAXON)} UNION ALL SELECT {_q(dims.ALL_ANIMALS)} FROM en WHERE taxon_group <> {_q(dims.HUMAN_TAXON)}) GROUP BY 1")
def _(spark, d):
    return enrich.pooled_animals(_enriched(spark, d)).groupBy("taxon_group").agg(F.count(F.lit(1)).alias("n"))


@query("bbox", _with("fx_site") + f"SELECT {_r('min(lon) - 0.25e0 * (max(lon) - min(lon))')} AS lon_min, {_r('max(lon) + 0.25e0 * (max(lon) - min(lon))')} AS lon_max, {_r('min(lat) - 0.25e0 * (max(lat) - min(lat))')} AS lat_min, {_r('max(lat) + 0.25e0 * (max(lat) - min(lat))')} AS lat_max FROM fx_site")
def _(spark, d):
    return _rounded(enrich.bounding_box(_sites(spark, d), ratio=0.25), "lon_min", "lon_max", "lat_min", "lat_max")


@query("model_availability", _with("fx_site") + "SELECT m.model, CAST(m.min_sites AS INTEGER) AS min_sites, 9 >= m.min_sites AS available, CASE WHEN 9 < m.min_sites THEN 'needs ' || m.min_sites || ' sites, has 9' END AS reason FROM (VALUES ('bioclim', 3), ('mahalanobis', 4), ('glm', 5), ('gam', 8), ('rf', 10), ('brt', 15), ('maxent', 5)) m(model, min_sites)")
def _(spark, d):
    return enrich.available_models(dims.model_table(spark), 9)


# -- scalar functions ------------------------------------------------------------------------


@query("taxon_class", _with("spec") + "SELECT taxon, taxon_group, count(*) AS n FROM spec GROUP BY 1, 2")
def _(spark, d):
    return _specimens(spark, d).groupBy("taxon", "taxon_group").agg(F.count(F.lit(1)).alias("n"))


@query("number_parse", "SELECT DISTINCT s, CASE WHEN regexp_matches(trim(s), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(trim(s) AS DOUBLE) END AS v, regexp_matches(trim(replace(s, ',', '')), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') AS numeric_like FROM (SELECT CASE o_orderkey % 6 WHEN 0 THEN ' ' || CAST(o_orderkey % 100 AS VARCHAR) || '.5 ' WHEN 1 THEN 'nan' WHEN 2 THEN '1,2' || CAST(o_orderkey % 10 AS VARCHAR) WHEN 3 THEN '1d' WHEN 4 THEN '-3e' || CAST(o_orderkey % 3 AS VARCHAR) ELSE 'n/a' END AS s FROM orders)")
def _(spark, d):
    k = F.col("o_orderkey")
    t = lambda n: (k % n).cast("string")
    s = F.when(k % 6 == 0, F.concat(F.lit(" "), t(100), F.lit(".5 "))).when(k % 6 == 1, "nan").when(k % 6 == 2, F.concat(F.lit("1,2"), t(10))).when(k % 6 == 3, "1d").when(k % 6 == 4, F.concat(F.lit("-3e"), t(3))).otherwise("n/a")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(s.alias("s")).distinct()
    return rows.select("s", text.to_number(F.col("s")).alias("v"), text.is_number(F.col("s")).alias("numeric_like"))


_DATES = {"1200-400 BCE": (3150, 2350), "398–494 AD": (1552, 1456), "265-420AD": (1685, 1530), "100BC-390AD": (2050, 1560), "B.C 2 - A.D 1": (2150, 1850), "": None, "no date": None, "500": (1450, 1450), "3-4 CE": (1749, 1550)}


@query("date_range_parse", "SELECT s, CAST(u AS DOUBLE) AS bp_upper, CAST(l AS DOUBLE) AS bp_lower FROM (VALUES " + ", ".join(f"({_q(k)}, {v[0] if v else 'NULL'}, {v[1] if v else 'NULL'})" for k, v in _DATES.items()) + ") t(s, u, l)")
def _(spark, d):
    rows = spark.createDataFrame([(k,) for k in _DATES], "s string")
    r = text.date_range(F.col("s"))
    return rows.select("s", r["bp_upper"].alias("bp_upper"), r["bp_lower"].alias("bp_lower"))


@query("calendar_to_bp", "SELECT o_orderkey, CAST(1950 - least(a, b) AS DOUBLE) AS bp_upper, CAST(1950 - greatest(a, b) AS DOUBLE) AS bp_lower FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 4000 - 2500 AS DOUBLE) END AS a, CAST(o_custkey % 3000 - 2000 AS DOUBLE) AS b FROM orders)")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 4000 - 2500).cast("double")).alias("a"), (F.col("o_custkey") % 3000 - 2000).cast("double").alias("b"))
    up, low = enrich.calendar_to_bp(F.col("a"), F.col("b"))
    return o.select("o_orderkey", up.alias("bp_upper"), low.alias("bp_lower"))


@query("region_names", "SELECT n_name AS region, " + _case([(f"lower(trim(n_name)) = {_q(k)}", _q(v)) for k, v in dims.REGION_SPELLINGS.items()], "trim(n_name)") + " AS fixed FROM nation UNION ALL SELECT s, f FROM (VALUES (' transbaika', 'Transbaikal'), ('Jillin Province', 'Jilin'), ('', NULL)) t(s, f)")
def _(spark, d):
    names = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("region")).union(spark.createDataFrame([(" transbaika",), ("Jillin Province",), ("",)], "region string"))
    return names.select("region", text.region_name(F.col("region")).alias("fixed"))


@query("site_keys", _with("fx_site") + "SELECT site, lower(site) AS key FROM fx_site UNION ALL SELECT * FROM (VALUES ('Pospelovo I', 'pospelovo 1'), ('Lamadong Site', 'lamadong'), ('Atsai-II', 'atsai 2'), ('Troitsky cemetery', 'troitsky'), ('nan', '')) t(s, k)")
def _(spark, d):
    names = _sites(spark, d).select("site").union(spark.createDataFrame([("Pospelovo I",), ("Lamadong Site",), ("Atsai-II",), ("Troitsky cemetery",), ("nan",)], "site string"))
    return names.select("site", text.normalised_site(F.col("site")).alias("key"))


@query("diet_class", _with("en") + "SELECT taxon_group, CASE WHEN d13c_coll IS NULL THEN 'unknown' WHEN d13c_coll < -18 THEN 'C3' WHEN d13c_coll > -12 THEN 'C4' ELSE 'mixed' END AS diet, count(*) AS n FROM en GROUP BY 1, 2")
def _(spark, d):
    return _enriched(spark, d).groupBy("taxon_group", summary.diet_class(F.col("d13C_coll")).alias("diet")).agg(F.count(F.lit(1)).alias("n"))


# -- periods, zones, coordinates -----------------------------------------------------------------


@query("period_by_date", _with("spec") + f"SELECT orderkey, line, {_BY_DATE} AS period FROM spec")
def _(spark, d):
    return _specimens(spark, d).select("orderkey", "line", enrich.period_by_date(enrich.any_midpoint()).alias("period"))


@query("period_assign", _with("en") + "SELECT orderkey, line, period FROM en")
def _(spark, d):
    return enrich.assign_period(_specimens(spark, d)).select("orderkey", "line", "period")


@query("period_inherit", _with("en") + "SELECT e.orderkey, e.line, coalesce(e.period, m.period) AS period, e.period IS NULL AND m.period IS NOT NULL AS inherited FROM (SELECT * REPLACE (CASE WHEN line <= 3 THEN period END AS period) FROM en) e LEFT JOIN (SELECT site, period FROM (SELECT site, period, count(*) AS n FROM en WHERE line <= 3 AND period IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY site ORDER BY n DESC, period) = 1) m ON e.site = m.site")
def _(spark, d):
    rows = _enriched(spark, d).withColumn("period", F.when(F.col("line") <= 3, F.col("period")))
    return enrich.inherit_period(rows).select("orderkey", "line", "period", "inherited")


@query("period_table", "SELECT CAST(o AS INTEGER) AS ordinal, k AS key, CAST(s AS DOUBLE) AS bp_start, CAST(e AS DOUBLE) AS bp_end, CAST((s + e) / 2 AS DOUBLE) AS bp_mid, c AS calendar FROM (VALUES (0, 'EBA', 4000e0, 3500e0, 'BCE 2050~BCE 1550'), (1, 'LBA', 3500e0, 2800e0, 'BCE 1550~BCE 850'), (2, 'EIA', 2800e0, 2200e0, 'BCE 850~BCE 250'), (3, 'HAN', 2200e0, 1700e0, 'BCE 250~CE 250'), (4, 'GOG', 1700e0, 1300e0, 'CE 250~CE 650'), (5, 'BHL', 1300e0, 700e0, 'CE 650~CE 1250')) t(o, k, s, e, c)")
def _(spark, d):
    return dims.period_table(spark).select("ordinal", "key", "bp_start", "bp_end", "bp_mid", "calendar")


@query("zone_assign", _with("en") + "SELECT orderkey, line, zone FROM en")
def _(spark, d):
    return enrich.assign_zone(_specimens(spark, d)).select("orderkey", "line", "zone")


@query("gazetteer_median", _with("fx_specimen") + f"SELECT lower(site) AS key, min_by(site, orderkey * 10 + line) AS site, {_r('median(lat)')} AS lat, {_r('median(lon)')} AS lon, 'name_match' AS coord_source FROM (SELECT site, orderkey, line, lat + (orderkey % 7) / 10e0 AS lat, lon + (orderkey % 5) / 10e0 AS lon FROM fx_specimen) WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1")
def _(spark, d):
    rows = _specimens(spark, d).select("site", (F.col("orderkey") * 10 + F.col("line")).alias("o"), (F.col("lat") + (F.col("orderkey") % 7) / F.lit(10.0)).alias("lat"), (F.col("lon") + (F.col("orderkey") % 5) / F.lit(10.0)).alias("lon"))
    return _rounded(enrich.build_gazetteer(rows, order="o"), "lat", "lon")


_GAZ = "SELECT lower(site) AS key, site, lat, lon, 'manual' AS coord_source FROM fx_site WHERE site_id % 3 <> 0"
_RESOLVED = f"""SELECT s.orderkey, s.line, s.site, s.region,
  coalesce(CASE WHEN s.lat IS NOT NULL AND s.lon IS NOT NULL THEN s.lat END, g.lat, s.lat) AS lat,
  coalesce(CASE WHEN s.lat IS NOT NULL AND s.lon IS NOT NULL THEN s.lon END, g.lon, s.lon) AS lon,
  CASE WHEN s.lat IS NOT NULL AND s.lon IS NOT NULL THEN 'exact' WHEN g.lat IS NOT NULL THEN 'manual' END AS coord_source
FROM fx_specimen s LEFT JOIN ({_GAZ}) g ON lower(s.site) = g.key"""


def _gazetteer(spark: SparkSession, d: str) -> DataFrame:
    known = _sites(spark, d).filter(F.col("site_id") % 3 != 0)
    return known.select(text.normalised_site(F.col("site")).alias("key"), "site", "lat", "lon", F.lit("manual").alias("coord_source"))


@query("coord_resolve", _with("fx_specimen", "fx_site") + f"SELECT orderkey, line, lat, lon, coord_source, " + _case([(f"coord_source = {_q(k)}", _q(v)) for k, v in dims.COORD_QUALITY.items()], _q(dims.NO_QUALITY)) + f" AS coord_quality FROM ({_RESOLVED})")
def _(spark, d):
    return enrich.resolve_coordinates(_specimens(spark, d), _gazetteer(spark, d)).select("orderkey", "line", "lat", "lon", "coord_source", "coord_quality")


@query("unresolved_sites", _with("fx_specimen", "fx_site") + f"SELECT DISTINCT site, region, lower(site) AS key FROM ({_RESOLVED}) WHERE lat IS NULL OR lon IS NULL")
def _(spark, d):
    return enrich.unresolved_sites(enrich.resolve_coordinates(_specimens(spark, d), _gazetteer(spark, d)))


@query("dedup_priority", _with("fx_site") + f"SELECT * FROM ({_GAZ}) UNION ALL SELECT lower(site), site, lat + 1, lon + 1, 'name_match' FROM fx_site WHERE site_id % 3 = 0")
def _(spark, d):
    second = _sites(spark, d).select(text.normalised_site(F.col("site")).alias("key"), "site", (F.col("lat") + 1).alias("lat"), (F.col("lon") + 1).alias("lon"), F.lit("name_match").alias("coord_source"))
    return enrich.merge_gazetteers(_gazetteer(spark, d), second)


@query("apatite_merge", _with("fx_collagen", "fx_apatite") + """, one AS (
  SELECT site, sample_id, grp, d13c_ap, d18o_ap FROM fx_apatite
  WHERE (d13c_ap IS NOT NULL OR d18o_ap IS NOT NULL) AND sample_id NOT IN ('', 'nan', 'None')
  QUALIFY row_number() OVER (PARTITION BY site, sample_id, grp ORDER BY ord, d13c_ap NULLS LAST, d18o_ap NULLS LAST) = 1
), merged AS (
  SELECT c.ord, c.site, c.sample_id, c.grp, c.d13c_coll, o.d13c_ap, o.d18o_ap FROM fx_collagen c
  LEFT JOIN one o ON c.site IS NOT DISTINCT FROM o.site AND c.sample_id = o.sample_id AND c.grp = o.grp
)
SELECT ord, site, sample_id, grp, d13c_coll, d13c_ap, d18o_ap FROM merged
UNION ALL
SELECT a.ord, a.site, a.sample_id, a.grp, NULL, a.d13c_ap, a.d18o_ap FROM fx_apatite a
WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE (m.d13c_ap IS NOT NULL OR m.d18o_ap IS NOT NULL) AND m.site IS NOT DISTINCT FROM a.site AND m.sample_id = a.sample_id AND m.grp = a.grp)""")
def _(spark, d):
    collagen = fixtures.fixture(spark, d, "fx_collagen").withColumnsRenamed({"grp": "group"})
    apatite = fixtures.fixture(spark, d, "fx_apatite").withColumnsRenamed({"grp": "group", "d13c_ap": "d13C_ap", "d18o_ap": "d18O_ap"})
    out = enrich.merge_apatite(collagen, apatite)
    return out.select("ord", "site", "sample_id", F.col("group").alias("grp"), "d13c_coll", F.col("d13C_ap").alias("d13c_ap"), F.col("d18O_ap").alias("d18o_ap"))


@query("points_join", _with("fx_site", "means") + "SELECT s.site, s.lon, s.lat, m.lon AS lon_iso, m.lat AS lat_iso, m.n FROM fx_site s LEFT JOIN means m ON s.site = m.site")
def _(spark, d):
    extra = summary.site_means(_specimens(spark, d), "d13C_coll").select("site", "lat", "lon", "n")
    return enrich.join_extra(_sites(spark, d).select("site", "lon", "lat"), extra, "site").select("site", "lon", "lat", "lon_iso", "lat_iso", "n")


@query("source_union", _with("spec") + "SELECT source, taxon, count(*) AS n FROM (SELECT source, taxon FROM spec UNION ALL SELECT 'C', NULL FROM spec WHERE line = 1) GROUP BY 1, 2")
def _(spark, d):
    s = _specimens(spark, d)
    extra = s.filter("line = 1").select(F.lit("C").alias("source"), "site")
    return enrich.union_sources(s.select("source", "taxon"), extra).groupBy("source", "taxon").agg(F.count(F.lit(1)).alias("n"))


# -- aggregates and windows ----------------------------------------------------------------------


@query("site_summary", _with("en") + f"SELECT period, taxon_group, count(*) AS n, count(DISTINCT site) AS sites, {_r('avg(d13c_coll)')} AS d13c_mean, {_r('stddev_samp(d13c_coll)')} AS d13c_sd, {_r('avg(d15n_coll)')} AS d15n_mean, {_r('stddev_samp(d15n_coll)')} AS d15n_sd FROM en GROUP BY 1, 2")
def _(spark, d):
    t = summary.site_summary(_enriched(spark, d), places=None)
    return t.select("period", "taxon_group", "n", "sites", *(stable(F.col(a)).alias(a.lower()) for a in ("d13C_mean", "d13C_sd", "d15N_mean", "d15N_sd")))


@query("site_means", _with("means") + f"SELECT site, lat, lon, {_r('value')} AS value, n, {_r('sd')} AS sd FROM means")
def _(spark, d):
    return _rounded(summary.site_means(_specimens(spark, d), "d13C_coll"), "value", "sd")


_FLAGSHIP = _with("en") + f"""SELECT zone, period, count(*) AS n, count(DISTINCT site) AS sites,
  count(d13c_coll) AS d13c_n, {_r('avg(d13c_coll)')} AS d13c_mean, {_r('stddev_samp(d13c_coll)')} AS d13c_sd,
  count(d15n_coll) AS d15n_n, {_r('avg(d15n_coll)')} AS d15n_mean, {_r('stddev_samp(d15n_coll)')} AS d15n_sd
FROM en WHERE lon BETWEEN 105 AND 141 AND lat BETWEEN 33 AND 56 AND (cn IS NULL OR cn BETWEEN 2.9e0 AND 3.6e0)
  AND zone IS NOT NULL AND period IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3"""


@query("zone_period", _FLAGSHIP)
def _(spark, d):
    rows = enrich.quality_filter(enrich.filter_region(_specimens(spark, d), (105, 33, 141, 56)))
    t = summary.zone_period_table(enrich.assign_zone(enrich.assign_period(rows)), ["d13C_coll", "d15N_coll"], places=None)
    short = {"d13C_coll": "d13c", "d15N_coll": "d15n"}
    return t.select("zone", "period", "n", "sites", *(F.col(f"{v}_n").alias(f"{s}_n") for v, s in short.items()), *(stable(F.col(f"{v}_{k}")).alias(f"{s}_{k}") for v, s in short.items() for k in ("mean", "sd")))


_PIVOT = lambda what: ", ".join(f"count({what.format(p=_q(p.key))}) AS \"{p.key}\"" for p in dims.PERIODS)


@query("taxon_period_pivot", _with("en") + "SELECT taxon_group, " + _PIVOT("DISTINCT CASE WHEN period = {p} THEN site END") + " FROM en WHERE taxon_group IS NOT NULL GROUP BY 1")
def _(spark, d):
    return summary.cross_tab(_enriched(spark, d), "taxon_group")


@query("zone_period_counts", _with("en") + "SELECT zone, " + _PIVOT("CASE WHEN period = {p} THEN 1 END") + " FROM en WHERE zone IS NOT NULL GROUP BY 1")
def _(spark, d):
    return summary.cross_tab(_enriched(spark, d), "zone", distinct=None)


@query("source_counts", _with("spec") + "SELECT source, count(*) AS n FROM spec GROUP BY 1")
def _(spark, d):
    return summary.source_counts(_specimens(spark, d))


@query("totals", _with("spec") + "SELECT count(*) AS samples, count(DISTINCT site) AS sites FROM spec")
def _(spark, d):
    return summary.totals(_specimens(spark, d))


@query("isoscape_record", _with("means") + f"SELECT count(*) AS sites, CAST(sum(n) AS BIGINT) AS samples, {_r('avg(value)')} AS mean, {_r('min(value)')} AS least, {_r('max(value)')} AS most FROM means")
def _(spark, d):
    return _rounded(summary.isoscape_record(summary.site_means(_specimens(spark, d), "d13C_coll")), "mean", "least", "most")


@query("distinct_values", _with("en") + "SELECT DISTINCT 'period' AS field, period AS value FROM en WHERE period IS NOT NULL UNION ALL SELECT DISTINCT 'zone', zone FROM en WHERE zone IS NOT NULL UNION ALL SELECT DISTINCT 'taxon_group', taxon_group FROM en WHERE taxon_group IS NOT NULL")
def _(spark, d):
    return summary.distinct_values(_enriched(spark, d), ["period", "zone", "taxon_group"])


@query("detrend", _with("en") + f"SELECT e.orderkey, e.line, {_r('e.d13c_coll - m.mean')} AS detrended FROM en e LEFT JOIN (SELECT zone, avg(d13c_coll) AS mean FROM en WHERE zone IS NOT NULL GROUP BY 1) m ON e.zone = m.zone")
def _(spark, d):
    return _rounded(summary.detrend_by_zone(_enriched(spark, d), "d13C_coll").select("orderkey", "line", "detrended"), "detrended")


@query("continuous_runs", _with("en") + f"""SELECT zone, string_agg(period, ',' ORDER BY o) AS periods, CAST(count(*) AS INTEGER) AS run_length FROM (
  SELECT *, o - row_number() OVER (PARTITION BY zone ORDER BY o) AS i FROM (SELECT DISTINCT zone, period, {_ORDINAL('period')} AS o FROM en WHERE zone IS NOT NULL AND period IS NOT NULL AND period <> 'HAN')
) GROUP BY zone, i HAVING count(*) >= 2""")
def _(spark, d):
    t = _enriched(spark, d).filter(F.col("zone").isNotNull() & F.col("period").isNotNull() & (F.col("period") != "HAN"))
    return summary.continuous_runs(t)


_PAIRS = f"""cell AS (SELECT zone, {_ORDINAL('period')} AS o, any_value(period) AS period, count(*) AS n, avg(d13c_coll) AS mean FROM en
  WHERE zone IS NOT NULL AND period IS NOT NULL AND d13c_coll IS NOT NULL GROUP BY 1, 2),
pair AS (SELECT a.zone, a.o, a.period AS from_period, b.period AS to_period, a.n AS from_n, b.n AS to_n, a.mean AS from_mean, b.mean AS to_mean FROM cell a JOIN cell b ON a.zone = b.zone AND a.o + 1 = b.o WHERE a.n >= 3 AND b.n >= 3)"""


@query("adjacent_changes", _with("en") + f", {_PAIRS} SELECT zone, from_period, to_period, from_n, to_n, {_r('from_mean')} AS from_mean, {_r('to_mean')} AS to_mean, {_r('to_mean - from_mean')} AS delta FROM pair")
def _(spark, d):
    return _rounded(summary.adjacent_changes(_enriched(spark, d), "d13C_coll", test=False), "from_mean", "to_mean", "delta")


@query("mann_whitney_u", _with("en") + f""", {_PAIRS}, vals AS (SELECT p.zone, p.o, p.from_n, p.to_n, e.d13c_coll AS v, CASE WHEN {_ORDINAL('e.period')} = p.o THEN 1 ELSE 0 END AS f
  FROM pair p JOIN en e ON e.zone = p.zone AND {_ORDINAL('e.period')} IN (p.o, p.o + 1) WHERE e.d13c_coll IS NOT NULL),
ranked AS (SELECT *, rank() OVER (PARTITION BY zone, o ORDER BY v) + (count(*) OVER (PARTITION BY zone, o, v) - 1) / 2e0 AS r FROM vals)
SELECT zone, CAST(o AS INTEGER) AS period_no, any_value(from_n) AS from_n, any_value(to_n) AS to_n, {_r('sum(r * f) - any_value(from_n) * (any_value(from_n) + 1) / 2e0')} AS u FROM ranked GROUP BY zone, o""")
def _(spark, d):
    t = summary.adjacent_changes(_enriched(spark, d), "d13C_coll")
    return t.select("zone", enrich.period_rank(F.col("from_period")).alias("period_no"), "from_n", "to_n", stable(F.col("u")).alias("u"))


@query("kruskal_h", _with("en") + f""", g AS (SELECT zone, period, count(*) AS n FROM en WHERE zone IS NOT NULL AND period IS NOT NULL AND d13c_coll IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 4),
v AS (SELECT e.zone, e.period, e.d13c_coll AS v FROM en e JOIN g ON e.zone = g.zone AND e.period = g.period WHERE e.d13c_coll IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY zone ORDER BY v) + (count(*) OVER (PARTITION BY zone, v) - 1) / 2e0 AS r FROM v),
s AS (SELECT zone, period, sum(r) AS r, count(*) AS n FROM r GROUP BY 1, 2),
t AS (SELECT zone, sum(c * c * c - c) AS ties FROM (SELECT zone, v, CAST(count(*) AS DOUBLE) AS c FROM v GROUP BY 1, 2) GROUP BY 1)
SELECT s.zone, string_agg(period, ', ' ORDER BY period) AS periods, count(*) AS groups, CAST(sum(n) AS BIGINT) AS n,
  {_r('(12e0 / (sum(n) * (sum(n) + 1e0)) * sum(r * r / n) - 3 * (sum(n) + 1e0)) / (1 - any_value(ties) / (CAST(sum(n) AS DOUBLE) * sum(n) * sum(n) - sum(n)))')} AS h
FROM s JOIN t ON s.zone = t.zone GROUP BY s.zone HAVING count(*) >= 2""")
def _(spark, d):
    return _rounded(summary.kruskal(_enriched(spark, d), "d13C_coll").select("zone", "periods", "groups", "n", "h"), "h")


# -- grids ------------------------------------------------------------------------------------


@query("cell_extract", _with("extracted") + "SELECT site, row, col, elev, bio1, bio12 FROM extracted")
def _(spark, d):
    return grid.extract(_sites(spark, d), _cells(spark, d), GRID, ["elev", "bio1", "bio12"]).select("site", "row", "col", "elev", "bio1", "bio12")


@query("thin_cells", _with("thinned") + "SELECT site, row, col FROM thinned")
def _(spark, d):
    return _thinned(spark, d).select("site", "row", "col")


@query("background_lcg", _with("background") + "SELECT row, col, bio1, bio12 FROM background")
def _(spark, d):
    return _background(spark, d).select("row", "col", "bio1", "bio12")


@query("grid_crop", _with("cells") + "SELECT CAST(row - 12 AS INTEGER) AS row, CAST(col - 20 AS INTEGER) AS col, x, y, bio1 FROM cells WHERE row BETWEEN 12 AND 31 AND col BETWEEN 20 AND 49")
def _(spark, d):
    out, _ = grid.crop(_cells(spark, d), GRID, (115.0, 40.0, 130.0, 50.0))
    return out.select("row", "col", "x", "y", "bio1")


@query("resample_average", _with("cells") + f"SELECT CAST(row // 2 AS INTEGER) AS row, CAST(col // 3 AS INTEGER) AS col, {_r('avg(bio12) / 10e0')} AS value FROM cells GROUP BY 1, 2")
def _(spark, d):
    coarse = grid.Grid(a=1.5, c=105.0, e=-1.0, f=56.0, height=23, width=24)
    return _rounded(grid.resample(_cells(spark, d), GRID, coarse, "bio12", "average", 10.0), "value")


@query("resample_bilinear", _with("cells") + f"""SELECT t.row, t.col, {_r('sum(CASE WHEN c.bio12 IS NOT NULL THEN w * c.bio12 END) / nullif(sum(CASE WHEN c.bio12 IS NOT NULL THEN w END), 0)')} AS value FROM (
  SELECT CAST(r.range AS INTEGER) AS row, CAST(q.range AS INTEGER) AS col, CAST(floor(fr - 0.5e0) AS INTEGER) + i AS sr, CAST(floor(fc - 0.5e0) AS INTEGER) + j AS sc,
    (CASE WHEN i = 1 THEN fr - 0.5e0 - floor(fr - 0.5e0) ELSE 1 - (fr - 0.5e0 - floor(fr - 0.5e0)) END) * (CASE WHEN j = 1 THEN fc - 0.5e0 - floor(fc - 0.5e0) ELSE 1 - (fc - 0.5e0 - floor(fc - 0.5e0)) END) AS w
  FROM range(30) r, range(40) q, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j), LATERAL (SELECT (56e0 - (54e0 + (r.range + 0.5e0) * -0.3e0)) / 0.5e0 AS fr, (110e0 + (q.range + 0.5e0) * 0.3e0 - 105e0) / 0.5e0 AS fc) z
) t LEFT JOIN cells c ON c.row = t.sr AND c.col = t.sc GROUP BY 1, 2""")
def _(spark, d):
    fine = grid.Grid(a=0.3, c=110.0, e=-0.3, f=54.0, height=30, width=40)
    return _rounded(grid.resample(_cells(spark, d), GRID, fine, "bio12", "bilinear"), "value")


@query("cell_area", _with("cells") + f"SELECT row, col, {_r('0.5e0 * 111.32e0 * cos(radians(y)) * 0.5e0 * 110.57e0')} AS km2 FROM cells")
def _(spark, d):
    return _cells(spark, d).select("row", "col", stable(grid.cell_area_km2(GRID, F.col("y"))).alias("km2"))


_W, _H = GRID.cell_metres()
_NEAR = """n1 AS (SELECT *, coalesce(lag(elev) OVER r, elev) AS w, coalesce(lead(elev) OVER r, elev) AS e FROM cells WINDOW r AS (PARTITION BY row ORDER BY col)),
n AS (SELECT *, coalesce(lag(w) OVER c, w) AS nw, coalesce(lag(elev) OVER c, elev) AS nn, coalesce(lag(e) OVER c, e) AS ne, coalesce(lead(w) OVER c, w) AS sw, coalesce(lead(elev) OVER c, elev) AS ss, coalesce(lead(e) OVER c, e) AS se FROM n1 WINDOW c AS (PARTITION BY col ORDER BY row))"""


@query("terrain_slope", _with("cells") + f""", {_NEAR}, g AS (SELECT row, col, ((ne + 2 * e + se) - (nw + 2 * w + sw)) / (8 * {_W!r}) AS dx, ((sw + 2 * ss + se) - (nw + 2 * nn + ne)) / (8 * {_H!r}) AS dy FROM n),
a AS (SELECT row, col, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope, CASE WHEN dx = 0 AND dy = 0 THEN 180e0 WHEN degrees(atan2(dy, -dx)) < 0 THEN degrees(atan2(dy, -dx)) + 360 ELSE degrees(atan2(dy, -dx)) END AS aspect FROM g)
SELECT row, col, {_r('slope')} AS slope, {_r('aspect')} AS aspect, {_r('cos(radians(aspect))')} AS northness, {_r('sin(radians(aspect))')} AS eastness FROM a""")
def _(spark, d):
    t = terrain.northness_eastness(terrain.slope_aspect(_cells(spark, d), "elev", GRID))
    return _rounded(t.select("row", "col", "slope", "aspect", "northness", "eastness"), "slope", "aspect", "northness", "eastness")


@query("terrain_tri", _with("cells") + f", {_NEAR} SELECT row, col, {_r('sqrt((nw-elev)*(nw-elev)+(nn-elev)*(nn-elev)+(ne-elev)*(ne-elev)+(w-elev)*(w-elev)+(e-elev)*(e-elev)+(sw-elev)*(sw-elev)+(ss-elev)*(ss-elev)+(se-elev)*(se-elev))')} AS tri FROM n")
def _(spark, d):
    return _rounded(terrain.ruggedness(_cells(spark, d), "elev").select("row", "col", "tri"), "tri")


# -- isoscapes --------------------------------------------------------------------------------


def _idw_sql(kx: str, ky: str, k: int, least: str) -> str:
    return f"""near AS (SELECT c.row, c.col, m.value, sqrt(((c.x - m.lon) / {kx}) * ((c.x - m.lon) / {kx}) + ((c.y - m.lat) / {ky}) * ((c.y - m.lat) / {ky})) AS d, m.site
  FROM cells c, means m, (SELECT avg(lat) AS mlat FROM means) z QUALIFY row_number() OVER (PARTITION BY c.row, c.col ORDER BY d, m.site) <= {k}),
surface AS (SELECT row, col, sum(value / pow(greatest(d, {least}), 2)) / sum(1 / pow(greatest(d, {least}), 2)) AS value, min(d) AS support FROM near GROUP BY 1, 2)"""


_IDW_KM = _idw_sql("(1 / (111.32e0 * greatest(cos(radians(z.mlat)), 0.1e0)))", "(1 / 110.57e0)", 6, "1e-6")


@query("idw_isoscape", _with("cells", "means") + f", {_IDW_KM} SELECT row, col, CASE WHEN support <= 250 THEN {_r('value')} END AS value, {_r('support')} AS support FROM surface")
def _(spark, d):
    t = isoscape.idw(_cells(spark, d), summary.site_means(_specimens(spark, d), "d13C_coll"))
    return _rounded(t.select("row", "col", "value", "support"), "value", "support")


@query("idw_degrees", _with("cells", "means") + f", {_idw_sql('1e0', '1e0', 8, '1e-12')} SELECT row, col, {_r('value')} AS value FROM surface")
def _(spark, d):
    t = isoscape.idw(_cells(spark, d), summary.site_means(_specimens(spark, d), "d13C_coll"), k=8, kilometres=False, max_distance=None)
    return _rounded(t.select("row", "col", "value"), "value")


@query("delta_surface", _with("surf") + f"SELECT row, col, {_r('b - a')} AS value FROM surf")
def _(spark, d):
    s = _surfaces(spark, d)
    return _rounded(isoscape.delta_surface(s.select("row", "col", F.col("a").alias("value")), s.select("row", "col", F.col("b").alias("value"))), "value")


_THREE = "three AS (SELECT 'p1' AS period, row, col, bio1 + 10 AS v FROM cells UNION ALL SELECT 'p2', row, col, bio12 FROM cells UNION ALL SELECT 'p3', row, col, elev + 1 FROM cells)"


@query("schoener_matrix", _with("cells") + f""", {_THREE}, met AS (SELECT s.period AS a, t.period AS b, s.v AS va, t.v AS vb FROM three s JOIN three t ON s.row = t.row AND s.col = t.col AND s.period <= t.period WHERE s.v IS NOT NULL AND t.v IS NOT NULL),
sums AS (SELECT a, b, sum(va) AS sa, sum(vb) AS sb FROM met GROUP BY 1, 2) SELECT a, b, {_r('1 - sum(abs(va / sa - vb / sb)) / 2')} AS d FROM met JOIN sums USING (a, b) GROUP BY 1, 2""")
def _(spark, d):
    c = _cells(spark, d)
    s = c.select("row", "col", F.explode(F.array(*(F.struct(F.lit(n).alias("period"), v.alias("value")) for n, v in (("p1", F.col("bio1") + 10), ("p2", F.col("bio12")), ("p3", F.col("elev") + 1))))).alias("s")).select("row", "col", "s.*")
    return _rounded(isoscape.schoener_pairs(s), "d")


# -- climate -----------------------------------------------------------------------------------


@query("climate_nearest", _with("spec") + f"SELECT orderkey, line, CASE WHEN bp IS NULL THEN NULL WHEN abs(bp - 6000) <= abs(bp + 30) AND abs(bp - 6000) <= abs(bp - 21000) THEN 'mid' WHEN abs(bp - 21000) <= abs(bp + 30) THEN 'lgm' ELSE 'current' END AS slice FROM (SELECT orderkey, line, anymid * 3 AS bp FROM spec)")
def _(spark, d):
    bp = enrich.any_midpoint() * 3
    return _specimens(spark, d).select("orderkey", "line", F.when(bp.isNotNull(), scenario.nearest_climate(bp, ("mid", "lgm"))["slice"]).alias("slice"))


@query("paleoclim_slice", _with("spec") + "SELECT orderkey, line, " + _case([(f"ka <= {o}e0 AND ka >= {y}e0", _q(n)) for n, o, y in dims.PALEO_SLICES], "'LH'") + " AS slice FROM (SELECT orderkey, line, anymid * 6 / 1000e0 AS ka FROM spec)")
def _(spark, d):
    return _specimens(spark, d).select("orderkey", "line", scenario.paleo_slice(enrich.any_midpoint() * 6 / F.lit(1000.0)).alias("slice"))


@query("bio_scale", "SELECT DISTINCT CAST(p_partkey % 19 + 1 AS INTEGER) AS bio, CASE WHEN p_partkey % 19 + 1 IN (1, 2, 4, 5, 6, 7, 8, 9, 10, 11) THEN 10e0 ELSE 1e0 END AS divisor FROM part")
def _(spark, d):
    bio = (F.col("p_partkey") % 19 + 1).cast("int")
    return spark.read.parquet(f"{d}/part.parquet").select(bio.alias("bio")).distinct().withColumn("divisor", scenario.bio_scale(F.col("bio")))


# -- ranges and scenarios --------------------------------------------------------------------------


def _change_sql(rows: str, group: str = "") -> str:
    area = "0.5e0 * 111.32e0 * cos(radians(y)) * 0.5e0 * 110.57e0"
    total = lambda c: f"coalesce(sum(CASE WHEN {c} THEN {area} END), 0e0)"
    names = ", ".join(f"({i}, {_q(n)})" for i, n in enumerate(dims.DIRECTIONS))
    by = f"{group}, " if group else ""
    return f"""t AS (SELECT {by}{total('p0')} AS before_km2, {total('p1')} AS after_km2, {total('p0 AND p1')} AS kept_km2, {total('p0 AND NOT p1')} AS lost_km2, {total('NOT p0 AND p1')} AS gained_km2,
  avg(CASE WHEN p0 THEN x END) AS x0, avg(CASE WHEN p0 THEN y END) AS y0, avg(CASE WHEN p1 THEN x END) AS x1, avg(CASE WHEN p1 THEN y END) AS y1 FROM ({rows}) {f'GROUP BY {group}' if group else ''}),
u AS (SELECT *, (x1 - x0) * 111.32e0 * cos(radians((y0 + y1) / 2)) AS dx, (y1 - y0) * 110.57e0 AS dy FROM t)
SELECT {by}{_r('before_km2')} AS before_km2, {_r('after_km2')} AS after_km2, {_r('kept_km2')} AS kept_km2, {_r('lost_km2')} AS lost_km2, {_r('gained_km2')} AS gained_km2,
  {_r('(after_km2 - before_km2) / greatest(before_km2, 1e0) * 100')} AS change_percent, {_r('sqrt(dx * dx + dy * dy)')} AS shift_km, n.name AS direction
FROM u JOIN (VALUES {names}) n(i, name) ON n.i = CAST(floor(((degrees(atan2(dx, dy)) + 360 + 22.5e0) % 360) / 45) AS INTEGER)"""


_CHANGE_FIELDS = ("before_km2", "after_km2", "kept_km2", "lost_km2", "gained_km2", "change_percent", "shift_km")


@query("range_change", _with("surf") + ", " + _change_sql("SELECT x, y, coalesce(a, 0) >= 0.3e0 AS p0, coalesce(b, 0) >= 0.5e0 AND row < 30 AS p1 FROM surf"))
def _(spark, d):
    s = _surfaces(spark, d)
    before = s.select("row", "col", "x", "y", scenario.in_range(F.col("a"), 0.3).alias("present"))
    after = s.select("row", "col", "x", "y", (scenario.in_range(F.col("b"), 0.5) & (F.col("row") < 30)).alias("present"))
    return _rounded(scenario.range_change(before, after, GRID), *_CHANGE_FIELDS)


@query("series_change", _with("surf") + ", " + _change_sql("SELECT 'lgm→mid' AS step, x, y, coalesce(a, 0) >= 0.4e0 AS p0, coalesce(b, 0) >= 0.4e0 AS p1 FROM surf UNION ALL SELECT 'mid→current', x, y, coalesce(b, 0) >= 0.4e0, coalesce(a * b, 0) >= 0.4e0 FROM surf", "step"))
def _(spark, d):
    s = _surfaces(spark, d)
    one = lambda n, v: s.select(F.lit(n).alias("slice"), "row", "col", "x", "y", v.alias("value"))
    long = one("lgm", F.col("a")).unionByName(one("mid", F.col("b"))).unionByName(one("current", F.col("a") * F.col("b")))
    return _rounded(scenario.summarise_series(long, list(dims.SCENARIO_ORDER), 0.4, GRID), *_CHANGE_FIELDS)


@query("p10_threshold", _with("fx_score") + f"SELECT {_r('quantile_cont(score, 0.1)')} AS threshold FROM fx_score WHERE label = 1")
def _(spark, d):
    return _rounded(scenario.p10_threshold(fixtures.fixture(spark, d, "fx_score").filter("label = 1")), "threshold")


@query("stretch", _with("cells") + f"SELECT row, col, {_r('least(greatest((elev - lo) / (hi - lo), 0e0), 1e0)')} AS scaled FROM cells, (SELECT quantile_cont(elev, 0.02) AS lo, quantile_cont(elev, 0.98) AS hi FROM cells)")
def _(spark, d):
    return _rounded(scenario.stretch(_cells(spark, d), "elev").select("row", "col", "scaled"), "scaled")


_STEPS, _THR = 6, 0.4


@query("dispersal_deterministic", _with("surf", recursive=True) + f""", occ(step, row, col) AS (
  SELECT 0, row, col FROM surf WHERE row BETWEEN 20 AND 24 AND col BETWEEN 30 AND 34 AND a IS NOT NULL
  UNION
  SELECT o.step + 1, s.row, s.col FROM occ o, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) k(i, j), surf s
  WHERE o.step < {_STEPS} AND s.row = o.row + k.i AND s.col = o.col + k.j AND coalesce((1 - (o.step + 1) / {_STEPS}e0) * s.a + (o.step + 1) / {_STEPS}e0 * s.b, 0) >= {_THR}e0
) SELECT CAST(step AS INTEGER) AS step, row, col FROM occ""")
def _(spark, d):
    s = _surfaces(spark, d)
    start = s.filter("row BETWEEN 20 AND 24 AND col BETWEEN 30 AND 34")
    return scenario.dispersal(s.select("row", "col", F.col("a").alias("value")), s.select("row", "col", F.col("b").alias("value")), start, _STEPS, _THR, 1, 1.0, 0.0)


# -- scores -------------------------------------------------------------------------------------


@query("auc_midrank", _with("fx_score") + f""", r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS r FROM fx_score)
SELECT {_r('(sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2e0) / (CAST(sum(label) AS DOUBLE) * (count(*) - sum(label)))')} AS auc, CAST(sum(label) AS BIGINT) AS presences, CAST(count(*) - sum(label) AS BIGINT) AS backgrounds FROM r""")
def _(spark, d):
    return _rounded(validate.auc(fixtures.fixture(spark, d, "fx_score")), "auc")


@query("tss_max", _with("fx_score") + f""", t AS (SELECT score AS threshold, sum(label) AS p, count(*) - sum(label) AS b FROM fx_score GROUP BY 1),
c AS (SELECT threshold, (sum(p) OVER () - coalesce(sum(p) OVER (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / CAST(sum(p) OVER () AS DOUBLE) + coalesce(sum(b) OVER (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / CAST(sum(b) OVER () AS DOUBLE) - 1 AS tss FROM t)
SELECT {_r('tss')} AS tss, threshold FROM c ORDER BY c.tss DESC, threshold LIMIT 1""")
def _(spark, d):
    return _rounded(validate.tss(fixtures.fixture(spark, d, "fx_score")), "tss")


@query("rank_normalize", _with("fx_score") + f"SELECT id, {_r('count(score) OVER (ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(count(score) OVER () AS DOUBLE)')} AS rank FROM fx_score")
def _(spark, d):
    s = fixtures.fixture(spark, d, "fx_score")
    return _rounded(validate.rank_normalise(s, s).select("id", "rank"), "rank")


@query("checkerboard", _with("fx_site") + "SELECT site, CAST(((CAST(floor((lon - 120) / 3e0) AS BIGINT) + CAST(floor((lat - 45) / 3e0) AS BIGINT)) % 4 + 4) % 4 AS INTEGER) AS fold FROM fx_site")
def _(spark, d):
    return _sites(spark, d).select("site", validate.checkerboard(F.col("lon") - 120, F.col("lat") - 45, 3.0, 4).alias("fold"))


@query("nearest_centre", _with("fx_site") + "SELECT site, CAST(arg_min(i, (lon - cx) * (lon - cx) + (lat - cy) * (lat - cy)) AS INTEGER) AS fold FROM fx_site, (VALUES (0, 110e0, 40e0), (1, 125e0, 45e0), (2, 135e0, 50e0)) k(i, cx, cy) GROUP BY site")
def _(spark, d):
    return _sites(spark, d).select("site", validate.nearest_centre(F.col("lon"), F.col("lat"), [(110.0, 40.0), (125.0, 45.0), (135.0, 50.0)]).alias("fold"))


# -- models -------------------------------------------------------------------------------------


def _ecdf(ref: str, band: str, op: str) -> str:
    return f"(SELECT count(*) FROM {ref} r WHERE r.{band} {op} c.{band})"


def _envelope(band: str) -> str:
    f = f"(({_ecdf('thinned', band, '<')} + {_ecdf('thinned', band, '<=')}) / (2e0 * (SELECT count(*) FROM thinned)))"
    return f"2 * least({f}, 1 - {f})"


@query("bioclim", _with("cells", "thinned") + f"SELECT row, col, CASE WHEN bio1 IS NOT NULL AND bio12 IS NOT NULL THEN {_r('least(greatest(least(' + _envelope('bio1') + ', ' + _envelope('bio12') + '), 0e0), 1e0)')} END AS score FROM cells c")
def _(spark, d):
    m = models.Bioclim().fit(_thinned(spark, d), _background(spark, d), ["bio1", "bio12"])
    return _rounded(m.predict(_cells(spark, d)).select("row", "col", "score"), "score")


def _similar(band: str) -> str:
    f = f"({_ecdf('every_background', band, '<=')} / CAST((SELECT count(*) FROM every_background) AS DOUBLE) * 100)"
    lo, hi = f"(SELECT min({band}) FROM every_background)", f"(SELECT max({band}) FROM every_background)"
    return f"CASE WHEN {f} = 0 THEN (c.{band} - {lo}) / ({hi} - {lo}) * 100 WHEN {f} <= 50 THEN 2 * {f} WHEN {f} < 100 THEN 2 * (100 - {f}) ELSE ({hi} - c.{band}) / ({hi} - {lo}) * 100 END"


_MESS = f"CASE WHEN bio1 IS NOT NULL AND bio12 IS NOT NULL THEN least({_similar('bio1')}, {_similar('bio12')}) END"


@query("mess", _with("cells", "every_background") + f"SELECT row, col, {_r(_MESS)} AS mess FROM cells c")
def _(spark, d):
    return _rounded(scenario.mess(_cells(spark, d), _background(spark, d, 5000), ["bio1", "bio12"]).select("row", "col", "mess"), "mess")


@query("extrapolated_share", _with("cells", "every_background") + f"SELECT {_r('100 * avg(CASE WHEN m < 0 THEN 1e0 ELSE 0e0 END)')} AS percent FROM (SELECT {_MESS} AS m FROM (SELECT row, col, bio1 + 6 AS bio1, bio12 FROM cells) c)")
def _(spark, d):
    warmer = _cells(spark, d).withColumn("bio1", F.col("bio1") + 6)
    return _rounded(scenario.extrapolated_share(scenario.mess(warmer, _background(spark, d, 5000), ["bio1", "bio12"])), "percent")


_SCALED = lambda b: f"least(greatest(({b} - (SELECT min({b}) FROM v)) / (SELECT max({b}) - min({b}) FROM v), 0e0), 1e0)"


@query("feature_expand", _with("cells") + f""", v AS (SELECT bio1, bio12 FROM cells WHERE bio1 IS NOT NULL AND bio12 IS NOT NULL), u AS (SELECT {_SCALED('bio1')} AS a, {_SCALED('bio12')} AS b FROM v),
q AS (SELECT quantile_cont(a, 1/3e0) AS a1, quantile_cont(a, 2/3e0) AS a2, quantile_cont(b, 1/3e0) AS b1, quantile_cont(b, 2/3e0) AS b2 FROM u),
f AS (SELECT unnest([a, b, a * a, b * b, a * b, greatest(a - a1, 0e0) / (1 - a1), greatest(a1 - a, 0e0) / a1, greatest(a - a2, 0e0) / (1 - a2), greatest(a2 - a, 0e0) / a2,
  greatest(b - b1, 0e0) / (1 - b1), greatest(b1 - b, 0e0) / b1, greatest(b - b2, 0e0) / (1 - b2), greatest(b2 - b, 0e0) / b2]) AS x, unnest(range(13)) AS i FROM u, q)
SELECT CAST(i AS INTEGER) AS feature, {_r('avg(x)')} AS mean, {_r('max(x)')} AS most FROM f GROUP BY 1""")
def _(spark, d):
    v = grid.valid_cells(_cells(spark, d), ["bio1", "bio12"])
    spec = maxent.fit_features(v, ["bio1", "bio12"], knots=2)
    stacked = v.select(F.posexplode(F.array(*(spec.column(f).cast("double") for f in spec.features))).alias("feature", "x"))
    return _rounded(stacked.groupBy("feature").agg(F.avg("x").alias("mean"), F.max("x").alias("most")), "mean", "most")


def _given_model(spark: SparkSession, d: str) -> tuple[maxent.Maxent, DataFrame]:
    v = grid.valid_cells(_cells(spark, d), ["bio1", "bio12"])
    spec = maxent.fit_features(v, ["bio1", "bio12"], kinds=("linear",))
    return maxent.with_background(spec, [1.5, -2.0], v), v


_ETA = f"v AS (SELECT row, col, bio1, bio12 FROM cells WHERE bio1 IS NOT NULL AND bio12 IS NOT NULL), e AS (SELECT row, col, 1.5e0 * {_SCALED('bio1')} - 2e0 * {_SCALED('bio12')} AS eta FROM v), o AS (SELECT max(eta) AS off FROM e), z AS (SELECT sum(exp(eta - off)) AS z FROM e, o), h AS (SELECT -sum(exp(eta - off) / z * ln(exp(eta - off) / z)) AS h FROM e, o, z)"


@query("entropy_cloglog", _with("cells") + f", {_ETA} SELECT row, col, {_r('eta')} AS link, {_r('1 - exp(-exp(h) * exp(eta - off) / z)')} AS cloglog, {_r('exp(h) * exp(eta - off) / z / (1 + exp(h) * exp(eta - off) / z)')} AS logistic FROM e, o, z, h")
def _(spark, d):
    m, v = _given_model(spark, d)
    return v.select("row", "col", *(stable(m.predict(o)).alias(o) for o in ("link", "cloglog", "logistic")))


@query("response_curve", _with("cells") + f""", {_ETA}, s AS (SELECT min(bio1) AS lo, max(bio1) AS hi, avg(bio12) AS m FROM v), g AS (SELECT lo + i.range * ((hi - lo) / 99) AS x, m FROM range(100) i, s),
r AS (SELECT x, 1.5e0 * least(greatest((x - (SELECT min(bio1) FROM v)) / (SELECT max(bio1) - min(bio1) FROM v), 0e0), 1e0) - 2e0 * least(greatest((m - (SELECT min(bio12) FROM v)) / (SELECT max(bio12) - min(bio12) FROM v), 0e0), 1e0) AS eta FROM g)
SELECT {_r('x')} AS x, {_r('1 - exp(-exp(h) * exp(eta - off) / z)')} AS y FROM r, o, z, h""")
def _(spark, d):
    m, v = _given_model(spark, d)
    return _rounded(m.response_curve(v, "bio1"), "x", "y")


@query("maxent_fit")
def _(spark, d):
    every = _cells(spark, d).dropna(subset=["bio1", "bio12"])
    m = maxent.fit(_thinned(spark, d), every, ["bio1", "bio12"], beta=3.0, kinds=("linear", "quadratic"))
    return _cells(spark, d).dropna(subset=["bio1", "bio12"]).select("row", "col", stable(m.predict("cloglog"), 4).alias("cloglog"))


# -- niches -------------------------------------------------------------------------------------

_ELL = """s AS (SELECT taxon_group, count(*) AS n, avg(d13c_coll) AS cx, avg(d15n_coll) AS cy, var_samp(d13c_coll) AS vx, var_samp(d15n_coll) AS vy, covar_samp(d13c_coll, d15n_coll) AS cxy, max(d15n_coll) - min(d15n_coll) AS nr, max(d13c_coll) - min(d13c_coll) AS cr
  FROM spec WHERE d13c_coll IS NOT NULL AND d15n_coll IS NOT NULL GROUP BY 1),
el AS (SELECT *, sqrt(greatest((vx + vy) / 2 + sqrt((vx - vy) / 2 * ((vx - vy) / 2) + cxy * cxy), 0e0)) AS a, sqrt(greatest((vx + vy) / 2 - sqrt((vx - vy) / 2 * ((vx - vy) / 2) + cxy * cxy), 0e0)) AS b,
  cos(atan2(2 * cxy, vx - vy) / 2) AS ux, sin(atan2(2 * cxy, vx - vy) / 2) AS uy, pi() * sqrt(greatest(vx * vy - cxy * cxy, 0e0)) AS sea FROM s)"""


@query("ellipse_sea", _with("spec") + f", {_ELL} SELECT taxon_group, n, {_r('a')} AS a, {_r('b')} AS b, {_r('sea')} AS sea, {_r('sea * (n - 1) / (n - 2)')} AS seac FROM el")
def _(spark, d):
    e = niche.ellipses(_specimens(spark, d), ["taxon_group"], "d13C_coll", "d15N_coll")
    return _rounded(e.select("taxon_group", "n", "a", "b", "sea", "seac"), "a", "b", "sea", "seac")


@query("layman_range", _with("spec") + f", {_ELL} SELECT taxon_group, {_r('nr')} AS nr, {_r('cr')} AS cr FROM el")
def _(spark, d):
    e = niche.ellipses(_specimens(spark, d), ["taxon_group"], "d13C_coll", "d15N_coll")
    return _rounded(e.select("taxon_group", "nr", "cr"), "nr", "cr")


_RES = niche.RESOLUTION
_IN = lambda s: f"(pow(({s}.ux * (x - {s}.cx) + {s}.uy * (y - {s}.cy)) / greatest({s}.a, 1e-9), 2) + pow(({s}.ux * (y - {s}.cy) - {s}.uy * (x - {s}.cx)) / greatest({s}.b, 1e-9), 2) <= 1)"


@query("ellipse_overlap", _with("spec") + f""", {_ELL}, ol AS (SELECT taxon_group, min(ex) AS x0, max(ex) AS x1, min(ey) AS y0, max(ey) AS y1 FROM (SELECT taxon_group, cx + ux * a * cos(t) - uy * b * sin(t) AS ex, cy + uy * a * cos(t) + ux * b * sin(t) AS ey FROM el, (SELECT i.range * {2 * math.pi / 99!r} AS t FROM range(100) i)) GROUP BY 1),
f AS (SELECT * FROM el JOIN ol USING (taxon_group)),
pr AS (SELECT p.taxon_group AS first, q.taxon_group AS second, least(p.x0, q.x0) AS lx, (greatest(p.x1, q.x1) - least(p.x0, q.x0)) / {_RES - 1} AS dx, least(p.y0, q.y0) AS ly, (greatest(p.y1, q.y1) - least(p.y0, q.y0)) / {_RES - 1} AS dy FROM f p JOIN f q ON p.taxon_group <= q.taxon_group),
g AS (SELECT first, second, dx * dy AS cell, lx + i.range * dx AS x, ly + j.range * dy AS y FROM pr, range({_RES}) i, range({_RES}) j),
k AS (SELECT g.first, g.second, any_value(cell) AS cell, sum(CASE WHEN {_IN('p')} THEN 1 ELSE 0 END) AS p, sum(CASE WHEN {_IN('q')} THEN 1 ELSE 0 END) AS q, sum(CASE WHEN {_IN('p')} AND {_IN('q')} THEN 1 ELSE 0 END) AS b FROM g JOIN f p ON g.first = p.taxon_group JOIN f q ON g.second = q.taxon_group GROUP BY 1, 2)
SELECT first, second, {_r('b * cell')} AS area, {_r('100e0 * b / nullif(p, 0)')} AS percent_first, {_r('100e0 * b / nullif(q, 0)')} AS percent_second, {_r('100e0 * b / nullif(p + q - b, 0)')} AS percent_union FROM k""")
def _(spark, d):
    e = niche.ellipses(_specimens(spark, d), ["taxon_group"], "d13C_coll", "d15N_coll")
    return _rounded(niche.overlaps(e, "taxon_group", _RES), "area", "percent_first", "percent_second", "percent_union")


@query("niche_table")
def _(spark, d):
    return niche.niche_table(_enriched(spark, d), ["period", "taxon_group"], "d13C_coll", "d15N_coll")
