"""Registered queries of sources, sinks, compositions and the finer operators, each with its DuckDB oracle."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dims, fixture_files
from .functions import asof, projection, text
from .operators import enrich, grid, maxent, models, niche, scenario, summary, terrain, validate
from .plans import plots, study
from .queries import _ELL, _ETA, _NEAR, _PAIRS, GRID, _cells, _enriched, _given_model, _q, _r, _rounded, _sites, _specimens, _surfaces, _thinned, _with, fixtures, query, ORACLES, QUERIES
from .schema import stable
from .shared import shared_dir
from .sources import files, points, rasters, sinks, workbook

_V = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else _q(v) if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else repr(v) for v in r) + ")" for r in rows)


# -- projections and lookups ------------------------------------------------------------------


@query("valid_mask", _with("cells") + "SELECT row, col FROM cells WHERE bio1 IS NOT NULL AND bio12 IS NOT NULL")
def _(spark, d):
    return grid.valid_cells(_cells(spark, d), ["bio1", "bio12"]).select("row", "col")


@query("band_subset", _with("cells") + "SELECT row, col, x, y, bio12 FROM cells")
def _(spark, d):
    return grid.subset(_cells(spark, d), ["bio12"])


@query("add_band", _with("cells", "surf") + "SELECT c.row, c.col, c.bio1, s.b AS extra FROM cells c LEFT JOIN (SELECT * FROM surf WHERE row < 20) s ON c.row = s.row AND c.col = s.col")
def _(spark, d):
    layer = _surfaces(spark, d).filter("row < 20").select("row", "col", F.col("b").alias("value"))
    return grid.add_band(_cells(spark, d), layer, "extra").select("row", "col", "bio1", "extra")


_HEADERS = [(["ID", "경도", "위도"], "경도", "위도"), (["Name", "Longitude_dd", "LAT"], "Longitude_dd", "LAT"), (["x", "y", "lon"], "lon", "y"), (["a", "b"], None, None)]


@query("column_guess", f"SELECT * FROM (VALUES {_V([(','.join(h), x, y) for h, x, y in _HEADERS])}) t(headers, lon, lat)")
def _(spark, d):
    rows = [(",".join(h), text.guess_column(h, points.LON_NAMES), text.guess_column(h, points.LAT_NAMES)) for h, _, _ in _HEADERS]
    return spark.createDataFrame(rows, "headers string, lon string, lat string")


_REGIONS = list(dims.REGION_CENTROIDS)
_REGION = "CASE line " + " ".join(f"WHEN {i} THEN {_q(' ' + r.upper())}" for i, r in enumerate(_REGIONS[:6], 1)) + " ELSE region END"


@query("region_centroids", _with("fx_specimen") + f""", s AS (SELECT orderkey, line, lat, lon, lower(trim({_REGION})) AS r FROM fx_specimen), c AS (SELECT * FROM (VALUES {_V([(k, *v) for k, v in dims.REGION_CENTROIDS.items()])}) t(r, clat, clon))
SELECT orderkey, line, coalesce(lat, clat) AS lat, coalesce(lon, clon) AS lon, CASE WHEN lat IS NOT NULL THEN 'exact' WHEN clat IS NOT NULL THEN 'approx' END AS coord_source FROM s LEFT JOIN c ON s.r = c.r""")
def _(spark, d):
    region = F.col("region")
    for i, r in reversed(list(enumerate(_REGIONS[:6], 1))):
        region = F.when(F.col("line") == i, F.lit(" " + r.upper())).otherwise(region)
    rows = _specimens(spark, d).withColumn("region", region)
    return enrich.resolve_coordinates(rows, None, use_approx=True).select("orderkey", "line", "lat", "lon", "coord_source")


@query("window_compare", _with("surf") + "SELECT CAST(row - 10 AS INTEGER) AS row, CAST(col - 20 AS INTEGER) AS col, a AS whole, b AS part FROM surf WHERE row BETWEEN 10 AND 24 AND col BETWEEN 20 AND 49")
def _(spark, d):
    s = _surfaces(spark, d)
    part = s.filter("row BETWEEN 10 AND 24 AND col BETWEEN 20 AND 49").select((F.col("row") - 10).alias("row"), (F.col("col") - 20).alias("col"), F.col("b").alias("value"))
    return grid.compare_window(s.select("row", "col", F.col("a").alias("value")), part, 10, 20)


@query("period_order", _with("en") + "SELECT DISTINCT period, CAST(list_position(['EBA', 'LBA', 'EIA', 'HAN', 'GOG', 'BHL'], period) - 1 AS INTEGER) AS place FROM en WHERE period IS NOT NULL")
def _(spark, d):
    return _enriched(spark, d).filter("period IS NOT NULL").select("period", enrich.period_rank(F.col("period")).alias("place")).distinct()


@query("file_names", "SELECT n_name AS name, replace(n_name, ' ', '_') AS safe FROM nation UNION ALL SELECT * FROM (VALUES ('a/b:c', 'a_b_c'), ('δ13C·수', 'δ13C_수'), ('x|y?', 'x_y_')) t(n, s)")
def _(spark, d):
    names = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("name")).union(spark.createDataFrame([("a/b:c",), ("δ13C·수",), ("x|y?",)], "name string"))
    return names.select("name", text.safe_name(F.col("name")).alias("safe"))


_RUNS = [("돼지", ["EIA", "HAN"], None, "돼지 | EIA,HAN | 전지역"), (None, None, ["z1"], "전체 | 전시기 | z1"), (None, [], [], "전체 | 전시기 | 전지역")]


@query("run_labels", f"SELECT * FROM (VALUES {_V([(i, r[3]) for i, r in enumerate(_RUNS)])}) t(run, label)")
def _(spark, d):
    return spark.createDataFrame([(i, study.run_label(*r[:3])) for i, r in enumerate(_RUNS)], "run int, label string")


@query("model_registry", "SELECT * FROM (VALUES ('bioclim'), ('brt'), ('gam'), ('glm'), ('mahalanobis'), ('maxent'), ('rf')) t(model)")
def _(spark, d):
    return spark.createDataFrame([(k,) for k in models.MODELS if hasattr(models.make_model(k), "fit")], "model string")


# -- rasters ------------------------------------------------------------------------------------


@query("target_background", _with("cells", "fx_specimen") + f""", e AS (SELECT CAST(floor((56e0 - lat) / 0.5e0) AS INTEGER) AS row, CAST(floor((lon - 105e0) / 0.5e0) AS INTEGER) AS col, count(*) AS effort FROM fx_specimen WHERE lon IS NOT NULL AND lat IS NOT NULL GROUP BY 1, 2)
SELECT c.row, c.col, bio1, bio12, effort FROM cells c JOIN e ON c.row = e.row AND c.col = e.col WHERE bio1 IS NOT NULL AND bio12 IS NOT NULL
ORDER BY -ln((((((CAST(c.row AS BIGINT) * 73856093 + CAST(c.col AS BIGINT) * 19349663 + 42) % 2147483647) * 48271 + 11) % 2147483647) + 0.5e0) / 2147483647e0) / effort, c.row, c.col LIMIT 40""")
def _(spark, d):
    """Background as uneven as the search: cells drawn by the number of all records in them."""
    effort = grid.sampling_effort(_specimens(spark, d), GRID)
    return grid.target_background(_cells(spark, d), effort, 40, ["bio1", "bio12"], rank=grid.lcg_rank(42), ranks=2147483647).select("row", "col", "bio1", "bio12", "effort")


@query("resample_nearest", _with("cells") + """SELECT t.row, t.col, c.bio12 AS value FROM (SELECT CAST(r.range AS INTEGER) AS row, CAST(q.range AS INTEGER) AS col,
  CAST(floor((56e0 - (54e0 + (r.range + 0.5e0) * -0.3e0)) / 0.5e0) AS INTEGER) AS sr, CAST(floor((110e0 + (q.range + 0.5e0) * 0.3e0 - 105e0) / 0.5e0) AS INTEGER) AS sc FROM range(30) r, range(40) q) t LEFT JOIN cells c ON c.row = t.sr AND c.col = t.sc""")
def _(spark, d):
    fine = grid.Grid(a=0.3, c=110.0, e=-0.3, f=54.0, height=30, width=40)
    return grid.resample(_cells(spark, d), GRID, fine, "bio12", "nearest")


_KERNEL = lambda d: f"(CASE WHEN {d} <= 1 THEN (1.5e0 * {d} - 2.5e0) * {d} * {d} + 1 WHEN {d} < 2 THEN ((-0.5e0 * {d} + 2.5e0) * {d} - 4) * {d} + 2 ELSE 0 END)"


@query("resample_cubic", _with("cells") + f"""SELECT t.row, t.col, {_r('sum(CASE WHEN c.bio12 IS NOT NULL THEN w * c.bio12 END) / nullif(sum(CASE WHEN c.bio12 IS NOT NULL THEN w END), 0)')} AS value FROM (
  SELECT CAST(r.range AS INTEGER) AS row, CAST(q.range AS INTEGER) AS col, CAST(floor(fr - 0.5e0) AS INTEGER) + i.range - 1 AS sr, CAST(floor(fc - 0.5e0) AS INTEGER) + j.range - 1 AS sc,
    {_KERNEL('abs(fr - 0.5e0 - floor(fr - 0.5e0) - (i.range - 1))')} * {_KERNEL('abs(fc - 0.5e0 - floor(fc - 0.5e0) - (j.range - 1))')} AS w
  FROM range(30) r, range(40) q, range(4) i, range(4) j, LATERAL (SELECT (56e0 - (54e0 + (r.range + 0.5e0) * -0.3e0)) / 0.5e0 AS fr, (110e0 + (q.range + 0.5e0) * 0.3e0 - 105e0) / 0.5e0 AS fc) z
) t LEFT JOIN cells c ON c.row = t.sr AND c.col = t.sc GROUP BY 1, 2""")
def _(spark, d):
    fine = grid.Grid(a=0.3, c=110.0, e=-0.3, f=54.0, height=30, width=40)
    return _rounded(grid.resample(_cells(spark, d), GRID, fine, "bio12", "cubic"), "value")


@query("mercator_points", _with("fx_site") + f"SELECT site, {_r('radians(lon) * 6378137e0')} AS x, {_r('ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137e0')} AS y FROM fx_site")
def _(spark, d):
    t = grid.to_crs(_sites(spark, d), "EPSG:3857").select("site", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return _rounded(t, "x", "y")


_TM = projection.system("EPSG:32651")
_SERIES_SUM = lambda f, g: " + ".join(f"({a!r}) * {f}({2 * j}e0 * xi) * {g}({2 * j}e0 * eta)" for j, a in enumerate(_TM._alpha, 1))
_Q = 2 * math.sqrt(_TM._n) / (1 + _TM._n)


@query("utm_points", _with("fx_site") + f""", a AS (SELECT site, sinh(atanh(sin(radians(lat))) - {_Q!r} * atanh({_Q!r} * sin(radians(lat)))) AS t, radians(lon - 123e0) AS w FROM fx_site),
b AS (SELECT site, atan2(t, cos(w)) AS xi, atanh(sin(w) / sqrt(1 + t * t)) AS eta FROM a)
SELECT site, round(500000e0 + {_TM._rectifying!r} * (eta + {_SERIES_SUM('cos', 'sinh')}), 3) AS x, round({_TM._rectifying!r} * (xi + {_SERIES_SUM('sin', 'cosh')}), 3) AS y FROM b""")
def _(spark, d):
    return grid.to_crs(_sites(spark, d), "EPSG:32651").select("site", F.round("lon", 3).alias("x"), F.round("lat", 3).alias("y"))


@query("overlay_bounds", f"SELECT {_r('degrees(11700000e0 / 6378137e0)')} AS lon_min, {_r('degrees(2 * atan(exp(4000000e0 / 6378137e0)) - pi() / 2)')} AS lat_min, {_r('degrees(15700000e0 / 6378137e0)')} AS lon_max, {_r('degrees(2 * atan(exp(7000000e0 / 6378137e0)) - pi() / 2)')} AS lat_max")
def _(spark, d):
    g = grid.Grid(a=100_000.0, c=11_700_000.0, e=-100_000.0, f=7_000_000.0, height=30, width=40, crs="EPSG:3857")
    return _rounded(grid.geographic_bounds(spark, g), "lon_min", "lat_min", "lon_max", "lat_max")


@query("warp_mercator", _with("cells") + """, t AS (SELECT CAST(r.range AS INTEGER) AS row, CAST(q.range AS INTEGER) AS col, degrees((11700000e0 + (q.range + 0.5e0) * 100000e0) / 6378137e0) AS lon, degrees(2 * atan(exp((7000000e0 + (r.range + 0.5e0) * -100000e0) / 6378137e0)) - pi() / 2) AS lat FROM range(30) r, range(40) q)
SELECT t.row, t.col, c.bio12 AS value FROM t LEFT JOIN cells c ON c.row = CAST(floor((56e0 - lat) / 0.5e0) AS INTEGER) AND c.col = CAST(floor((lon - 105e0) / 0.5e0) AS INTEGER)""")
def _(spark, d):
    target = grid.Grid(a=100_000.0, c=11_700_000.0, e=-100_000.0, f=7_000_000.0, height=30, width=40, crs="EPSG:3857")
    return grid.resample(_cells(spark, d), GRID, target, "bio12", "nearest")


@query("slice_stack", _with("cells") + "SELECT slice, count(*) AS n, sum(bio12) AS total FROM (SELECT 'mid' AS slice, bio12 FROM cells UNION ALL SELECT 'current', bio12 + 1 FROM cells) GROUP BY 1")
def _(spark, d):
    c = _cells(spark, d)
    return grid.stack_slices({"mid": c, "current": c.withColumn("bio12", F.col("bio12") + 1)}).groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.sum("bio12").alias("total"))


@query("terrain_bundle", _with("cells") + f""", {_NEAR}, g AS (SELECT *, ((ne + 2 * e + se) - (nw + 2 * w + sw)) / (8 * {GRID.cell_metres()[0]!r}) AS dx, ((sw + 2 * ss + se) - (nw + 2 * nn + ne)) / (8 * {GRID.cell_metres()[1]!r}) AS dy FROM n),
a AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 180e0 ELSE degrees(atan2(dy, -dx)) END AS aspect FROM g)
SELECT row, col, {_r('degrees(atan(sqrt(dx * dx + dy * dy)))')} AS slope, {_r('cos(radians(aspect))')} AS northness, {_r('sqrt((nw-elev)*(nw-elev)+(nn-elev)*(nn-elev)+(ne-elev)*(ne-elev)+(w-elev)*(w-elev)+(e-elev)*(e-elev)+(sw-elev)*(sw-elev)+(ss-elev)*(ss-elev)+(se-elev)*(se-elev))')} AS tri FROM a""")
def _(spark, d):
    t = terrain.add_terrain(_cells(spark, d), "elev", GRID, ("slope", "northness", "tri"))
    return _rounded(t.select("row", "col", "slope", "northness", "tri"), "slope", "northness", "tri")


# -- isoscapes through time ------------------------------------------------------------------------

_GROUPS = """v AS (SELECT taxon_group, period, site, lat, lon, avg(d13c_coll) AS value FROM en WHERE taxon_group IS NOT NULL AND period IS NOT NULL AND site IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND d13c_coll IS NOT NULL AND taxon_group <> '사람' GROUP BY ALL),
g AS (SELECT taxon_group, period, count(*) AS sites, avg(lat) AS mlat FROM v GROUP BY 1, 2 HAVING count(*) >= 3),
near AS (SELECT v.taxon_group, v.period, c.row, c.col, v.value, sqrt(pow((c.x - v.lon) * (111.32e0 * greatest(cos(radians(mlat)), 0.1e0)), 2) + pow((c.y - v.lat) * 110.57e0, 2)) AS d, v.site FROM cells c, v JOIN g USING (taxon_group, period)
  QUALIFY row_number() OVER (PARTITION BY v.taxon_group, v.period, c.row, c.col ORDER BY d, v.site) <= 6),
surface AS (SELECT taxon_group, period, row, col, sum(value / pow(greatest(d, 1e-6), 2)) / sum(1 / pow(greatest(d, 1e-6), 2)) AS value, min(d) AS support FROM near GROUP BY ALL),
shown AS (SELECT taxon_group, period, row, col, CASE WHEN support <= 300 THEN value END AS value FROM surface)"""


def _group_surfaces(spark: SparkSession, d: str) -> DataFrame:
    rows = _enriched(spark, d).filter(F.col("period").isNotNull() & (F.col("taxon_group") != dims.HUMAN_TAXON))
    return study.temporal_isoscapes(rows, _cells(spark, d), ("d13C_coll",), 3, 300.0)[0]


@query("group_isoscapes", _with("cells", "en") + f", {_GROUPS} SELECT taxon_group, period, row, col, {_r('value')} AS value FROM shown")
def _(spark, d):
    return _rounded(_group_surfaces(spark, d).select("taxon_group", "period", "row", "col", "value"), "value")


@query("available_changes", _with("cells", "en") + f""", {_GROUPS}, p AS (SELECT taxon_group, period, lead(period) OVER (PARTITION BY taxon_group ORDER BY list_position(['EBA', 'LBA', 'EIA', 'HAN', 'GOG', 'BHL'], period)) AS next FROM (SELECT DISTINCT taxon_group, period FROM shown))
SELECT p.taxon_group, p.period AS from_period, p.next AS to_period, a.row, a.col, {_r('b.value - a.value')} AS value FROM p JOIN shown a ON a.taxon_group = p.taxon_group AND a.period = p.period JOIN shown b ON b.taxon_group = p.taxon_group AND b.period = p.next AND b.row = a.row AND b.col = a.col""")
def _(spark, d):
    return _rounded(study.surface_changes(_group_surfaces(spark, d)).drop("proxy"), "value")


# -- models -------------------------------------------------------------------------------------------


@query("model_contributions", f"SELECT * FROM (VALUES {_V([('bio12', 1), ('bio1', 2)])}) t(band, place), LATERAL (SELECT CASE band WHEN 'bio12' THEN {_r('200e0 / 3.5e0')} ELSE {_r('150e0 / 3.5e0')} END AS percent, place = 1 AS top) z")
def _(spark, d):
    found = _given_model(spark, d)[0].contributions()
    t = spark.createDataFrame([(b, i, float(p), i == 1) for i, (b, p) in enumerate(found, 1)], "band string, place int, percent double, top boolean")
    return _rounded(t, "percent")


@query("l1_weights", f"SELECT kind, {_r('greatest(2e0 * base / sqrt((SELECT count(*) FROM thinned)), 1e-8)')} AS weight FROM (VALUES {_V(list(maxent.BASES.items()))}) t(kind, base)".replace("SELECT kind", _with("thinned") + "SELECT kind", 1))
def _(spark, d):
    kinds = list(maxent.BASES)
    found = maxent.l1_weights(tuple(maxent.Feature(k, ("bio1",) * (2 if k == "product" else 1)) for k in kinds), _thinned(spark, d).count(), 2.0)
    return _rounded(spark.createDataFrame([(k, float(w)) for k, w in zip(kinds, found, strict=True)], "kind string, weight double"), "weight")


@query("project_slices", _with("cells") + f""", {_ETA}, s AS (SELECT 'current' AS slice, row, col, bio1, bio12 FROM v UNION ALL SELECT 'warm', row, col, bio1 + 2, bio12 FROM v),
p AS (SELECT slice, row, col, 1.5e0 * least(greatest((bio1 - (SELECT min(bio1) FROM v)) / (SELECT max(bio1) - min(bio1) FROM v), 0e0), 1e0) - 2e0 * least(greatest((bio12 - (SELECT min(bio12) FROM v)) / (SELECT max(bio12) - min(bio12) FROM v), 0e0), 1e0) AS eta FROM s)
SELECT slice, row, col, {_r('1 - exp(-exp(h) * exp(eta - off) / z)')} AS value FROM p, o, z, h""")
def _(spark, d):
    m, v = _given_model(spark, d)
    model = models.MaxentModel(model=m)
    stacked = grid.stack_slices({"current": v, "warm": v.withColumn("bio1", F.col("bio1") + 2)})
    return _rounded(model.predict(stacked, "value").select("slice", "row", "col", "value"), "value")


@query("mahalanobis", _with("cells", "thinned") + f""", m AS (SELECT count(*) AS n, avg(bio1) AS m1, avg(bio12) AS m2, stddev_pop(bio1) AS s1, stddev_pop(bio12) AS s2 FROM thinned),
z AS (SELECT (bio1 - m1) / s1 AS a, (bio12 - m2) / s2 AS b, n FROM thinned, m), q AS (SELECT avg(a * b) AS c, avg((a * a + b * b) * (a * a + b * b)) AS quad, any_value(n) AS n FROM z),
k AS (SELECT c * (1 - CASE WHEN c = 0 THEN 0 ELSE least(greatest((quad - (2 + 2 * c * c)) / (n * 2e0), 0e0), c * c) / (c * c) END) AS c FROM q)
SELECT row, col, {_r('exp(-((a * a + b * b - 2 * k.c * a * b) / (1 - k.c * k.c)) / 2)')} AS score FROM (SELECT row, col, (bio1 - m1) / s1 AS a, (bio12 - m2) / s2 AS b FROM cells, m WHERE bio1 IS NOT NULL AND bio12 IS NOT NULL) t, k""")
def _(spark, d):
    m = models.Mahalanobis().fit(_thinned(spark, d), _thinned(spark, d), ["bio1", "bio12"])
    return _rounded(m.predict(_cells(spark, d).dropna(subset=["bio1", "bio12"])).select("row", "col", "score"), "score")


_DRAW = "(((CAST(draw AS BIGINT) * 73856093 + CAST(i AS BIGINT) * 19349663 + 42) % 2147483647) * 48271 + 11) % 2147483647"


@query("null_auc", f"""WITH s AS (SELECT draw.range AS draw, i.range AS i FROM range(99) draw, range(530) i), r AS (SELECT draw, i, {_DRAW} AS score FROM s),
k AS (SELECT draw, i, rank() OVER (PARTITION BY draw ORDER BY score) + (count(*) OVER (PARTITION BY draw, score) - 1) / 2e0 AS r FROM r),
a AS (SELECT draw, (sum(CASE WHEN i < 30 THEN r END) - 30 * 31 / 2e0) / (30e0 * 500) AS auc FROM k GROUP BY 1) SELECT {_r('quantile_cont(auc, 0.95)')} AS null_auc FROM a""")
def _(spark, d):
    mixed = (F.col("draw").cast("long") * 73856093 + F.col("i") * 19349663 + 42) % 2147483647
    return _rounded(validate.null_auc(spark, 30, 500, 99, score=(mixed * 48271 + 11) % 2147483647), "null_auc")


@query("tss_quantiles", _with("fx_score") + f""", v AS (SELECT DISTINCT score FROM fx_score), cut AS (SELECT DISTINCT unnest(quantile_cont(score, [k / 19e0 FOR k IN range(20)])) AS t FROM v),
m AS (SELECT t, avg(CASE WHEN label = 1 THEN CASE WHEN score >= t THEN 1e0 ELSE 0e0 END END) + avg(CASE WHEN label = 0 THEN CASE WHEN score < t THEN 1e0 ELSE 0e0 END END) - 1 AS tss FROM fx_score, cut GROUP BY 1)
SELECT {_r('tss')} AS tss, {_r('t')} AS threshold FROM m ORDER BY m.tss DESC, t LIMIT 1""")
def _(spark, d):
    return _rounded(validate.tss(fixtures.fixture(spark, d, "fx_score"), quantiles=20), "tss", "threshold")


@query("fold_scores", _with("fx_score") + f""", r AS (SELECT id % 4 AS fold, label, rank() OVER (PARTITION BY id % 4 ORDER BY score) + (count(*) OVER (PARTITION BY id % 4, score) - 1) / 2e0 AS r FROM fx_score),
a AS (SELECT fold, (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2e0) / (CAST(sum(label) AS DOUBLE) * (count(*) - sum(label))) AS auc FROM r GROUP BY 1)
SELECT {_r('round(avg(auc), 3)')} AS auc_mean, {_r('round(stddev_samp(auc), 3)')} AS auc_sd, {_r('round(avg(auc) - 0.5, 3)')} AS tss_mean, count(auc) AS valid_folds FROM a""")
def _(spark, d):
    scored = fixtures.fixture(spark, d, "fx_score").withColumn("fold", (F.col("id") % 4).cast("int"))
    folds = validate.group_auc(scored, ["fold"]).withColumn("tss", F.col("auc") - 0.5)
    return _rounded(study.cv_summary(folds), "auc_mean", "auc_sd", "tss_mean")


@query("cluster_folds", _with("fx_site") + "SELECT site, min(site) OVER (PARTITION BY site_id % 3) AS fold_of FROM fx_site")
def _(spark, d):
    apart = _sites(spark, d).withColumn("lon", F.col("lon") + 500 * (F.col("site_id") % 3))
    placed, _ = validate.kmeans_folds(apart, "lon", "lat", 3)
    names = placed.groupBy("fold").agg(F.min("site").alias("fold_of"))
    return placed.join(names, "fold").select("site", "fold_of")


@query("isotope_groups", _with("fx_specimen") + "SELECT orderkey, line, CASE WHEN d13c_coll IS NULL OR d15n_coll IS NULL THEN -1 ELSE CAST(orderkey % 3 AS INTEGER) END AS isotope_group FROM fx_specimen")
def _(spark, d):
    rows = _specimens(spark, d).select("orderkey", "line", (F.col("d13C_coll") + 500 * (F.col("orderkey") % 3)).alias("x"), (F.col("d15N_coll") + 500 * (F.col("orderkey") % 3 % 2)).alias("y"))
    found = models.isotope_groups(rows, "x", "y", 3)
    # clusters are numbered as they come: name each by the remainder that its rows share
    least = found.groupBy("isotope_group").agg(F.min(F.col("orderkey") % 3).cast("int").alias("least"))
    names = least.select("isotope_group", F.when(F.col("isotope_group") >= 0, F.col("least")).alias("name"))
    return found.join(F.broadcast(names), "isotope_group", "left").select("orderkey", "line", F.coalesce("name", "isotope_group").alias("isotope_group"))


@query("ensemble", _with("surf") + f""", r AS (SELECT row, col, a, b, count(a) OVER (ORDER BY a RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(count(a) OVER () AS DOUBLE) AS ra, count(b) OVER (ORDER BY b RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(count(b) OVER () AS DOUBLE) AS rb FROM surf WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT row, col, {_r('(0.3e0 * ra + 0.2e0 * rb) / 0.5e0')} AS score FROM r""")
def _(spark, d):
    s = _surfaces(spark, d).dropna()
    one = {"a": s.select("row", "col", F.col("a").alias("score")), "b": s.select("row", "col", F.col("b").alias("score")), "bad": s.select("row", "col", F.lit(1.0).alias("score"))}
    return _rounded(models.ensemble(one, one, {"a": 0.8, "b": 0.7, "bad": 0.55}), "score")


def _gradient(m, spark: SparkSession, d: str) -> DataFrame:
    """(feature, gradient): of the penalised likelihood at a fitted regression's coefficients; it is strictly convex, so nothing but its optimum has none."""
    presence, background = _thinned(spark, d).select("bio1", "bio12"), _cells(spark, d).dropna(subset=["bio1", "bio12"]).select("bio1", "bio12")
    fitted = m.fit(presence, background, ["bio1", "bio12"])
    rows = models.class_weights(presence.withColumn("label", F.lit(1)).unionByName(background.withColumn("label", F.lit(0))))
    x, beta = fitted.features(), [float(c) for c in fitted.model.coefficients]
    total = float(rows.agg(F.sum("w")).first()[0])
    eta = F.lit(float(fitted.model.intercept))
    for c, f in zip(beta, x, strict=True):
        eta = eta + c * f
    off = F.col("w") * (1 / (1 + F.exp(-eta)) - F.col("label"))
    sums = rows.agg(*((F.sum(off * f) / total + c / (m.strength * total)).alias(f"g{i}") for i, (c, f) in enumerate(zip(beta, x, strict=True))), (F.sum(off) / total).alias("g_free"))
    named = F.array(*(F.struct(F.lit(i).alias("feature"), F.col(f"g{i}").alias("gradient")) for i in range(len(x))), F.struct(F.lit(-1).alias("feature"), F.col("g_free").alias("gradient")))
    return sums.select(F.explode(named).alias("s")).select("s.feature", stable(F.col("s.gradient"), 4).alias("gradient"))


@query("glm_optimum", "SELECT CAST(range - 1 AS INTEGER) AS feature, 0e0 AS gradient FROM range(5)")
def _(spark, d):
    return _gradient(models.Glm(), spark, d)


@query("gam_optimum", "SELECT CAST(range - 1 AS INTEGER) AS feature, 0e0 AS gradient FROM range(13)")
def _(spark, d):
    return _gradient(models.Gam(), spark, d)


@query("maxent_optimum", "SELECT * FROM (VALUES ('linear(bio1)', 0e0), ('linear(bio12)', 0e0), ('quadratic(bio1)', 0e0), ('quadratic(bio12)', 0e0)) t(feature, violation)")
def _(spark, d):
    """How far each coefficient is from the optimum's conditions: no gradient left but the penalty's, or less than it at 0."""
    presence, background = _thinned(spark, d).select("bio1", "bio12"), _cells(spark, d).dropna(subset=["bio1", "bio12"]).select("bio1", "bio12")
    m = maxent.fit(presence, background, ["bio1", "bio12"], beta=3.0, kinds=("linear", "quadratic"))
    n = presence.count()
    penalty = maxent.l1_weights(m.spec.features, n, 3.0)
    rows = presence.withColumn("y", F.lit(1.0)).unionByName(background.withColumn("y", F.lit(0.0)))
    weight = F.when(F.col("y") == 1, 1.0).otherwise(maxent.BACKGROUND_WEIGHT)
    # the intercept is free: the one that makes the weighted residuals sum to nothing
    eta = rows.select("*", m.link().alias("eta"), weight.alias("w")).cache()
    free = 0.0
    for _ in range(60):
        off, slope = eta.agg(F.sum(F.col("w") * (1 / (1 + F.exp(-F.col("eta") - free)) - F.col("y"))), F.sum(F.col("w") / (2 + F.exp(F.col("eta") + free) + F.exp(-F.col("eta") - free)))).first()
        free -= max(min(off / slope, 2.0), -2.0)
        if abs(off) < 1e-9 * n:
            break
    off = F.col("w") * (1 / (1 + F.exp(-F.col("eta") - free)) - F.col("y"))
    got = eta.agg(*(F.sum(off * m.spec.column(f)).alias(f"g{i}") for i, f in enumerate(m.spec.features))).first()
    eta.unpersist()
    out = []
    for i, (f, c) in enumerate(zip(m.spec.features, m.coefficients, strict=True)):
        g, most = got[f"g{i}"] / n, float(penalty[i])
        out.append((f.name, abs(g + most * (1 if c > 0 else -1)) if c else max(0.0, abs(g) - most)))
    return spark.createDataFrame(out, "feature string, violation double").select("feature", stable(F.col("violation"), 4).alias("violation"))


@query("importance_of_one_band", "SELECT * FROM (VALUES ('bio1', 100e0), ('bio12', 0e0)) t(band, percent)")
def _(spark, d):
    cells = _cells(spark, d).dropna(subset=["bio1", "bio12"])
    presence, background = cells.filter("bio1 > 8"), cells.filter("bio1 <= 8")
    m = maxent.with_background(maxent.fit_features(cells, ["bio1", "bio12"], kinds=("linear",)), [3.0, 0.0], background)
    return _rounded(spark.createDataFrame(maxent.permutation_importance(m, presence, background, repeats=1), "band string, percent double"), "percent")


@query("comparison_of_few_sites", "SELECT m.model, 'needs ' || m.min_sites || ' sites, has 2' AS note, CAST(0 AS INTEGER) AS folds FROM (VALUES ('bioclim', 3), ('mahalanobis', 4), ('glm', 5), ('gam', 8), ('rf', 10), ('brt', 15), ('maxent', 5)) m(model, min_sites)")
def _(spark, d):
    cells = _cells(spark, d).dropna(subset=["bio1", "bio12"])
    two = cells.orderBy("row", "col").limit(2)  # the case: fewer sites than any model needs
    return models.compare_models(two, cells, ["bio1", "bio12"], list(dims.MODEL_MIN_SITES)).select("model", "note", "folds")


@query("models_by_cv", _with("thinned", "every_background") + f""", r AS (SELECT row_number() OVER () AS id, * FROM (SELECT 1 AS label, x, y, bio1, bio12 FROM thinned UNION ALL SELECT 0, x, y, bio1, bio12 FROM every_background)),
rows AS MATERIALIZED (SELECT *, ((CAST(floor(x / 4e0) AS BIGINT) + CAST(floor(y / 4e0) AS BIGINT)) % 4 + 4) % 4 AS fold FROM r),
sets AS (SELECT k.range AS k FROM range(-1, 4) k),
tr AS (SELECT k, bio1, bio12 FROM sets JOIN rows ON label = 1 AND fold <> k), te AS MATERIALIZED (SELECT k, id, label, bio1, bio12 FROM sets JOIN rows ON k = -1 OR fold = k),
m AS MATERIALIZED (SELECT k, count(*) AS n, avg(bio1) AS m1, avg(bio12) AS m2, stddev_pop(bio1) AS s1, stddev_pop(bio12) AS s2 FROM tr GROUP BY 1),
f AS (SELECT te.k, id, any_value(label) AS label, sum((tr.bio1 < te.bio1)::INT + (tr.bio1 <= te.bio1)::INT) / (2e0 * count(*)) AS f1, sum((tr.bio12 < te.bio12)::INT + (tr.bio12 <= te.bio12)::INT) / (2e0 * count(*)) AS f12 FROM te JOIN tr ON te.k = tr.k GROUP BY 1, 2),
z AS (SELECT k, (bio1 - m1) / s1 AS a, (bio12 - m2) / s2 AS b, n FROM tr JOIN m USING (k)), q AS (SELECT k, avg(a * b) AS c, avg((a * a + b * b) * (a * a + b * b)) AS quad, any_value(n) AS n FROM z GROUP BY 1),
h AS (SELECT k, c * (1 - CASE WHEN c = 0 THEN 0 ELSE least(greatest((quad - (2 + 2 * c * c)) / (n * 2e0), 0e0), c * c) / (c * c) END) AS c FROM q),
scored AS (SELECT 'bioclim' AS model, k, label, least(greatest(least(2 * least(f1, 1 - f1), 2 * least(f12, 1 - f12)), 0e0), 1e0) AS score FROM f
  UNION ALL SELECT 'mahalanobis', k, label, exp(-((a * a + b * b - 2 * h.c * a * b) / (1 - h.c * h.c)) / 2) FROM (SELECT te.k, label, (bio1 - m1) / s1 AS a, (bio12 - m2) / s2 AS b FROM te JOIN m ON te.k = m.k) t JOIN h USING (k)),
t AS (SELECT model, k, score, sum(label) AS p, count(*) - sum(label) AS b FROM scored GROUP BY ALL),
w AS (SELECT *, sum(p) OVER g AS np, sum(b) OVER g AS nb, coalesce(sum(p) OVER (PARTITION BY model, k ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bp, coalesce(sum(b) OVER (PARTITION BY model, k ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bb FROM t WINDOW g AS (PARTITION BY model, k)),
e AS (SELECT model, k, sum(p * (bb + b / 2e0)) / (any_value(np) * any_value(nb)) AS auc, max((np - bp) / CAST(np AS DOUBLE) + bb / CAST(nb AS DOUBLE) - 1) AS tss FROM w WHERE np > 0 AND nb >= 20 AND (k = -1 OR (SELECT count(*) FROM thinned) - np >= 3) GROUP BY 1, 2),
c AS (SELECT model, max(CASE WHEN k = -1 THEN auc END) AS train_auc, avg(CASE WHEN k >= 0 THEN auc END) AS cv_auc, avg(CASE WHEN k >= 0 THEN tss END) AS cv_tss, CAST(count(*) FILTER (k >= 0) AS INTEGER) AS folds FROM e GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY c.cv_auc DESC) AS INTEGER) AS place, model, {_r('train_auc')} AS train_auc, {_r('cv_auc')} AS cv_auc, {_r('cv_tss')} AS cv_tss, folds FROM c""")
def _(spark, d):
    """Models of closed form in the order of their AUC on folds of blocks, trained and tested on all sites and cells."""
    every = _cells(spark, d).dropna(subset=["bio1", "bio12"])
    found = models.compare_models(_thinned(spark, d), every, ["bio1", "bio12"], ["bioclim", "mahalanobis"], folds=4, method="checkerboard", block=4.0)
    table = [(i, r["model"], r["train_auc"], r["cv_auc"], r["cv_tss"], r["folds"]) for i, r in enumerate(found.collect(), 1)]  # a row a model
    return _rounded(spark.createDataFrame(table, "place int, model string, train_auc double, cv_auc double, cv_tss double, folds int"), "train_auc", "cv_auc", "cv_tss")


@query("asof_slices", """WITH r AS (SELECT l_orderkey AS orderkey, l_linenumber AS line, CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey END AS place, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS day FROM lineitem),
s AS (SELECT place, day, max(reading) AS reading FROM (SELECT CASE WHEN k % 3 = 0 THEN 0 ELSE k END AS place, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, o_totalprice AS reading FROM (SELECT *, o_custkey % (SELECT count(*) FROM supplier) + 1 AS k FROM orders)) GROUP BY 1, 2)
SELECT r.orderkey, r.line, r.place, r.day, s.reading FROM r ASOF LEFT JOIN s ON r.place = s.place AND r.day >= s.day""")
def _(spark, d):
    """For each dated record the latest earlier reading of its place; a third of all records and readings are of one place."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    place = lambda k: F.when(k % 3 == 0, F.lit(0).cast("long")).otherwise(k)
    records = read("lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), place(F.col("l_suppkey")).alias("place"), day("l_shipdate").alias("day"))
    readings = read("orders").select(place(F.col("o_custkey") % read("supplier").count() + 1).alias("place"), day("o_orderdate").alias("day"), F.col("o_totalprice").alias("reading"))
    return asof.asof_join(records, readings, ["place"], "day", ["reading"])


# -- tests of ranks ----------------------------------------------------------------------------------


def _upper_gamma(a: str, x: str) -> str:
    """Upper regularised incomplete gamma function by the series of the lower one."""
    return f"(CASE WHEN {x} > 45 THEN 0e0 WHEN {x} <= 0 THEN 1e0 ELSE 1 - list_sum([exp(-{x} + ({a} + k) * ln({x}) - lgamma({a} + k + 1)) FOR k IN range(250)]) END)"


@query("mann_whitney_p", _with("en") + f""", {_PAIRS}, vals AS (SELECT p.zone, p.o, p.from_n, p.to_n, e.d13c_coll AS v, CASE WHEN list_position(['EBA', 'LBA', 'EIA', 'HAN', 'GOG', 'BHL'], e.period) - 1 = p.o THEN 1 ELSE 0 END AS f
  FROM pair p JOIN en e ON e.zone = p.zone AND list_position(['EBA', 'LBA', 'EIA', 'HAN', 'GOG', 'BHL'], e.period) - 1 IN (p.o, p.o + 1) WHERE e.d13c_coll IS NOT NULL),
ranked AS (SELECT *, rank() OVER (PARTITION BY zone, o ORDER BY v) + (count(*) OVER (PARTITION BY zone, o, v) - 1) / 2e0 AS r FROM vals),
t AS (SELECT zone, o, sum(c * c * c - c) AS ties FROM (SELECT zone, o, v, CAST(count(*) AS DOUBLE) AS c FROM vals GROUP BY 1, 2, 3) GROUP BY 1, 2),
u AS (SELECT zone, o, CAST(any_value(from_n) AS DOUBLE) AS m, CAST(any_value(to_n) AS DOUBLE) AS n, sum(r * f) - any_value(from_n) * (any_value(from_n) + 1) / 2e0 AS u FROM ranked GROUP BY 1, 2),
z AS (SELECT zone, o, (greatest(u, m * n - u) - m * n / 2 - 0.5e0) / sqrt(m * n / 12 * ((m + n + 1) - ties / ((m + n) * (m + n - 1)))) AS z FROM u JOIN t USING (zone, o) WHERE least(m, n) > 8)
SELECT zone, CAST(o AS INTEGER) AS period_no, {_r('least(1e0, CASE WHEN z <= 0 THEN 1e0 ELSE ' + _upper_gamma('0.5e0', '(z * z / 2)') + ' END)')} AS p FROM z""")
def _(spark, d):
    t = summary.adjacent_changes(_enriched(spark, d), "d13C_coll").filter("least(from_n, to_n) > 8")
    return t.select("zone", enrich.period_rank(F.col("from_period")).alias("period_no"), stable(F.col("p")).alias("p"))


@query("kruskal_p", _with("en") + f""", g AS (SELECT zone, period, count(*) AS n FROM en WHERE zone IS NOT NULL AND period IS NOT NULL AND d15n_coll IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 4),
v AS (SELECT e.zone, e.period, e.d15n_coll AS v FROM en e JOIN g ON e.zone = g.zone AND e.period = g.period WHERE e.d15n_coll IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY zone ORDER BY v) + (count(*) OVER (PARTITION BY zone, v) - 1) / 2e0 AS r FROM v),
s AS (SELECT zone, period, sum(r) AS r, count(*) AS n FROM r GROUP BY 1, 2),
t AS (SELECT zone, sum(c * c * c - c) AS ties FROM (SELECT zone, v, CAST(count(*) AS DOUBLE) AS c FROM v GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT s.zone, count(*) - 1 AS df, (12e0 / (sum(n) * (sum(n) + 1e0)) * sum(r * r / n) - 3 * (sum(n) + 1e0)) / (1 - any_value(ties) / (CAST(sum(n) AS DOUBLE) * sum(n) * sum(n) - sum(n))) AS h FROM s JOIN t ON s.zone = t.zone GROUP BY s.zone HAVING count(*) >= 2),
p AS (SELECT zone, {_upper_gamma('(df / 2e0)', '(h / 2)')} AS p FROM h)
SELECT zone, {_r('p')} AS p, p < 0.05e0 AS significant FROM p""")
def _(spark, d):
    return _rounded(summary.kruskal(_enriched(spark, d), "d15N_coll").select("zone", "p", "significant"), "p")


# -- niches --------------------------------------------------------------------------------------------


@query("niche_counts", _with("en") + f""", {_ELL.replace('FROM spec', 'FROM en').replace('taxon_group, count', 'period, taxon_group, count').replace('GROUP BY 1)', 'GROUP BY 1, 2)', 1)},
w AS (SELECT period, taxon_group, count(DISTINCT site) AS sites FROM en WHERE d13c_coll IS NOT NULL AND d15n_coll IS NOT NULL GROUP BY 1, 2)
SELECT el.period, el.taxon_group, n, sites, {_r('cx')} AS x_mean, {_r('cy')} AS y_mean, CASE WHEN NOT thin THEN {_r('sea')} END AS sea, CASE WHEN NOT thin THEN {_r('sea * (n - 1) / (n - 2)')} END AS seac, CASE WHEN NOT thin THEN {_r('nr')} END AS nr, CASE WHEN NOT thin THEN {_r('cr')} END AS cr,
  CASE WHEN n < 5 THEN 'too few' WHEN nr = 0 OR cr = 0 THEN 'no spread' WHEN n < 10 THEN 'few, take care' END AS note
FROM (SELECT *, n < 5 OR nr = 0 OR cr = 0 AS thin FROM el) el JOIN w ON el.period IS NOT DISTINCT FROM w.period AND el.taxon_group IS NOT DISTINCT FROM w.taxon_group""")
def _(spark, d):
    t = niche.niche_table(_enriched(spark, d), ["period", "taxon_group"], "d13C_coll", "d15N_coll")
    return _rounded(t.select("period", "taxon_group", "n", "sites", "x_mean", "y_mean", "sea", "seac", "nr", "cr", "note"), "x_mean", "y_mean", "sea", "seac", "nr", "cr")


#: Hulls on the whole numbers behind the values (quantity, discount in percent); of each x only the ends matter.
_HULL = """i AS (SELECT s.taxon_group, CAST(round((d13c_coll + 24) / 0.3e0) AS BIGINT) AS x, CAST(round((d15n_coll - 4) / 0.6e0) AS BIGINT) AS y FROM spec s WHERE d13c_coll IS NOT NULL AND d15n_coll IS NOT NULL),
e AS (SELECT taxon_group, x, min(y) AS lo, max(y) AS hi FROM i GROUP BY 1, 2), p AS (SELECT taxon_group, x, lo AS y FROM e UNION SELECT taxon_group, x, hi FROM e),
k AS (SELECT a.taxon_group, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM p a JOIN p b ON a.taxon_group = b.taxon_group AND (a.x <> b.x OR a.y <> b.y)),
s AS (SELECT k.*, min((qx - px) * (p.y - py) - (qy - py) * (p.x - px)) AS least,
  bool_or((qx - px) * (p.y - py) = (qy - py) * (p.x - px) AND ((p.x - px) * (qx - px) + (p.y - py) * (qy - py) < 0 OR (p.x - px) * (qx - px) + (p.y - py) * (qy - py) > (qx - px) * (qx - px) + (qy - py) * (qy - py))) AS beyond FROM k JOIN p ON p.taxon_group = k.taxon_group GROUP BY ALL)"""


@query("hull_area", _with("spec") + f", {_HULL} SELECT taxon_group, {_r('sum(px * qy - qx * py) / 2e0 * 0.3e0 * 0.6e0')} AS ta FROM s WHERE least >= 0 AND NOT beyond GROUP BY 1")
def _(spark, d):
    t = niche.niche_table(_specimens(spark, d), ["taxon_group"], "d13C_coll", "d15N_coll", draws=1)
    return _rounded(t.select("taxon_group", "ta"), "ta")


@query("niche_labels", _with("en") + "SELECT DISTINCT zone || ' 0' || CAST(list_position(['EBA', 'LBA', 'EIA', 'HAN', 'GOG', 'BHL'], period) - 1 AS VARCHAR) AS grp FROM en WHERE zone IS NOT NULL AND period IS NOT NULL AND d13c_coll IS NOT NULL AND d15n_coll IS NOT NULL")
def _(spark, d):
    return study.niche_study(_enriched(spark, d))["table"].select("grp")


# -- scenarios --------------------------------------------------------------------------------------------

_SERIES = "CASE CAST(floor((step - 1) / 3) AS INTEGER) WHEN 0 THEN (1 - ((step - 1) % 3 + 1) / 3e0) * a + ((step - 1) % 3 + 1) / 3e0 * b ELSE (1 - ((step - 1) % 3 + 1) / 3e0) * b + ((step - 1) % 3 + 1) / 3e0 * c END"
_SURF3 = "surf3 AS (SELECT *, CASE WHEN a IS NOT NULL THEN ((row * 5 + col * 3) % 100) / 100e0 END AS c FROM surf)"


def _three(spark: SparkSession, d: str) -> list[DataFrame]:
    s = _surfaces(spark, d).withColumn("c", F.when(F.col("a").isNotNull(), ((F.col("row") * 5 + F.col("col") * 3) % 100) / F.lit(100.0)))
    return [s.select("row", "col", F.col(v).alias("value")) for v in ("a", "b", "c")]


@query("dispersal_series", _with("surf", recursive=True) + f""", {_SURF3}, occ(step, row, col) AS (
  SELECT 0, row, col FROM surf3 WHERE a >= 0.7e0
  UNION
  SELECT o.step + 1, s.row, s.col FROM occ o, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) k(i, j), (SELECT step, row, col, {_SERIES} AS v FROM surf3, (SELECT range AS step FROM range(1, 7)) t) s
  WHERE o.step < 6 AND s.step = o.step + 1 AND s.row = o.row + k.i AND s.col = o.col + k.j AND coalesce(s.v, 0) >= 0.4e0
) SELECT CAST(step AS INTEGER) AS step, row, col FROM occ""")
def _(spark, d):
    series = _three(spark, d)
    start = series[0].filter("value >= 0.7")
    return scenario.dispersal_series(series, start, 3, 0.4, 1, 1.0, 0.0)


@query("suitable_cells", _with("surf") + f", {_SURF3} SELECT CAST(step AS INTEGER) AS step, sum(CASE WHEN {_SERIES} >= 0.4e0 THEN 1 ELSE 0 END)::BIGINT AS suitable FROM surf3, (SELECT range AS step FROM range(1, 7)) t GROUP BY 1")
def _(spark, d):
    return scenario.suitable_counts(_three(spark, d), 3, 0.4)


@query("occupied_cells", _with("surf") + "SELECT 0 AS step, count(*) AS occupied FROM surf WHERE a >= 0.7e0")
def _(spark, d):
    one = _surfaces(spark, d).filter("a >= 0.7").select(F.lit(0).alias("step"), "row", "col")
    return scenario.occupancy_counts(one)


@query("start_cells", _with("located") + "SELECT DISTINCT row, col FROM located")
def _(spark, d):
    return study.start_cells(_sites(spark, d), GRID)


# -- plot tables -------------------------------------------------------------------------------------------


@query("plot_biplot", _with("en") + 'SELECT period AS "group", d13c_coll AS x, d15n_coll AS y FROM en WHERE d13c_coll IS NOT NULL AND d15n_coll IS NOT NULL')
def _(spark, d):
    return plots.biplot(_enriched(spark, d))


@query("plot_site_map", _with("en") + "SELECT site, lon, lat, zone, count(*) AS n FROM en WHERE lon IS NOT NULL AND lat IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return plots.site_map(_enriched(spark, d))


@query("plot_time_series", _with("en") + "SELECT period, taxon_group, CAST(list_position(['EBA', 'LBA', 'EIA', 'HAN', 'GOG', 'BHL'], period) - 1 AS INTEGER) AS ordinal, count(*) AS n, count(DISTINCT site) AS sites FROM en WHERE period IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return plots.time_series(_enriched(spark, d)).select("period", "taxon_group", "ordinal", "n", "sites")


@query("plot_zone_trajectories", _with("en") + "SELECT zone, period, CAST(list_position(['EBA', 'LBA', 'EIA', 'HAN', 'GOG', 'BHL'], period) - 1 AS INTEGER) AS ordinal, count(*) AS n, count(d13c_coll) AS d13c_n FROM en WHERE zone IS NOT NULL AND period IS NOT NULL GROUP BY ALL HAVING count(*) >= 3")
def _(spark, d):
    return plots.zone_trajectories(_enriched(spark, d), "d13C_coll").select("zone", "period", "ordinal", "n", F.col("d13C_coll_n").alias("d13c_n"))


@query("plot_zone_taxon", _with("en") + f"SELECT zone, taxon_group, count(*) AS n, {_r('avg(d13c_coll)')} AS x, {_r('stddev_samp(d13c_coll)')} AS x_sd, {_r('avg(d15n_coll)')} AS y, {_r('stddev_samp(d15n_coll)')} AS y_sd FROM en WHERE zone IS NOT NULL AND d13c_coll IS NOT NULL AND d15n_coll IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return _rounded(plots.zone_taxon_biplot(_enriched(spark, d)), "x", "x_sd", "y", "y_sd")


@query("plot_ellipses", _with("spec") + f", {_ELL} SELECT taxon_group, CAST(i.range AS INTEGER) AS i, {_r(f'cx + ux * a * cos(i.range * {2 * math.pi / 99!r}) - uy * b * sin(i.range * {2 * math.pi / 99!r})')} AS ex, {_r(f'cy + uy * a * cos(i.range * {2 * math.pi / 99!r}) + ux * b * sin(i.range * {2 * math.pi / 99!r})')} AS ey FROM el, range(100) i WHERE n >= 3")
def _(spark, d):
    return _rounded(plots.niche_ellipses(_specimens(spark, d), ["taxon_group"]).select("taxon_group", "i", "ex", "ey"), "ex", "ey")


@query("plot_panels", _with("cells") + f"SELECT panel, row, col, {_r('least(greatest((v - lo) / (hi - lo), 0e0), 1e0)')} AS scaled FROM (SELECT 'elev' AS panel, row, col, elev AS v FROM cells UNION ALL SELECT 'bio12', row, col, bio12 FROM cells) t, (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM (SELECT elev AS v FROM cells UNION ALL SELECT bio12 FROM cells)) z")
def _(spark, d):
    c = _cells(spark, d)
    t = plots.panel_maps({"elev": c.select("row", "col", F.col("elev").alias("value")), "bio12": c.select("row", "col", F.col("bio12").alias("value"))})
    return _rounded(t.select("panel", "row", "col", "scaled"), "scaled")


# -- sources read from files that the query writes -------------------------------------------------------------

_FX = _with("fx_site")


def _site_rows(spark: SparkSession, d: str) -> list:
    """The fixture's sites on the driver: what goes into one file (a row for each site)."""
    return _sites(spark, d).select("site_id", "site", "lat", "lon").orderBy("site_id").collect()


_COLLAGEN = ["Site Name", "Province", "Culture/Chronology", "Sample ID", "Latitude", "Longitude", "Estimated Year  Upper (BP)", "Estimated Year Lower (BP)"]


@query("regional_workbook", _FX + """, c AS (SELECT 'S' || site_id AS sample_id, site, lat, lon, CASE WHEN site_id % 4 = 0 THEN 'human' ELSE 'animal' END AS grp, 2000e0 + site_id % 500 AS up, 1900e0 + site_id % 500 AS low, -20e0 + site_id % 5 AS c13, 8e0 + site_id % 4 AS n15, CASE WHEN site_id % 3 = 0 THEN NULL ELSE 3.2e0 END AS cn, site_id FROM fx_site),
a AS (SELECT CASE WHEN site_id % 5 = 0 THEN 'X' || site_id ELSE 'S' || site_id END AS sample_id, site, lat, lon, grp, up, low, -10e0 - site_id % 3 AS ap, site_id FROM c WHERE site_id % 2 = 0)
SELECT grp AS "group", c.site, c.lat, c.lon, (up + low) / 2 AS bp_mid, c13 AS d13c, n15 AS d15n, cn, ap AS d13c_ap FROM c LEFT JOIN (SELECT sample_id, site, ap FROM a) a ON a.sample_id = c.sample_id AND a.site = c.site
UNION ALL SELECT grp, site, lat, lon, (up + low) / 2, NULL, NULL, NULL, ap FROM a WHERE site_id % 5 = 0""")
def _(spark, d):
    value, mineral = ["δ13C (‰, VPDB)", "δ15N (‰, AIR)", "Atomic C:N Ratio"], ["δ13C Carbonate (‰, VPDB)", "δ18O Carbonate (‰, VPDB)"]
    sheets = {n: [h] for n, h in (("Human organic materials", [*_COLLAGEN, *value]), ("Animal organic materials", [*_COLLAGEN, "Common Name", "Genus&Species", *value]), ("Human bioapatite", [*_COLLAGEN, *mineral]), ("Animal bioapatite", [*_COLLAGEN, "Common Name", *mineral]))}
    for r in _site_rows(spark, d):
        k, human = r["site_id"], r["site_id"] % 4 == 0
        base = [r["site"], "Jilin", "Han Dynasty", f"S{k}", r["lat"], r["lon"], 2000 + k % 500, 1900 + k % 500]
        who = [] if human else ["Pig", None]
        kind = "Human" if human else "Animal"
        sheets[f"{kind} organic materials"].append([*base, *who, -20 + k % 5, 8 + k % 4, "n/a" if k % 3 == 0 else 3.2])
        if k % 2 == 0:
            sheets[f"{kind} bioapatite"].append([*base[:3], f"{'X' if k % 5 == 0 else 'S'}{k}", *base[4:], *who[:1], -10 - k % 3])
    path = fixture_files.written(spark, {"r.xlsx": fixture_files.xlsx_bytes(sheets)})
    t = workbook.load_regional_workbook(spark, f"{path}/r.xlsx")
    return t.select("group", "site", "lat", "lon", "bp_mid", F.col("d13C_coll").alias("d13c"), F.col("d15N_coll").alias("d15n"), F.col("CN").alias("cn"), F.col("d13C_ap").alias("d13c_ap"))


@query("eurasian_workbook", _FX + """SELECT site, lat, lon, 'Mongolia' AS region, CASE WHEN site_id % 2 = 0 THEN 'human' ELSE 'animal' END AS "group", 1950e0 - (site_id % 900 - 600) AS bp_upper, 1950e0 - (site_id % 900 - 500) AS bp_lower, -17e0 - site_id % 4 AS d13c, CASE WHEN site_id % 2 = 0 THEN '사람' ELSE '개' END AS taxon_group FROM fx_site""")
def _(spark, d):
    rows = [["Site name", "Country", "Species", "Latitude", "Longitude", "Min age (95%)", "Max age (95%)", "delta 13C coll"]]
    for r in _site_rows(spark, d):
        k = r["site_id"]
        rows.append([r["site"], "Mongolia", "Homo sapiens" if k % 2 == 0 else "dog", r["lat"], r["lon"], k % 900 - 500, k % 900 - 600, -17 - k % 4])
    path = fixture_files.written(spark, {"e.xlsx": fixture_files.xlsx_bytes({"data": rows})})
    t = workbook.load_eurasian_workbook(spark, f"{path}/e.xlsx")
    return t.select("site", "lat", "lon", "region", "group", "bp_upper", "bp_lower", F.col("d13C_coll").alias("d13c"), "taxon_group")


@query("local_workbook", _FX + """SELECT site, CASE WHEN site_id % 2 = 0 THEN lat END AS lat, CASE WHEN site_id % 2 = 0 THEN lon END AS lon, 'Primorye' AS region, 1552e0 AS bp_upper, 1456e0 AS bp_lower, CASE WHEN site_id % 2 = 0 THEN 'pig' ELSE 'dog' END AS taxon, -20e0 + site_id % 3 AS d13c, 6e0 + site_id % 4 AS d15n, CASE WHEN site_id % 2 = 1 THEN 3.3e0 END AS cn FROM fx_site WHERE site_id % 7 <> 0""")
def _(spark, d):
    rows = [["Region", "culture", "period", "date", "lattitude", "longtidue", "site", "feature form", "spieces", "sex", "age", "δ13C", "δ15N"]]
    for r in _site_rows(spark, d):
        k = r["site_id"]
        c, n = (None, None) if k % 7 == 0 else (-20 + k % 3, 6 + k % 4)
        start = ["primorye", "c", "p", "398–494 AD"]
        # rows of the second layout hold the site where the latitude belongs, and the values further left
        rows.append([*start, r["lat"], r["lon"], r["site"], "pit", "pig", None, None, c, n] if k % 2 == 0 else [*start, r["site"], None, "dog", c, n, None, None, 3.3])
    path = fixture_files.written(spark, {"l.xlsx": fixture_files.xlsx_bytes({"s": rows})})
    t = workbook.load_local_table(spark, f"{path}/l.xlsx")
    return t.select("site", "lat", "lon", "region", "bp_upper", "bp_lower", "taxon", F.col("d13C_coll").alias("d13c"), F.col("d15N_coll").alias("d15n"), F.col("CN").alias("cn"))


@query("shapefile_points", _FX + "SELECT site, lon, lat, CASE WHEN site_id % 3 <> 0 THEN -18.5e0 + site_id % 4 END AS d13c, '돼지' AS taxon_group FROM fx_site")
def _(spark, d):
    rows = _site_rows(spark, d)
    shp, dbf = fixture_files.shapefile_bytes([(r["lon"], r["lat"]) for r in rows], {"id": [str(r["site_id"]) for r in rows], points.SITE_FIELD: [r["site"] for r in rows]})
    table = "id,13C,15N\n" + "".join(f"{r['site_id']},{'가' if r['site_id'] % 3 == 0 else -18.5 + r['site_id'] % 4},7\n" for r in rows)
    path = fixture_files.written(spark, {"p.shp": shp, "p.dbf": dbf, "v.csv": table.encode("cp949")})
    t = points.load_point_isotopes(spark, f"{path}/p.shp", f"{path}/v.csv")
    return t.select("site", "lon", "lat", F.col("d13C_coll").alias("d13c"), "taxon_group")


@query("shapefile_gazetteer", _FX + "SELECT lower(site) AS key, site, lat, lon, 'shapefile' AS coord_source FROM fx_site")
def _(spark, d):
    rows = _site_rows(spark, d)
    shp, dbf = fixture_files.shapefile_bytes([(r["lon"], r["lat"]) for r in rows], {points.SITE_FIELD: [r["site"] for r in rows]})
    path = fixture_files.written(spark, {"p.shp": shp, "p.dbf": dbf})
    return points.gazetteer_from_shapefile(spark, f"{path}/p.shp", points.SITE_FIELD)


@query("point_files", _FX + "SELECT kind, site, lon, lat FROM fx_site, (VALUES ('csv'), ('korean'), ('geojson'), ('xlsx')) t(kind) WHERE kind <> 'korean' OR site_id % 2 = 0")
def _(spark, d):
    rows = _site_rows(spark, d)
    plain = "name,lon,lat\n" + "".join(f"{r['site']},{r['lon']!r},{r['lat']!r}\n" for r in rows)
    # the Korean letters come after more than the first 64 kB
    korean = "name,경도,위도\n" + "x,,\n" * 20_000 + "".join(f"{r['site']},{r['lon']!r},{r['lat']!r}\n" if r["site_id"] % 2 == 0 else "가,,\n" for r in rows)
    features = [{"type": "Feature", "properties": {"name": r["site"]}, "geometry": {"type": "Point", "coordinates": [r["lon"], r["lat"]]}} for r in rows]
    sheet = [["name", "Longitude", "Latitude"], *([r["site"], r["lon"], r["lat"]] for r in rows)]
    path = fixture_files.written(spark, {"a.csv": plain.encode(), "k.csv": korean.encode("cp949"), "a.geojson": json.dumps({"type": "FeatureCollection", "features": features}).encode(), "a.xlsx": fixture_files.xlsx_bytes({"s": sheet})})
    read = lambda kind, name: points.load_points(spark, f"{path}/{name}").select(F.lit(kind).alias("kind"), F.try_element_at("attributes", F.lit("name")).alias("site"), "lon", "lat")
    return read("csv", "a.csv").unionByName(read("korean", "k.csv")).unionByName(read("geojson", "a.geojson")).unionByName(read("xlsx", "a.xlsx"))


@query("gazetteer_file", _FX + "SELECT lower(site) AS key, site, lat, lon, 'manual' AS coord_source FROM fx_site")
def _(spark, d):
    where = shared_dir(spark, "gazetteer")
    points.save_gazetteer(_sites(spark, d).select(F.lit(None).cast("string").alias("key"), "site", "lat", "lon", F.lit("manual").alias("coord_source")), f"{where}/g.csv")
    return points.load_gazetteer(spark, f"{where}/g.csv")


@query("raster_files", _with("cells") + "SELECT row, col, x, y, CAST(CAST(elev AS FLOAT) AS DOUBLE) AS elev, CAST(CAST(bio12 AS FLOAT) AS DOUBLE) / 10 AS bio12 FROM cells")
def _(spark, d):
    c, where = _cells(spark, d), shared_dir(spark, "rasters")
    for band in ("elev", "bio12"):
        rasters.write_layer(c.select("row", "col", F.col(band).alias("value")), GRID, f"{where}/{band}.tif")
    cells, g = rasters.read_stack(spark, {b: f"{where}/{b}.tif" for b in ("elev", "bio12")}, divisors={"bio12": 10.0})
    assert g == GRID
    return cells.select("row", "col", "x", "y", "elev", "bio12")


@query("raster_window", """WITH c AS (SELECT CAST(o_orderkey // 256 AS INTEGER) AS row, CAST(o_orderkey % 256 AS INTEGER) AS col, CAST(max(CAST(o_totalprice AS FLOAT)) AS DOUBLE) AS price FROM orders GROUP BY ALL),
size AS (SELECT max(row) + 1 AS height FROM c), win AS (SELECT height // 3 AS r0, height // 2 + 1 - height // 3 AS rows FROM size)
SELECT CAST(g.row AS INTEGER) AS row, CAST(k.range AS INTEGER) AS col, 100e0 + (k.range + 70 + 0.5e0) * 0.25e0 AS x, c.price, ((r0 + rows + 15) // 16 - r0 // 16) * 8 AS blocks
FROM win, LATERAL (SELECT unnest(range(rows)) AS row) g, range(114) k LEFT JOIN c ON c.row = g.row + r0 AND c.col = k.range + 70""")
def _(spark, d):
    """A surface of all orders as a tiled file, and a window of it: only the tiles that meet the window are taken out and decoded."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    cells = orders.select(F.floor(F.col("o_orderkey") / 256).cast("int").alias("row"), (F.col("o_orderkey") % 256).cast("int").alias("col"), F.col("o_totalprice").alias("value"))
    height = cells.agg(F.max("row")).first()[0] + 1
    g = grid.Grid(0.25, 100.0, -0.25, 0.25 * height, height, 256)
    path = f"{shared_dir(spark, 'rasters')}/price.tif"
    rasters.write_layer(cells, g, path, tile=16)
    r0, rows = height // 3, height // 2 + 1 - height // 3
    box = (117.5, g.f - 0.25 * (r0 + rows), 146.0, g.f - 0.25 * r0)
    blocks = rasters.coded_blocks(spark, path, g.window(box)).count()
    found, _ = rasters.read_stack(spark, {"price": path}, bbox=box)
    return found.select("row", "col", "x", "price", F.lit(blocks).cast("long").alias("blocks"))


@query("climate_catalogues", f"SELECT * FROM (VALUES {_V([('current', 'bio1', 'wc2.1_10m_bio_1.tif', 1.0), ('current', 'bio12', 'wc2.1_10m_bio_12.tif', 1.0), ('paleo', 'bio1', 'bio_1.tif', 10.0), ('paleo', 'bio12', 'bio_12.tif', 1.0), ('mid', 'bio1', 'ccmidbi1.tif', 10.0), ('mid', 'bio12', 'ccmidbi12.tif', 1.0)])}) t(kind, band, file, divisor)")
def _(spark, d):
    names = [f.format(n=n) for n in (1, 12) for f in ("wc2.1_10m_bio_{n}.tif", "bio_{n}.tif", "ccmidbi{n}.tif")]
    where = fixture_files.written(spark, dict.fromkeys(names, b""))
    found = {"current": rasters.worldclim_layers(spark, where, (1, 12)), "paleo": rasters.paleoclim_layers(spark, where, (1, 12)), "mid": rasters.worldclim_paleo_layers(spark, where, (1, 12))}
    scale = rasters.worldclim14_divisors((1, 12))
    rows = [(kind, band, path.rsplit("/", 1)[-1], 1.0 if kind == "current" else scale[band]) for kind, layers in found.items() for band, path in layers.items()]
    return spark.createDataFrame(rows, "kind string, band string, file string, divisor double")


@query("input_status", "SELECT * FROM (VALUES ('db', 'b.csv', true), ('none', 'x.csv', false), ('list', 'a.csv,b.csv', true)) t(name, path, found)")
def _(spark, d):
    where = fixture_files.written(spark, {"a.csv": b"x\n1\n", "b.csv": b"x\n2\n", "c.txt": b""})
    status = files.status(spark, {"db": [f"{where}/z.csv", f"{where}/b.csv"], "none": [f"{where}/x.csv"]})
    listed = ",".join(p.rsplit("/", 1)[-1] for p in files.list_datasets(spark, [where]))
    return status.withColumn("path", F.substring_index("path", "/", -1)).unionByName(spark.createDataFrame([("list", listed, True)], "name string, path string, found boolean"))


@query("csv_round_trip", _with("means") + f"SELECT site, {_r('lat')} AS lat, {_r('value')} AS value, n FROM means")
def _(spark, d):
    where = shared_dir(spark, "csv")
    sinks.write_csv(_rounded(summary.site_means(_specimens(spark, d), "d13C_coll").select("site", "lat", "value", "n"), "lat", "value"), f"{where}/t.csv", bom=True)
    t = spark.read.csv(f"{where}/t.csv", header=True)
    first = t.columns[0]
    return t.select(F.col(f"`{first}`").alias("site"), text.to_number(F.col("lat")).alias("lat"), text.to_number(F.col("value")).alias("value"), F.col("n").cast("long").alias("n"))


@query("json_round_trip", _with("means") + f"SELECT site, {_r('value')} AS value, {_r('sd')} AS sd FROM means")
def _(spark, d):
    shown = json.loads(sinks.table_json(_rounded(summary.site_means(_specimens(spark, d), "d13C_coll"), "value", "sd").select("site", "value", "sd")))
    return spark.createDataFrame([tuple(r) for r in shown["rows"]], ", ".join(f"{c} {'string' if c == 'site' else 'double'}" for c in shown["columns"]))


@query("preview_rows", "SELECT least(count(*), 300) AS rows FROM orders")
def _(spark, d):
    return sinks.preview(spark.read.parquet(f"{d}/orders.parquet")).agg(F.count(F.lit(1)).alias("rows"))


@query("summary_file", "SELECT count(*) AS samples, count(DISTINCT l_suppkey) AS sites FROM lineitem")
def _(spark, d):
    where = shared_dir(spark, "summary")
    totals = summary.totals(spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("site"))).first()
    sinks.write_summary(spark, totals.asDict(), f"{where}/s.json")
    return spark.read.json(f"{where}/s.json", multiLine=True).select("samples", "sites")


