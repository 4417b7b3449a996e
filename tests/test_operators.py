"""Properties and special cases of the operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelens import dims
from sitelens.functions import stats, text
from sitelens.functions.search import array_of, position, running_totals
from sitelens.operators import enrich, grid, isoscape, maxent, models, niche, scenario, summary, terrain, validate
from sitelens.schema import SPECIMEN, finalise, half_even, no_nan

GRID = grid.Grid(a=1.0, c=0.0, e=-1.0, f=10.0, height=10, width=12)


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(r, c, c + 0.5, 9.5 - r, float(r * 3 + c), float((r * 7 + c * 5) % 11)) for r in range(10) for c in range(12)]
    return spark.createDataFrame(rows, "row int, col int, x double, y double, b1 double, b2 double").cache()


def test_rounding_is_half_even(spark):
    assert spark.range(1).select(half_even(F.lit(0.125), 2)).first()[0] == 0.12


def test_no_nan(spark):
    assert spark.createDataFrame([(float("nan"),), (1.0,)], "v double").select(F.avg(no_nan(F.col("v")))).first()[0] == 1.0


def test_finalise_pads_and_orders(spark):
    t = finalise(spark.createDataFrame([("a", 10.0, 20.0)], "site string, bp_upper double, bp_lower double"))
    assert t.schema == SPECIMEN and t.first()["bp_mid"] == 15.0


def test_period_bins_and_fallback(spark):
    rows = spark.createDataFrame([(3500.0, 3500.0, None), (4000.0, 4000.0, None), (700.0, 700.0, None), (5000.0, 5000.0, "Han Dynasty"), (None, 2500.0, None)], "bp_upper double, bp_lower double, culture string")
    assert [r["period"] for r in enrich.assign_period(rows).collect()] == ["LBA", "EBA", None, "HAN", "EIA"]


def test_zone_priority(spark):
    t = enrich.assign_zone(spark.createDataFrame([(130.0, 43.0), (None, 43.0)], "lon double, lat double"))
    assert [r["zone"] for r in t.collect()] == [dims.ZONES[0][0], None]


def test_quality_bounds(spark):
    rows = spark.createDataFrame([(2.9,), (3.6,), (None,), (2.89,), (3.61,)], "CN double")
    assert enrich.quality_filter(rows).count() == 3
    with pytest.raises(ValueError):
        enrich.quality_filter(rows, require="bones")


def test_taxon_quirk(spark):
    rows = spark.createDataFrame([("Bos bovis",), ("ovis",), (None,), ("nan",), (" PIG ",)], "t string")
    assert [r[0] for r in rows.select(text.taxon_group(F.col("t"))).collect()] == ["소", "양·염소", "기타", "기타", "돼지"]


def test_inherited_mode_takes_first_of_ties(spark):
    rows = spark.createDataFrame([("s", "b"), ("s", "a"), ("s", None), ("", "c"), (None, None)], "site string, period string")
    got = {(r["site"], r["period"], r["inherited"]) for r in enrich.inherit_period(rows).collect()}
    assert ("s", "a", True) in got and (None, "c", True) in got
    strict = {(r["site"], r["period"]) for r in enrich.inherit_period(rows, unnamed=False).collect()}
    assert (None, None) in strict


def test_coordinates_replace_the_pair(spark):
    gaz = spark.createDataFrame([("a", "A", 1.0, 2.0, "manual")], "key string, site string, lat double, lon double, coord_source string")
    rows = spark.createDataFrame([("A", 50.0, None, "jilin"), ("B", None, None, "Jilin")], "site string, lat double, lon double, region string")
    got = {r["site"]: (r["lat"], r["lon"], r["coord_quality"]) for r in enrich.resolve_coordinates(rows, gaz, use_approx=True).collect()}
    assert got == {"A": (1.0, 2.0, "수기입력"), "B": (43.5, 126.0, "지역근사")}


@given(st.lists(st.floats(-100, 100), min_size=1, max_size=40), st.floats(-120, 120))
@settings(max_examples=5, deadline=None)
def test_position_is_binary_search(spark, values, probe):
    a = sorted(values)
    r = spark.range(1).select(position(F.lit(probe), array_of(a), len(a)), position(F.lit(probe), array_of(a), len(a), right=False)).first()
    assert tuple(r) == (np.searchsorted(a, probe, "right"), np.searchsorted(a, probe, "left"))


def test_running_totals(spark):
    t = spark.range(1000).select(F.col("id").cast("double").alias("k"), (F.col("id") % 7).alias("v"))
    got = {r["k"]: r["s"] for r in running_totals(t, "k", {"s": "v"}, ranges=5).collect()}
    assert [got[float(i)] for i in range(1000)] == np.cumsum(np.arange(1000) % 7).tolist()


def test_gamma_and_normal():
    assert abs(stats.chi2_survival(9.487729036781154, 4) - 0.05) < 1e-9
    assert abs(stats.chi2_survival(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(stats.normal_two_sided(1.959963984540054) - 0.05) < 1e-12


def test_u_distribution():
    assert stats.u_counts(2, 2) == [1, 1, 2, 1, 1]
    assert sum(stats.u_counts(4, 5)) == math.comb(9, 4)
    assert abs(stats.mann_whitney_p(0, 3, 3, 0) - 0.1) < 1e-12


def test_flat_aspect_and_edges(spark, cells):
    flat = cells.withColumn("b1", F.lit(5.0))
    assert {(r["slope"], r["aspect"]) for r in terrain.slope_aspect(flat, "b1", GRID).collect()} == {(0.0, 180.0)}
    assert terrain.ruggedness(flat, "b1").agg(F.max("tri")).first()[0] == 0.0


def test_extract_and_thin(spark, cells):
    sites = spark.createDataFrame([("p", 0.2, 9.8), ("q", 0.9, 9.1), ("out", -5.0, 3.0)], "site string, lon double, lat double")
    got = grid.presence_matrix(sites, cells, GRID, ["b1", "b2"]).collect()
    assert [(r["site"], r["row"], r["col"]) for r in got] == [("p", 0, 0)]


def test_background_is_repeatable(spark, cells):
    pick = lambda seed: {(r["row"], r["col"]) for r in grid.sample_background(cells, 30, ["b1"], seed).collect()}
    assert pick(1) == pick(1) != pick(2) and len(pick(1)) == 30


def test_crop_outside_fails():
    with pytest.raises(ValueError):
        GRID.window((100, 100, 110, 110))


def test_idw_bounds_and_sites(spark, cells):
    sites = spark.createDataFrame([("a", 0.5, 9.5, 1.0), ("b", 6.5, 4.5, 3.0), ("c", 11.5, 0.5, 2.0)], "site string, lon double, lat double, value double")
    got = isoscape.idw(cells, sites, max_distance=None).collect()
    assert all(1 - 1e-9 <= r["value"] <= 3 + 1e-9 for r in got)
    assert abs(next(r["value"] for r in got if (r["row"], r["col"]) == (0, 0)) - 1.0) < 1e-9
    with pytest.raises(ValueError):
        isoscape.idw(cells, sites.limit(1))


def test_schoener(spark, cells):
    s = cells.select("row", "col", F.col("b1").alias("value"))
    t = cells.select("row", "col", F.col("b2").alias("value"))
    assert abs(isoscape.schoener_d(s, s).first()["d"] - 1) < 1e-12
    assert 0 <= isoscape.schoener_d(s, t).first()["d"] <= 1


def test_auc_symmetry_and_ties(spark):
    t = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "label int, score double")
    assert validate.auc(t).first()["auc"] == 0.875
    assert abs(validate.auc(t.withColumn("label", 1 - F.col("label"))).first()["auc"] - 0.125) < 1e-12
    assert validate.auc(t.filter("label = 1")).first()["auc"] is None


def test_tss(spark):
    t = spark.createDataFrame([(1, 0.9), (1, 0.7), (0, 0.5), (0, 0.1)], "label int, score double")
    r = validate.tss(t).first()
    assert (r["tss"], r["threshold"]) == (1.0, 0.7)
    assert validate.tss(t, quantiles=500).first()["tss"] == 1.0


def test_negative_checkerboard(spark):
    assert spark.range(1).select(validate.checkerboard(F.lit(-3.0), F.lit(0.0), 1.0, 4)).first()[0] == 1


def test_kmeans_folds_cover_all(spark, cells):
    folded, centres = validate.kmeans_folds(cells, "x", "y", 4, tries=2)
    assert folded.count() == 120 and {r[0] for r in folded.select("fold").distinct().collect()} == set(range(4)) and len(centres) == 4


def test_mess_on_reference_is_not_negative(spark, cells):
    assert scenario.mess(cells, cells, ["b1", "b2"]).agg(F.min("mess")).first()[0] >= 0


def test_range_change_accounts(spark, cells):
    before = cells.select("row", "col", "x", "y", (F.col("b1") > 10).alias("present"))
    after = cells.select("row", "col", "x", "y", (F.col("b2") > 5).alias("present"))
    r = scenario.range_change(before, after, GRID).first()
    assert abs(r["kept_km2"] + r["lost_km2"] - r["before_km2"]) < 1e-6 and abs(r["kept_km2"] + r["gained_km2"] - r["after_km2"]) < 1e-6


def test_dispersal_stays_in_reach(spark, cells):
    s = cells.select("row", "col", (F.col("b2") / 11).alias("value"))
    got = scenario.dispersal(s, s, s.filter("row = 5 and col = 5"), 3, 0.3, radius=1, p_colonise=0.7)
    steps = {}
    for r in got.collect():
        steps.setdefault(r["step"], set()).add((r["row"], r["col"]))
    for t in range(1, 4):
        reach = {(a + i, b + j) for a, b in steps[t - 1] for i, j in [(0, 0), *scenario.disk(1)]}
        assert steps.get(t, set()) <= reach
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in scenario.dispersal(s, s, s.filter("row = 5 and col = 5"), 3, 0.3, radius=1, p_colonise=0.7).collect()}


def test_climate_choice(spark):
    row = spark.range(1).select(scenario.nearest_climate(F.lit(3750.0))["slice"], scenario.nearest_climate(F.lit(2500.0))["slice"], scenario.paleo_slice(F.lit(18.0))).first()
    assert tuple(row) == ("mid", "current", "LH")


def test_solver_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x, y = rng.random((400, 5)), np.r_[np.ones(40), np.zeros(360)]
    w = np.where(y == 1, 1.0, 100.0)
    theta, b = maxent.solve_l1_logistic(x, y, w, 4.0)
    p = 1 / (1 + np.exp(-(x @ theta + b)))
    slope = x.T @ (w * (p - y))
    assert np.all(np.abs(slope[theta == 0]) <= 4.0 + 1e-3)
    assert np.allclose(slope[theta != 0], -4.0 * np.sign(theta[theta != 0]), atol=1e-3)


def test_maxent_outputs(spark, cells):
    presence, background = cells.filter("b1 > 25 and b2 < 6"), cells
    m = maxent.fit(presence, background, ["b1", "b2"])
    r = background.select(m.predict("cloglog").alias("c"), m.predict("raw").alias("r"), m.predict("logistic").alias("l")).agg(F.min("c"), F.max("c"), F.sum("r"), F.min("l"), F.max("l")).first()
    assert 0 <= r[0] and r[1] <= 1 and abs(r[2] - 1) < 1e-9 and 0 <= r[3] and r[4] <= 1
    assert abs(sum(v for _, v in m.contributions()) - 100) < 1e-6
    scored = presence.select(m.predict("link").alias("score"), F.lit(1).alias("label")).unionByName(background.select(m.predict("link").alias("score"), F.lit(0).alias("label")))
    assert validate.auc(scored).first()["auc"] > 0.8
    assert m.response_curve(cells, "b1", 10).count() == 10
    assert sum(v for _, v in maxent.permutation_importance(m, presence, background, repeats=1)) == pytest.approx(100)


def test_sums_in_spark_give_the_same_fit(spark, cells, monkeypatch):
    presence = cells.filter("b1 > 25")
    local = maxent.fit(presence, cells, ["b1", "b2"], kinds=("linear", "quadratic"))
    monkeypatch.setattr(maxent, "LOCAL_ROWS", 0)
    large = maxent.fit(presence, cells, ["b1", "b2"], kinds=("linear", "quadratic"))
    assert np.allclose(local.coefficients, large.coefficients, atol=1e-6)


@pytest.mark.parametrize("key", ["bioclim", "mahalanobis", "glm", "gam"])
def test_models_rank_presences_higher(spark, cells, key):
    presence = cells.filter("b1 between 12 and 20 and b2 < 8")
    m = models.make_model(key).fit(presence, cells, ["b1", "b2"])
    scored = models._labelled(m, presence, cells)
    assert validate.auc(scored).first()["auc"] > 0.6


def test_mahalanobis_is_a_probability(spark, cells):
    m = models.Mahalanobis().fit(cells, cells, ["b1", "b2"])
    low, high = m.predict(cells).agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 1


def test_bsplines_sum_to_one(spark):
    t = spark.range(21).select((F.col("id") / 20).alias("z"))
    total = sum(models.bspline(F.col("z"), 0.0, 1.0, 4, 3), F.lit(0.0))
    assert all(abs(r[0] - 1) < 1e-9 for r in t.select(total).collect())


def test_compare_and_ensemble(spark, cells):
    presence = cells.filter("b1 between 12 and 24 and b2 < 8")
    table = {r["model"]: r for r in models.compare_models(presence, cells, ["b1", "b2"], ["bioclim", "mahalanobis"], folds=2).collect()}
    assert table["bioclim"]["train_auc"] > 0.5
    fitted = models.Bioclim().fit(presence, cells, ["b1", "b2"])
    predicted = fitted.predict(cells).select("row", "col", "score")
    out = models.ensemble({"bioclim": predicted}, {"bioclim": predicted}, {"bioclim": 0.7})
    assert out.count() == 120 and out.agg(F.max("score")).first()[0] <= 1
    with pytest.raises(ValueError):
        models.ensemble({}, {}, {"bioclim": 0.5})


def test_ellipses(spark):
    rng = np.random.default_rng(1)
    xy = rng.normal(size=(60, 2)) @ np.array([[2.0, 0.5], [0.0, 1.0]])
    t = spark.createDataFrame([("g" if i % 2 else "h", float(a), float(b)) for i, (a, b) in enumerate(xy)], "g string, x double, y double")
    for r in niche.ellipses(t, ["g"], "x", "y").collect():
        own = np.array([p for i, p in enumerate(xy) if ("g" if i % 2 else "h") == r["g"]])
        assert abs(r["sea"] - math.pi * math.sqrt(np.linalg.det(np.cov(own.T)))) < 1e-9 and r["seac"] > r["sea"]
    pairs = {(r["first"], r["second"]): r for r in niche.overlaps(niche.ellipses(t, ["g"], "x", "y"), "g", 60).collect()}
    assert pairs[("g", "g")]["percent_union"] == 100 and 0 < pairs[("g", "h")]["percent_union"] < 100


def test_hull():
    square = np.array([0.0, 0, 1, 1, 0.5]), np.array([0.0, 1, 0, 1, 0.5])
    assert niche.hull_area(*square) == 1.0
    assert niche.hull_area(np.array([0.0, 1, 2]), np.array([0.0, 1, 2])) == 0.0
    assert niche.hull_area(np.array([0.0, 1]), np.array([0.0, 1])) is None


def test_niche_notes(spark):
    t = spark.createDataFrame([("few", float(i), float(i * i)) for i in range(4)] + [("flat", float(i), 1.0) for i in range(12)] + [("ok", float(i % 5), float(i % 7)) for i in range(20)], "g string, x double, y double")
    got = {r["g"]: (r["note"], r["seac"] is None) for r in niche.niche_table(t, ["g"], "x", "y", draws=50).collect()}
    assert got == {"few": ("too few", True), "flat": ("no spread", True), "ok": (None, False)}


def test_groups_mark_missing(spark):
    t = spark.createDataFrame([(float(i % 3 * 10), float(i % 3 * 10)) for i in range(12)] + [(None, 1.0)], "x double, y double")
    got = models.isotope_groups(t, "x", "y", tries=3)
    assert got.filter("isotope_group = -1").count() == 1 and got.select("isotope_group").distinct().count() == 4


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SPECIMEN)
    dated = enrich.assign_zone(enrich.assign_period(empty))
    assert summary.zone_period_table(dated, ["d13C_coll"]).count() == 0
    assert summary.adjacent_changes(dated, "d13C_coll").count() == 0
    assert enrich.inherit_period(dated).count() == 0


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic", "average"])
def test_resampling_keeps_a_plane(spark, cells, method):
    plane = cells.withColumn("v", 2 * F.col("x") + 3 * F.col("y"))
    target = grid.Grid(a=0.5, c=3.0, e=-0.5, f=7.0, height=6, width=8)
    for r in grid.resample(plane, GRID, target, "v", method).collect():
        x, y = 3.0 + (r["col"] + 0.5) * 0.5, 7.0 - (r["row"] + 0.5) * 0.5
        exact = 2 * x + 3 * y
        if method in ("bilinear", "cubic"):
            assert abs(r["value"] - exact) < 1e-9
        elif r["value"] is not None:
            assert abs(r["value"] - exact) <= 2.5
    with pytest.raises(ValueError):
        grid.resample(plane, GRID, target, "v", "magic")


def test_mahalanobis_against_numpy(spark, cells):
    x = np.array([[r["b1"], r["b2"]] for r in cells.collect()])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    s, n = np.cov(z.T, bias=True), len(z)
    mu = np.trace(s) / 2
    noise = (((z[:, :, None] * z[:, None, :] - s) ** 2).sum() / n**2) / 2
    norm = ((s - mu * np.eye(2)) ** 2).sum() / 2
    k = min(noise, norm) / norm
    precision = np.linalg.pinv((1 - k) * s + k * mu * np.eye(2))
    m = models.Mahalanobis().fit(cells, cells, ["b1", "b2"])
    assert np.allclose(m.precision, precision)
    r = m.predict(cells).first()
    q = (np.array([r["b1"], r["b2"]]) - x.mean(axis=0)) / x.std(axis=0)
    assert abs(r["score"] - math.exp(-q @ precision @ q / 2)) < 1e-9


def test_tiles_find_the_same_neighbours(spark, cells, monkeypatch):
    rng = np.random.default_rng(6)
    clustered = np.r_[rng.normal((2, 2), 0.4, (60, 2)), rng.random((25, 2)) * 12]
    sites = spark.createDataFrame([(f"s{i:03}", float(a), float(b), float(i % 9)) for i, (a, b) in enumerate(clustered)], "site string, lon double, lat double, value double")
    take = lambda: {(r["row"], r["col"]): (r["value"], r["support"]) for r in isoscape.idw(cells, sites, max_distance=None).collect()}
    whole = take()
    monkeypatch.setattr(isoscape, "MAX_SITES", 0)
    tiled = take()
    assert tiled.keys() == whole.keys() and all(np.allclose(tiled[c], whole[c]) for c in whole)


def test_ranks_by_join(spark, cells):
    from sitelens.functions.search import ranks

    ref = cells.filter("b1 < 20")
    pick = lambda most: sorted((r["row"], r["col"], r["below"], r["upto"]) for r in ranks(cells, "b2", ref, most=most).collect())
    assert pick(10**6) == pick(0)


def test_nearest_sites_in_sparse_space(spark, monkeypatch):
    """Crowded sites, a huge empty extent, sites at one place: the rows of all pairs, and few tiles a cell."""
    rng = np.random.default_rng(4)
    crowd = rng.normal((10.0, 10.0), 0.001, (3000, 2))
    lonely = rng.uniform(-170, 170, (6, 2)) * (1, 0.4)
    same = np.full((200, 2), 10.0)
    where = np.vstack([crowd, lonely, same])
    sites = spark.createDataFrame([(f"s{i:05d}", float(a), float(b), float(i % 97)) for i, (a, b) in enumerate(where)], "site string, lon double, lat double, value double")
    spots = np.vstack([rng.uniform(-175, 175, (60, 2)) * (1, 0.45), rng.normal((10.0, 10.0), 0.002, (60, 2)), [(10.0, 10.0)]])
    cells = spark.createDataFrame([(i // 11, i % 11, float(a), float(b), i) for i, (a, b) in enumerate(spots)], "row int, col int, x double, y double, extra int")
    got = {r["extra"]: r for r in isoscape.idw(cells, sites, max_distance=None).collect()}
    kx, ky = 111.32 * max(math.cos(math.radians(where[:, 1].mean())), 0.1), 110.57
    assert len(got) == len(spots)
    for i, (a, b) in enumerate(spots):
        near = sorted((math.hypot((a - x) * kx, (b - y) * ky), f"s{j:05d}", j % 97) for j, (x, y) in enumerate(where))[:6]
        weight = [max(d, 1e-6) ** -2 for d, _, _ in near]
        assert got[i]["support"] == pytest.approx(near[0][0], abs=1e-9)
        assert got[i]["value"] == pytest.approx(sum(w * v for w, (_, _, v) in zip(weight, near)) / sum(weight), rel=1e-6)
    named = sites.withColumnRenamed("value", "v")
    nodes, leaves, deepest = isoscape.site_tree(named, 6, 1 / kx, 1 / ky, (-175.0, -80.0, 175.0, 80.0))
    assert leaves.count() == len(where) and deepest > 5
    sizes = [r[0] for r in isoscape.frontier(cells, nodes, deepest, 6, 1 / kx, 1 / ky).select(F.size("_front")).collect()]
    assert max(sizes) <= 40 and nodes.count() < 3000


def test_target_background_follows_the_effort(spark):
    cells = spark.range(4000).select((F.col("id") / 100).cast("int").alias("row"), (F.col("id") % 100).cast("int").alias("col"), F.lit(1.0).alias("b"))
    effort = cells.select("row", "col", F.when(F.col("col") < 10, 9).when(F.col("col") < 90, 1).otherwise(0).alias("effort"))
    for seed in (1, 2):
        drawn = grid.target_background(cells, effort, 200, ["b"], seed)
        rows = drawn.collect()
        assert len({(r["row"], r["col"]) for r in rows}) == 200 and all(r["effort"] > 0 for r in rows)
        assert 70 <= sum(r["effort"] == 9 for r in rows) <= 130  # 400 cells of weight 9 and 3,200 of weight 1
    assert grid.target_background(cells, effort, 10**6, ["b"]).count() == 3600 and grid.target_background(cells, effort.limit(0), 5, ["b"]).count() == 0
    points = spark.createDataFrame([(100.2, 49.9), (100.2, 49.8), (None, 49.9), (99.0, 49.9)], "lon double, lat double")
    assert [tuple(r) for r in grid.sampling_effort(points, grid.Grid(0.5, 100.0, -0.5, 50.0, 4, 4)).collect()] == [(0, 0, 2)]


def test_a_bias_covariate_is_held(spark, cells):
    biased = cells.withColumn("effort", (F.col("row") % 5).cast("double"))
    m = maxent.fit(biased.filter("b1 > 25 and effort > 2"), biased, ["b1", "b2", "effort"])
    assert dict(m.contributions())["effort"] > 0
    shown = biased.select("b1", "b2", m.predict_without({"effort": 4.0}).alias("v")).groupBy("b1", "b2").agg(F.countDistinct("v").alias("n"))
    assert shown.filter("n > 1").count() == 0
    with pytest.raises(ValueError):
        m.predict_without({"other": 1.0})
