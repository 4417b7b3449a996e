"""What used to be cut: whole files, whole tables, both solvers, large rank tests; projections; holes in grids."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens import queries
from sitelens.functions import projection, stats
from sitelens.operators import enrich, grid, isoscape, maxent, summary, terrain
from sitelens.shared import shared_dir
from sitelens.sources import points, rasters, sinks, workbook


def test_encoding_is_tried_on_the_whole_file(spark, tmp_path):
    (tmp_path / "k.csv").write_bytes(("lon,lat,name\n" + "126,43,plain\n" * 6000 + "127,44,가나다\n").encode("cp949"))
    rows = points.load_points(spark, str(tmp_path / "k.csv")).filter("lon = 127").collect()
    assert [r["attributes"]["name"] for r in rows] == ["가나다"]
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / "a.csv").write_bytes("lon,lat,name\n1,2,é\n".encode())
    (tmp_path / "mixed" / "b.csv").write_bytes("lon,lat,name\n3,4,나\n".encode("cp949"))
    assert {(r["lon"], r["name"]) for r in points.read_csv(spark, str(tmp_path / "mixed")).collect()} == {("1", "é"), ("3", "나")}


def test_tables_go_out_whole(spark):
    shown = json.loads(sinks.table_json(spark.range(12_000).withColumn("model", F.lit("x"))))
    assert shown["columns"] == ["id"] and len(shown["rows"]) == 12_000
    with pytest.raises(ValueError, match="json_rows"):
        sinks.table_json(spark.range(20), most=19)


def test_all_headers_of_a_workbook(spark):
    cells = {f"h{k}": "1" for k in range(1500)}
    rows = spark.createDataFrame([(cells,)], "cells map<string,string>")
    assert len(workbook.headers(rows)) == 1500


def test_large_rasters_are_refused_or_written_as_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rasters, "MAX_BYTES", 500)
    g = grid.Grid(1.0, 0.0, -1.0, 2.0, 2, 3)
    surface = spark.createDataFrame([(r, c, float(r + c)) for r in range(2) for c in range(3)], "row int, col int, value double")
    with pytest.raises(ValueError, match="write_cells"):
        rasters.write_layer(surface, g, str(tmp_path / "x.tif"))
    rasters.write_cells(surface, str(tmp_path / "cells"), rows=1)
    assert spark.read.parquet(str(tmp_path / "cells")).count() == 6


def test_both_solvers_of_the_entropy_model_agree(spark, sf, monkeypatch):
    presence, background = queries._thinned(spark, sf), queries._background(spark, sf)
    fits = []
    for most in (30_000, 0):
        monkeypatch.setattr(maxent, "LOCAL_ROWS", most)
        m = maxent.fit(presence, background, ["bio1", "bio12"], beta=2.0, kinds=("linear", "quadratic"))
        fits.append([r[0] for r in background.orderBy("row", "col").select(m.predict("cloglog")).collect()])
    assert np.abs(np.array(fits[0]) - np.array(fits[1])).max() < 1e-8


def test_rank_tests_of_one_small_side():
    whole, share = stats.u_counts(6, 40), stats.u_shares(6, 40)
    assert np.allclose(share, np.array(whole) / sum(whole), atol=1e-15)
    monte = stats.mann_whitney_p(8 * 100_000 * 0.3, 8, 100_000, 0)
    normal = stats.normal_two_sided((8 * 100_000 * 0.2 - 0.5) / math.sqrt(8 * 100_000 / 12 * 100_009))
    assert abs(monte - normal) < 0.01 and 0 < monte < 1
    assert stats.mann_whitney_p(0.0, 8, 10_000_000, 0) < 1e-5  # beyond MAX_VALUES: normal


def test_significant_digits(spark):
    t = spark.createDataFrame([(0.012345,), (0.0,), (123.4,), (9.996e-7,), (None,)], "p double").select(summary.significant_digits(F.col("p"), 3).alias("p"))
    got = [r["p"] for r in t.collect()]
    assert got[:4] == pytest.approx([0.0123, 0.0, 123.0, 1.0e-6], rel=1e-12) and got[4] is None


def test_holes_in_a_grid_repeat_the_edge(spark):
    cells = [(r, c, float(10 * r + c)) for r in range(4) for c in range(5) if (r, c) != (1, 2)]
    near = terrain.neighbours(spark.createDataFrame(cells, "row int, col int, v double"), "v")
    at = {(r["row"], r["col"]): r for r in near.collect()}
    assert (at[1, 1]["n_0_p"], at[1, 3]["n_0_m"]) == (11.0, 13.0)  # not the cell behind the hole
    assert (at[0, 2]["n_p_0"], at[2, 2]["n_m_0"]) == (2.0, 22.0)
    assert (at[2, 1]["n_m_p"], at[2, 3]["n_m_m"], at[2, 2]["n_p_p"]) == (11.0, 13.0, 33.0)


def test_projections(spark):
    where = [(126.9784, 37.5665), (123.0, 0.0), (140.0, 55.0), (105.0, 33.0), (121.5, -33.0)]
    t = spark.createDataFrame(where, "lon double, lat double")
    for crs in ("EPSG:3857", "EPSG:32651", "EPSG:32751", "EPSG:5179", "EPSG:5186"):
        x, y = projection.transform(F.col("lon"), F.col("lat"), "EPSG:4326", crs)
        lon, lat = projection.transform(F.col("x"), F.col("y"), crs, "EPSG:4326")
        back = t.select("*", x.alias("x"), y.alias("y")).select("lon", "lat", lon.alias("a"), lat.alias("b")).collect()
        assert all(abs(r["lon"] - r["a"]) < 1e-8 and abs(r["lat"] - r["b"]) < 1e-8 for r in back)
    utm = [tuple(r) for r in grid.to_crs(t, "EPSG:32651").collect()]
    assert utm[1] == pytest.approx((500_000, 0), abs=1e-6)
    # a degree along the central meridian is a metre or two over 110.5 km, times the scale
    line = spark.createDataFrame([(123.0, 40.0), (123.0, 41.0)], "lon double, lat double")
    a, b = (r["lat"] for r in grid.to_crs(line, "EPSG:32651").collect())
    assert abs((b - a) / 0.9996 - 111_044.3) < 2
    with pytest.raises(ValueError, match="closed form"):
        grid.to_crs(t, "EPSG:27700")


def test_layers_of_another_system_are_warped(spark):
    source = grid.Grid(50_000.0, 0.0, -50_000.0, 6_000_000.0, 60, 40, "EPSG:32651")
    cells = spark.range(2400).select((F.col("id") / 40).cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col"))
    cells = cells.withColumns({"x": source.x(F.col("col")), "y": source.y(F.col("row"))})
    lon, lat = projection.transform(F.col("x"), F.col("y"), source.crs, "EPSG:4326")
    band = cells.withColumn("v", lon + 2 * lat)
    target = grid.Grid(0.5, 120.0, -0.5, 50.0, 10, 12)
    for method, most in (("nearest", 1.2), ("bilinear", 0.02), ("cubic", 0.02), ("average", 0.9)):
        got = grid.resample(band, source, target, "v", method).dropna()
        off = got.select(F.max(F.abs(F.col("value") - (target.x(F.col("col")) + 2 * target.y(F.col("row")))))).first()[0]
        assert off < most and got.count() > (50 if method == "average" else 119)


def test_group_surfaces_equal_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sites = [(g, f"s{k}", float(110 + 8 * rng.random()), float(40 + 5 * rng.random()), float(rng.random())) for g, n in (("a", 30), ("b", 9), ("c", 1), ("d", 2)) for k in range(n)]
    means = spark.createDataFrame(sites, "g string, site string, lon double, lat double, value double")
    cells = spark.range(60).select((F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col")).withColumns({"x": 110 + F.col("col") * 0.8, "y": 44.5 - F.col("row") * 0.8})
    monkeypatch.setattr(isoscape, "MAX_SITES", 20)  # the first group goes by tiles
    got = {(r["g"], r["row"], r["col"]): (r["value"], r["support"]) for r in isoscape.idw_groups(cells, means, ["g"], max_distance=200.0).collect()}
    assert {k[0] for k in got} == {"a", "b", "d"}
    for g in ("a", "b", "d"):
        for r in isoscape.idw(cells, means.filter(F.col("g") == g), max_distance=200.0).collect():
            value, support = got[g, r["row"], r["col"]]
            assert support == pytest.approx(r["support"]) and (value is None) == (r["value"] is None) and (value is None or value == pytest.approx(r["value"]))


def test_unnamed_sites_are_answered_beyond_the_broadcast(spark, monkeypatch):
    rows = [(f"site {k % 7}" if k % 3 else None, "HAN" if k % 5 == 0 else None, k) for k in range(200)]
    df = spark.createDataFrame(rows, "site string, period string, k int")
    plain = sorted(map(tuple, enrich.inherit_period(df).select("k", "period", "inherited").collect()))
    monkeypatch.setattr(enrich, "is_small", lambda *_: False)
    assert sorted(map(tuple, enrich.inherit_period(df).select("k", "period", "inherited").collect())) == plain
    assert any(p for k, p, _ in plain if rows[k][0] is None)


def test_permutation_importance_finds_the_band(spark, sf):
    presence = queries._thinned(spark, sf)
    background = queries._background(spark, sf)
    m = maxent.with_background(maxent.fit_features(background, ["bio1", "bio12"], kinds=("linear",)), [4.0, 0.0], background)
    found = dict(maxent.permutation_importance(m, presence, background, repeats=2))
    assert found["bio12"] == 0.0 and found["bio1"] in (0.0, 100.0)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class _Conf:
        def get(self, key, default=None):
            return default

    class _Session:
        conf = _Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Session(), "x")


def test_few_sites_are_enough_for_the_linear_model():
    from sitelens.dims import MODEL_MIN_SITES

    assert MODEL_MIN_SITES == {"bioclim": 3, "mahalanobis": 4, "glm": 5, "gam": 8, "rf": 10, "brt": 15, "maxent": 5}


def test_first_of_a_tie_does_not_depend_on_partitions(spark):
    rows = [("a", 1, v, w) for v in (3.0, None, 2.0) for w in (None, 5.0, 4.0)] + [("b", 2, None, 1.0), ("b", 1, None, None)]
    df = spark.createDataFrame(rows, "k string, ord int, v double, w double")
    for parts in (1, 3, 7):
        got = {tuple(r) for r in enrich.first_by(df.repartition(parts).orderBy(F.rand(parts)), ["k"], [F.col("ord")]).collect()}
        assert got == {("a", 1, 2.0, 4.0), ("b", 1, None, None)}


def test_a_fit_converges_or_raises(monkeypatch):
    rng = np.random.default_rng(3)
    u = rng.random((2000, 3))
    x = np.column_stack([u, u**2, *(np.maximum(u[:, j] - k, 0) for j in range(3) for k in np.linspace(0.1, 0.9, 9)), *(np.maximum(k - u[:, j], 0) for j in range(3) for k in np.linspace(0.1, 0.9, 9))])
    y = np.r_[np.ones(25), np.zeros(1975)]
    w = np.where(y == 1, 1.0, 100.0)
    x[:25, 0] = 0.8 + 0.2 * x[:25, 0]
    for penalty in (0.05, 1.0, 20.0, 1e6):
        theta, b = maxent.solve_l1_logistic(x, y, w, penalty)
        slope = x.T @ (w * (1 / (1 + np.exp(-(x @ theta + b))) - y))
        assert np.abs(slope[theta == 0]).max(initial=0) <= penalty + 1e-6
        assert np.abs(slope[theta != 0] + penalty * np.sign(theta[theta != 0])).max(initial=0) < 1e-6
    with pytest.raises(maxent.NotConverged):
        maxent.solve_l1(lambda theta, want: maxent._moments(x, y, w, theta, want), x.shape[1], 0.0, 0.05, rounds=2)


def test_large_groups_share_one_tree(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(g, f"s{k}", float(110 + 8 * rng.random()), float(40 + 5 * rng.random()), float(rng.random())) for g, n in (("a", 40), ("b", 300), (None, 60)) for k in range(n)]
    rows += [("b", f"t{k}", 112.0 + k * 1e-7, 42.0, 1.0) for k in range(200)]  # crowded: deeper than an even spread needs
    means = spark.createDataFrame(rows, "g string, site string, lon double, lat double, value double")
    cells = spark.createDataFrame([(i // 5, i % 5, 110.0 + i % 5 * 1.6, 44.0 - i // 5 * 1.2) for i in range(15)] + [(9, 9, 112.00001, 42.0)], "row int, col int, x double, y double")
    trees, plain = [], isoscape.site_tree
    monkeypatch.setattr(isoscape, "MAX_SITES", 20)
    monkeypatch.setattr(isoscape, "site_tree", lambda *a: trees.append(a) or plain(*a))
    got = {(r["g"], r["row"], r["col"]): (r["value"], r["support"]) for r in isoscape.idw_groups(cells, means, ["g"], max_distance=None).collect()}
    assert len(trees) == 1 and len(got) == 3 * 16
    for g in ("a", "b", None):
        own = [r[1:] for r in rows if r[0] == g]
        kx = 111.32 * math.cos(math.radians(np.mean([r[2] for r in own])))
        for c in cells.collect():
            near = sorted((math.hypot((c["x"] - x) * kx, (c["y"] - y) * 110.57), s, v) for s, x, y, v in own)[:6]
            weight = [max(d, 1e-6) ** -2 for d, _, _ in near]
            assert got[g, c["row"], c["col"]] == pytest.approx((sum(w * n[2] for w, n in zip(weight, near)) / sum(weight), near[0][0]), rel=1e-6)
