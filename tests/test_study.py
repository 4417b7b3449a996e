"""A written mini study from files to tables, the one-call model, and the comparison of models."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import _BASE, _xlsx

from sitelens import dims, queries
from sitelens.operators import scenario
from sitelens.operators.grid import Grid
from sitelens.plans import study
from sitelens.sources import rasters

GRID = Grid(0.5, 105.0, -0.5, 55.0, 40, 40)
COARSE = Grid(1.0, 104.0, -1.0, 56.0, 24, 24)


def _layer(folder, name, g, f):
    folder.mkdir(parents=True, exist_ok=True)
    rows, cols = np.mgrid[0 : g.height, 0 : g.width]
    (folder / name).write_bytes(rasters.tiff_bytes(f(g.c + (cols + 0.5) * g.a, g.f + (rows + 0.5) * g.e).astype("f4"), g))


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    at = tmp_path_factory.mktemp("study")
    for n, f in ((1, lambda x, y: 30 - y / 2 + np.sin(x)), (4, lambda x, y: x / 3 + np.cos(y))):
        _layer(at / "current", f"wc2.1_10m_bio_{n}.tif", GRID, f)
        _layer(at / "paleo" / "mid", f"ccmidbi{n}.tif", COARSE, lambda x, y, f=f, n=n: f(x, y) * (10 if n in dims.SCALE10_BIOS else 1))
    people, pigs = [], []
    for k in range(24):
        early = k % 2 == 0
        base = [f"Site {k}", "Jilin", "", f"H{k}", 38 + (k * 7 % 24) * 0.6, 107 + (k * 5 % 24) * 0.6, 3800 if early else 2600, 3700 if early else 2500]
        people.append([*base, -18.0 + k % 5, 8.0 + k % 3, 3.2])
        pigs.append([*base[:3], f"P{k}", *base[4:], "Pig", None, -20.0 + k % 4, 6.0 + k % 2, 3.2])
    value = ["δ13C (‰, VPDB)", "δ15N (‰, AIR)", "Atomic C:N Ratio"]
    bio = [*_BASE, "δ13C Carbonate (‰, VPDB)", "δ18O Carbonate (‰, VPDB)"]
    sheets = {"Human organic materials": [[*_BASE, *value], *people], "Animal organic materials": [[*_BASE, "Common Name", "Genus&Species", *value], *pigs]}
    sheets |= {"Human bioapatite": [bio], "Animal bioapatite": [[*_BASE, "Common Name", *bio[8:]]]}
    _xlsx(at / "regional.xlsx", sheets)
    local = ["Region", "culture", "period", "date", "lattitude", "longtidue", "site", "feature form", "spieces", "sex", "age", "δ13C", "δ15N"]
    _xlsx(at / "local.xlsx", {"s": [local, ["primorye", "c", "p", "1800-1700 BCE", None, None, "Site 2", "pit", "pig", None, None, -19, 8], ["amur", "c", "p", "1800-1700 BCE", None, None, "Nowhere", "pit", "pig", None, None, -20, 7]]})
    return at


def test_mini_study(spark, inputs, tmp_path):
    config = {
        "출력폴더": str(tmp_path / "out"),
        "자료": {"china_db": str(inputs / "regional.xlsx"), "isomemo_db": "", "ecology_xlsx": str(inputs / "local.xlsx")},
        "고환경": {"worldclim_dir": str(inputs / "current"), "paleoclim_dir": str(inputs / "paleo"), "bio": [1, 4]},
        "범위": {"bbox": [105, 35, 125, 55]},
        "분석": {"프록시": ["d13C_coll"], "아이소스케이프_분류군": ["사람"], "SDM_분류군": ["돼지"], "최소유적수_아이소스케이프": 5, "최소유적수_SDM": 5, "지지거리_km": 400, "beta_multiplier": 2.0, "공간블록교차검증": True},
    }
    (tmp_path / "c.json").write_text(json.dumps(config, ensure_ascii=False), encoding="utf-8")
    c = study.StudyConfig.from_json((tmp_path / "c.json").read_text(encoding="utf-8"))
    assert (c.proxies, c.isoscape_taxa, c.sdm_taxa, c.min_sites_isoscape, c.min_sites_sdm, c.support_km, c.beta, c.spatial_cv) == (("d13C_coll",), ("사람",), ("돼지",), 5, 5, 400, 2.0, True)
    stacks, climate, g, bands = study.period_stacks(spark, c)
    assert g == GRID and bands == ["bio1", "bio4"] and climate["EIA"] == "current" and climate["EBA"].startswith("mid, 2250 years")
    both = stacks["EBA"].join(stacks["EIA"].select("row", "col", F.col("bio1").alias("now")), ["row", "col"])
    assert both.filter("row between 5 and 30").agg(F.max(F.abs(F.col("bio1") - F.col("now")))).first()[0] < 1  # one grid, one unit
    out = study.run_config(spark, c, {k: stacks[k] for k in ("EBA", "EIA")}, g, bands, climate)
    assert {r["taxon_group"] for r in out["zone_period"].collect()} <= {"사람"}
    assert {tuple(r) for r in out["isoscape_records"].select("taxon_group", "proxy", "period", "sites").collect()} == {("사람", "d13C_coll", "EBA", 12), ("사람", "d13C_coll", "EIA", 12)}
    fits = {(r["period"], r["variant"]): r for r in out["range_fits"].collect()}
    assert fits["EBA", "env"]["sites"] >= 10 and 0 <= fits["EIA", "env"]["auc"] <= 1 and fits["EBA", "env"]["top_band"] in bands
    cv = {r["period"]: r for r in out["spatial_cv"].collect()}
    assert set(cv) == {"EBA", "EIA"} and all(0.4 < r["baseline_auc"] < 0.8 for r in cv.values())
    summary = json.loads((tmp_path / "out" / "run_summary.json").read_text(encoding="utf-8"))
    assert summary["isoscapes"] == ["사람/d13C_coll"] and summary["models"] == ["돼지"] and summary["climate"] == climate and len(summary["spatial_cv"]) == 2
    assert [u["site"] for u in summary["unresolved_sites"]] == ["Nowhere"]
    assert {"isoscape_사람_d13C_coll_EBA.tif", "sdm_돼지_EIA_env.tif", "zone_period.csv"} <= set(summary["files"])
    values, grid, _ = rasters.read_tiff((tmp_path / "out" / "isoscape_사람_d13C_coll_EBA.tif").read_bytes())
    assert grid == GRID and np.isfinite(values).any()
    located = out["dataset"].filter("source = 'Local'").collect()
    assert [(r["site"], r["coord_source"], r["period"]) for r in located] == [("Site 2", "name_match", "EBA")]


def test_one_call_model(spark, inputs, tmp_path):
    rows = ["id,lon,lat,v"] + [f"{k},{108 + k * 0.7},{40 + (k * 3 % 11)},{-20 + k % 4}" for k in range(14)]
    (tmp_path / "p.csv").write_text("\n".join(rows))
    (tmp_path / "iso.csv").write_text("id,d13C,v\n" + "\n".join(f"{k},{-19 + k % 3},x" for k in range(12)))
    layers = rasters.worldclim_layers(spark, str(inputs / "current"), (1, 4))
    got = study.run_sdm(spark, str(tmp_path / "p.csv"), layers, str(tmp_path / "o"), isotopes={"c": "d13C", "lost": "v_iso"}, isotope_table=str(tmp_path / "iso.csv"), join_on="id", terrain_from="bio1", terrain_include=("slope",), background=300, repeats=1)
    assert got["summary"]["bands"] == ["bio1", "bio4", "slope", "c"] and got["summary"]["sites"] == 14
    assert (got["grid"].height, got["grid"].width) == (30, 27)  # the points' box and a quarter on each side
    names = {r["band"] for r in got["importance"].collect()}
    assert names == set(got["summary"]["bands"]) and json.loads((tmp_path / "o" / "summary.json").read_text())["features"] == list(study.STUDY_KINDS)
    values, g, _ = rasters.read_tiff((tmp_path / "o" / "suitability_cloglog.tif").read_bytes())
    assert g == got["grid"] and np.nanmax(values) <= 1 and (tmp_path / "o" / "isoscape_c.tif").exists()


def test_comparison_and_labels(spark, sf):
    data = queries._enriched(spark, sf)
    out = study.compare_study(data, queries._cells(spark, sf), queries.GRID, ["bio1", "bio12"], periods=["HAN"], keys=["bioclim", "mahalanobis", "brt"], folds=2, background=400, min_auc=0.0, repeats=5)
    table = {r["model"]: r for r in out["table"].collect()}
    assert set(table) == {"bioclim", "mahalanobis", "brt"} and table["brt"]["note"].startswith("needs 15") and 0.3 < table["bioclim"]["baseline_auc"] < 0.9
    assert set(out["surfaces"]) == {"bioclim", "mahalanobis"} and out["label"] == "전체 | HAN | 전지역"
    good = [k for k, r in table.items() if r["cv_auc"] is not None and r["cv_auc"] > 0.5]
    assert (out["ensemble"] is not None) == any(r["cv_auc"] is not None for r in table.values())
    assert study.run_label("돼지", ["EIA", "HAN"], ["z"]) == "돼지 | EIA,HAN | z" and good is not None


def test_dispersal_through_three_slices(spark):
    cells = [(r, c) for r in range(9) for c in range(9)]
    slices = {"lgm": lambda r, c: 1.0 if c < 3 else 0.1, "mid": lambda r, c: 1.0 if c < 6 else 0.1, "current": lambda r, c: 1.0 if r < 5 else 0.0}
    long = spark.createDataFrame([(n, r, c, f(r, c)) for n, f in slices.items() for r, c in cells], "slice string, row int, col int, value double")
    out = study.dispersal_through(long, list(slices), 0.5, steps=4, p_colonise=1.0, p_survive=0.0)
    at = lambda n, r, c: slices[n](r, c)
    names, held, want = list(slices), {(r, c) for r, c in cells if at("lgm", r, c) >= 0.5}, []
    want.append((0, len(held), None))
    for t in range(1, 9):
        i, w = (t - 1) // 4, ((t - 1) % 4 + 1) / 4
        good = {(r, c) for r, c in cells if (1 - w) * at(names[i], r, c) + w * at(names[i + 1], r, c) >= 0.5}
        held = {(r, c) for r, c in good if (r, c) in held or any((r + a, c + b) in held for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)))}
        want.append((t, len(held), len(good)))
    assert sorted(map(tuple, out["curve"].collect())) == want
    start = study.start_cells(spark.createDataFrame([("s", 105.2, 54.9)], "site string, lon double, lat double"), GRID)
    assert start.collect() == [(0, 0)]
    assert scenario.occupancy_counts(out["frames"]).count() == 9
