"""Compositions and the streaming extension."""

from pyspark.sql import functions as F

from sitelens import queries
from sitelens.operators import enrich
from sitelens.plans import study
from sitelens.schema import finalise
from sitelens.streaming import ingest


def test_config_round_trip():
    c = study.StudyConfig.from_json(study.template())
    assert c.bbox == (105, 33, 141, 56) and c.min_sites_sdm == 4 and c.support_km == 350


def test_period_climate():
    assert study.period_climate() == {"EBA": "mid", "LBA": "mid", "EIA": "current", "HAN": "current", "GOG": "current", "BHL": "current"}


def test_isoscapes_and_changes(spark, sf):
    data = study.harmonise([finalise(queries._specimens(spark, sf))], bbox=(105, 33, 141, 56))
    one = enrich.select_rows(data, periods=["EIA", "GOG"], taxon="돼지")
    cells = queries._cells(spark, sf).filter("row < 5 and col < 5")
    surfaces, records = study.temporal_isoscapes(one, cells, ("d13C_coll",), support_km=10_000)
    assert records.count() == 2 and surfaces.count() == 50
    change = study.surface_changes(surfaces)
    assert change.select("from_period", "to_period").distinct().collect() == [("EIA", "GOG")]


def test_temporal_sdm(spark, sf):
    data = enrich.assign_period(queries._specimens(spark, sf))
    cells = queries._cells(spark, sf)
    surfaces, table, overlap = study.temporal_sdm(data, {"EIA": cells, "HAN": cells}, queries.GRID, ["bio1", "bio12"], ["돼지"], min_sites=4)
    rows = table.collect()
    assert {r["period"] for r in rows} == {"EIA", "HAN"} and all(r["note"] or r["auc"] is not None for r in rows)
    assert surfaces.count() == 0 or overlap.filter("a = b").agg(F.min("d")).first()[0] == 1.0


def test_stream(spark, sf, tmp_path):
    finalise(queries._specimens(spark, sf)).write.parquet(str(tmp_path / "in"))
    counted = ingest.zone_period_counts(ingest.enrich_stream(ingest.specimen_stream(spark, str(tmp_path / "in"))))
    q = counted.writeStream.format("memory").queryName("stream_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["zone"], r["period"]): r["n"] for r in spark.table("stream_counts").collect()}
    batch = ingest.zone_period_counts(ingest.enrich_stream(spark.read.parquet(str(tmp_path / "in"))))
    assert got == {(r["zone"], r["period"]): r["n"] for r in batch.collect()} and got


def test_plot_tables(spark, sf):
    from sitelens.plans import plots

    data = enrich.assign_zone(enrich.assign_period(queries._specimens(spark, sf)))
    assert plots.time_series(data).count() > 0 and plots.zone_trajectories(data, "d13C_coll").count() > 0
    assert plots.niche_ellipses(data, ["taxon_group"]).count() % 100 == 0
    assert plots.biplot(data).columns == ["group", "x", "y"] and plots.site_map(data).count() > 0 and plots.zone_taxon_biplot(data).count() > 0
    assert plots.suitability_map(queries._cells(spark, sf), "elev").agg(F.max("scaled")).first()[0] == 1.0


def test_scenario_study(spark, sf):
    cells = queries._cells(spark, sf)
    sites = queries._sites(spark, sf)
    out = study.scenario_study(sites, {"lgm": cells.withColumn("bio1", F.col("bio1") - 3), "mid": cells, "current": cells}, queries.GRID, ["bio1", "bio12"], model="bioclim")
    assert out["change"].count() == 2 and out["extrapolation"].count() == 3
    threshold = out["threshold"].first()[0]
    moved = study.dispersal_study(out["surfaces"], "mid", "current", None, threshold, steps=1)
    assert moved.filter("step = 0").count() > 0
    presence = queries._thinned(spark, sf)
    assert study.spatial_cv(presence, queries._background(spark, sf), ["bio1", "bio12"], folds=2, method="checkerboard", block=10.0).count() > 0


def test_command_line(capsys):
    from sitelens.__main__ import main

    main(["template"])
    assert "자료" in capsys.readouterr().out
