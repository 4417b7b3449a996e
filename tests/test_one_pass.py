"""Large inputs are read once and held in parts: files, groups, periods, niches, changes."""

import io
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitelens import fixture_files
from sitelens.operators import enrich, models, niche
from sitelens.plans import study
from sitelens.sources import workbook


def test_changes_read_their_surfaces_once(spark, tmp_path):
    rows = [("pig", "d13C_coll", p, 0, c, float(i * 10 + c)) for i, p in enumerate(("EBA", "EIA", "HAN")) for c in range(3)]
    spark.createDataFrame(rows, "taxon_group string, proxy string, period string, row int, col int, value double").write.parquet(str(tmp_path / "surfaces"))
    change = study.surface_changes(spark.read.parquet(str(tmp_path / "surfaces")))
    assert not [f for f in change.inputFiles() if str(tmp_path) in f]
    assert sorted((r["from_period"], r["to_period"], r["col"], r["value"]) for r in change.collect()) == sorted((a, b, c, 10.0) for a, b in (("EBA", "EIA"), ("EIA", "HAN")) for c in range(3))


def test_a_workbook_is_parsed_in_parts():
    head = [f"column {k}" for k in range(8)]
    data = fixture_files.xlsx_bytes({"a": [head, *([f"text {n} {k}" for k in range(8)] for n in range(24_000))], "b": [head, ["x"] * 8]})
    source = pa.RecordBatch.from_arrays([pa.array(["w"]), pa.array([data])], names=["path", "content"])
    del data
    tracemalloc.start()
    rows, last = 0, None
    for batch in workbook._parse(iter([source])):
        rows, last = rows + batch.num_rows, batch.slice(batch.num_rows - 1).to_pylist()[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 24_001 and last["sheet"] == "b" and last["row"] == 2 and dict(last["cells"])["column 7"] == "x"
    assert peak < 25e6


def test_shared_strings_keep_their_places():
    xml = f'<sst xmlns="{fixture_files._MAIN}"><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si><si/><si><t>d</t></si></sst>'
    assert ["".join(t.text or "" for t in item.iter(f"{workbook._MAIN}t")) for item in workbook._elements(io.BytesIO(xml.encode()), "si")] == ["a", "bc", "", "d"]


def test_groups_are_of_weighted_pairs(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    seen, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, ready, *a: seen.append(ready.count()) or fit(self, ready, *a))
    # one heavy pair: by rows 0 and 4 part from 10, were each pair one row 4 would go with 10 as well as with 0
    points = [(0.0, 50), (4.0, 1), (10.0, 60), (11.0, 3)]
    t = spark.createDataFrame([(v, v) for v, n in points for _ in range(n)] + [(None, 1.0)], "x double, y double")
    got = {r["x"]: (r["isotope_group"], r["n"]) for r in models.isotope_groups(t, "x", "y", 2, tries=3).groupBy("x", "isotope_group").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert seen == [4, 4, 4]
    assert got[None] == (-1, 1) and {v: got[v][1] for v, _ in points} == dict(points)
    assert got[0.0][0] == got[4.0][0] != got[10.0][0] == got[11.0][0]


@pytest.mark.parametrize("broadcast", [True, False])
def test_names_are_normalised_once_each(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(enrich, "is_small", lambda *_: False)
    rows = [("Site A", "HAN"), ("site  a ", None), ("SITE A", "EIA"), ("site a", "EIA"), (None, "LBA"), ("nan", None), (" ", None), (None, None), ("b", None)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "site string, period string, k int")
    out = enrich.inherit_period(df)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().toString()
    got = {r["k"]: (r["site"], r["period"], r["inherited"]) for r in out.collect()}
    assert got == {k: (s, p or {"b": None, "site  a ": "EIA"}.get(s, "LBA"), p is None and s != "b") for k, (s, p) in enumerate(rows)}
    assert {r["k"]: r["period"] for r in enrich.inherit_period(df, unnamed=False).collect() if r["k"] in (5, 6, 7)} == {5: None, 6: None, 7: None}


def test_niches_read_their_rows_once(spark, tmp_path):
    spark.createDataFrame([("g", float(i % 7), float(i % 5), f"s{i % 3}") for i in range(40)], "g string, x double, y double, site string").write.parquet(str(tmp_path / "rows"))
    table = niche.niche_table(spark.read.parquet(str(tmp_path / "rows")), ["g"], "x", "y", draws=20)
    assert not [f for f in table.inputFiles() if str(tmp_path) in f]
    r = table.first()
    assert (r["n"], r["sites"], r["nr"], r["cr"]) == (40, 3, 4.0, 6.0)
