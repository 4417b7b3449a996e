"""The jobs: reruns, growing input, chosen partitions, command lines' configuration."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from jobs import common, name_candidates, specimen_archive
from sitelens.operators import summary


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_archive_again_and_by_period(spark, sf, tmp_path):
    out = str(tmp_path / "archive")
    first = _rows(specimen_archive.run(spark, sf, out))
    assert first == _rows(specimen_archive.run(spark, sf, out))
    # only one period anew, under a narrower box: the others stay
    kept = lambda df: {(r["period"], r["n"]) for r in df.filter("status = 'kept'").groupBy("period").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = kept(spark.read.parquet(f"{out}/specimens"))
    after = kept(specimen_archive.run(spark, sf, out, bbox=(105.0, 33.0, 120.0, 56.0), periods=["LBA", None]))
    assert {p for p, n in before ^ after} == {"LBA", None}
    assert first == _rows(specimen_archive.run(spark, sf, out))
    table = spark.read.parquet(f"{out}/table")
    rows = specimen_archive.specimens(spark, sf, (105.0, 33.0, 141.0, 56.0), (2.9, 3.6)).filter("status = 'kept'")
    assert table.count() == summary.zone_period_table(rows, ["d13C_coll"]).count() > 5


def test_archive_without_records(spark, sf, tmp_path):
    none = tmp_path / "none"
    for t in ("lineitem", "supplier", "nation"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(none / f"{t}.parquet"))
    assert specimen_archive.run(spark, str(none), str(tmp_path / "out")).count() == 0


@pytest.fixture
def reports(spark, sf, tmp_path):
    """The documents in four files, outside the folder that is watched, and what all of them give."""
    spark.read.parquet(f"{sf}/documents.parquet").repartition(4, "doc_id").write.parquet(str(tmp_path / "all"))
    whole = name_candidates.candidates(name_candidates.mentions(spark.read.parquet(f"{sf}/documents.parquet")))
    return sorted((tmp_path / "all").glob("part-*")), whole


def test_candidates_of_growing_reports(spark, tmp_path, reports, caplog):
    files, whole = reports
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()
    caplog.set_level("INFO")
    took = []
    for arrived in (files[:1], files[1:3], [], files[3:], []):
        for f in arrived:
            shutil.copy(f, inbox)
        caplog.clear()
        found = name_candidates.run(spark, str(inbox), out, mark, files=1)
        took.append(sum("step" in r.message for r in caplog.records))
    assert took == [1, 2, 0, 1, 0]  # only what is new is read
    assert _rows(found) == _rows(whole) and found.count() > 5


def test_candidates_of_odd_texts(spark, tmp_path):
    texts = [None, "", "Start here, Lower town and Lower town. Next, Élan vital xÉlan", "in Lower, Lower Lower"]
    rows = spark.createDataFrame([(k if k < 3 else None, t, "en" if k else None, "s", 1.0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, lower double")
    rows.union(rows.limit(0)).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        out = name_candidates.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"))
    assert {(r["key"], r["name"], r["mentions"], r["reports"]) for r in out.collect()} == {("lower", "Lower", 4, 2), ("élan", "Élan", 1, 1)}


def test_configuration_is_read_by_spark(spark):
    for job in ("specimen_archive", "name_candidates"):
        with open(f"jobs/{job}.json") as f:
            assert common.read_config(spark, f"jobs/{job}.json") == json.load(f)
