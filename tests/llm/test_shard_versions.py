"""Versions of a shard store through compactions, lost commits and vacuums."""

import pytest
from pyspark.sql import functions as F

from sitelens.llm import shards
from sitelens.llm.common import shared_dir


def _arrival(spark, k, n=20):
    return spark.range(n).select((F.col("id") + 1000 * k).alias("doc_id"), F.lit(f"text {k}").alias("text"))


@pytest.fixture
def store(spark):
    out = shards.ShardStore(spark, shared_dir(spark, "versions"))
    for k in range(5):
        out.append(_arrival(spark, k).repartition(2))
    return out


def _rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def _expected(upto):
    return sorted((1000 * k + i, f"text {k}") for k in range(upto) for i in range(20))


def _files(store):
    data = store._path(f"{store.root}/data")
    return sum(f.getPath().getName().startswith("part-") for d in store._fs.listStatus(data) for f in store._fs.listStatus(d.getPath()))


def test_every_listed_version_reads_whole_through_a_compaction(store):
    opened = store.read()
    after = store.compact()
    assert after.version == 6 and len(after.shards) == 1 and store.versions() == [1, 2, 3, 4, 5, 6]
    for version in store.versions():
        assert _rows(store.read(version)) == _expected(min(version, 5))
    assert _rows(opened) == _expected(5)


def test_vacuum_retires_versions_and_what_only_they_name(store):
    store.compact()
    store.vacuum(keep=2)
    assert store.versions() == [5, 6] and _rows(store.read(5)) == _expected(5) == _rows(store.read())
    with pytest.raises(ValueError, match="version 4"):
        store.read(4)
    store.vacuum(keep=1)
    assert store.versions() == [6] and _files(store) == 1 and _rows(store.read()) == _expected(5)
    store.vacuum(keep=0)
    assert _rows(store.read()) == _expected(5)


def test_orphans_go_when_they_are_old(spark, store):
    _arrival(spark, 9).write.parquet(f"{store.root}/data/lost")
    before = _files(store)
    store.vacuum()
    assert _files(store) == before
    store.vacuum(orphan_seconds=-60)
    assert _files(store) == sum(len(store.manifest(v).shards) for v in store.versions()[-1:]) < before
    assert _rows(store.read()) == _expected(5)


def test_compaction_plans_anew_when_another_writer_was_first(spark, store, monkeypatch):
    other, merge, calls = shards.ShardStore(spark, store.root), shards.ShardStore._merge_run, []

    def slow(self, run, schema):
        if self is store and not calls:
            calls.append(1)
            other.compact()
            other.append(_arrival(spark, 5))
        return merge(self, run, schema)

    monkeypatch.setattr(shards.ShardStore, "_merge_run", slow)
    store.compact()
    assert calls and _rows(store.read()) == _expected(6)
    store.vacuum(keep=1, orphan_seconds=-60)
    assert _files(store) == len(store.manifest().shards)


def test_columns_of_later_arrivals(spark, store):
    store.append(spark.createDataFrame([(7, "x")], "doc_id long, extra string"))
    rows = {r["doc_id"]: r for r in store.read().collect()}
    assert (rows[7]["text"], rows[7]["extra"]) == (None, "x") and rows[0]["extra"] is None
    store.compact()
    assert {r["doc_id"]: r["extra"] for r in store.read().collect()}[7] == "x"
    with pytest.raises(ValueError, match="doc_id"):
        store.append(spark.createDataFrame([("7",)], "doc_id string"))


def test_unwritten_store_and_very_long_texts(spark):
    store = shards.ShardStore(spark, shared_dir(spark, "versions"))
    with pytest.raises(ValueError):
        store.read()
    store.vacuum()
    store.append(spark.createDataFrame([(None, "long text " * 400_000), (1, "")], "doc_id long, text string"))
    assert sorted(len(r["text"]) for r in store.read().collect()) == [0, 4_000_000]
