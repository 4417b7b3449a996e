"""niche_table is registered with the reference's 1,000 bootstrap draws; hulls and draws in parts."""

import inspect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.operators import niche
from sitelens.queries import QUERIES


def test_registered_draws(spark, sf, monkeypatch):
    whole, seen = niche.niche_table, []

    def watched(*args, **kwargs):
        bound = inspect.signature(whole).bind(*args, **kwargs)
        bound.apply_defaults()
        seen.append(bound.arguments["draws"])
        return whole(*args, **kwargs)

    monkeypatch.setattr(niche, "niche_table", watched)
    assert QUERIES["niche_table"](spark, sf).count() > 0 and seen == [1000]


def _group(seed, n):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(-20, 2, n), 1)
    return x, np.round(0.5 * x + rng.normal(20, 1, n), 1)


def _plain(x, y, draws=4000):
    """The interval by drawing rows, as it is written down."""
    rng, n, out = np.random.default_rng(9), len(x), []
    for _ in range(draws):
        pick = rng.integers(0, n, n)
        if np.ptp(x[pick]) > 0 and np.ptp(y[pick]) > 0:
            v = np.cov(x[pick], y[pick])
            out.append(math.pi * math.sqrt(max(np.linalg.det(v), 0)) * (n - 1) / (n - 2))
    return np.percentile(out, [2.5, 97.5])


def test_draws_of_parts_are_draws_of_the_group():
    count = np.array([3, 1, 7, 2, 5, 4])
    part = np.array([0, 1, 0, 2, 1, 2])
    totals = np.bincount(part, count).astype(int)
    one = [niche.drawn_sums(np.ones(m.sum()), np.arange(6.0)[m], count[m], totals, k, 3000, [1, 2]) for k in range(3) for m in [part == k]]
    assert np.array_equal(sum(one)[:, 0], np.full(3000, 22.0))  # every draw has as many rows as the group
    assert sum(one)[:, 1].mean() == pytest.approx(float(count @ np.arange(6)), rel=0.01)
    varied = sum(one)[:, 1].var()
    assert varied == pytest.approx(22 * np.average((np.arange(6) - np.average(np.arange(6), weights=count)) ** 2, weights=count), rel=0.1)


@pytest.mark.parametrize("pairs", [50_000, 7])
def test_intervals_and_hulls_against_plain_draws(spark, monkeypatch, pairs):
    monkeypatch.setattr(niche, "PART_PAIRS", pairs)  # a group in many parts
    groups = {"a": _group(1, 12), "b": _group(2, 300), None: _group(3, 60)}
    rows = [(g, "k", float(u), float(v)) for g, (x, y) in groups.items() for u, v in zip(x, y)] + [("flat", "k", 1.0, float(i)) for i in range(6)] + [("two", "k", 1.0, 2.0), ("two", "k", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, h string, x double, y double").repartition(5)
    got = {r["g"]: r for r in niche.resampled(df, ["g", "h"], "x", "y", 2000, 0).collect()}
    for g, (x, y) in groups.items():
        low, high = _plain(x, y)
        assert got[g]["seac_low"] == pytest.approx(low, rel=0.12) and got[g]["seac_high"] == pytest.approx(high, rel=0.08)
        assert got[g]["ta"] == pytest.approx(niche.hull_area(x, y))
    assert got["flat"]["seac_low"] is None and got["flat"]["ta"] == 0 and got["two"]["ta"] is None and got["two"]["seac_high"] is None
    again = {r["g"]: r for r in niche.resampled(df.repartition(3), ["g", "h"], "x", "y", 2000, 0).collect()}
    assert all(again[g]["seac_low"] == pytest.approx(got[g]["seac_low"], rel=1e-9) for g in groups)  # whatever the partitions


def test_a_hot_group_is_dealt_to_tasks(spark):
    rows = spark.range(600_000, numPartitions=8).select(F.lit("hot").alias("g"), (F.col("id") % 700 / 10).alias("x"), (F.col("id") % 457 / 10 + F.col("id") % 700 / 20).alias("y"))
    r = niche.resampled(rows, ["g"], "x", "y", 100, 0).first()
    every = niche.ellipses(rows, ["g"], "x", "y").first()
    assert r["seac_low"] < every["seac"] < r["seac_high"] and r["seac_high"] / r["seac_low"] < 1.02
