"""Latest earlier slices against a search of all slices; hot keys, ties, nulls."""

import random

import pytest

from sitelens.functions.asof import asof_join


@pytest.mark.parametrize("ranges", [1, 2, 9])
def test_against_all_slices(spark, ranges):
    rng = random.Random(ranges)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    time = lambda: rng.choice([None, *range(40)])
    rows = [(i % 150, key(), rng.choice(["x", "y"]), time(), "own") for i in range(400)]
    slices = [(key(), rng.choice(["x", "y"]), time(), rng.choice([None, *range(9)]), f"s{i % 7}") for i in range(120)]
    df = spark.createDataFrame(rows, "id int, k string, `k 2` string, t int, v string").repartition(5)
    s = spark.createDataFrame(slices, "k string, `k 2` string, year int, v int, w string")
    got = asof_join(df, s.withColumnRenamed("year", "t"), ["k", "k 2"], "t", ["v", "w"], ranges=ranges)
    assert got.columns == ["id", "k", "k 2", "t", "v", "w"]

    def latest(k, k2, t):
        found = [x for x in slices if t is not None and k is not None and x[0] == k and x[1] == k2 and x[2] is not None and x[2] <= t]
        if not found:
            return None, None
        newest = [x[3:] for x in found if x[2] == max(y[2] for y in found)]
        return max(newest, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))  # null is the least value

    wanted = sorted(((i, k, k2, t, *latest(k, k2, t)) for i, k, k2, t, _ in rows), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == wanted


def test_empty_sides(spark):
    rows = spark.createDataFrame([(1, "a", 5.0)], "id int, k string, t double")
    slices = spark.createDataFrame([("a", 5.0, 7)], "k string, t double, v int")
    assert [tuple(r) for r in asof_join(rows, slices, ["k"], "t", ["v"]).collect()] == [(1, "a", 5.0, 7)]
    assert [r["v"] for r in asof_join(rows, slices.limit(0), ["k"], "t", ["v"]).collect()] == [None]
    assert asof_join(rows.limit(0), slices, ["k"], "t", ["v"]).count() == 0
