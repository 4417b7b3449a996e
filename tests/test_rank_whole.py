"""rank_normalize counts every row of fx_score."""

from pathlib import Path

import duckdb

from sitelens.queries import QUERIES, _r, _with


def test_ranks_are_against_all_scores(spark, sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    want = con.sql(_with("fx_score") + f"SELECT id, {_r('cume_dist() OVER (ORDER BY score)')} AS rank FROM fx_score").fetchall()
    got = QUERIES["rank_normalize"](spark, sf).select("id", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want
