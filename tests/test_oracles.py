"""Every registered query with an oracle gives DuckDB's rows."""

import math
from pathlib import Path

import duckdb
import pytest

from sitelens.queries_more import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def _norm(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    picked = ", ".join(f'"{c}"' for c in columns)
    assert _norm(got.select(*(f"`{c}`" for c in columns)).collect()) == _norm(duck.sql(f"select {picked} from ({ORACLES[name]})").fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:2] == ["zone", "period"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
