"""Every registered query against its SQL in DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from docfacts.plans.registry import ORACLE, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in sorted(glob.glob(f"{SF}/*.parquet")):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6g}"
        return "null" if v is None else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con):
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name not in ORACLE:
        assert rows
        return
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    want = plain(cur.fetchall(), columns)
    mine = plain(rows, got.columns)
    assert len(mine) == len(want)
    assert mine == want
