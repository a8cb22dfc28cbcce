"""Every registered query that has SQL, against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from tessella.plans import queries_cells, queries_channels, queries_features, queries_more, queries_projection, queries_regions, queries_topology  # noqa: F401
from tessella.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 9) + 0.0
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    want = duck.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    w, g = table(want.columns, want.fetchall()), table(got.columns, [tuple(r) for r in got.collect()])
    assert w[0] == g[0] and len(w[1]) == len(g[1])
    for a, b in zip(w[1], g[1], strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-5)) for x, y in zip(a, b, strict=True)), (a, b)
    assert g[1]
