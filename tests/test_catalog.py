"""Every registered query with SQL gives DuckDB's rows."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from evigrain.plans import catalog, graphs, searches  # noqa: F401  these add to the catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def rows(found, names):
    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.6g}")
        return float(v) if isinstance(v, int) and not isinstance(v, bool) else v

    return sorted((tuple(plain(r[n]) for n in names) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = con.execute(catalog.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == names
    assert rows([r.asDict() for r in df.collect()], names) == rows([dict(zip(columns, r, strict=True)) for r in want.fetchall()], names)


def test_every_query_runs(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLE)):
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
