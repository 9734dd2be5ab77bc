"""Every engine query against DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from helixframe import queries as engine

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(str(tuple(cell(r[k]) for k in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_same_rows(spark, con, name):
    df = engine.queries()[name](spark, DATA)
    found = con.execute(engine.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), columns)


def test_seeds_differ(spark):
    text = "customer.project({c_custkey}).orderBy({c_custkey}).randomize(seed:="
    one, two = (engine.run(spark, DATA, f"{text}{k})").collect() for k in (1, 2))
    assert one != two and sorted(one) == sorted(two)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
