"""Every graph query beside its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from vertexloom import catalog

SF = Path("/root/testdata/sf0.001")
TABLES = ("lineitem", "orders", "part")


@pytest.fixture(scope="module")
def duck():
    if not SF.is_dir():
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, str(SF))
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want)


def test_entry_point(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(catalog.queries()) <= set(names) and set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).count() == 200
