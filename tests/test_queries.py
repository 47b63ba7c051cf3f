"""Every query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from hostelry.plans import registry

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in SF.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(rows, columns):
    shown = lambda v: "NULL" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(v) for _, v in sorted(zip(columns, row))) for row in rows)


@pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck):
    found = registry.QUERIES[name](spark, str(SF))
    rows = [tuple(r) for r in found.collect()]
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name])
        assert sorted(found.columns) == sorted(want.columns)
        assert plain(rows, found.columns) == plain(want.fetchall(), want.columns)
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[:2] == ["property_id", "stay_date"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
