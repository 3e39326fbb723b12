"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
from pathlib import Path

import duckdb
import pytest

from duskwatch import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(name, spark, duck):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    found = duck.execute(catalog.ORACLES[name])
    want = rows([c[0] for c in found.description], found.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in found.description)
    assert got == want
