"""Every query of the library's own operators beside its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tarnflow.plans import catalog, indexes, sessions  # noqa: F401


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return x


def in_order(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, tables, name):
    df = catalog.QUERIES[name](spark, sf)
    if name not in catalog.ORACLES:
        assert df.count() >= 0
        return
    want = tables.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert in_order(df.select(*columns).collect()) == in_order(want.fetchall())


def test_flagship(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
