"""Queries beside their SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tarnflow.llm import queries


def in_order(rows):
    plain = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf, tables, name):
    want = tables.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert in_order(df.select(*columns).collect()) == in_order(want.fetchall())
