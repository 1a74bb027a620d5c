"""Every query agrees with its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import SparkSession

from sluiceway.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value: object) -> object:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 8) if isinstance(value, float) else value


@pytest.fixture(scope="session")
def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark: SparkSession, duck: duckdb.DuckDBPyConnection, sf: str, name: str) -> None:
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    mine = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in rows), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()), key=repr)
    assert mine == theirs
