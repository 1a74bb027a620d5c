"""Operators that SQL can express agree with it over whole tables."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import SparkSession

from sluiceway.llm.queries import ORACLES, queries


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_operator(spark: SparkSession, sf: str, name: str) -> None:
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries()[name](spark, sf)
    expected = con.execute(ORACLES[name])
    columns = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, expected.fetchall()))
