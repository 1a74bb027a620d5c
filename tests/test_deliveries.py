"""Delivery epochs against a fold over each key."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import SparkSession

from sluiceway.operators.deliveries import first_deliveries

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def folded(rows: list[tuple], days: int) -> list[tuple]:
    by_key: dict[tuple, list[tuple]] = defaultdict(list)
    out = []
    for r in rows:
        if r[2] is None:
            out.append((*r, None, True))
        else:
            by_key[r[:2]].append(r)
    for own in by_key.values():
        begin, n, first = None, 0, set()
        for r in sorted(own, key=lambda r: (r[2], r[3])):
            if begin is None or r[2] - begin >= timedelta(days=days):
                begin, n = r[2], n + 1
            out.append((*r, n, n not in first))
            first.add(n)
    return out


def compared(rows: list[tuple]) -> list[tuple]:
    return sorted((repr(r[0]), repr(r[1]), r[2].timestamp() if r[2] else 0.0, *r[3:]) for r in rows)


@pytest.mark.parametrize(("days", "years"), [(7, 0.2), (7, 3), (1, 1), (30, 0.01)])
def test_epochs(spark: SparkSession, days: int, years: float) -> None:
    r = random.Random(days)
    rows: list[tuple] = []
    for k in range(300):
        key = ("hot", 1) if k % 3 == 0 else (r.choice(["a", "b", None]), r.choice([1, 2, None]))
        rows.append((*key, START + timedelta(seconds=r.randrange(int(years * 365 * 86400))), k))
    rows += [("edge", 1, START + timedelta(days=days) * n, 1000 + n) for n in range(5)] + [("edge", 2, START + timedelta(days=days) * n - timedelta(microseconds=n), 2000 + n) for n in range(5)]
    rows += [("same", 1, START, 3000 + n) for n in range(4)] + [("same", 1, START - timedelta(days=3 * days), 3100), ("none", 1, None, 4000), ("none", 1, None, 4001)]
    df = spark.createDataFrame([(*x, None) for x in rows], "client string, k long, at timestamp, n int, t string").repartition(4)
    found = [(x.client, x.k, x["at"].astimezone(timezone.utc) if x["at"] else None, x.n, x.delivery_epoch, x.is_first) for x in first_deliveries(df, ["client", "k"], "at", days).collect()]
    assert compared(found) == compared(folded(rows, days))


def test_equal_rows_and_none(spark: SparkSession) -> None:
    df = spark.createDataFrame([("a", START)] * 5 + [("b", None)], "client string, at timestamp")
    found = first_deliveries(df, ["client"], "at").collect()
    assert sorted((x.client, x.delivery_epoch or 0, x.is_first) for x in found) == [("a", 1, False)] * 4 + [("a", 1, True), ("b", 0, True)]
    assert first_deliveries(df.limit(0), ["client"], "at").isEmpty() and first_deliveries(df.where("client = 'b'"), ["client"], "at").count() == 1
