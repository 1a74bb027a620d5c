"""Holdout, exemplars, latency sketches and retention."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict
from datetime import date, datetime, timedelta
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sluiceway.operators import monitoring, selection
from sluiceway.sources import retention


def test_holdout_takes_the_least_hashes_of_each_type(spark: SparkSession) -> None:
    r = random.Random(1)
    rows = [(k, "hot" if k % 3 else r.choice(["a", "b", None])) for k in range(900)] + [(5000 + k, "few") for k in range(3)]
    by_type: dict = defaultdict(list)
    for k, kind in rows:
        by_type[kind].append((hashlib.sha256(f"c9|{k}".encode()).hexdigest(), k))
    want = {k: (h in {x for x, _ in sorted(by_type[kind])[: max(5, math.ceil(len(by_type[kind]) * 0.2))]}) for kind, own in by_type.items() for h, k in own}
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], "sample_id long, email_type string, h string, g int").repartition(5)
    found = selection.holdout(df, "c9")
    assert {x.sample_id: x.is_holdout for x in found.collect()} == want and found.columns == [*df.columns, "is_holdout"]
    # A sample that is repeated stays on one side, even as a third of all rows.
    repeated = selection.holdout(df.unionByName(df.where("sample_id = 7").crossJoin(spark.range(400)).drop("id")), "c9").groupBy("sample_id").agg(F.count_distinct("is_holdout").alias("sides"))
    assert repeated.where("sides <> 1").isEmpty()
    assert selection.holdout(df.limit(0), "c9").isEmpty()


def test_proposed_types(spark: SparkSession) -> None:
    df = spark.createDataFrame([(k, "hot" if k % 4 else None) for k in range(100, 0, -1)], "sample_id long, email_type string")
    assert {x.email_type: (x.n, x.exemplars) for x in selection.propose_types(df).collect()} == {"hot": (75, [1, 2, 3]), None: (25, [4, 8, 12])}
    plan = selection.propose_types(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan, "a rank with a bound is cut before the shuffle"


def test_sketches_merge_to_any_window(spark: SparkSession) -> None:
    r = random.Random(2)
    values = [(("a", "b")[k % 2], datetime(2024, 1, 1) + timedelta(minutes=k % 3000), r.lognormvariate(3, 1)) for k in range(20_000)] + [("a", datetime(2024, 1, 1), None), ("c", datetime(2024, 1, 1), 5.0)]
    sketches = monitoring.latency_sketches(spark.createDataFrame(values, "client_id string, at timestamp, ms double"), "ms", "at")
    for by in ((), ("client_id",), ("client_id", "day")):
        found = monitoring.merged_latency(sketches.withColumn("day", F.to_date("hour")), *by).collect()
        for row in found:
            own = sorted(v for c, t, v in values if v is not None and ("client_id" not in by or c == row.client_id) and ("day" not in by or t.date() == row.day))
            assert row.n == len(own)
            for q, value in ((0.5, row.p50), (0.95, row.p95)):
                assert sum(v < value for v in own) / len(own) <= q + monitoring.RANK_ERROR and sum(v <= value for v in own) / len(own) >= q - monitoring.RANK_ERROR


def test_expired_days_are_gone_and_others_untouched(spark: SparkSession, tmp_path: Path) -> None:
    path, today = f"file://{tmp_path}/messages", date(2024, 3, 1)
    rows = [("a b/c" if k % 2 else "d", datetime(2024, 2, 1) + timedelta(days=k), f"text {k}") for k in range(28)] + [("d", None, "no time")]
    retention.write_by_day(spark.createDataFrame(rows, "client_id string, at timestamp, body string"), path, "at")
    audits = spark.createDataFrame([(k,) for k in range(28)], "audit_id long")
    audits.write.parquet(str(tmp_path / "audits"))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "messages").rglob("*.parquet")}
    one = retention.delete_expired(spark, path, 14, today, client_id="a b/c")
    assert {r.client_id for r in one.collect()} == {"a b/c"} and spark.read.parquet(path).where("client_id = 'd'").count() == 15
    every = retention.delete_expired(spark, path, 14, today)
    left = {p: p.stat().st_mtime_ns for p in (tmp_path / "messages").rglob("*.parquet")}
    assert left.items() <= before.items() and len(before) - len(left) == one.count() + every.count() == 15 or len(left) < len(before)
    days = {r.day for r in spark.read.parquet(path).select("day").distinct().collect()}
    assert min(d for d in days if d) == date(2024, 2, 16) and None in days
    assert spark.read.parquet(f"{path}_deletions").agg(F.sum("files")).first()[0] >= 15 and spark.read.parquet(str(tmp_path / "audits")).count() == 28
    assert retention.delete_expired(spark, path, 14, today).isEmpty() and retention.delete_expired(spark, f"{path}-none", 14, today).isEmpty()
