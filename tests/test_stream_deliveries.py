"""Re-delivery in a stream, over restarts and expired windows."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import SparkSession
from test_engine import MAILS, write_package

from sluiceway.plans import contracts
from sluiceway.plans.runs import process
from sluiceway.sources import commits, packages
from sluiceway.streaming.deliveries import run_deliveries, with_audit_ids
from sluiceway.streaming.runs import message_stream

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
MESSAGE = "client_id string, message_id string, received_at timestamp, n long"


def run(spark: SparkSession, tmp: Path) -> dict[int, tuple[str, bool]]:
    """What the stream says of all messages since it last ran."""
    found: dict[int, tuple[str, bool]] = {}

    def take(batch, _number: int) -> None:  # noqa: ANN001
        found.update({r.n: (r.audit_id, r.is_new) for r in batch.collect()})

    query = with_audit_ids(message_stream(spark, str(tmp / "in"), MESSAGE), "w").writeStream.foreachBatch(take).trigger(availableNow=True).option("checkpointLocation", str(tmp / "ck")).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return found


def test_a_repeat_has_the_first_audit_id(spark: SparkSession, tmp_path: Path) -> None:
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    try:
        (tmp_path / "in").mkdir()
        spark.createDataFrame([("c", "m", START, 0), ("c", "m", START + timedelta(days=2), 1), ("d", "m", START, 2), (None, "m", START, 3), ("c", None, START, 4), ("c", "x", None, 5)], MESSAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        one = run(spark, tmp_path)
        assert set(one) == {0, 1, 2} and [one[k][1] for k in (0, 1, 2)] == [True, False, True]
        assert one[0][0] == one[1][0] != one[2][0]
        # The query starts again and still knows the first run.
        spark.createDataFrame([("c", "m", START + timedelta(days=6.9), 10), ("c", "m", START + timedelta(days=7), 11), ("c", "m", START + timedelta(days=13), 12)], MESSAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        two = run(spark, tmp_path)
        assert two[10] == (one[0][0], False) and two[11][1] and two[11][0] != one[0][0] and two[12] == (two[11][0], False)
        # The watermark passes the window, the timer ends the state, and the key begins anew.
        spark.createDataFrame([("d", "z", START + timedelta(days=40), 20)], MESSAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(spark, tmp_path)
        spark.createDataFrame([("c", "m", START + timedelta(days=41), 30), ("d", "z", START + timedelta(days=41), 31)], MESSAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        four = run(spark, tmp_path)
        assert four[30][1] and four[30][0] not in (one[0][0], two[11][0]) and not four[31][1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_repeat_makes_no_second_review_entry(spark: SparkSession, tmp_path: Path) -> None:
    package = packages.load_package(spark, write_package(tmp_path / "p"))
    queue, sink = "client_id string, message_id string, received_at timestamp, n long, content binary", f"file://{tmp_path}/out"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    (tmp_path / "in").mkdir()
    try:
        for rows in ([("acme", "good", 0, 1), ("acme", "missing", 0, 2), ("acme", "missing", 1, 3)], [("acme", "missing", 5, 4), ("acme", "good", 8, 5)]):
            spark.createDataFrame([(c, m, START + timedelta(days=d), n, MAILS[m]) for c, m, d, n in rows], queue).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            query = run_deliveries(message_stream(spark, str(tmp_path / "in"), queue), lambda b: process(b, package, "acme", "w", "1.0.0"), sink, str(tmp_path / "ck"), "w")
            query.awaitTermination(400)
            assert query.exception() is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    read = lambda name, schema=None: commits.read_committed(spark, sink, name, schema or contracts.schema(name)).collect()
    reviews, results = read("review_entry"), read("result")
    again = {r.n: r.audit_id for r in read("redelivered", "client_id string, message_id string, received_at timestamp, n long, audit_id string")}
    assert len(reviews) == 1 and again == {3: reviews[0].audit_id, 4: reviews[0].audit_id}
    assert len(results) == 2 and len({r.audit_id for r in results}) == 2, "outside the window a new run"
    assert len(read("audit")) == 3
