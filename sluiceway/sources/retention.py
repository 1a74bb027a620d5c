"""Retention of tables that lie by client and day: days that are over are deleted with their files, and the deletion is recorded."""

from __future__ import annotations

from datetime import date, timedelta
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import Files

MANIFEST = "client_id string, day date, files long, bytes long, deleted_at timestamp"


def write_by_day(df: DataFrame, path: str, at: str) -> None:
    """Appends rows under client_id=.../day=..., the day of `at`; rows without a time lie under no day and are kept for good."""
    df.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("client_id", "day").parquet(path)


def delete_expired(spark: SparkSession, path: str, days: int, today: date, client_id: str | None = None) -> DataFrame:
    """Deletes the days before `today` less `days`, of one client or of all; returns what this call deleted (see MANIFEST).

    Whole day folders go, so no other file is read or written. The manifest is written before the deletion
    and read back after it: where a call dies in between, its entries name files that are still there, and
    the next call deletes these again.
    """
    files, limit, found = Files(spark), today - timedelta(days=days), []
    for client in files.names(path):
        if not client.startswith("client_id=") or (client_id is not None and unquote(client.removeprefix("client_id=")) != client_id):
            continue
        for day in files.names(f"{path}/{client}"):
            value = day.removeprefix("day=")
            if day.startswith("day=") and not value.startswith("__HIVE") and date.fromisoformat(value) < limit:
                count, size = files.usage(f"{path}/{client}/{day}")
                found.append((unquote(client.removeprefix("client_id=")), date.fromisoformat(value), count, size, f"{path}/{client}/{day}"))
    rows = spark.createDataFrame([(*x[:4], None) for x in found], MANIFEST).withColumn("deleted_at", F.current_timestamp())
    if found:
        rows.coalesce(1).write.mode("append").parquet(f"{path}_deletions")
    for *_, folder in found:
        files.delete(folder)
    return spark.createDataFrame([(*x[:4], None) for x in found], MANIFEST).withColumn("deleted_at", F.current_timestamp())
