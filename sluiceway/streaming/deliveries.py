"""Re-delivery in a stream: each message gets the audit_id of the run that its key's epoch began with.

The state of a key is one row, the begin of its epoch and the audit_id of its run, and a timer on event time
ends it when the watermark passes the window's end; keys are spread by hash, and a batch sends the messages of
a key in pieces, so that no task holds all of them. State lives in RocksDB with a changelog in the query's
checkpoint folder, and a query that starts again from there goes on with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions.frames import kept, stages
from ..plans.records import checked
from ..sources.commits import committed, write_batch
from ..sources.files import ingest

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000


def stream_audit_id(client_id: str, workflow_id: str, message_id: str, begin_ms: int) -> str:
    return hashlib.sha256(f"{client_id}|{workflow_id}|{message_id}|{begin_ms}".encode()).hexdigest()


class Redelivery(StatefulProcessor):
    """Rows with client_id, message_id, received_ms and n -> also audit_id and is_new.

    The messages of a piece of a batch are taken in the order of their times, then of n. One before the
    begin of the epoch, which came late, belongs to it as well, if it lies within the window before; one at
    the window's end or later begins the next epoch.
    """

    def __init__(self, workflow_id: str, days: float):
        self.workflow_id, self.span = workflow_id, int(days * DAY)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.epoch = handle.getValueState("epoch", "begin_ms long, audit_id string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        client_id, message_id = key
        begin, audit_id = self.epoch.get() if self.epoch.exists() else (None, None)
        kept = begin
        for df in rows:
            df = df.sort_values(["received_ms", "n"], kind="stable")
            found = []
            for at in df["received_ms"]:
                new = begin is None or not begin - self.span < at < begin + self.span
                if new:
                    begin, audit_id = int(at), stream_audit_id(client_id, self.workflow_id, message_id, int(at))
                found.append((audit_id, new))
            yield df.assign(audit_id=[x[0] for x in found], is_new=[x[1] for x in found])
        if begin is not None and begin != kept:
            if kept is not None:
                self.handle.deleteTimer(kept + self.span)
            self.epoch.update((begin, audit_id))
            self.handle.registerTimer(begin + self.span)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.epoch.clear()
        yield from ()

    def close(self) -> None:
        pass


def with_audit_ids(stream: DataFrame, workflow_id: str, days: float = 7, late: str = "1 day") -> DataFrame:
    """A stream with client_id, message_id, received_at (timestamp) and n -> all its columns, audit_id and is_new.

    A repeat within `days` of its epoch's begin has the begin's audit_id and is_new false. Rows later than
    `late` behind the newest are dropped by the watermark; rows without a key or time are left out. n is the
    message's number at the source and orders messages of the same time.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    timed = stream.where("client_id IS NOT NULL AND message_id IS NOT NULL AND received_at IS NOT NULL").withWatermark("received_at", late)
    rows = timed.withColumn("received_ms", F.unix_millis("received_at"))
    shape = T.StructType([*rows.schema.fields, T.StructField("audit_id", T.StringType()), T.StructField("is_new", T.BooleanType())])
    found = rows.groupBy("client_id", "message_id").transformWithStateInPandas(Redelivery(workflow_id, days), outputStructType=shape, outputMode="append", timeMode="EventTime")
    return found.drop("received_ms")


def run_deliveries(stream: DataFrame, process: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, workflow_id: str, version: str = "", days: float = 7) -> StreamingQuery:
    """Runs the batch plan on first deliveries (client_id, message_id, received_at, n, content) and answers repeats with their run's audit_id.

    Each batch commits the records of its new runs, under the audit_id that their delivery was given, and the
    table redelivered (client_id, message_id, received_at, n, audit_id) together.
    """
    spark = stream.sparkSession
    source = hashlib.sha256(f"{checkpoint}|{version}".encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        name = f"{number:012}"
        if committed(spark, sink, name):
            return
        with stages(spark, f"deliveries-{source}-{name}"):
            rows = kept(batch, "deliveries")
            new = rows.where("is_new").withColumn("run_id", F.col("n").cast("string"))
            messages = ingest(new, "run_id").join(new.select("run_id", "audit_id"), "run_id")
            again = rows.where("NOT is_new").select("client_id", "message_id", "received_at", "n", "audit_id")
            write_batch(checked(kept(process(messages), "done")) | {"redelivered": again}, sink, name)

    return with_audit_ids(stream, workflow_id, days).writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
