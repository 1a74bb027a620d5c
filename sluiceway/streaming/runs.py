"""The streaming run path: deduplicated messages, the batch plan, terminals and audits committed together."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.frames import kept, stages
from ..plans.records import checked
from ..sources.commits import committed, write_batch


def message_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """A folder as a queue of messages; per_trigger bounds what one batch admits."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def deduplicated(stream: DataFrame, keys: list[str], at: str = "received_at", days: int = 7) -> DataFrame:
    """The first delivery of each key within so many days of event time."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark(keys)


def run_stream(stream: DataFrame, process: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, shadow: bool = False, version: str = "") -> StreamingQuery:
    """Runs the batch plan on each micro-batch; its results, review entries, dead letters and audits are committed together.

    A batch that is replayed after a failure goes on from the stages that had ended (version, the package's,
    tells other plans apart), commits once, and leaves no intermediate table. sources.commits.read_committed
    reads what is there. A run that breaks a contract is a dead letter. Records of a trial feed are labelled
    as shadow.
    """
    spark = stream.sparkSession
    source = hashlib.sha256(f"{checkpoint}|{version}".encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        name = f"{number:012}"
        if committed(spark, sink, name):
            return
        # Start records come first, so that a batch that never ends is known (see monitoring.overdue).
        started = batch.select(F.col("run_id"), F.current_timestamp().alias("started_at"), F.lit(shadow).alias("is_shadow"))
        write_batch({"started": started}, sink, f"{name}-started")
        with stages(spark, f"stream-{source}-{name}"):
            found = checked(kept(process(batch), "done"))
            write_batch({table: rows.withColumn("is_shadow", F.lit(shadow)) for table, rows in found.items()}, sink, name)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def windowed_throughput(stream: DataFrame, at: str = "received_at", late: str = "10 minutes", span: str = "1 hour") -> DataFrame:
    """(window, client_id, n) with late rows up to `late`."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, span), "client_id").agg(F.count(F.lit(1)).alias("n"))


def poisoned(attempts: DataFrame, most: int = 3) -> DataFrame:
    """Messages (message_id, error, attempt) that failed so often that they go to the dead-letter table."""
    return attempts.groupBy("message_id").agg(F.max("attempt").alias("attempts"), F.max_by("error", "attempt").alias("error")).where(F.col("attempts") >= most)
