"""Tables that become visible together: a batch is written to folders of its own, and one marker, written last, names them.

Readers go by the markers alone, so they see all tables of a batch or none, and of a batch that was written
twice the attempt whose marker came first. A marker is a small file that is moved into place, which is atomic
where the store's rename is (HDFS and local file systems).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.frames import Files


def committed(spark: SparkSession, sink: str, batch: str) -> bool:
    return Files(spark).exists(f"{sink}/_commits/{batch}.json")


def write_batch(tables: Mapping[str, DataFrame], sink: str, batch: str) -> bool:
    """Writes the tables of a batch and commits them at once; False, and no change, if the batch is committed already.

    What failed attempts of the batch have left is deleted after the commit.
    """
    spark = next(iter(tables.values())).sparkSession
    if committed(spark, sink, batch):
        return False
    files, attempt = Files(spark), uuid.uuid4().hex
    for name, rows in tables.items():
        rows.write.parquet(f"{sink}/batches/{batch}/{attempt}/{name}")
    first = files.put_once(f"{sink}/_commits/{batch}.json", json.dumps({"batch": batch, "attempt": attempt, "tables": sorted(tables)}))
    if not first:
        files.delete(f"{sink}/batches/{batch}/{attempt}")
        return False
    for other in files.names(f"{sink}/batches/{batch}"):
        if other != attempt:
            files.delete(f"{sink}/batches/{batch}/{other}")
    return True


def read_committed(spark: SparkSession, sink: str, table: str, schema: T.StructType | str) -> DataFrame:
    """All committed rows of a table; an empty table if there are none. One marker for each batch is read by the driver."""
    if not [n for n in Files(spark).names(f"{sink}/_commits") if n.endswith(".json")]:
        return spark.createDataFrame([], schema)
    markers = spark.read.schema("batch string, attempt string, tables array<string>").json(f"{sink}/_commits/*.json").where(f"array_contains(tables, '{table}')")
    paths = [f"{sink}/batches/{r.batch}/{r.attempt}/{table}" for r in markers.select("batch", "attempt").collect()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
