"""Commits of a batch as a whole, stages that are resumed, runs that break a contract."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from test_engine import MAILS, write_package

from sluiceway.functions.frames import kept, shared_folder, stages
from sluiceway.operators import history
from sluiceway.plans import contracts
from sluiceway.plans.records import checked
from sluiceway.plans.runs import process, run_key
from sluiceway.sources import commits, files, packages

TABLES = ("result", "review_entry", "dead_letter", "audit")


def fail(df: DataFrame) -> DataFrame:
    """The table, which breaks where it is computed."""
    return df.withColumn(df.columns[0], F.when(F.rand() < 2, F.raise_error(F.lit("killed"))).cast(df.dtypes[0][1]))


@pytest.fixture(scope="module")
def done(spark: SparkSession, tmp_path_factory: pytest.TempPathFactory) -> DataFrame:
    tmp_path = tmp_path_factory.mktemp("packages")
    messages = files.ingest(spark.createDataFrame(list(MAILS.items()), "path string, content binary"))
    return kept(process(messages, packages.load_package(spark, write_package(tmp_path / "p")), "acme", "invoices", "1.0.0"), "done")


def test_a_batch_is_there_whole_or_not_at_all(spark: SparkSession, done: DataFrame, tmp_path: Path) -> None:
    sink = f"file://{tmp_path}/sink"
    read = {name: (lambda name=name: commits.read_committed(spark, sink, name, contracts.schema(name))) for name in TABLES}
    found = checked(done)
    for k, broken in enumerate(TABLES):
        with pytest.raises(Exception, match="killed"):
            commits.write_batch({name: fail(rows) if name == broken else rows for name, rows in found.items()}, sink, "1")
        assert all(read[name]().isEmpty() for name in TABLES), k
    assert packages.write_terminals(done, sink, "1") and not packages.write_terminals(done, sink, "1")
    assert packages.write_terminals(done.withColumn("audit_id", F.concat("audit_id", F.lit("2"))), sink, "2")
    ends = read["result"]().select("audit_id").unionByName(read["review_entry"]().select("audit_id")).unionByName(read["dead_letter"]().select("audit_id"))
    assert read["audit"]().count() == 2 * len(MAILS) and history.reconcile(ends, read["audit"]()).isEmpty()
    assert len(list((tmp_path / "sink/batches/1").iterdir())) == 1, "failed attempts are deleted"
    assert commits.read_committed(spark, f"file://{tmp_path}/none", "audit", contracts.schema("audit")).isEmpty()


def test_one_broken_run_does_not_stop_its_batch(spark: SparkSession, done: DataFrame) -> None:
    odd = done.withColumns({
        "engine_version": F.when(F.col("run_id") != "good", F.col("engine_version")),
        "reasons": F.when(F.col("run_id") == "missing", F.array(F.lit("made_up"))).otherwise(F.col("reasons")),
        "audit_id": F.when(F.col("run_id") != "conflict", F.col("audit_id")),
        "outcome": F.when(F.col("run_id") == "other", F.lit("lost")).otherwise(F.col("outcome")),
    })
    found = checked(kept(odd, "odd"))
    told = {r.error for r in found["dead_letter"].collect()}
    assert told == {"malformed_email", "contract: a key is null", "contract: unknown or no reason", "contract: unknown outcome"}
    assert found["dead_letter"].count() == 5 and found["audit"].count() == len(MAILS)
    for name in ("result", "review_entry", "audit"):
        assert contracts.violations(found[name], name).isEmpty()


def test_a_killed_run_goes_on_from_its_last_stage(spark: SparkSession, tmp_path: Path) -> None:
    messages = files.ingest(spark.createDataFrame(list(MAILS.items()), "path string, content binary"))
    package = packages.load_package(spark, write_package(tmp_path / "r"))
    key = run_key(messages, package, "1.0.0")
    assert key == run_key(messages.repartition(3), package, "1.0.0") != run_key(messages.where("run_id <> 'good'"), package, "1.0.0")
    assert key != run_key(messages, package | {"keywords": package["keywords"].withColumn("weight", F.lit(0.1))}, "1.0.0")
    root = Path(shared_folder(spark).removeprefix("file://")) / "sluiceway-stages" / key
    with pytest.raises(Exception, match="killed"), stages(spark, key):
        process(messages, package | {"bands": fail(package["bands"])}, "acme", "invoices", "1.0.0").collect()
    assert root.exists()
    with stages(spark, key) as store:
        outcomes = {r.run_id: r.outcome for r in process(messages, package, "acme", "invoices", "1.0.0").collect()}
    assert store.resumed == ["ingested", "messages", "csv_parser", "spreadsheet_parser", "doc_parser", "pdf_parser", "candidates", "settled"] and len(outcomes) == len(MAILS)
    assert not root.exists(), "nothing is left after success"
    with pytest.raises(ValueError), stages(spark) as other:
        kept(spark.range(3), "x")
        raise ValueError("without a key nothing is resumed")
    assert not Path(other.root.removeprefix("file://")).exists()
