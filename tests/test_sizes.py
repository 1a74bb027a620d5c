"""Tables beyond what one task should hold are dealt by their rows, and files that share parts are read once."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import SparkSession

from sluiceway.functions import frames
from sluiceway.plans import operations_queries
from sluiceway.plans.queries import QUERIES
from sluiceway.sources import files


def test_dealt_by_rows(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(frames, "ROWS_A_TASK", 100)
    assert frames.dealt(spark.range(5_000), "id").rdd.getNumPartitions() == 50
    few = spark.range(100 * spark.sparkContext.defaultParallelism)
    assert frames.dealt(few, "id") is few


@pytest.mark.parametrize("name", ["q_route_outcomes", "q_coverage"])
def test_no_task_joins_more_than_its_rows(spark: SparkSession, sf: str, monkeypatch: pytest.MonkeyPatch, name: str) -> None:
    """Spark merged the join's partitions up to a size in packed bytes: 1 GB of one task's memory at 60 times sf0.1."""
    before = sorted(QUERIES[name](spark, sf).collect())
    monkeypatch.setattr(frames, "ROWS_A_TASK", 200)
    found = QUERIES[name](spark, sf)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
    assert sorted(found.collect()) == before


def test_only_conflicts_are_dealt_to_meet_critical_fields(spark: SparkSession, sf: str, monkeypatch: pytest.MonkeyPatch) -> None:
    """All settled fields of a large table were dealt out once more, with how far they lie apart, before those in conflict were told."""
    before = sorted(QUERIES["q_route_outcomes"](spark, sf).collect())
    monkeypatch.setattr(frames, "ROWS_A_TASK", 200)
    found = QUERIES["q_route_outcomes"](spark, sf)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = [plan[k + 1] for k, x in enumerate(plan) if "RepartitionByExpression [run_id" in x]
    # One side of each join by field keeps as many tasks as the rows ask for.
    assert len(dealt) == 4 and not any("delta" in x for x in dealt)
    assert sorted(found.collect()) == before


def test_parts_that_workbooks_share_are_read_once(monkeypatch: pytest.MonkeyPatch) -> None:
    """Three of the five parts of each of q_office_files' workbooks are alike; each took a parse of its own."""
    read, plain = [], files._xml
    monkeypatch.setattr(files, "_xml", lambda data: read.append(data) or plain(data))
    rows = [files._xlsx_rows("b.xlsx", operations_queries._workbook(f"n{k}", f"{k}.5", k)) for k in range(10)]
    assert len(read) <= 3 + 2 * 10
    assert [[r["cells"]["Due"] for r in x if "Due" in r["cells"]] for x in rows] == [[f"2024-01-{k + 1:02}"] for k in range(10)]
    # Other styles are not taken for these.
    book = operations_queries._workbook("n", "1.5", 3)
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        parts = {name: z.read(name).decode().replace('numFmtId="14"', 'numFmtId="0"') for name in z.namelist()}
    assert list(parts) == ["xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/styles.xml", "xl/worksheets/sheet1.xml", "xl/worksheets/sheet2.xml"]
    assert [r["cells"]["Due"] for r in files._xlsx_rows("b.xlsx", operations_queries._packed(parts)) if "Due" in r["cells"]] == ["45295"]
