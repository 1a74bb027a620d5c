"""The engine end to end: messages, packages, routing, registry, streams."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from decimal import Decimal
from email.message import EmailMessage
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.functions import scalars as fn
from sluiceway.operators import authoring, detection, evaluation, governance, history, monitoring, routing
from sluiceway.plans import contracts
from sluiceway.plans.runs import canonical_hash, process
from sluiceway.sources import commits, files, packages
from sluiceway.streaming import runs as streaming

SCHEMA = {
    "schema_version": "1", "email_type": "invoice", "generated_by": "a", "reviewed_by": "b",
    "required_fields": [{"name": "amount", "type": "decimal", "critical": True, "validation": {"min": 0}}, {"name": "due_date", "type": "date", "critical": False}],
    "optional_fields": [{"name": "note", "type": "string"}],
    "aliases": {"amount": ["total", "amount due"], "due_date": ["due"]},
}
RULES = {"schema_version": "1", "types": {"invoice": {"keywords": [{"term": "invoice", "weight": 0.7}], "patterns": [{"name": "no", "regex": "INV-[0-9]+", "weight": 0.2}], "entity_weights": {}, "classification_threshold": 0.6, "negative_signals": ["newsletter"]}}, "generated_by": "a", "reviewed_by": "b"}


def limits(accept: float) -> dict:
    return {"schema_version": "1", "types": {"invoice": {"accept_at": accept, "review_below": 0.6, "reject_below": 0.3, "required_field_coverage": 1.0, "critical_field_tolerance": {"amount": {"absolute": 1.0}}, "always_review_if": ["encrypted_no_key", "attachment_parse_failed", "classification_ambiguous"]}}, "generated_by": "a", "reviewed_by": "b"}


def write_package(root: Path, accept: float = 0.7) -> str:
    listed = []
    for path, kind, body in (("schemas/invoice.json", "field_schema", SCHEMA), ("rules.json", "detection_rules", RULES), ("thresholds.json", "thresholds", limits(accept))):
        data = json.dumps(body).encode()
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)
        listed.append((path, kind, hashlib.sha256(data).hexdigest()))
    (root / "manifest.json").write_text(packages.manifest_json("acme", "invoices", "1.0.0", ">=1.0.0 <2.0.0", ["invoice"], listed))
    return f"file://{root}"


def xlsx(rows: list[list[str]]) -> bytes:
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="str"><v>{v}</v></c>' for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Summary"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def mail(body: str, *attached: tuple[str, str, bytes]) -> bytes:
    m = EmailMessage()
    m["Message-ID"], m["From"], m["Subject"] = "<1@example.org>", "a@example.org", "x"
    m.set_content(body)
    for name, mime, data in attached:
        m.add_attachment(data, maintype=mime.split("/")[0], subtype=mime.split("/")[1], filename=name)
    return m.as_bytes()


MAILS = {
    "good": mail("An invoice INV-1\nTotal: 100.00 EUR\nDue: 2024-05-01\n", ("t.csv", "text/csv", b"total,due\n100.00,2024-05-01\n")),
    "missing": mail("An invoice INV-2\nTotal: 5.00\n"),
    "conflict": mail("An invoice\nTotal: 12400\nDue: 2024-05-01\n", ("s.xlsx", "application/vnd.ms-excel", xlsx([["Total"], ["12450"]]))),
    "other": mail("Good morning\n"),
    "veto": mail("Our newsletter about an invoice\nTotal: 1\nDue: 2024-05-01\n"),
    "broken_zip": mail("An invoice\nTotal: 7\nDue: 2024-05-01\n", ("s.xlsx", "application/zip", b"PK\x03\x04\0\0\0\0 xl/workbook.xml nonsense")),
    "odd_type": mail("An invoice\nTotal: 7\nDue: 2024-05-01\n", ("p.png", "image/png", b"\x89PNG1234")),
    "bad": b"",
}


@pytest.fixture(scope="session")
def messages(spark: SparkSession) -> DataFrame:
    return files.ingest(spark.createDataFrame(list(MAILS.items()), "path string, content binary"))


def outcomes(spark: SparkSession, messages: DataFrame, package: str) -> dict[str, tuple[str, list[str]]]:
    done = process(messages, packages.load_package(spark, package), "acme", "invoices", "1.0.0")
    return {r.run_id: (r.outcome, r.reasons) for r in done.collect()}


def test_runs_end_as_the_package_says(spark: SparkSession, messages: DataFrame, tmp_path: Path) -> None:
    found = outcomes(spark, messages, write_package(tmp_path / "p"))
    assert found["good"] == ("extracted", [])
    assert found["missing"][0] == "review_queued" and "missing_field:due_date" in found["missing"][1]
    assert "critical_field_conflict:amount" in found["conflict"][1]
    assert found["other"] == ("review_queued", ["classification_ambiguous"])
    assert found["veto"][1] == ["classification_ambiguous"]
    assert found["broken_zip"][1] == ["attachment_parse_failed:s.xlsx"]
    assert found["odd_type"] == ("extracted", [])  # not in always_review_if
    assert found["bad"][0] == "error"


def test_accept_band_changes_routing_only(spark: SparkSession, messages: DataFrame, tmp_path: Path) -> None:
    strict = outcomes(spark, messages, write_package(tmp_path / "q", accept=0.99))
    assert strict["good"] == ("review_queued", ["low_confidence"])


def test_replay_repeats_every_hash(spark: SparkSession, messages: DataFrame, tmp_path: Path) -> None:
    package = packages.load_package(spark, write_package(tmp_path / "r"))
    one = {r.run_id: r.hash for r in canonical_hash(process(messages, package, "acme", "invoices", "1.0.0")).collect()}
    two = {r.run_id: r.hash for r in canonical_hash(process(messages.repartition(3), package, "acme", "invoices", "1.0.0")).collect()}
    assert one == two and len(one) == len(MAILS)


def test_sources_point_at_real_cells(spark: SparkSession, messages: DataFrame) -> None:
    attached = files.attachments(messages)
    assert {(r.run_id, r.kind) for r in attached.collect()} == {("good", "csv"), ("conflict", "xlsx"), ("broken_zip", "xlsx"), ("odd_type", "png")}
    row = files.parse_xlsx(attached.where("run_id = 'conflict'")).first()
    assert row.cells == {"Total": "12450"} and row.places == {"Total": "A2"} and row.sheet == "Summary"
    assert [r.code for r in files.attachment_flags(attached).collect()] == ["unsupported_attachment:image/png"]


def test_tampered_package_is_refused(spark: SparkSession, tmp_path: Path) -> None:
    path = write_package(tmp_path / "s")
    (tmp_path / "s/rules.json").write_bytes((tmp_path / "s/rules.json").read_bytes() + b" ")
    with pytest.raises(ValueError, match="package_corrupt"):
        packages.load_package(spark, path)


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_embedded_depth(spark: SparkSession, depth: int) -> None:
    inner = mail("deepest")
    for _ in range(depth):
        outer = EmailMessage()
        outer["Message-ID"] = "<o@example.org>"
        outer.set_content("outer")
        import email
        import email.policy

        outer.add_attachment(email.message_from_bytes(inner, policy=email.policy.default))
        inner = outer.as_bytes()
    found, flags = files.expand_embedded(files.ingest(spark.createDataFrame([("m", inner)], "path string, content binary")))
    assert found.count() == min(depth, 3) + 1
    assert flags.count() == int(depth > 3)


def test_documents_and_pdf(spark: SparkSession) -> None:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="x"><w:p><w:r><w:t>Hello</w:t></w:r></w:p></w:document>')
    pdf = b"%PDF-1.4\nstream\nBT (Total: 5) Tj ET\nendstream\n"
    rows = [("r", "a.docx", out.getvalue(), "docx", False), ("r", "b.pdf", pdf, "pdf", False), ("r", "c.pdf", b"%PDF-1.4", "pdf", False)]
    attached = spark.createDataFrame(rows, "run_id string, name string, content binary, kind string, encrypted boolean")
    assert files.parse_docx(attached).first().text == "Hello"
    assert {(r.file, r.text, r.error_code) for r in files.parse_pdf(attached).collect()} == {("b.pdf", "Total: 5", None), ("c.pdf", None, "attachment_parse_failed:c.pdf")}


def docx(*lines: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="x">' + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines) + "</w:document>")
    return out.getvalue()


def holding(body: str, inner: bytes) -> bytes:
    import email
    import email.policy

    m = EmailMessage()
    m["Message-ID"] = "<o@example.org>"
    m.set_content(body)
    m.add_attachment(email.message_from_bytes(inner, policy=email.policy.default))
    return m.as_bytes()


def test_documents_and_embedded_messages_reach_the_run(spark: SparkSession, tmp_path: Path) -> None:
    pdf = b"%PDF-1.4\nstream\nBT 1 0 0 1 50 700 Tm (Total: 5.00) Tj 0 -14 Td (Due:) Tj 30 0 Td (2024-05-01) Tj ET\nendstream\n"
    deep = mail("deepest")
    for _ in range(4):
        deep = holding("An invoice\nTotal: 7\nDue: 2024-05-01\n", deep)
    mails = {
        "pdf": mail("An invoice\n", ("a.pdf", "application/pdf", pdf)),
        "docx": mail("An invoice\n", ("a.docx", "application/x", docx("Total: 6.00", "Due: 2024-05-02"))),
        "inner": holding("An invoice\n", mail("Total: 8\n", ("i.csv", "text/csv", b"total,due\n8,2024-05-03\n"))),
        "inner_pdf": holding("An invoice\n", mail("see file\n", ("b.pdf", "application/pdf", pdf))),
        "bad_pdf": mail("An invoice\nTotal: 7\nDue: 2024-05-01\n", ("c.pdf", "application/pdf", b"%PDF-1.4")),
        "deep": deep,
    }
    package = packages.load_package(spark, write_package(tmp_path / "d", accept=0.5))
    package["always_review"] = package["always_review"].unionByName(spark.createDataFrame([("invoice", "embedded_depth_exceeded")], "type string, prefix string"))
    done = {r.run_id: r for r in process(files.ingest(spark.createDataFrame(list(mails.items()), "path string, content binary")), package, "acme", "invoices", "1.0.0").collect()}
    values = {k: {f.field: (f.triple.value, f.triple.source) for f in r.fields} for k, r in done.items()}
    assert {k: v[0] for k, v in values["pdf"].items()} == {"amount": "5.00", "due_date": "2024-05-01"} and values["pdf"]["amount"][1] == "attachment:a.pdf#p1"
    assert {k: v[0] for k, v in values["docx"].items()} == {"amount": "6.00", "due_date": "2024-05-02"}
    assert values["inner"]["due_date"] == ("2024-05-03", "embedded:1:0/attachment:i.csv#row2:due")
    assert values["inner_pdf"]["amount"][1] == "embedded:1:0/attachment:b.pdf#p1"
    assert [done[k].outcome for k in ("pdf", "docx", "inner", "inner_pdf")] == ["extracted"] * 4
    assert done["bad_pdf"].reasons == ["attachment_parse_failed:c.pdf"]
    assert done["deep"].reasons == ["embedded_depth_exceeded"]


def test_entities_score_and_tolerances_keep_their_type(spark: SparkSession, tmp_path: Path) -> None:
    package = packages.load_package(spark, write_package(tmp_path / "e", accept=0.3))
    package["entities"] = spark.createDataFrame([("invoice", "MONEY", 0.7)], "type string, entity string, weight double")
    package["tolerances"] = spark.sql("SELECT 'other' AS type, 'amount' AS field, CAST(0 AS DECIMAL(18,2)) AS absolute, CAST(NULL AS INT) AS days UNION ALL SELECT 'invoice', 'amount', CAST(100 AS DECIMAL(18,2)), NULL")
    mails = [("a", mail("Pay EUR 12.00\nTotal: 12\nDue: 2024-05-01\n", ("t.csv", "text/csv", b"total,due\n50,2024-05-01\n")))]
    one = process(files.ingest(spark.createDataFrame(mails, "path string, content binary")), package, "acme", "invoices", "1.0.0").first()
    assert (one.type, one.outcome, one.reasons) == ("invoice", "extracted", [])


def test_scalars(spark: SparkSession) -> None:
    row = spark.range(1).select(
        fn.parse_amount(F.lit("EUR 1.240,50")).alias("a"), fn.parse_amount(F.lit("$1,240.50")).alias("b"), fn.parse_amount(F.lit("none")).alias("c"), fn.parse_date(F.lit("01.05.2024")).alias("d"),
        fn.in_range(F.lit("2.10.0"), F.lit(">=2.9.0 <3.0.0")).alias("r"), fn.bump_between(F.lit("1.9.0"), F.lit("1.10.0")).alias("u"), fn.self_contained(F.lit("a/../b")).alias("p"),
        fn.parse_locator(F.lit("attachment:inv.xlsx!Summary!B14")).alias("l"), fn.phrase_in(F.lit("Été: le prix"), "le").alias("k"), fn.phrase_in(F.lit("élevé"), "lev").alias("n"), fn.magic_kind(F.lit(b"%PDF-1.4")).alias("m"),
    ).first()
    assert (row.a, row.b, row.c, str(row.d)) == (Decimal("1240.50"), Decimal("1240.50"), None, "2024-05-01")
    assert (row.r, row.u, row.p, row.l.file, row.l.locator, row.k, row.n, row.m) == (True, "minor", False, "inv.xlsx", "Summary!B14", True, False, "pdf")


def test_reasons_are_closed(spark: SparkSession) -> None:
    df = spark.createDataFrame([("missing_field:x",), ("made_up",)], "c string")
    assert [r.k for r in df.select(contracts.known_reason(F.col("c")).alias("k")).collect()] == [True, False]
    for name in contracts.SCHEMAS:
        assert contracts.schema(name).fields
    bad = spark.createDataFrame([("a", "c", "w", "1.0.0", None, "done")], "audit_id string, client_id string, workflow_id string, package_version string, engine_version string, outcome string")
    bad = bad.selectExpr("*", "current_timestamp() received_at", "array() agent_trace", "array() field_attribution", "array() retries", "array() conflicts", "array() chosen_sheets")
    assert {r.rule for r in contracts.violations(bad, "audit").collect()} == {"engine_version is null", "unknown outcome"}


def test_registry(spark: SparkSession) -> None:
    events = spark.createDataFrame([("c", "w", "1.0.0", "Draft", 1, 1), ("c", "w", "1.0.0", "Evaluated", 2, 2), ("c", "w", "1.1.0", "Draft", 1, 3), ("c", "w", "1.1.0", "Promoted", 2, 4)], "client_id string, workflow_id string, version string, state string, at int, seq int")
    assert {(r.version, r.state) for r in history.current_state(events).collect()} == {("1.0.0", "Evaluated"), ("1.1.0", "Promoted")}
    assert [(r.version, r.state) for r in history.illegal_moves(events).collect()] == [("1.1.0", "Promoted")]
    versions = spark.createDataFrame([("c", "w", "1.10.0"), ("c", "w", "1.9.0")], "client_id string, workflow_id string, version string")
    assert {r.version: r.previous for r in history.previous_version(versions).collect()} == {"1.9.0": None, "1.10.0": "1.9.0"}
    promo = history.may_promote(
        spark.createDataFrame([("1",), ("2",), ("3",)], "version string"),
        spark.createDataFrame([("1", True, "h"), ("2", True, "h"), ("3", False, "h")], "version string, passed boolean, report_hash string"),
        spark.createDataFrame([("1", "h"), ("2", "other")], "version string, report_hash string"),
        spark.createDataFrame([("1", "me")], "version string, reviewed_by string"),
    )
    assert {r.version: r.code for r in promo.collect()} == {"1": None, "2": "signoff_required", "3": "gate_failed"}


def test_publish_problems(spark: SparkSession) -> None:
    manifest = spark.createDataFrame([("c", "w", "1.0.0", ">=2.0.0", [("a/../x", "thresholds", "1")])], "client_id string, workflow_id string, version string, engine_range string, artifacts array<struct<path:string,kind:string,sha256:string>>")
    listed = spark.createDataFrame([("a/../x", 11 * 1024 * 1024, "2", "9")], "path string, size long, sha256 string, schema_version string")
    found = {r.code for r in history.publish_problems(manifest, listed, manifest.select("client_id", "workflow_id", "version"), "1.0.0").collect()}
    assert found == {"package_corrupt", "engine_incompatible", "schema_unsupported", "version_exists"}
    types, one = spark.createDataFrame([("a",), ("b",)], "type string"), spark.createDataFrame([("a",)], "type string")
    assert [r.type for r in history.incomplete_types(types, one, one).collect()] == ["b"]


def test_redelivery(spark: SparkSession) -> None:
    messages = spark.createDataFrame([("c", "m", "2024-01-05"), ("c", "m", "2024-02-05"), ("d", "m", "2024-01-05")], "client_id string, message_id string, at string").withColumn("at", F.to_timestamp("at"))
    runs = spark.createDataFrame([("c", "m", "2024-01-01", "a1")], "client_id string, message_id string, started_at string, audit_id string").withColumn("started_at", F.to_timestamp("started_at"))
    found = {(r.client_id, r["at"].month): r.original_audit_id for r in history.redelivered(messages, runs, ["client_id", "message_id"], "at").collect()}
    assert found == {("c", 1): "a1", ("c", 2): None, ("d", 1): None}


def test_packages_by_route(spark: SparkSession) -> None:
    messages = spark.createDataFrame([("a", "in@acme", "2024-01-05"), ("b", "in@acme", "2023-12-31"), ("c", "nobody", "2024-01-05"), ("d", None, "2024-01-05"), ("e", "in@acme", "2024-02-05")], "run_id string, route string, received_at string").withColumn("received_at", F.to_timestamp("received_at"))
    routes = spark.createDataFrame([("in@acme", "acme", "invoices")], "route string, client_id string, workflow_id string")
    active = spark.sql("SELECT 'acme' client_id, 'invoices' workflow_id, * FROM VALUES ('1.0.0', timestamp'2024-01-01'), ('1.1.0', timestamp'2024-02-01') v(version, activated_at)")
    found = {r.run_id: (r.client_id, r.package_version, r.error) for r in history.resolve_packages(messages, routes, active).collect()}
    assert found == {"a": ("acme", "1.0.0", None), "b": ("acme", None, "package_unresolved"), "c": (None, None, "package_unresolved"), "d": (None, None, "package_unresolved"), "e": ("acme", "1.1.0", None)}


def test_skill_variants(spark: SparkSession) -> None:
    default = spark.createDataFrame([("s", k, k < 5) for k in range(10)] + [("t", k, True) for k in range(4)], "skill_id string, sample_id long, correct boolean")
    variant = spark.createDataFrame([("s", k, k != 0) for k in range(9)] + [("t", k, None) for k in range(4)], "skill_id string, sample_id long, correct boolean")
    found = {r.skill_id: (r.n, r.before, r.after, r.fixed, r.broken, r.cases, r.proposed) for r in evaluation.skill_variants(default, variant).collect()}
    assert found == {"s": (10, 0.5, 0.8, 4, 1, [5, 6, 7], True), "t": (4, 1.0, 0.0, 0, 4, [], False)}


def test_as_of_before_first_activation(spark: SparkSession) -> None:
    runs = spark.createDataFrame([(1, "w", "2024-01-01"), (2, "w", "2024-01-03"), (3, "w", "2024-03-01"), (4, "v", "2024-03-01")], "id int, workflow_id string, at string").withColumn("at", F.to_timestamp("at"))
    active = spark.createDataFrame([("w", "1", "2024-01-02"), ("w", "2", "2024-02-01")], "workflow_id string, version string, activated_at string").withColumn("activated_at", F.to_timestamp("activated_at"))
    assert {r.id: r.version for r in history.as_of(runs, active, ["workflow_id"], "at").collect()} == {1: None, 2: "1", 3: "2", 4: None}


def test_gates_and_report(spark: SparkSession) -> None:
    metrics = spark.createDataFrame([("type_accuracy", 0.96), ("false_accept_rate", 0.02)], "metric string, value double")
    found = {r.metric: r.passed for r in evaluation.gates(metrics).collect()}
    assert found["type_accuracy"] and not found["false_accept_rate"] and not found["calibration"]
    with pytest.raises(ValueError):
        evaluation.gates(metrics, {"false_accept_rate": 0.5})
    fields = spark.createDataFrame([("a", 2, 0.5)], "field string, n long, accuracy double")
    assert evaluation.report(metrics, fields).first().report_hash == evaluation.report(metrics.repartition(3), fields).first().report_hash


def test_authoring(spark: SparkSession) -> None:
    stages = spark.createDataFrame([("r", "profile"), ("r", "types")], "run_id string, stage string")
    assert authoring.next_stage(stages, ("profile", "types", "fields")).first().next_stage == "fields"
    proposals = spark.createDataFrame([("alias", "amount", "total"), ("alias", "amount", "sum")], "kind string, key string, payload string")
    assert authoring.without_rejected(proposals, proposals.where("payload = 'sum'")).first().payload == "total"
    headers = spark.createDataFrame([(k, "Grand-Total", "5") for k in range(5)], "sample_id int, header string, value_norm string")
    labels = spark.createDataFrame([(k, "amount", "5") for k in range(5)], "sample_id int, field string, value_norm string")
    assert [(r.field, r.alias, r.support) for r in authoring.propose_aliases(headers, labels).collect()] == [("amount", "grand total", 5)]


def test_overdue_and_logs(spark: SparkSession) -> None:
    started = spark.sql("SELECT 'a' run_id, timestamp'2024-01-01 00:00:00' started_at UNION ALL SELECT 'b', timestamp'2024-01-01 00:09:00'")
    late = monitoring.overdue(started, started.where("false"), F.lit("2024-01-01 00:10:00").cast("timestamp"))
    assert [(r.run_id, r.code) for r in late.collect()] == [("a", "agent_timeout:orchestrator")]
    assert monitoring.without_content(started.withColumn("body", F.lit("x"))).columns == ["run_id"]


def test_empty_partials_invariant(spark: SparkSession) -> None:
    entries = spark.sql("SELECT 'a' run_id, map('x', 1) partial_fields UNION ALL SELECT 'b', cast(map() as map<string,int>)")
    assert [r.run_id for r in routing.empty_partials(entries, entries.select("run_id")).collect()] == ["b"]


def test_segments(spark: SparkSession) -> None:
    bodies = spark.createDataFrame([("a", "new\nOn Monday, X wrote:\nold"), ("b", None)], "run_id string, body string")
    assert sorted((r.run_id, r.segment_index, r.text) for r in detection.segment(bodies).collect()) == [("a", 0, "new"), ("a", 1, "old"), ("b", 0, "")]


def test_stream_writes_pairs_once(spark: SparkSession, messages: DataFrame, tmp_path: Path) -> None:
    package = packages.load_package(spark, write_package(tmp_path / "t"))
    messages.write.parquet(str(tmp_path / "queue"))
    stream = streaming.message_stream(spark, str(tmp_path / "queue"), files.MESSAGE)
    for _ in range(2):  # the second start finds nothing new
        query = streaming.run_stream(stream, lambda b: process(b, package, "acme", "invoices", "1.0.0"), str(tmp_path / "out"), str(tmp_path / "ck"), shadow=True)
        query.processAllAvailable()
        query.stop()
    kinds = {name: commits.read_committed(spark, str(tmp_path / "out"), name, contracts.schema(name).add("is_shadow", "boolean")) for name in ("result", "review_entry", "dead_letter", "audit")}
    assert kinds["audit"].count() == kinds["audit"].select("audit_id").distinct().count() == len(MAILS)
    assert kinds["audit"].where("not is_shadow").isEmpty()
    started = commits.read_committed(spark, str(tmp_path / "out"), "started", "run_id string, started_at timestamp, is_shadow boolean")
    assert {r.run_id for r in started.collect()} == set(MAILS)
    ends = kinds["result"].select("audit_id").unionByName(kinds["review_entry"].select("audit_id")).unionByName(kinds["dead_letter"].select("audit_id"))
    assert history.reconcile(ends, kinds["audit"]).isEmpty() and kinds["dead_letter"].count() == 1
    failed = kinds["audit"].where("outcome = 'error'").first()
    assert [(s.agent, s.status, s.reason) for s in failed.agent_trace] == [("ingestion", "failed", "malformed_email")]


def test_stream_dedupe(spark: SparkSession, tmp_path: Path) -> None:
    rows = spark.createDataFrame([("c", "m", "2024-01-01 00:00:00"), ("c", "m", "2024-01-02 00:00:00"), ("d", "m", "2024-01-01 00:00:00")], "client_id string, message_id string, received_at string")
    rows.withColumn("received_at", F.to_timestamp("received_at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming.deduplicated(streaming.message_stream(spark, str(tmp_path / "in"), "client_id string, message_id string, received_at timestamp"), ["client_id", "message_id"])
    query = stream.writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("deduped").count() == 2


def test_immutable_versions(spark: SparkSession, tmp_path: Path) -> None:
    packages.write_once(spark.range(1), str(tmp_path / "v"))
    with pytest.raises(Exception, match="already exists"):
        packages.write_once(spark.range(1), str(tmp_path / "v"))


def test_governance(spark: SparkSession, tmp_path: Path) -> None:
    root = write_package(tmp_path / "prod")
    before = governance.folder_hash(spark, root)
    packages.load_package(spark, root)
    assert governance.folder_hash(spark, root) == before
    assert governance.package_path("s3://r/", "c", "w", "1.0.0") == "s3://r/c/w@1.0.0"
    assert governance.stays_apart("/uat/x", "/prod") and not governance.stays_apart("/prod/x", "/prod")
    out = spark.createDataFrame([("r", "x"), ("s", None)], "run_id string, mapping string")
    assert governance.output_problems(out, {"mapping": "map<string,string>"}, "csv_parser") == ["agent_failed:csv_parser"]
    assert governance.output_problems(out, {"mapping": "string"}, "csv_parser") == []
    assert [r.run_id for r in governance.null_outputs(out, ["mapping"], "csv_parser").collect()] == ["s"]
    assert governance.bad_ends(spark.createDataFrame([("a", "failed"), ("b", "lost")], "run_id string, state string")).first().run_id == "b"


def test_corpus_folder(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "c/samples/s1").mkdir(parents=True)
    (tmp_path / "c/samples/s1/mail.eml").write_bytes(MAILS["good"])
    (tmp_path / "c/labels.jsonl").write_text(json.dumps({"sample_id": "s1", "email_type": "invoice", "in_scope": True, "fields": {"amount": "100"}, "field_sources": {"amount": "body:segment:0"}}))
    corpus = packages.load_corpus(spark, f"file://{tmp_path}/c")
    assert corpus["samples"].select("sample_id", "file").first() == ("s1", "mail.eml")
    bare = corpus["corpus"].first()
    assert (bare.id, bare.counted) == (None, 1)
    (tmp_path / "c/corpus.json").write_text('{"id": "acme-1", "client": "acme", "date": "2026-09-01", "sample_count": 1}')
    named = packages.load_corpus(spark, f"file://{tmp_path}/c")["corpus"].first()
    assert (named.id, str(named.date), named.sample_count, named.content_hash) == ("acme-1", "2026-09-01", 1, bare.content_hash)
    (tmp_path / "c/samples/s1/other.eml").write_bytes(b"x")
    assert packages.load_corpus(spark, f"file://{tmp_path}/c")["corpus"].first().content_hash != bare.content_hash
    assert corpus["label_fields"].select("field", "value", "source").first() == ("amount", "100", "body:segment:0")
