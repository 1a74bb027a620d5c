"""Parsers lose nothing without a word, and fail with a type; what the run plan records of them."""

from __future__ import annotations

import email.headerregistry
import io
import time
import zipfile
import zlib
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from test_engine import docx, mail, write_package, xlsx

from sluiceway.functions import scalars
from sluiceway.functions.scalars import REPEAT
from sluiceway.operators import extraction, history
from sluiceway.plans.queries import QUERIES
from sluiceway.plans.runs import process, replayed_stages
from sluiceway.sources import files, packages, pdf
from sluiceway.sources.attempts import TransientError, attempted


def test_attempts() -> None:
    tries = iter([TransientError("busy"), TransientError("busy"), [{"x": 1}]])

    def flaky() -> list[dict]:
        x = next(tries)
        if isinstance(x, Exception):
            raise x
        return x

    waits: list[float] = []
    assert attempted(flaky, "csv_parser", "a.csv", wait=waits.append)[:4] == ([{"x": 1}], None, None, 3) and waits == [0.1, 0.2]

    def busy() -> list[dict]:
        raise TransientError

    assert attempted(busy, "csv_parser", "a.csv", wait=waits.append)[:4] == ([], "attachment_parse_failed:a.csv", True, 3)
    assert attempted(lambda: 1 / 0, "csv_parser", "a.csv")[:4] == ([], "attachment_parse_failed:a.csv", False, 1)
    rows, code, transient, attempts, elapsed = attempted(lambda: time.sleep(5), "csv_parser", "a.csv", seconds=0.2)
    assert (rows, code, transient, attempts) == ([], "agent_timeout:csv_parser", True, 1) and 150 <= elapsed < 3000


def test_a_stalled_parser_is_told_from_a_broken_one(spark: SparkSession) -> None:
    given = spark.createDataFrame([("r", "good", b"1"), ("r", "stalled", b"2"), ("s", "broken", b"3"), ("s", "busy", b"4"), ("t", "none", b"5")], "run_id string, name string, content binary")

    def parse(name: str, content: bytes) -> list[dict]:
        if name == "stalled":
            while True:
                time.sleep(0.01)
        if name == "broken":
            raise ValueError(name)
        if name == "busy":
            raise TransientError
        return [{"page_no": 1, "text": content.decode(), "path": "x"}] * (name == "good")

    parsed = files.parse_with(given, parse, files.TEXTS, "doc_parser", seconds=0.3)
    found = {r.file: (r.code, r.is_transient, r.attempts) for r in files.calls(parsed, "doc_parser").collect()}
    assert found == {"good": (None, None, 1), "stalled": ("agent_timeout:doc_parser", True, 1), "broken": ("attachment_parse_failed:broken", False, 1), "busy": ("attachment_parse_failed:busy", True, 3), "none": (None, None, 1)}


@pytest.mark.parametrize(
    ("content", "cells"),
    [
        (b"item,amount,amount\nx,1,2\n", [{"item": "x", "amount": "1", f"amount{REPEAT}2": "2"}]),
        (b"item,amount\nx,1,extra,more\ny\n", [{"item": "x", "amount": "1", "column 3": "extra", "column 4": "more"}, {"item": "y"}]),
        ("stück;preis\nä;1,50\nö;2,50\n".encode("cp1252"), [{"stück": "ä", "preis": "1,50"}, {"stück": "ö", "preis": "2,50"}]),
        (b"a;b,c\n1;2\n3;4\n", [{"a": "1", "b,c": "2"}, {"a": "3", "b,c": "4"}]),
        (b'a\tb\n"x\ty"\t"line\nbreak"\n', [{"a": "x\ty", "b": "line\nbreak"}]),
        (b"only\nx\n", [{"only": "x"}]),
        (b"\xef\xbb\xbfa|b\n1|2", [{"a": "1", "b": "2"}]),
        (b"a,b\n" + b"1,2\n" * 20_000 + b"3,4\n", None),
    ],
)
def test_csv_keeps_every_cell(content: bytes, cells: list[dict] | None) -> None:
    found = files._csv_rows("x.csv", content)
    assert len(found) == 20_001 if cells is None else [r["cells"] for r in found] == cells


def book(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_rels/", "_rels/"), text)
    return out.getvalue()


def test_xlsx_by_relationship_with_dates_and_rich_text() -> None:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Second" r:id="rId2"/><sheet name="First" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet9.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.00&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><r><t>Due</t></r><r><t> date</t></r><rPh><t>hint</t></rPh></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><r><t>To</t></r><r><t>tal</t></r></is></c><c r="D1" t="str"><v>Total</v></c></row><row r="2"><c r="A2" s="1"><v>45413</v></c><c r="B2" s="3"><v>45413</v></c><c r="C2"><v>7</v></c><c r="D2" s="2"><v>45413.5</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet9.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="str"><v>x</v></c></row><row r="2"><c r="A2" t="str"><v>y</v></c></row></sheetData></worksheet>')
    found = {r["sheet"]: r for r in files._xlsx_rows("b.xlsx", out.getvalue())}
    assert found["Second"]["cells"] == {"x": "y"}
    assert found["First"]["cells"] == {"Due date": "2024-05-01", "Total": "45413", f"Total{REPEAT}2": "2024-05-01 12:00:00", "column C": "7"}
    assert found["First"]["places"] == {"Due date": "A2", "Total": "B2", f"Total{REPEAT}2": "D2", "column C": "C2"}


def stream(data: bytes, attributes: bytes = b"") -> bytes:
    return b"1 0 obj <<" + attributes + b">>\nstream\n" + data + b"\nendstream\nendobj\n"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (stream(b"BT <546F74616C3A2035> Tj ET"), "Total: 5"),
        (stream(b"BT (a\\(b\\) (nested) \\101\\n) Tj [(x) -20 (y)] TJ ET"), "a(b) (nested) A\n xy"),
        (stream(zlib.compress(b"BT 0 0 Td (deflated) Tj 0 -5 Td (line) Tj ET"), b"/Filter /FlateDecode"), "deflated\nline"),
        (stream(b"42540A2868657829 20546A0A4554>", b"/Filter [/ASCIIHexDecode]"), "hex"),
        (stream(b"q BI /W 1 ID \x00(junk EI Q BT (after) Tj ET"), "after"),
        (stream(b"\xff\xd8 picture", b"/Subtype /Image /Filter /DCTDecode") + stream(b"BT (beside) Tj ET"), "beside"),
        (stream(b"BT (one) Tj ET") + stream(b"BT (two) Tj ET"), "one|two"),
    ],
)
def test_pdf_text(body: bytes, text: str) -> None:
    assert "|".join(r["text"] for r in pdf.pages("a.pdf", b"%PDF-1.4\n" + body)) == text


@pytest.mark.parametrize("body", [stream(b"x", b"/Filter /LZWDecode") + stream(b"BT (seen) Tj ET"), stream(b"BT (open Tj ET"), stream(b"BT <0041> Tj ET") + b"<< /Subtype /Type0 >>", stream(b"q Q"), stream(zlib.compress(b"BT (x) Tj ET")[:-9] + b"!" * 9, b"/Filter /FlateDecode"), stream(b"BT (x) Tj ET", b"/Filter /FlateDecode /DecodeParms << /Predictor 12 >>"), b"stream\nBT (x) Tj"])
def test_pdf_that_is_not_read_whole_fails(body: bytes) -> None:
    rows, code, transient, *_ = attempted(lambda: pdf.pages("a.pdf", b"%PDF-1.4\n" + body), "pdf_parser", "a.pdf")
    assert (rows, code, transient) == ([], "attachment_parse_failed:a.pdf", False)


def two_sheets() -> bytes:
    one, ns = zipfile.ZipFile(io.BytesIO(xlsx([["Remark", "Note"], ["x", "y"]]))), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Notes"/><sheet name="Lines"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", one.read("xl/worksheets/sheet1.xml"))
        z.writestr("xl/worksheets/sheet2.xml", zipfile.ZipFile(io.BytesIO(xlsx([["Total", "Due", "Total"], ["12.00", "2024-05-01", "12.40"]]))).read("xl/worksheets/sheet1.xml"))
    return out.getvalue()


def test_what_a_run_records(spark: SparkSession, tmp_path: Path) -> None:
    mails = {
        "book": mail("An invoice\nTotal: 11.90\nDue: 2024-05-01\n", ("b.xlsx", "application/x", two_sheets())),
        "no_sheet": mail("An invoice\nTotal: 7\nDue: 2024-05-01\n", ("n.xlsx", "application/x", xlsx([["Remark"], ["x"]]))),
        "half": mail("An invoice\nTotal: 7\nDue: 2024-05-01\n", ("h.csv", "text/csv", b"total,due\n7,\n,\n,2024-05-01\n"), ("p.pdf", "application/pdf", b"%PDF-1.4\n" + stream(b"BT (Total: 7) Tj ET") + stream(b"x", b"/Filter /LZWDecode"))),
        "later": mail("An invoice\nTotal: 7\nDue: 2024-05-01\n", ("d.docx", "application/x", docx("This statement of account", "Total: 7"))),
    }
    package = packages.load_package(spark, write_package(tmp_path / "p", accept=0.5))
    package["keywords"] = package["keywords"].unionByName(spark.createDataFrame([("statement", "statement", 0.9)], package["keywords"].schema))
    package["types"] = package["types"].unionByName(spark.sql("SELECT 'statement' AS type, CAST(0.6 AS DECIMAL(5,4)) AS threshold"))
    messages = files.ingest(spark.createDataFrame(list(mails.items()), "path string, content binary"))
    once = process(messages, package, "acme", "invoices", "1.0.0")
    done = {r.run_id: r for r in once.collect()}
    assert [(s.file, s.sheet, s.reason) for s in done["book"].chosen_sheets] == [("b.xlsx", "Lines", "3 headers mean a field")]
    # Both cells under the repeated header are candidates; the body's amount lost against the surer cell.
    assert {(c.winner.value, c.loser.value, c.rule) for c in done["book"].conflicts} == {("12.00", "12.40", "recency"), ("12.00", "11.90", "confidence")}
    assert done["no_sheet"].reasons == ["attachment_parse_failed:n.xlsx"]
    assert done["half"].reasons == ["attachment_parse_failed:p.pdf"]
    sure = {f.field: float(f.triple.confidence) for f in done["half"].fields}
    assert sure["amount"] == 0.855 and sure["due_date"] == 0.855  # 0.9 for the parser, columns of which half is filled
    assert done["later"].reasons == ["classification_ambiguous"] and done["later"].type == "invoice"
    parsing = {s.agent: s.duration_ms for s in done["book"].agent_trace}
    assert parsing["attachment_parsers"] is not None and parsing["merge"] is None
    # A replay with another alias first differs where tables are read, and nowhere in runs without one.
    aliases = package["aliases"].where("alias <> 'due'").unionByName(spark.createDataFrame([("invoice", "due_date", "remark")], package["aliases"].schema))
    other = process(messages, package | {"aliases": aliases}, "acme", "invoices", "1.0.0")
    apart = {r.run_id: (r.stage_no, r.agent) for r in history.first_divergence(replayed_stages(once), replayed_stages(other)).collect()}
    assert apart["book"] == (3, "attachment_parsers") and set(apart.values()) == {(3, "attachment_parsers")}
    assert history.first_divergence(replayed_stages(once), replayed_stages(once)).isEmpty()


def test_headers_are_parsed_once_for_many_messages(monkeypatch: pytest.MonkeyPatch) -> None:
    """A header that messages share is not parsed again for each message and each question (F1 to F3)."""
    parsed, parse = [], email.headerregistry.ContentTypeHeader.parse.__func__
    monkeypatch.setattr(email.headerregistry.ContentTypeHeader, "parse", classmethod(lambda cls, value, kwds: (parsed.append(value), parse(cls, value, kwds))[1]))
    raw = lambda k: f"Message-ID: <{k}@x>\r\nContent-Type: multipart/mixed; boundary=bb\r\n\r\n--bb\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nn {k}\r\n--bb\r\nContent-Type: text/x-a; name=f{k}\r\n\r\n{k}\r\n--bb--\r\n".encode()
    found = [files.parse_message(raw(k)) for k in range(50)]
    assert [(m["message_id"], m["body"].strip(), m["attachments"][0]["name"]) for m in found] == [(f"<{k}@x>", f"n {k}", f"f{k}") for k in range(50)]
    assert len(parsed) <= 60


@pytest.mark.parametrize("name", ["q_messages", "q_messages_all", "q_embedded_documents"])
def test_messages_are_parsed_by_all_cores(spark: SparkSession, sf: str, name: str) -> None:
    """A table in one file makes messages in as many tasks as there are cores (F1 to F3)."""
    assert len([f for f in QUERIES[name](spark, sf).inputFiles() if f"{sf}/" not in f]) >= spark.sparkContext.defaultParallelism


def test_parsers_answer_null_content_and_many_rows(spark: SparkSession) -> None:
    given = spark.createDataFrame([("none", None), ("long", b"Message-ID: <a@x>\r\n\r\nhi")], "path string, content binary")
    assert {r.run_id: r.error_code for r in files.ingest(given).collect()} == {"none": "malformed_email", "long": None}
    table = ("a,b\n" + "1,2\n" * 25_000).encode()
    rows = files.parse_csv(spark.createDataFrame([("r", "t.csv", table, "csv", False), ("n", "t.csv", None, "csv", False)], "run_id string, name string, content binary, kind string, encrypted boolean"))
    assert [tuple(x) for x in rows.groupBy("run_id", "error_code").agg(F.count("*"), F.max("row_no")).orderBy("run_id").collect()] == [("n", "attachment_parse_failed:t.csv", 1, None), ("r", None, 25_000, 25_001)]


def test_rows_are_dealt_by_run_once(spark: SparkSession) -> None:
    """Cells that mean nothing stay in their task, rows without any still count for their column, and both counts need one shuffle (F5, F7)."""
    rows = spark.createDataFrame(
        [("1", "a.csv", None, k, {"Total": v, "Note": "n"}, {"Total": f"row{k}:Total", "Note": f"row{k}:Note"}, None) for k, v in ((2, "5.00"), (3, " "))] + [("1", "a.csv", None, 4, {"Note": "n"}, {"Note": "row4:Note"}, None)],
        "run_id string, file string, sheet string, row_no int, cells map<string,string>, places map<string,string>, error_code string",
    )
    types = spark.createDataFrame([("1", "invoice")], "run_id string, type string")
    fields = spark.createDataFrame([("invoice", "amount", "decimal", "total"), ("invoice", "net", "decimal", "Net")], "type string, field string, field_type string, alias string")
    found = extraction.extract_rows(rows, types, fields, "csv_parser")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(run_id") == 2
    sure = spark.range(1).select((F.lit(0.9).cast("decimal(5,4)") * scalars.mapping_confidence(F.lit("total"), F.lit("total"), F.lit(1), F.lit(3))).cast("decimal(5,4)")).first()[0]
    assert [(r.field, r.value_raw, r.source, r.confidence) for r in found.collect()] == [("amount", "5.00", "attachment:a.csv#row2:Total", sure)]


def test_labels_of_cells_are_found_once(spark: SparkSession, sf: str) -> None:
    """Where no count of rows is asked for, Spark tested before the shuffle that a row has a cell of a field, and found all labels twice more for that."""
    plan = QUERIES["q_table_candidates"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(map_entries(cells") == 1


def test_blank_and_missing_cells_are_no_candidates(spark: SparkSession) -> None:
    cells = [{"Total": "1.00"}, {"Total": None}, {"Total": " "}, {}, None, {"Note": "n"}, {"Total": "2.00", f"Total{REPEAT}2": "3.00"}]
    rows = spark.createDataFrame([("1", "a.csv", None, k, c, {h: f"row{k}:{h}" for h in c or ()}, None) for k, c in enumerate(cells, 2)], files.ROWS.partition(", is_transient")[0])
    types = spark.createDataFrame([("1", "invoice")], "run_id string, type string")
    fields = spark.createDataFrame([("invoice", "amount", "decimal", "total")], "type string, field string, field_type string, alias string")
    found = extraction.extract_rows(rows, types, fields, "csv_parser")
    sure = [spark.range(1).select((F.lit(0.9).cast("decimal(5,4)") * scalars.mapping_confidence(F.lit("total"), F.lit("total"), F.lit(n), F.lit(6))).cast("decimal(5,4)")).first()[0] for n in (2, 1)]
    assert sorted((r.value_raw, r.confidence) for r in found.collect()) == [("1.00", sure[0]), ("2.00", sure[0]), ("3.00", sure[1])]
    assert sorted(r.value_raw for r in found.select("value_raw").collect()) == ["1.00", "2.00", "3.00"]


def test_cells_are_named_once_for_lines_of_one_width(monkeypatch: pytest.MonkeyPatch) -> None:
    """Every line's names, and the text of their places, were made anew."""
    named, plain = [], files.cell_names
    monkeypatch.setattr(files, "cell_names", lambda head, width: named.append(width) or plain(head, width))
    found = files._csv_rows("x.csv", b"a,a,b\n" + b"1,2,3\n" * 50 + b"4\n5,6,7,8\n")
    assert sorted(named) == [1, 3, 4]
    assert found[0] == {"sheet": None, "row_no": 2, "cells": {"a": "1", f"a{REPEAT}2": "2", "b": "3"}, "places": {"a": "row2:a", f"a{REPEAT}2": "row2:a#2", "b": "row2:b"}}
    assert [r["cells"] for r in found[50:]] == [{"a": "4"}, {"a": "5", f"a{REPEAT}2": "6", "b": "7", "column 4": "8"}]


def test_maps_of_rows_may_be_empty_or_missing(spark: SparkSession) -> None:
    kinds = {"full": {"cells": {"a": "1", "b": None}}, "empty": {"cells": {}}, "null": {"cells": None}, "absent": {}}
    given = spark.createDataFrame([(k,) for k in kinds], "kind string").coalesce(1)
    found = files.in_arrow(given, lambda r: [{"kind": r["kind"]} | kinds[r["kind"]]], "kind string, cells map<string,string>")
    assert {r.kind: r.cells for r in found.collect()} == {"full": {"a": "1", "b": None}, "empty": {}, "null": None, "absent": None}
