"""Queries of files, telemetry and deliveries over whole tables, each with the SQL that it must agree with."""

from __future__ import annotations

import io
import zipfile
from functools import lru_cache
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import kept, spread
from ..operators import detection, evaluation, extraction, history, monitoring
from ..sources import files
from .queries import _HIT, _LOCKED, KEYWORDS, _locked, _t, register

_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_LINKS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _packed(parts: dict[str, str], begun: bytes = b"") -> bytes:
    """An archive of these parts, after those of one that is begun."""
    out = io.BytesIO(begun)
    with zipfile.ZipFile(out, "a" if begun else "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


@lru_cache(1)
def _book() -> bytes:
    """What all workbooks share."""
    return _packed({
        "xl/workbook.xml": f'<workbook {_MAIN} {_LINKS}><sheets><sheet name="Bill" r:id="b"/><sheet name="Notes" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {_MAIN}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    })


def _row(n: int, *cells: tuple[str, str, str]) -> str:
    return f'<row r="{n}">' + "".join(f'<c r="{column}{n}" {kind}><v>{escape(value)}</v></c>' for column, kind, value in cells) + "</row>"


def _workbook(name: str, balance: str, nation: int) -> bytes:
    """Two sheets whose order in the workbook is not that of their files; a date by its style, a repeated header."""
    text = 't="str"'
    notes = _row(1, ("A", text, "Remark"), ("B", text, "Name")) + _row(2, ("A", text, name), ("B", text, name))
    bill = _row(1, ("A", text, "Amount due"), ("B", text, "Due"), ("C", text, "Amount due")) + _row(2, ("A", "", balance), ("B", 's="1"', str(45292 + nation)), ("C", "", "0.01"))
    sheets = {
        "xl/worksheets/sheet1.xml": f"<worksheet {_MAIN}><sheetData>{notes}</sheetData></worksheet>",
        "xl/worksheets/sheet2.xml": f"<worksheet {_MAIN}><sheetData>{bill}</sheetData></worksheet>",
    }
    return _packed(sheets, _book())


def _document(balance: str) -> bytes:
    return _packed({"word/document.xml": f'<w:document xmlns:w="w"><w:p><w:r><w:t>Amount</w:t></w:r><w:r><w:t> due: {escape(balance)}</w:t></w:r></w:p></w:document>'})


def _attached(customers: DataFrame) -> DataFrame:
    """A workbook and a document of each customer."""

    def made(c: dict) -> list[dict]:
        contents = {"bill.xlsx": _workbook(c["c_name"], c["balance"], c["nation"]), "letter.docx": _document(c["balance"])}
        return [{"run_id": c["run_id"], "attachments": [{"name": k, "mime": "application/octet-stream", "content": v} for k, v in contents.items()]}]

    balance = F.abs("c_acctbal").cast("decimal(18,2)").cast("string")
    given = customers.select(F.col("c_custkey").cast("string").alias("run_id"), "c_name", balance.alias("balance"), F.col("c_nationkey").cast("int").alias("nation"))
    return files.attachments(files.in_arrow(given, made, "run_id string, attachments array<struct<name:string,mime:string,content:binary>>"))


@register("""WITH c AS (SELECT c_custkey, CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS a, DATE '2024-01-01' + CAST(c_nationkey AS INTEGER) AS d FROM customer)
SELECT c_custkey, 'amount' AS field, CAST(a AS VARCHAR) AS value, 'attachment:bill.xlsx!Bill!A2' AS source, 'Bill' AS sheet FROM c UNION ALL SELECT c_custkey, 'amount', '0.01', 'attachment:bill.xlsx!Bill!C2', 'Bill' FROM c
UNION ALL SELECT c_custkey, 'due', strftime(d, '%Y-%m-%d'), 'attachment:bill.xlsx!Bill!B2', 'Bill' FROM c UNION ALL SELECT c_custkey, 'amount', CAST(a AS VARCHAR), 'attachment:letter.docx#p1', 'Bill' FROM c""")
def q_office_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from a workbook, by its chosen sheet, and a document of every customer (OP-004, 007, 104, 145, 147)."""
    attached = kept(_attached(spread(_t(spark, sf_dir, "customer"))), "attached")
    sheets, texts = kept(files.parse_xlsx(attached), "sheets"), kept(files.parse_docx(attached), "texts")
    fields = spark.sql("SELECT 'invoice' AS type, * FROM VALUES ('amount', 'decimal', 'amount due'), ('due', 'date', 'due') v(field, field_type, alias)")
    types = attached.select("run_id", F.lit("invoice").alias("type")).distinct()
    chosen = kept(extraction.choose_sheet(sheets, fields), "chosen")
    rows = extraction.extract_rows(sheets.join(chosen.select("run_id", "file", "sheet"), ["run_id", "file", "sheet"], "left_semi"), types, fields, "spreadsheet_parser")
    found = rows.unionByName(extraction.extract_texts(texts, types, fields, "doc_parser"))
    return found.join(chosen.select("run_id", "sheet"), "run_id").select(F.col("run_id").cast("long").alias("c_custkey"), "field", F.col("value_norm").alias("value"), "source", "sheet")


@register("SELECT event_type AS client_id, count(*) AS n, true AS p50_near, true AS p95_near FROM events GROUP BY 1")
def q_latency_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles merged from the sketches of each hour, held against the exact ranks of all rows (OP-084)."""
    events = _t(spark, sf_dir, "events")
    sketches = kept(monitoring.latency_sketches(events, "value", "ts", "event_type"), "sketches")
    merged = kept(monitoring.merged_latency(sketches, "client_id"), "merged")
    ranks = events.join(merged, F.col("event_type") == F.col("client_id")).groupBy("client_id", "n").agg(
        *[F.count_if(F.col("value") < F.col(p)).alias(f"{p}_below") for p in ("p50", "p95")], *[F.count_if(F.col("value") <= F.col(p)).alias(f"{p}_upto") for p in ("p50", "p95")]
    )
    # Equal values share ranks: the wanted rank lies between the rows below the value and those up to it.
    near = lambda p, q: ((F.col(f"{p}_below") / F.col("n") <= q + monitoring.RANK_ERROR) & (F.col(f"{p}_upto") / F.col("n") >= q - monitoring.RANK_ERROR)).alias(f"{p}_near")
    return ranks.select("client_id", "n", near("p50", 0.5), near("p95", 0.95))


_ACTIVATED = "(VALUES ('click', '1.0.0', TIMESTAMP '2024-01-03 00:00:00'), ('click', '1.1.0', TIMESTAMP '2024-01-10 12:00:00'), ('view', '2.0.0', TIMESTAMP '2024-01-01 00:00:00'), ('view', '2.0.1', TIMESTAMP '2024-01-21 06:30:00'), ('signup', '1.0.0', TIMESTAMP '2024-01-15 00:00:00')) a(workflow_id, version, activated_at)"


@register(f"""SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS workflow_id, a.version AS package_version, CASE WHEN a.version IS NULL THEN 'package_unresolved' END AS error
FROM events e ASOF LEFT JOIN {_ACTIVATED} ON e.event_type = a.workflow_id AND e.ts >= a.activated_at""")
def q_resolved_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The package of each event's route that was active when it came, or package_unresolved (OP-011, 049, 102)."""
    events = _t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("route"), F.col("ts").cast("timestamp").alias("received_at"))
    routes = events.where("route <> 'error'").select("route", F.lit("c").alias("client_id"), F.col("route").alias("workflow_id")).distinct()
    active = spark.sql(f"SELECT 'c' AS client_id, workflow_id, version, activated_at FROM {_ACTIVATED}")
    return history.resolve_packages(events, routes, active).select("event_id", "workflow_id", "package_version", "error")


@register("SELECT event_id, event_type AS skill_id, CASE WHEN value < 50 THEN 'read' ELSE 'write' END AS tool FROM events WHERE value IS NOT NULL AND NOT (value < 50 OR event_type IN ('click', 'view'))")
def q_tool_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of tools that a skill's manifest does not list (OP-057)."""
    calls = _t(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", F.col("event_type").alias("skill_id"), F.lit("agent").alias("agent"), F.when(F.col("value") < 50, "read").otherwise("write").alias("tool"))
    skills = calls.select("skill_id").distinct()
    tools = skills.select("skill_id", F.lit("read").alias("tool")).unionByName(skills.where("skill_id IN ('click', 'view')").select("skill_id", F.lit("write").alias("tool")))
    return history.binding_violations(calls, skills.select("skill_id", F.lit("agent").alias("agent")), tools).select("event_id", "skill_id", "tool")


@register("SELECT o_orderpriority AS client_id, count(*) AS waiting, CAST(epoch(TIMESTAMP '2030-01-01 00:00:00') - epoch(CAST(min(o_orderdate) AS TIMESTAMP)) AS BIGINT) AS oldest_s FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1")
def q_queue_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that nothing has started on, and how long the first waits (OP-123)."""
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("client_id"), F.col("o_orderdate").alias("received_at"))
    started = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"))
    return monitoring.queue_lag(orders, started, F.lit("2030-01-01 00:00:00").cast("timestamp"))


#: A client's own weights beside the default's.
_OWN = [(kind, term, weight + 0.15) for kind, term, weight in KEYWORDS]
_LOCKED_OWN = _LOCKED.replace(_HIT, " + ".join("CASE WHEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}])' || '{0}' || '([^\\p{{L}}\\p{{N}}]|$)') AND type = '{1}' THEN {2} ELSE 0 END".format(w, k, round(s, 4)) for k, w, s in _OWN))


@register(f"""WITH a AS ({_LOCKED}), b AS ({_LOCKED_OWN}), j AS (SELECT 'detect_' || a.lang AS skill_id, a.doc_id, coalesce(a.type = a.lang, false) AS was, coalesce(b.type = b.lang, false) AS now FROM a JOIN b ON a.doc_id = b.doc_id WHERE a.lang IS NOT NULL)
SELECT skill_id, count(*) AS n, round(avg(CASE WHEN was THEN 1.0 ELSE 0.0 END), 9) AS before, round(avg(CASE WHEN now THEN 1.0 ELSE 0.0 END), 9) AS after, count(*) FILTER (WHERE NOT was AND now) AS fixed, count(*) FILTER (WHERE was AND NOT now) AS broken,
coalesce(array_to_string((list(doc_id ORDER BY doc_id) FILTER (WHERE NOT was AND now))[1:3], ','), '') AS cases, avg(CASE WHEN now THEN 1.0 ELSE 0.0 END) > avg(CASE WHEN was THEN 1.0 ELSE 0.0 END) AS proposed FROM j GROUP BY 1""")
def q_skill_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client's variant of each detection skill, before and after, with the errors that it mends (the skill author's proposal)."""
    documents = spread(_t(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    limits = spark.sql("SELECT type, CAST(0.6 AS DECIMAL(5,4)) AS threshold FROM VALUES ('en'), ('fr'), ('de'), ('es') v(type)")
    own = detection.lock_type(detection.score_types(documents, _OWN, [], key="doc_id"), limits, "doc_id")
    scored = lambda locked: documents.where("lang IS NOT NULL").join(locked, "doc_id").select(F.concat(F.lit("detect_"), "lang").alias("skill_id"), F.col("doc_id").alias("sample_id"), (F.col("type") == F.col("lang")).alias("correct"))
    found = evaluation.skill_variants(scored(_locked(spark, sf_dir)), scored(own))
    rate = {c: F.round(c, 9) for c in ("before", "after")}
    return found.withColumns(rate | {"cases": F.array_join(F.transform("cases", lambda x: x.cast("string")), ",")})
