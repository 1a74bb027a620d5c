"""Messages and attachments: MIME, CSV, spreadsheets, documents and PDF text from binary files.

Bytes are opened in Python inside mapInArrow only, each kind on its own filtered branch, and every
parser answers with rows or a typed error, never with an exception: a code, whether another attempt may do
better, how many there were and how long they took. A parser that cannot read all of a file reads none of it.
"""

from __future__ import annotations

import csv
import email
import email.headerregistry
import email.policy
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta
from functools import lru_cache
from itertools import accumulate
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.scalars import REPEAT, magic_kind
from . import pdf
from .attempts import DEADLINE, MOST_MEMBER, MOST_RATIO, attempted

MESSAGE = "run_id string, message_id string, received_at string, subject string, body string, depth int, attachments array<struct<name:string,mime:string,content:binary>>, embedded array<binary>, error_code string"
ROWS = "run_id string, file string, sheet string, row_no int, cells map<string,string>, places map<string,string>, error_code string, is_transient boolean, attempts int, elapsed_ms bigint"
TEXTS = "run_id string, file string, page_no int, text string, path string, error_code string, is_transient boolean, attempts int, elapsed_ms bigint"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "content")


#: Headers up to so many characters are parsed once for all messages of a worker, the last so many of them.
_CACHED_CHARS, _CACHED_HEADERS = 500, 4_096
#: Rows that a worker takes and sends on at once.
_GIVEN_AT_ONCE, _ROWS_AT_ONCE = 256, 10_000


class _Headers(email.headerregistry.HeaderRegistry):
    """Parsed headers by name and value. They never change, and one part is asked for its type a dozen times."""

    def __init__(self) -> None:
        super().__init__()
        self._parsed = lru_cache(_CACHED_HEADERS)(super().__call__)
        self._class = lru_cache(_CACHED_HEADERS)(super().__getitem__)

    def __getitem__(self, name: str) -> type:
        return self._class(name.lower())

    def __call__(self, name: str, value: str) -> email.headerregistry.BaseHeader:
        return self._parsed(name, value) if len(value) <= _CACHED_CHARS else super().__call__(name, value)


_POLICY = email.policy.default.clone(header_factory=_Headers())


def _column(values: Sequence, kind: pa.DataType) -> pa.Array:
    """Values as an Arrow column; of maps, all keys and all items are converted at once."""
    if not pa.types.is_map(kind):
        return pa.array(values, kind)
    ends = [0, *accumulate(len(v or ()) for v in values)]
    keys = pa.array([k for v in values if v for k in v], kind.key_type)
    items = pa.array([x for v in values if v for x in v.values()], kind.item_type)
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), keys, items, type=kind, mask=pa.array([v is None for v in values], pa.bool_()))


def in_arrow(df: DataFrame, rows_of: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """The rows that rows_of gives for each row, in batches of bounded length."""
    wanted = to_arrow_schema(StructType.fromDDL(schema))
    names = wanted.names

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_column(values, f.type) for f, values in zip(wanted, zip(*rows, strict=True), strict=True)], schema=wanted)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            rows: list[list] = []
            for at in range(0, given.num_rows, _GIVEN_AT_ONCE):
                for row in given.slice(at, _GIVEN_AT_ONCE).to_pylist():
                    rows += [[r.get(name) for name in names] for r in rows_of(row)]
                while len(rows) >= _ROWS_AT_ONCE:
                    yield batch(rows[:_ROWS_AT_ONCE])
                    rows = rows[_ROWS_AT_ONCE:]
            if rows:
                yield batch(rows)

    return df.mapInArrow(fn, schema)


def parse_message(raw: bytes) -> dict:
    """Headers, text, attachments and embedded messages of one message; malformed_email if it has neither."""
    out = {"message_id": None, "received_at": None, "subject": None, "body": None, "attachments": [], "embedded": [], "error_code": None}
    try:
        message = email.message_from_bytes(raw, policy=_POLICY)
        if not message.keys() or (message.is_multipart() is False and message.get_content_maintype() == "multipart"):
            return out | {"error_code": "malformed_email"}
        out |= {"message_id": str(message["Message-ID"] or "").strip() or None, "received_at": str(message["Date"] or "") or None, "subject": str(message["Subject"] or "") or None}
        bodies = []

        def walk(part: email.message.EmailMessage) -> None:
            kind = part.get_content_type()
            if kind == "message/rfc822":
                inner = part.get_payload()
                if isinstance(inner, list) and inner:
                    out["embedded"].append(inner[0].as_bytes())
            elif part.is_multipart():
                for p in part.iter_parts():
                    walk(p)
            elif part.get_filename() or part.get_content_disposition() == "attachment":
                out["attachments"].append({"name": part.get_filename() or "attachment", "mime": kind, "content": part.get_payload(decode=True) or b""})
            elif kind == "text/plain":
                bodies.append(part.get_content())
            elif kind == "text/html" and not bodies:
                bodies.append(re.sub(r"<[^>]+>", " ", part.get_content()))

        walk(message)
        out["body"] = "\n".join(bodies)
    except (LookupError, ValueError, TypeError, AttributeError, KeyError):
        return out | {"error_code": "malformed_email"}
    return out


def ingest(files: DataFrame, id_column: str = "path") -> DataFrame:
    """files (path, content) as messages; a malformed one has only its error code."""
    depth = F.col("depth") if "depth" in files.columns else F.lit(0)
    given = files.select(F.col(id_column).cast("string").alias("run_id"), "content", depth.cast("int").alias("depth"))
    return in_arrow(given, lambda m: [{"run_id": m["run_id"], "depth": m["depth"]} | parse_message(m["content"])], MESSAGE)


def expand_embedded(messages: DataFrame, most_depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """All messages down to most_depth, and flags (run_id, code) of runs that go deeper.

    One pass for each level: the depth is checked before a level is opened. origin is the depth and the
    place of an embedded message, such as 2:0.1, and empty for the outer one.
    """
    level = found = messages.withColumn("origin", F.lit(""))
    for depth in range(1, most_depth + 1):
        each = level.select("run_id", "origin", F.posexplode("embedded").alias("place", "content"))
        above = F.concat(F.substring_index("origin", ":", -1), F.lit(".")) if depth > 1 else F.lit("")
        inner = each.select(F.concat("run_id", F.lit(f"\0{depth}:"), above, F.col("place").cast("string")).alias("id"), "content", F.lit(depth).alias("depth"))
        level = at_home(ingest(inner, "id")).select(*found.columns)
        found = found.unionByName(level)
    flags = level.where(F.size("embedded") > 0).select("run_id", F.lit("embedded_depth_exceeded").alias("code")).distinct()
    return found, flags


def away(messages: DataFrame) -> DataFrame:
    """Messages whose run_id holds their origin too, so that it passes through every parser."""
    return messages.withColumn("run_id", F.concat("run_id", F.lit("\0"), "origin"))


def at_home(rows: DataFrame) -> DataFrame:
    """Rows with run_id and origin apart again."""
    return rows.withColumns({"run_id": F.substring_index("run_id", "\0", 1), "origin": F.substring_index("run_id", "\0", -1)})


def attachments(messages: DataFrame) -> DataFrame:
    """run_id, name, mime, kind, encrypted, content: kind by the first bytes, never by the name."""
    each = messages.select("run_id", F.explode("attachments").alias("a")).select("run_id", "a.name", "a.mime", "a.content")
    inside = F.col("content").cast("string")
    kind = F.when(magic_kind(F.col("content")) == "zip", F.when(inside.contains("xl/workbook.xml"), "xlsx").when(inside.contains("word/document.xml"), "docx").otherwise("zip")).when(
        (magic_kind(F.col("content")) == "text") & (F.lower("name").endswith(".csv") | F.col("mime").isin("text/csv", "application/csv")), "csv"
    ).otherwise(magic_kind(F.col("content")))
    utf16 = F.col("content").cast("binary")
    locked = (F.col("kind").isin("zip", "xlsx", "docx") & (F.conv(F.hex(F.substring(utf16, 7, 1)), 16, 10).cast("int").bitwiseAND(F.lit(1)) == 1)) | ((F.col("kind") == "pdf") & inside.contains("/Encrypt")) | (
        (F.col("kind") == "ole") & F.hex("content").contains("45006E006300720079007000740065006400500061")
    )
    return each.withColumn("kind", kind).withColumn("encrypted", F.coalesce(locked, F.lit(False)))


def attachment_flags(files: DataFrame, supported: tuple[str, ...] = ("csv", "xlsx", "docx", "pdf")) -> DataFrame:
    """(run_id, code): encrypted_no_key, or unsupported_attachment with the mime type."""
    code = F.when(F.col("encrypted"), "encrypted_no_key").when(~F.col("kind").isin(*supported), F.concat(F.lit("unsupported_attachment:"), F.col("mime")))
    return files.select("run_id", code.alias("code")).where("code is not null")


def parse_with(files: DataFrame, parse: Callable[[str, bytes], list[dict]], schema: str, agent: str, most: int = 3, seconds: float = DEADLINE) -> DataFrame:
    """The rows that parse gives for each file (run_id, name, content), or one row with an error code; see attempted."""

    def rows_of(file: dict) -> list[dict]:
        name, content = file["name"], file["content"]
        found, code, transient, attempts, elapsed = attempted(lambda: parse(name, content), agent, name, most, seconds)
        call = {"run_id": file["run_id"], "file": name, "error_code": code, "is_transient": transient, "attempts": attempts, "elapsed_ms": elapsed}
        return [call | r for r in found] or [call]

    return in_arrow(files.select("run_id", "name", "content"), rows_of, schema)


def calls(parsed: DataFrame, agent: str) -> DataFrame:
    """(run_id, agent, file, code, is_transient, attempts, elapsed_ms): one row for each file that a parser was given."""
    return parsed.select("run_id", F.lit(agent).alias("agent"), "file", F.col("error_code").alias("code"), "is_transient", "attempts", "elapsed_ms").distinct()


def _decoded(content: bytes) -> str:
    """UTF-8, or else what Windows writes in the West; bytes that it has no letter for stand for themselves."""
    for name in ("utf-8-sig", "cp1252"):
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            pass
    return content.decode("latin-1")


def _delimiter(text: str) -> str:
    """The one that parts the first line in several cells and most other lines in as many; of equal ones the first."""
    first = next(csv.reader(io.StringIO(text[: text.find("\n") + 1] or text)), [])
    line = ",".join(first) if len(first) > 1 else text[: text.find("\n") + 1] or text
    able = [d for d in ",;\t|" if d in line]
    if len(able) < 2:
        return able[0] if able else ","

    def alike(d: str) -> int:
        widths = [len(row) for row in csv.reader(io.StringIO(text), delimiter=d) if row]
        return sum(w == widths[0] for w in widths) if widths and widths[0] > 1 else 0

    return max(able, key=alike)


def cell_names(head: list[str], width: int) -> list[str]:
    """The names of a line's cells: their headers; a repeated header and cells beyond the headers get numbered names (see scalars.plain_header)."""
    seen: dict[str, int] = {}
    names = []
    for k in range(width):
        name = head[k] if k < len(head) else f"column {k + 1}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}{REPEAT}{seen[name]}")
    return names


def named_cells(head: list[str], line: list[str]) -> dict[str, str]:
    """Cells by their names (see cell_names)."""
    return dict(zip(cell_names(head, len(line)), line, strict=True))


def _csv_rows(name: str, content: bytes) -> list[dict]:
    text = _decoded(content)
    if not text.strip() or "\0" in text:
        raise ValueError("no table")
    csv.field_size_limit(1 << 30)
    lines = csv.reader(io.StringIO(text, newline=""), delimiter=_delimiter(text), strict=False)
    head = [h.strip() for h in next(lines)]
    named: dict[int, tuple[list[str], list[str]]] = {}
    out = []
    for k, line in enumerate(lines, 2):
        if any(map(str.strip, line)):
            # Lines of one width have the same names.
            if len(line) not in named:
                names = cell_names(head, len(line))
                named[len(line)] = names, [f":{h.replace(REPEAT, '#')}" for h in names]
            names, shown = named[len(line)]
            row = f"row{k}"
            out.append({"sheet": None, "row_no": k, "cells": dict(zip(names, line, strict=True)), "places": {h: row + s for h, s in zip(names, shown, strict=True)}})
    return out


def _member(archive: zipfile.ZipFile, name: str) -> bytes:
    info = archive.getinfo(name)
    if info.file_size > MOST_MEMBER or info.file_size > MOST_RATIO * max(1, info.compress_size):
        raise ValueError("archive member too large")
    return archive.read(name)


def _xml(data: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in data[:2000] or b"<!ENTITY" in data:
        raise ValueError("entities are not read")
    return ElementTree.fromstring(data)


def _texts(node: ElementTree.Element) -> str:
    """The text of a string item, runs of rich text together, without phonetic hints."""
    hints = {t for x in node.iter() if x.tag.endswith("}rPh") for t in x.iter()}
    return "".join(t.text or "" for t in node.iter() if t.tag.endswith("}t") and t not in hints)


# Fixed values of the format: the numbers of built-in formats that are dates or times.
_DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))


#: Parts of a workbook up to so many bytes are read once for all workbooks of a worker that hold the same, the last so many of them.
_CACHED_PART, _CACHED_PARTS = 20_000, 256


def _by_part(read: Callable) -> Callable:
    """A function of a workbook's parts whose answers for small ones are remembered: workbooks of one program share them."""
    known = lru_cache(_CACHED_PARTS)(read)
    return lambda *parts: known(*parts) if sum(len(p or b"") for p in parts) <= _CACHED_PART else read(*parts)


@_by_part
def _date_styles(styles: bytes) -> tuple[bool, ...]:
    """Of each cell style, whether it shows a number as a date."""
    root = _xml(styles)
    own = {x.get("numFmtId"): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", x.get("formatCode", "")) for x in root.iter() if x.tag.endswith("}numFmt")}
    formats = next((x for x in root.iter() if x.tag.endswith("}cellXfs")), [])
    return tuple(bool(re.search(r"[ymdhs]", own[n], re.I)) if (n := x.get("numFmtId", "0")) in own else int(n) in _DATE_FORMATS for x in formats)


def _as_date(serial: str, base_1904: bool) -> str:
    """A serial number of days as ISO 8601; numbers before March 1900 count a day that never was."""
    days = float(serial)
    start = datetime(1904, 1, 1) if base_1904 else datetime(1899, 12, 30 if days >= 61 else 31)
    at = start + timedelta(seconds=round(days * 86_400))
    return at.date().isoformat() if days == int(days) else at.isoformat(sep=" ")


@_by_part
def _sheets(workbook: bytes, links: bytes | None) -> tuple[bool, tuple[tuple[str, str], ...]]:
    """Whether dates count from 1904, and (name, part) of each sheet by its relationship; where the file has none, by position."""
    root = _xml(workbook)
    base_1904 = any(x.tag.endswith("}workbookPr") and x.get("date1904") in ("1", "true") for x in root.iter())
    parts: dict[str, str] = {}
    for x in [] if links is None else _xml(links):
        target = x.get("Target", "")
        parts[x.get("Id", "")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
    found = []
    for k, x in enumerate((x for x in root.iter() if x.tag.endswith("}sheet")), 1):
        link = next((v for name, v in x.attrib.items() if name.endswith("}id")), None)
        found.append((x.get("name", ""), parts.get(link, "") if link is not None and parts else f"xl/worksheets/sheet{k}.xml"))
    return base_1904, tuple(found)


def _xlsx_rows(name: str, content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = archive.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [_texts(si) for si in _xml(_member(archive, "xl/sharedStrings.xml")) if si.tag.endswith("}si")]
        links = _member(archive, "xl/_rels/workbook.xml.rels") if "xl/_rels/workbook.xml.rels" in names else None
        base_1904, sheets = _sheets(_member(archive, "xl/workbook.xml"), links)
        dates = _date_styles(_member(archive, "xl/styles.xml")) if "xl/styles.xml" in names else ()
        out = []
        for sheet, part in sheets:
            if not part.startswith("xl/worksheets/"):
                continue  # a chart or dialog
            columns: list[str] = []
            head: list[str] = []
            for row in (r for r in _xml(_member(archive, part)).iter() if r.tag.endswith("}row")):
                values: dict[str, str] = {}
                for c in (c for c in row if c.tag.endswith("}c")):
                    kind, v = c.get("t"), next((x.text for x in c if x.tag.endswith("}v")), None)
                    inline = next((x for x in c if x.tag.endswith("}is")), None)
                    value = _texts(inline) if inline is not None else shared[int(v)] if kind == "s" and v is not None else v
                    style = int(c.get("s", "0"))
                    if value is not None and kind in (None, "n") and style < len(dates) and dates[style]:
                        value = _as_date(value, base_1904)
                    if value is not None:
                        values[re.sub(r"\d", "", c.get("r", ""))] = value
                if not head:
                    columns, head = list(values), [str(v).strip() for v in values.values()]
                elif values:
                    n = int(row.get("r", "0"))
                    beyond = [c for c in values if c not in columns]
                    labels = [*named_cells(head, head), *(f"column {c}" for c in beyond)]
                    placed = [(h, c) for h, c in zip(labels, [*columns, *beyond], strict=True) if c in values]
                    out.append({"sheet": sheet, "row_no": n, "cells": {h: values[c] for h, c in placed}, "places": {h: f"{c}{n}" for h, c in placed}})
    return out


def parse_csv(files: DataFrame) -> DataFrame:
    """Rows of CSV attachments, with the place of each cell."""
    return parse_with(files.where("kind = 'csv' and not encrypted"), _csv_rows, ROWS, "csv_parser")


def parse_xlsx(files: DataFrame) -> DataFrame:
    """Rows of spreadsheets: the first row of a sheet names its columns."""
    return parse_with(files.where("kind = 'xlsx' and not encrypted"), _xlsx_rows, ROWS, "spreadsheet_parser")


def _docx_text(name: str, content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = _xml(_member(archive, "word/document.xml"))
    lines = ["".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in root.iter() if p.tag.endswith("}p")]
    return [{"page_no": 1, "text": "\n".join(lines), "path": "docx"}]


def parse_docx(files: DataFrame) -> DataFrame:
    return parse_with(files.where("kind = 'docx' and not encrypted"), _docx_text, TEXTS, "doc_parser")


def parse_pdf(files: DataFrame) -> DataFrame:
    return parse_with(files.where("kind = 'pdf' and not encrypted"), pdf.pages, TEXTS, "pdf_parser")
