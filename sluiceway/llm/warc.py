"""WARC archives as a chunked record table.

An archive is a table of (archive, record, chunk, last, data, digest) rows: the data of its rows in order
is the archive file. Payloads larger than a chunk take several rows, each with the digest of the record
so far, so a reader or writer holds one chunk and a digest state and never a whole record. Repeated
payloads are written once, as the response with the largest page_id; the others are revisit records.
`read_files` streams .warc and .warc.gz files into such a table, `write_files` makes files of one.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 64 * 1024
DATE = "2024-01-01T00:00:00Z"
#: What begins a record after a line break.
VERSION = b"\nWARC/1."
CHUNKS = "archive long, record long, chunk int, last boolean, data binary, digest string"
RECORDS = "page_id long, record_type string, refers_to long, target string, payload_bytes long, payload_digest string, digest_good boolean, whole boolean"
#: Fields of a record head that are read; of other lines only so many bytes are held.
FIELDS = ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-payload-digest", "content-type", "content-length")
LINE = 8192
#: Bytes that a line of these fields and a record's head may have; a record with more is read on, but is not whole.
MOST_LINE, MOST_HEAD = 1 << 20, 4 << 20


def with_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, html and refers_to: the largest page_id with the same payload of at least min_bytes, else null.

    A null html is empty; a null page_id is dropped. Rows with the largest page_id of their payload are
    responses, all of them if they repeat. Payloads are told apart by SHA-1 and length.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).where("page_id is not null")
    facts = rows.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("size")).where(F.col("size") >= min_bytes)
    owners = facts.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    revisits = facts.join(owners, ["digest", "size"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    return rows.withColumn("digest", F.sha1("html")).join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")


def _head(page: int, url: str | None, digest: bytes, size: int, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    target = re.sub(r"\s", "%20", url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {target}"] if target else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (size if refers_to is None else 0)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes pages (page_id, url, html, refers_to) as the chunked record table at this path."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, record = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for page, url, cell, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                # The cell's own bytes, without a copy.
                payload = memoryview(cell.as_buffer()) if cell.as_buffer() is not None else memoryview(b"")
                head = _head(page, url, hashlib.sha1(payload).digest(), len(payload), refers_to)
                body = payload if refers_to is None else payload[:0]
                state, chunk, at = hashlib.sha1(), 0, 0
                while True:
                    piece = bytes(body[at : at + CHUNK])
                    at += len(piece)
                    last = at >= len(body)
                    data = (head if chunk == 0 else b"") + piece + (b"\r\n\r\n" if last else b"")
                    state.update(data)
                    held.append((archive, record, chunk, last, data, state.hexdigest()))
                    size += len(data)
                    chunk += 1
                    if size > 8_000_000:
                        yield _chunk_batch(held)
                        held, size = [], 0
                    if last:
                        break
                record += 1
        if held:
            yield _chunk_batch(held)

    pages.select("page_id", "url", "html", "refers_to").mapInArrow(fn, CHUNKS).write.option("compression", "zstd").parquet(path)


def _chunk_batch(held: list[tuple]) -> pa.RecordBatch:
    columns = zip(*held, strict=True)
    types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["archive", "record", "chunk", "last", "data", "digest"])


class Lines:
    """Cuts chunks into lines; it holds MOST_LINE bytes of a wanted line and LINE bytes of any other. cut: a wanted line had more."""

    def __init__(self) -> None:
        self.held, self.cut = bytearray(), False

    def next(self, data: bytes, at: int, wanted: bool) -> tuple[bytes | None, int]:
        """The line that ends in data from `at` on, without its line break, and where the next begins; None if it goes on."""
        end = data.find(b"\n", at)
        stop = len(data) if end < 0 else end
        named = wanted and _wanted(bytes(self.held[:64]) + data[at : at + 64])
        room = max(0, (MOST_LINE if named else LINE) - len(self.held))
        self.cut |= named and stop - at > room
        self.held += data[at : min(stop, at + room)]
        if end < 0:
            return None, len(data)
        line, self.held = bytes(self.held).removesuffix(b"\r"), bytearray()
        return line, end + 1


def _wanted(line: bytes) -> bool:
    return line[:64].lower().startswith(tuple(f.encode() for f in FIELDS))


def _digest(stated: str) -> str | None:
    """The hexadecimal form of a stated SHA-1, in base 32 or 16; None if it is none."""
    value = stated.strip().partition(":")[2] if ":" in stated else stated.strip()
    if re.fullmatch(r"[0-9a-fA-F]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch(r"[A-Za-z2-7]{32}", value) else None


class RecordReader:
    """Reads one record from its chunks; holds the fields it needs, a part of a line and digest states only."""

    def __init__(self) -> None:
        self.state = "version"  # then fields, http (the head of the response), body and what follows it
        self.lines = Lines()
        self.fields: dict[str, str] = {}
        self.payload, self.all = hashlib.sha1(), hashlib.sha1()
        self.left = self.size = 0
        self.tail = b""
        self.good = True
        self.next = 0

    def feed(self, chunk: int, data: bytes, digest: str) -> None:
        self.all.update(data)
        self.good &= chunk == self.next and self.all.hexdigest() == digest
        self.next += 1
        at = 0
        while at < len(data) and self.state != "body":
            begin = at
            line, at = self.lines.next(data, at, self.state == "fields")
            if self.state == "http":
                self.left -= at - begin
            if line is not None:
                self._line(line)
        body = data[at : at + max(0, self.left)] if self.state == "body" else b""
        self.payload.update(body)
        self.size += len(body)
        self.left -= len(body)
        self.tail += data[at + len(body) :][:8] if self.state == "body" and len(self.tail) < 8 else b""

    def _line(self, line: bytes) -> None:
        if self.state == "version":
            self.good &= line.startswith(b"WARC/1.")
            self.state = "fields"
        elif line:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            if self.state == "fields" and name.strip().lower() in FIELDS:
                self.fields.setdefault(name.strip().lower(), value.strip())
        elif self.state == "http":
            self.state = "body"
        else:
            length = self.fields.get("content-length", "")
            self.good &= length.isdigit()
            self.left = int(length) if length.isdigit() else 0
            self.state = "http" if self.fields.get("content-type", "").lower().startswith("application/http") else "body"

    def row(self) -> tuple:
        page = _page(self.fields.get("warc-record-id"))
        kind, refers_to = self.fields.get("warc-type"), _page(self.fields.get("warc-refers-to"))
        stated = self.fields.get("warc-payload-digest", "")
        digest = self.payload.hexdigest() if kind != "revisit" else _digest(stated)
        # A revisit has no payload of its own; resolve_revisits holds its digest against the response's.
        good = digest is not None and (kind == "revisit" or digest == _digest(stated))
        whole = self.state == "body" and self.left == 0 and self.tail in (b"\r\n\r\n", b"\n\n") and self.good and not self.lines.cut
        return page, kind, refers_to, self.fields.get("warc-target-uri"), self.size if kind != "revisit" else None, digest, good, whole


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def read_records(chunks: DataFrame) -> DataFrame:
    """One row for each record of a chunked record table, its payload digested chunk by chunk.

    Only records of several chunks are shuffled, to bring their chunks together in order; a chunk
    numbered 0 begins a record.
    whole: the record ends where its head says and every chunk's running digest holds; a chunk that is
    missing, damaged or null makes its record not whole and no other. digest_good: the payload has the
    digest that the head states, in base 32 or 16. A revisit has the digest that its head states (null
    and not good if that is none) and no payload_bytes (see resolve_revisits). Records whose id is not a
    page's have a null page_id. An empty table has no records; other columns are ignored.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
        names = ["page_id", "record_type", "refers_to", "target", "payload_bytes", "payload_digest", "digest_good", "whole"]
        now, reader, done = None, RecordReader(), []

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

        for batch in batches:
            for archive, record, chunk, data, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4), batch.column(5).to_pylist(), strict=True):
                if (archive, record) != now or chunk == 0:
                    if now is not None:
                        done.append(reader.row())
                    now, reader = (archive, record), RecordReader()
                reader.feed(chunk, data.as_py() or b"", digest)
                if len(done) >= 5000:
                    yield out()
                    done = []
        if now is not None:
            done.append(reader.row())
        if done:
            yield out()

    chunks = chunks.select("archive", "record", "chunk", "last", "data", "digest")
    alone = F.coalesce((F.col("chunk") == 0) & F.col("last"), F.lit(False))
    dealt = chunks.where(~alone).repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return chunks.where(alone).mapInArrow(fn, RECORDS).unionByName(dealt.mapInArrow(fn, RECORDS))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records with payload_bytes of the response that each revisit refers to; null, and digest_good false, if that is missing or differs."""
    responses = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest"), F.col("payload_bytes").alias("_bytes")).distinct()
    joined = records.join(responses, ["refers_to", "payload_digest"], "left")
    revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    good = F.when(revisit, F.col("_bytes").isNotNull() & F.col("digest_good")).otherwise(F.col("digest_good"))
    return joined.withColumns({"payload_bytes": F.coalesce("payload_bytes", "_bytes"), "digest_good": good}).select(*records.columns)


def _open(path: str, write: bool = False) -> pa.NativeFile:
    """A stream of the bytes of a file at a path or URI: to write as they are, to read unpacked as its name says."""
    system, plain = FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    return system.open_output_stream(plain, compression=None) if write else system.open_input_stream(plain, compression="gzip" if path.endswith(".gz") else None)


def record_chunks(stream: pa.NativeFile) -> Iterator[tuple[int, int, bool, bytes, str]]:
    """(record, chunk, last, data, running digest) of a stream of records; holds the head of one record and one chunk.

    A record reaches from its version line to the blank lines after its block, whose length the head
    states. A record without a blank line in MOST_HEAD bytes has no head: it reaches to the next line that
    begins like a version line, in chunks like any other, and is not whole.
    """
    buffer, record, ended = bytearray(), 0, False

    def fill(n: int) -> None:
        nonlocal ended
        while len(buffer) < n and not ended:
            more = stream.read(CHUNK)
            buffer.extend(more)
            ended = not more

    def take(n: int) -> bytes:
        piece = bytes(buffer[:n])
        del buffer[:n]
        return piece

    def headless() -> Iterator[bytes]:
        """What comes before the next version line, in pieces; a mark may lie across two of them."""
        seen = 1
        while True:
            fill(CHUNK + len(VERSION))
            at = buffer.find(VERSION, seen)
            if at >= 0 and at + 1 <= CHUNK:
                yield take(at + 1)
                return
            if ended and len(buffer) <= CHUNK:
                yield take(len(buffer))
                return
            yield take(CHUNK - len(VERSION))
            seen = 0

    while True:
        fill(4)
        if not buffer:
            return
        size = 0
        while (at := min((x for x in (buffer.find(b"\r\n\r\n", max(0, size - 4)), buffer.find(b"\n\n", max(0, size - 4))) if x >= 0), default=-1)) < 0 and not ended and len(buffer) < MOST_HEAD:
            size = len(buffer)
            fill(size + 1)
        state, chunk = hashlib.sha1(), 0
        if at < 0:
            pieces = headless()
            piece = next(pieces)
            while True:
                following = next(pieces, None)
                state.update(piece)
                yield record, chunk, following is None, piece, state.hexdigest()
                if following is None:
                    break
                piece, chunk = following, chunk + 1
            record += 1
            continue
        head = bytes(buffer[: at + (4 if buffer[at : at + 1] == b"\r" else 2)])
        stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
        left = len(head) + (int(stated[1]) if stated else 0)
        while True:
            fill(min(left, CHUNK + len(head)) + 8)
            piece = take(min(left, CHUNK + (len(head) if chunk == 0 else 0)))
            left -= len(piece)
            last = left == 0 or not piece
            if last:
                # Blank lines end the record.
                fill(5)
                start = bytes(buffer[:CHUNK])
                piece += take(len(start) - len(start.lstrip(b"\r\n")))
            state.update(piece)
            yield record, chunk, last, piece, state.hexdigest()
            chunk += 1
            if last:
                break
        record += 1


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The chunked record table of .warc and .warc.gz files that all executors can open, each read by one task as a stream.

    archive is the place of a file in `paths`. Without paths the table is empty.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held, size = [], 0
                with _open(path) as stream:
                    for row in record_chunks(stream):
                        held.append((archive, *row))
                        size += len(row[3])
                        if size > 8_000_000:
                            yield _chunk_batch(held)
                            held, size = [], 0
                if held:
                    yield _chunk_batch(held)

    files = spark.createDataFrame(list(enumerate(paths)), "archive long, path string")
    return files.repartition(max(1, len(paths)), "archive").mapInArrow(fn, CHUNKS)


def write_files(chunks: DataFrame, folder: str, packed: bool = True) -> DataFrame:
    """archive, path, bytes: a file in `folder` for each archive of a chunked record table, written by one task as a stream.

    A packed file has a gzip member for each record, so that a reader can begin at any of them.

    A task writes under a name of its attempt and renames the file when it is whole, so a lost executor
    leaves no part of a file under its name. The files are written when the result is first computed.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, member, size, done = None, None, None, 0, []
        mine = f"{TaskContext.get().taskAttemptId()}"

        def close() -> None:
            if member is not None:
                out.write(member.flush())
            out.close()
            path = f"{folder}/{now:06d}.warc{'.gz' if packed else ''}"
            system, plain = FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
            system.move(f"{plain[: -len('.gz')] if packed else plain}.{mine}{'.gz' if packed else ''}", plain)
            done.append((now, path, size))

        for batch in batches:
            for archive, chunk, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4), strict=True):
                if archive != now:
                    if out is not None:
                        close()
                    now, size = archive, 0
                    target = f"{folder}/{archive:06d}.warc.{mine}{'.gz' if packed else ''}"
                    system, plain = FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
                    system.create_dir(plain)
                    out, member = _open(target, write=True), None
                if packed and (member is None or chunk == 0):
                    if member is not None:
                        out.write(member.flush())
                    member = zlib.compressobj(wbits=31)
                out.write(member.compress(data.as_buffer()) if packed else data.as_buffer())
                size += len(data.as_buffer())
        if out is not None:
            close()
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done, strict=True)], ["archive", "path", "bytes"])

    dealt = chunks.select("archive", "record", "chunk", "last", "data").repartition("archive").sortWithinPartitions("archive", "record", "chunk")
    return dealt.mapInArrow(fn, "archive long, path string, bytes long")
