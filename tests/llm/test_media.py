"""MPEG streams, WARC archives, HTML text and packing: exact round trips and plain versions."""

from __future__ import annotations

import base64
import hashlib
import random
import time
import tracemalloc
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from helpers import frame, hard_texts
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluiceway.llm import html_text, mpeg, packing, tokens, warc
from sluiceway.llm.tokens import load

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("text", [None, "", "a", "TAG" * 100, "TAG" * 1000 + "x", "ID3" * 900, "é" * 5000, "x" * 192, "y" * 193, "z" * 122_000])
def test_stream_round_trip(text: str | None) -> None:
    payload, size = mpeg.padded(text)
    stream = mpeg.parse_stream(mpeg.write_stream(payload, size))
    assert mpeg.payload_of(stream) == (payload, size)
    assert stream.junk == stream.crc_bad == 0 and stream.vbr["frames"] == len(stream.headers) == stream.crc_good
    assert stream.samples == 1152 * len(stream.headers)


def test_resynchronises_after_junk_and_damage() -> None:
    media = mpeg.write_stream(*mpeg.padded("word " * 3000))
    clean = mpeg.parse_stream(media)
    cut = clean.offsets[5]
    damaged = mpeg.parse_stream(b"\xff\xff\0rubbish\xff" + media[:cut] + b"\0" * 37 + b"\xff\xfa" + media[cut:])
    assert len(damaged.headers) == len(clean.headers) and damaged.junk == 11 + 37 + 2
    flipped = bytearray(media)
    flipped[clean.offsets[3] + 8] ^= 1
    assert mpeg.parse_stream(bytes(flipped)).crc_bad == 1
    assert mpeg.parse_stream(None).headers == [] and mpeg.parse_stream(b"\xff" * 500).headers == []


def test_headers_of_other_versions() -> None:
    head = mpeg.read_header(bytes((0xFF, 0xFB, 0x90, 0x00)))  # MPEG-1 Layer III, 128 kbit/s, 44.1 kHz
    assert (head.version, head.layer, head.kbits, head.hertz, head.size, head.samples) == (1, 3, 128, 44100, 417, 1152)
    low = mpeg.read_header(bytes((0xFF, 0xF3, 0x80, 0xC0)))  # MPEG-2 Layer III, 64 kbit/s, 22.05 kHz
    assert (low.version, low.size, low.samples, low.mono) == (2, 208, 576, True)
    assert mpeg.read_header(bytes((0xFF, 0xFB, 0xF0, 0))) is None and mpeg.read_header(b"\xff") is None


def long_division(bits: str) -> int:
    """The remainder of the bits by x^16 + x^15 + x^2 + 1, begun with sixteen ones."""
    register = [1] * 16
    for bit in bits:
        out = register.pop(0) ^ int(bit)
        register.append(0)
        if out:
            for at in (0, 13, 15):
                register[at] ^= 1
    return int("".join(map(str, register)), 2)


@pytest.mark.parametrize(
    ("second", "third", "fourth", "covered"),
    [
        (0xFE, 0x90, 0xC0, 32 * 4),  # MPEG-1 Layer I, mono
        (0xFE, 0x90, 0x00, 64 * 4),  # stereo
        (0xFE, 0x90, 0x50, (8 * 2 + 24) * 4),  # joint stereo from subband 8 on
        (0xFC, 0x84, 0xC0, 11 * 4 + 12 * 3 + 4 * 2),  # Layer II, 128 kbit/s mono at 48 kHz: table a
        (0xFC, 0x80, 0xC0, 11 * 4 + 12 * 3 + 7 * 2),  # 44.1 kHz: table b
        (0xFC, 0x10, 0xC0, 2 * 4 + 6 * 3),  # 32 kbit/s mono: table c
        (0xFC, 0x18, 0xC0, 2 * 4 + 10 * 3),  # at 32 kHz: table d
        (0xF4, 0x80, 0xC0, 4 * 4 + 7 * 3 + 19 * 2),  # MPEG-2 Layer II
    ],
)
def test_checksums_of_layers_one_and_two(second: int, third: int, fourth: int, covered: int) -> None:
    head = bytes((0xFF, second, third, fourth))
    size = mpeg.read_header(head).size
    frame = head + b"\0\0" + bytes(size - 6)
    assert mpeg.covered_bits(frame, mpeg.read_header(head)) == covered
    bits = "".join(f"{b:08b}" for b in frame[2:4]) + "0" * covered
    good = head + long_division(bits).to_bytes(2, "big") + bytes(size - 6)
    stream = mpeg.parse_stream(good * 3 + good[:4] + bytes((good[4] ^ 1,)) + good[5:])
    assert (stream.crc_good, stream.crc_bad, stream.junk, len(stream.headers)) == (3, 1, 0, 4)


def test_seek_points_and_delay() -> None:
    media = mpeg.write_stream(*mpeg.padded("word " * 30_000))
    stream = mpeg.parse_stream(media)
    assert len(stream.seek) == 100 and stream.seek_error() <= 2 / 100 and stream.offsets[0] == stream.vbr["at"] + 192
    assert all(media[x] == 0xFF for x in stream.offsets)
    table = bytearray(media[stream.vbr["at"] : stream.vbr["at"] + 192])
    place = 21 + 8 + 8 + 100
    table[place : place + 4], table[place + 21 : place + 24] = b"LAME", (576 << 12 | 1000).to_bytes(3, "big")
    told = mpeg.parse_stream(media[: stream.vbr["at"]] + bytes(table) + media[stream.vbr["at"] + 192 :])
    assert stream.samples - told.samples == 1576
    head = bytes((0xFF, 0xFB, 0x90, 0xC0))
    vbri = head + bytes(32) + b"VBRI" + bytes(6) + (417 * 5).to_bytes(4, "big") + (4).to_bytes(4, "big") + b"".join(n.to_bytes(2, "big") for n in (4, 1, 2, 1, 417, 417, 417, 417))
    found = mpeg.parse_stream(vbri + bytes(417 - len(vbri)) + (head + bytes(413)) * 4)
    assert [at for _, at in found.seek] == found.offsets and found.seek_error() == 0


def test_free_format_tags_and_false_headers() -> None:
    free = bytes((0xFF, 0xFB, 0x00, 0xC0)) + bytes(496)
    found = mpeg.parse_stream(free * 4)
    assert [h.size for h in found.headers] == [500] * 4 and found.headers[0].kbits == 153
    frame = bytes((0xFF, 0xFB, 0x90, 0xC0)) + bytes(413)
    # A header of another kind inside junk leads to a frame of the stream, but it is none.
    false = bytes((0xFF, 0xFD, 0x10, 0xC0)) + bytes(100)
    assert mpeg.parse_stream(false + frame * 3).offsets == [len(false) + 417 * k for k in range(3)]
    text = b"TIT2" + (5).to_bytes(4, "big") + b"\0\0\0a\xff\0b"
    tag = b"ID3\x03\0\xc0" + mpeg._synchsafe(10 + len(text)) + (6).to_bytes(4, "big") + bytes(6) + text
    assert mpeg.parse_stream(tag + frame * 2).tags == {"TIT2": "aÿb"}
    last = b"TAG" + b"Title".ljust(30, b"\0") + bytes(95)
    ended = mpeg.parse_stream(frame * 2 + last)
    assert ended.tags == {"TIT2": "Title"} and len(ended.headers) == 2 and ended.junk == 0


def test_media_columns(spark: SparkSession) -> None:
    rows = hard_texts()
    found = mpeg.read_media(mpeg.store_texts(frame(spark, rows))).collect()
    assert sorted((r.doc_id, r.n_bytes, bytes(r.payload)) for r in found) == sorted((i, mpeg.padded(t)[1], mpeg.padded(t)[0]) for i, t in rows)
    none = frame(spark, rows).limit(0)
    assert mpeg.read_media(mpeg.store_texts(none)).isEmpty()
    assert len({(bytes(r.media), r.feature) for r in found}) == len({mpeg.padded(t) for _, t in rows})


PAGES = [(1, "http://a/x", "s" * 2000), (2, "http://b/ y", "s" * 2000), (3, None, "s" * 2000), (4, "u", None), (5, "u", ""), (6, "u", "é\r\n\r\nWARC/1.1\r\n" * 30_000), (7, "u", "short"), (8, "u", "short"), (None, "u", "x")]


def test_warc_round_trip(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int")
    warc.write_archives(warc.with_revisits(pages), str(tmp_path / "w"))
    chunks = spark.read.schema(warc.CHUNKS).parquet(str(tmp_path / "w"))
    assert chunks.agg(F.max(F.length("data"))).first()[0] <= warc.CHUNK + 2000 and chunks.where("chunk > 5").count() > 0
    found = {r.page_id: r for r in warc.resolve_revisits(warc.read_records(chunks)).collect()}
    for page, _, html in PAGES[:-1]:
        raw = (html or "").encode()
        assert (found[page].payload_bytes, found[page].payload_digest, found[page].whole, found[page].digest_good) == (len(raw), hashlib.sha1(raw).hexdigest(), True, True)
        assert (found[page].record_type, found[page].refers_to) == (("revisit", 3) if page in (1, 2) else ("response", None))
    assert len(found) == len(PAGES) - 1
    damaged = chunks.withColumn("data", F.when(F.col("chunk") == 2, F.lit(b"x")).otherwise(F.col("data")))
    assert [r.page_id for r in warc.read_records(damaged).where("not whole").collect()] == [6]
    archive = b"".join(bytes(r.data) for r in chunks.orderBy("archive", "record", "chunk").collect())
    assert archive.count(b"WARC-Type: response") == 6 and archive.count(b"WARC-Type: revisit") == 2
    assert base64.b32encode(hashlib.sha1(b"short").digest()) in archive


def head(**fields: str) -> bytes:
    return "\r\n".join(["WARC/1.1", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items())]).encode() + b"\r\n\r\n"


def read_one(data: bytes, step: int) -> tuple[tuple, int]:
    """The row of a record fed in steps, and the most bytes that its reader held."""
    reader, state, held = warc.RecordReader(), hashlib.sha1(), 0
    for k, at in enumerate(range(0, len(data), step)):
        piece = data[at : at + step]
        state.update(piece)
        reader.feed(k, piece, state.hexdigest())
        held = max(held, len(reader.lines.held) + len(reader.tail))
    return reader.row(), held


@pytest.mark.parametrize("step", [1, 7, 1000, 1 << 20])
def test_records_cut_anywhere(step: int) -> None:
    http = b"HTTP/1.1 200 OK\r\nX: " + b"y" * 30_000 + b"\r\n\r\n"
    body = b"body\n\r\n\r\n" * 500
    sha = hashlib.sha1(body)
    fields = {"WARC_Type": "response", "WARC_Record_ID": "<urn:page:7>", "X_Other": "z" * 40_000, "WARC_Target_URI": "http://" + "u" * 20_000, "WARC_Payload_Digest": f"sha1:{sha.hexdigest()}", "Content_Type": "application/http; msgtype=response", "Content_Length": str(len(http) + len(body))}
    row, held = read_one(head(**fields) + http + body + b"\r\n\r\n", step)
    assert row == (7, "response", None, "http://" + "u" * 20_000, len(body), sha.hexdigest(), True, True)
    assert held < 21_000
    plain, _ = read_one(head(WARC_Type="resource", Content_Type="text/plain", Content_Length="4") + b"abcd\r\n\r\n", step)
    assert plain[4:] == (4, hashlib.sha1(b"abcd").hexdigest(), False, True)
    bad, _ = read_one(head(WARC_Type="revisit", WARC_Payload_Digest="sha1:not base 32", Content_Length="0") + b"\r\n\r\n", step)
    assert bad[5:] == (None, False, True)
    endless, held = read_one(b"WARC/1.1\r\nX: " + b"z" * 300_000, step)
    assert not endless[-1] and held <= warc.LINE
    if step >= 1000:
        long = head(WARC_Type="resource", WARC_Target_URI="u" * 3_000_000, Content_Type="text/plain", Content_Length="4") + b"abcd\r\n\r\n"
        row, held = read_one(long, step)
        assert held <= warc.MOST_LINE and row[4] == 4 and not row[-1], "a field that is too long is told"


class Bytes:
    """A stream of these bytes that counts how many it has given."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> bytes:
        piece, self.at = self.data[self.at : self.at + n], self.at + n
        return piece


@pytest.mark.parametrize("junk", [b"no head at all " * 400_000, b"WARC/1.0\r\nX: " + b"y" * 6_000_000, b"x" * 10, b"x" * (warc.CHUNK - 3), b"\n" + b"x" * (5 << 20)])
def test_a_record_without_a_head_is_cut_in_chunks(junk: bytes) -> None:
    good = head(WARC_Type="resource", WARC_Record_ID="<urn:page:7>", Content_Type="text/plain", Content_Length="4") + b"abcd\r\n\r\n"
    began = time.process_time()
    rows = list(warc.record_chunks(Bytes(junk + b"\n" + good + good)))
    assert time.process_time() - began < 3
    assert b"".join(r[3] for r in rows) == junk + b"\n" + good + good and max(len(r[3]) for r in rows) <= warc.MOST_HEAD
    if len(junk) > warc.MOST_HEAD:
        assert max(len(r[3]) for r in rows) <= warc.CHUNK and {r[0] for r in rows} == {0, 1, 2}
        assert [r[0] for r in rows if r[2]] == [0, 1, 2] and b"".join(r[3] for r in rows if r[0] == 1) == good


def test_packed_files_have_a_member_for_each_record(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.with_revisits(pages), str(tmp_path / "w"))
    chunks = spark.read.schema(warc.CHUNKS).parquet(str(tmp_path / "w"))
    records = {(r.archive, r.record) for r in chunks.select("archive", "record").distinct().collect()}
    members = 0
    for row in warc.write_files(chunks, str(tmp_path / "files"), True).collect():
        data = open(row.path, "rb").read()
        while data:
            member = zlib.decompressobj(wbits=31)
            assert member.decompress(data).startswith(b"WARC/1.1\r\n")
            data, members = member.unused_data, members + 1
    assert members == len(records)


@pytest.mark.parametrize("packed", [True, False])
def test_warc_files(spark: SparkSession, tmp_path, packed: bool) -> None:  # noqa: ANN001
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    warc.write_archives(warc.with_revisits(pages), str(tmp_path / "w"))
    chunks = spark.read.schema(warc.CHUNKS).parquet(str(tmp_path / "w"))
    files = sorted(r.path for r in warc.write_files(chunks, str(tmp_path / "files"), packed).collect())
    assert sorted(str(f) for f in (tmp_path / "files").iterdir()) == files
    read = warc.read_files(spark, files)
    assert read.agg(F.max(F.length("data"))).first()[0] <= warc.CHUNK + 2000
    columns = ["page_id", "record_type", "refers_to", "target", "payload_bytes", "payload_digest", "digest_good", "whole"]
    one, other = (sorted(map(repr, warc.read_records(x).select(*columns).collect())) for x in (read, chunks))
    assert one == other and len(one) == 8
    assert warc.read_files(spark, []).isEmpty() and warc.read_records(warc.read_files(spark, [])).isEmpty()


def test_warc_edges(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    """Empty tables, and revisits of records that are missing."""
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.with_revisits(none), str(tmp_path / "none"))
    assert warc.resolve_revisits(warc.read_records(spark.read.schema(warc.CHUNKS).parquet(str(tmp_path / "none")))).isEmpty()
    records = spark.createDataFrame([(1, "revisit", 9, None, None, "d", True, True), (2, "response", None, None, 5, "e", True, True), (3, "revisit", 2, None, None, "e", True, True)], warc.RECORDS)
    found = {r.page_id: (r.payload_bytes, r.digest_good) for r in warc.resolve_revisits(records).collect()}
    assert found == {1: (None, False), 2: (5, True), 3: (5, True)}


HOSTED = '<html><head><title>t</title><script>var a="<p>no</p>"</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="wrap"><div class="post-{n}"><h1>Title &amp; {n}</h1><p>First&nbsp; para\n graph, long enough to count.<p>Second <b>bold<br>line</b> here, with more words.</div><aside>Side</aside></div><div id="comments"><p>Nice article, thank you very much indeed!</p></div><footer>&copy; x</footer></body></html>'


def test_html_text(spark: SparkSession) -> None:
    rows = [(n, f"http://h.example.com/{n}", HOSTED.replace("{n}", str(n))) for n in range(5)] + [(10, "http://h.example.com/z", '<div class="wrap"><div class="post-9"><p>Cut &am'), (11, None, None), (12, "x", "plain text only"), (13, "http://other/", "<article><p>One</p><form>no</form><p>Two</p></article>")]
    found = {r.page_id: r for r in html_text.extract_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, path int")).collect()}
    assert found[3].text == "Title & 3\nFirst para graph, long enough to count.\nSecond bold line here, with more words."
    assert found[3].path == ">html>body>div.wrap>div.post-"
    assert found[10].text == "Cut &am" and found[11].text == "" and found[12].text == "plain text only" and found[13].text == "One\nTwo"
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


STORY = "A story that is long enough to be read as the text of the page."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><body><p>{STORY}</p></body></html>",
        f"<title>t</title><meta charset=x><p>{STORY}</p>",
        f"""<head><script>if (a <b && c == "x) {{}}</script></head><body><p>{STORY}</p></body>""",
        f"""<body><script>if (a <b && c == "x) {{}}</script><p class="x">{STORY}</p></body>""",
        f"<body><div><button>Menu</div><p>{STORY}</p></body>",
        f"<body><button>Menu<p>{STORY}</p><button>Top</button></body>",
        f"<body><div><select><option>a</div><article><p>{STORY}</p></article></body>",
        f"<body><svg><path d=x><p>{STORY}</p></body>",
        f"<body><object data=x><p>{STORY}</p><object></object></body>",
        f'<body><div class="layout has-sidebar"><article><p>{STORY}</p></article></div><div>Short note</div></body>',
        f'<body><div id="page-no-comments"><p>{STORY}</p></div></body>',
        f'<body><div class="sidebar-layout"><p>{STORY}</p></div><div class="cookie-notice">We use cookies</div></body>',
        f'<body><div class="overflow-hidden"><p>{STORY}</p></div></body>',
        f'<body><form action="x.aspx"><div><p>{STORY}</p></div></form></body>',
        f'<body><div class="widget"><p>{STORY}</p></div></body>',
        f'<body><aside><p>{STORY}</p></aside><footer></footer></body>',
        f'<body><div class="nav"><p>Home</p></div><div><p><a href=x>{STORY}</a></p></div></body>',
    ],
)
def test_html_text_of_hard_pages(spark: SparkSession, page: str) -> None:
    parsed = html_text.parse_page(page)
    path = html_text.best_path(parsed)[0]
    assert (html_text.text_at(parsed, path) if path else "\n".join(b.text for b in parsed.blocks if not b.chrome)) == STORY


@pytest.mark.parametrize(
    "block",
    ["<p class=it's>{}</p>", "<p title=a'b data-x=c\"d>{}</p>", "<p data-x='hidden'>{}</p>", "<p data-hidden=1>{}</p>", '<div class="market-share">{}</div>', '<div class="comment-analysis">{}</div>', '<div id="ad-hoc">{}</div>', "<a href=x?y=it's>{}</a>"],
)
def test_html_text_keeps_blocks_of_an_article(block: str) -> None:
    page = html_text.parse_page(f"<body><nav>Home</nav><article><p>{STORY}</p>{block.format('Middle block')}<p>{STORY}</p></article></body>")
    assert html_text.text_at(page, html_text.best_path(page)[0]) == f"{STORY}\nMiddle block\n{STORY}"


@pytest.mark.parametrize("block", ['<div class="related-posts">{}</div>', '<div class="comment-list">{}</div>', '<section id="newsletter-signup">{}</section>', "<p hidden>{}</p>", "<p class=ad>{}</p>", '<p hidden="">{}</p>', "<aside>{}</aside>"])
def test_html_text_drops_chrome_in_an_article(block: str) -> None:
    page = html_text.parse_page(f"<body><article><p>{STORY}</p>{block.format('Other block')}<p>{STORY}</p></article></body>")
    assert html_text.text_at(page, html_text.best_path(page)[0]) == f"{STORY}\n{STORY}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p>A</p><div class="box"><p>{0}</p></div><p>END</p></article>', "A\n{0}\nEND"),
        ('<main><section class="intro"><p>{0}</p></section><section class="text"><p>{1}</p></section></main>', "{0}\n{1}"),
        ('<body><div class="a"><p>{0}</p></div><div class="b"><p>{1}</p></div></body>', "{0}\n{1}"),
        ('<body><h1>Title</h1><div class="wrap"><div class="story"><p>{0}</p><p>{1}</p></div></div></body>', "Title\n{0}\n{1}"),
        ('<body><article class="x"><p>{0}</p></article><nav>Menu</nav><article class="x"><p>{1}</p></article></body>', "{0}\n{1}"),
        ('<body><article><p>Teaser</p></article><div class="story"><p>{0}</p><p>{1}</p></div></body>', "Teaser\n{0}\n{1}"),
        ('<body><p>{0}</p><div><div><div><p>{1}</p></div></div></div><p>END</p></body>', "{0}\n{1}\nEND"),
    ],
)
def test_html_text_loses_no_block(page: str, text: str) -> None:
    a, b = "First " + STORY, "Second " + STORY
    parsed = html_text.parse_page(page.format(a, b))
    assert html_text.text_at(parsed, html_text.best_path(parsed)[0]) == text.format(a, b)


def test_html_text_leaves_a_hosts_path_that_misses_the_article(spark: SparkSession) -> None:
    usual = '<body><div class="ad">x</div><div class="story"><p>{0}</p><p>{0}</p></div></body>'
    rows = [(k, "http://h/", usual.format(f"{k} {STORY}")) for k in range(5)]
    rows += [(10, "http://h/", f'<body><div class="story"><p>short teaser</p></div><div class="long"><p>{STORY}</p><p>{STORY}</p></div></body>')]
    found = {r.page_id: (r.text, r.path) for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3] == (f"3 {STORY}\n3 {STORY}", ">body>div.story")
    assert found[10][0].endswith(f"{STORY}\n{STORY}")


def random_article(r: random.Random) -> tuple[str, list[str]]:
    """An article split over nested sections, lists and boxes, with chrome between them; and its blocks."""
    lines: list[str] = []

    def prose(least: int = 3) -> str:
        lines.append(" ".join(r.choice(["alpha", "beta", "gamma", "delta", "Über", "naïve", "omega"]) + str(r.randrange(100)) for _ in range(r.randrange(least, 60))))
        return lines[-1]

    def chrome() -> str:
        return r.choice(["<nav><ul><li><a href=/>Home</a></ul></nav>", '<div class="cookie-banner"><p>We use cookies</p></div>', "<aside><p>Aside</p></aside>", '<div class="ad"><p>Buy this now</p></div>', "<script>var x = '<p>no</p>'</script>", "<form><p>Search</p></form>", '<section id="comments"><p>Nice one</p></section>', ""])

    def part(depth: int) -> str:
        kind = r.randrange(6 if depth else 2)
        if kind == 0:
            return f"<p>{prose()}</p>"
        if kind == 1:
            return f"<h2>{prose(1)}</h2><p>{prose()}</p>"
        if kind == 2:
            return f"<ul><li>{prose()}<li>{prose()}</ul>"
        tag, name = r.choice([("div", "box"), ("section", "part"), ("div", ""), ("section", "intro"), ("div", "col-7")])
        return f'<{tag} class="{name}">' + "".join(part(depth - 1) + chrome() for _ in range(r.randrange(1, 4))) + f"</{tag}>"

    body = "".join(part(3) for _ in range(r.randrange(1, 5)))
    around = r.choice(["<main>{}</main>", "<article>{}</article>", '<main class="m"><article>{}</article></main>', '<div class="wrap"><div class="text">{}</div></div>', "{}"])
    return f"<html><head><title>t</title></head><body>{chrome()}<header><p>Site</p></header>{around.format(body)}{chrome()}<footer><p>Imprint</p></footer></body></html>", lines


def test_html_text_of_random_articles(spark: SparkSession) -> None:
    r = random.Random(11)
    pages = [random_article(r) for _ in range(300)]
    for html, lines in pages:
        parsed = html_text.parse_page(html)
        assert html_text.text_at(parsed, html_text.best_path(parsed)[0]).split("\n") == lines
    rows = [(k, f"http://h{k % 7}/", html) for k, (html, _) in enumerate(pages)]
    found = {x.page_id: x.text for x in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    kept = sum(len(set(found[k].split("\n")) & set(lines)) for k, (_, lines) in enumerate(pages))
    assert kept >= 0.98 * sum(len(set(lines)) for _, lines in pages)


@pytest.mark.parametrize("unit", ["<div>", '<div class="a1 b">', '<div class="nav">', "<ul><li>", "<p><table><td>", "<article>", "<div>x</p></section>", "<svg><p>", "<button>", "<select><option>"])
def test_html_text_of_deep_pages(unit: str) -> None:
    began, seconds = time.process_time(), {}
    for n in (3_000, 12_000):
        page = html_text.parse_page(unit * n + f"<p>{STORY}</p>" + "</div>" * n)
        assert STORY in html_text.text_at(page, html_text.best_path(page)[0])
        seconds[n] = time.process_time() - began
    assert seconds[12_000] < 5
    tracemalloc.start()
    html_text.best_path(html_text.parse_page("<div>" * 12_000 + STORY))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20


class ArticleText(HTMLParser):
    """The text of the article element by the standard library's parser: one line for each block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.lines = 0, [""]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag == "article"
        if tag == "br":
            self.lines[-1] += " "
        elif tag in html_text.BLOCK:
            self.lines.append("")

    def handle_endtag(self, tag: str) -> None:
        self.depth -= tag == "article"
        if tag in html_text.BLOCK:
            self.lines.append("")

    def handle_data(self, data: str) -> None:
        if self.depth:
            self.lines[-1] += data


def test_html_text_of_all_pages(spark: SparkSession, sf: str) -> None:
    """Whole generated pages, whose text is their article, against another parser."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        parser = ArticleText()
        parser.feed(r.html)
        parser.close()
        assert found[r.page_id] == "\n".join(x for x in (" ".join(line.split()) for line in parser.lines) if x)
    assert len(found) == pages.count() > 0


def test_chunks_are_learnt_once_and_forgotten_by_halves(monkeypatch: pytest.MonkeyPatch) -> None:
    """A chunk is learnt where it is first met, without a pass over a batch's chunks before; a full memo keeps its older half."""
    words = tokens.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    asked, learn = [], words.memo.learn
    words.memo.learn = lambda chunk: asked.append(chunk) or learn(chunk)
    found = words.encode(["one two, one 3.5 two,", "one four five"])
    assert asked == [b"one", b"two,", b"two", b",", b"3.5", b"four", b"five"]
    monkeypatch.setattr(tokens, "MEMO_CHUNKS", 7)
    more = words.encode(["six, one"])
    assert list(words.memo) == [b"one", b"two", b",", b"six", b"six,"] and asked[-2:] == [b"six,", b"six"]
    assert found + more == [words._whole(t) for t in ("one two, one 3.5 two,", "one four five", "six, one")]


@pytest.mark.parametrize("marked", [True, False])
def test_many_new_words_are_learnt_together(marked: bool, monkeypatch: pytest.MonkeyPatch) -> None:
    """No word of many is asked for alone if the model marks where words end; what a word has after it is not remembered with it."""
    monkeypatch.setattr(tokens, "TOGETHER", 999)
    words, plain = tokens.WordTokens(PATH), Tokenizer.from_file(PATH)
    asked, learn = [], words.memo.learn
    words.memo.learn = lambda chunk: asked.append(chunk) or learn(chunk)
    words.last &= marked
    letters = "abcdéßñöxyz"
    made = ["".join(letters[k // 11**i % 11] for i in range(5)) for k in range(0, 160_000, 16)]
    texts = [" ".join(made[k : k + 1000]) + f" {made[k]}, it's\t{made[k + 1]}... 3.{k} don't ÀB" for k in range(0, len(made), 1000)] + [None, "", "a<|endoftext|>b", " \x0b"]
    found = words.encode(texts)
    assert [np.frombuffer(x, words.dtype).tolist() for x in found] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(set(made)) == 10_000 > tokens.MANY_CHUNKS and {m.encode() for m in made} <= set(words.memo)
    if marked:
        assert not {m.encode() for m in made} & set(asked) and f"{made[0]},".encode() not in words.memo
    tokens._LOADED["made"] = words
    tokens.forget()
    assert not words.memo and tokens._LOADED.pop("made").encode(texts) == found


def test_heaviest_tokens_of_a_document() -> None:
    """Tokens count once however often they occur, in any order of ids; of equal weights the smaller token is taken."""
    stats = packing.Statistics(np.array([0.0, 1, 1, 1, 1, 3, 0]), 4.0)
    token, tf = packing.distinct(np.array([4, 1, 4, 5, 4], np.uint16), np.full(7, 99))
    assert sorted(zip(token.tolist(), tf.tolist(), strict=True)) == [(1, 1), (4, 3), (5, 1)]
    assert packing.heaviest(np.array([4, 3, 2, 1, 5, 0], np.uint16), stats) == [5, 1, 2]
    assert packing.heaviest(np.array([4, 2, 4, 0, 6], np.uint16), stats) == [4, 2, -1]


def test_tokens_equal_the_tokenizer() -> None:
    words = load(PATH)
    plain = Tokenizer.from_file(PATH)
    texts = [None, "", "  ", "It's   O'REILLY's «quoted» naïve İstanbul 12,3 ́x", "a<|endoftext|>b", "\x1cabc d", "ﬁ ǆ ß q​q", "don''t 's x's"] + [t for _, t in hard_texts()]
    for text, ids in zip(texts, words.encode(texts), strict=True):
        assert np.frombuffer(ids, words.dtype).tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_packing(spark: SparkSession) -> None:
    rows = hard_texts()
    plain = Tokenizer.from_file(PATH)
    found = packing.pack(frame(spark, rows), PATH, window=256, shard_tokens=4000).collect()
    expected = sorted((i, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    pieces: dict[int, list] = {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
    ids = []
    for doc, own in pieces.items():
        flat: dict[tuple, list[int]] = {}
        for r in sorted(own, key=lambda r: r.start):
            assert len(r.ids) == 4 * r.length
            flat.setdefault((r.doc_tokens,), []).extend(np.frombuffer(r.ids, "<u4").tolist())
        ids += [(doc, tuple(v[k : k + n])) for (n,), v in flat.items() for k in range(0, len(v), n)] if doc != 70 else []
    assert sorted(ids) == [x for x in expected if x[0] != 70]
    sequences: dict[int, list] = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 256
    partly = sum(sum(n for _, n in own) < 256 for own in sequences.values())
    assert partly <= len({s >> 32 for s in sequences})
    assert packing.pack(frame(spark, rows).limit(0), PATH).isEmpty()


def test_neighbours_follow_their_seed() -> None:
    stats = packing.Statistics(np.ones(100), 20.0)
    docs = [np.array(x) for x in ([1, 2, 3], [50, 51], [1, 2, 9], [60, 61], [3, 1, 8])]
    pieces = packing.fill([3, 2, 3, 2, 3], packing.ShardIndex(docs, stats), 9)
    assert [p[0] for p in pieces][:3] == [0, 2, 4] or [p[0] for p in pieces][:3] == [0, 4, 2]
