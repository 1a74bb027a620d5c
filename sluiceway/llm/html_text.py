"""HTML main text by consensus host paths.

Each page's containers are scored; the best one of a page votes for its generalised path (tags and
classes, digits taken out) on the page's host. Votes are counted in Spark, and every page is then
extracted again from the path that won on its host, or from its own where the host's holds too little of
its prose. A container's path is kept as a label, a parent and a rolling hash, so that memory and time are
linear in a page's length however deep it is nested.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: The most hosts whose winning paths are broadcast; more are joined by a shuffle.
MOST_HOSTS = 100_000
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?)*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")

# Fixed values of HTML: elements that hold no text of the page, void elements, and block elements.
SILENT = frozenset("script style template noscript svg math iframe object select textarea button canvas audio video title".split())
#: Silent elements whose content holds no tags.
RAW = frozenset("script style textarea title iframe noscript".split())
#: Start tags that may stand inside a silent element that is never closed, and blocks that no button or select holds.
LABEL = frozenset("span i b em strong small svg path use img option optgroup".split())
NO_LABEL = frozenset("body main article section h1 h2 h3 table ul ol blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary fieldset header footer nav aside form center hgroup dialog menu search".split()
)
CONTAINER = frozenset("html body main article section div td center".split())
#: Block elements that end an open paragraph.
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
CHROME_TAGS = frozenset("nav footer aside form menu dialog search".split())
CHROME_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar rail footer header masthead topbar ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert gdpr comment comments disqus reply replies share sharing social related recommended recommendations newsletter subscribe signup login popup modal overlay widget pagination pager toolbar skip".split()
)
#: Words that tell of an element's place or kind; beside chrome words they leave a name as sure as these are.
LAYOUT_WORDS = frozenset(
    "area article articles bar block body bottom box button buttons card col column container content entry form global group holder icon inner item items layout left link links list main module outer page panel post posts primary right row secondary section site text title top wrap wrapper".split()
)
#: Beside one of these a chrome word tells of what a page has or lacks, not of the element.
ABOUT = frozenset("has have no not non with without hide".split())
#: How surely an element is chrome: by a part of a name with other words (outside of articles only), by a part of a
#: name with layout words or as a form (unless it holds most of the text), by a whole name, by its tag, as hidden.
LOOSE, PART, NAME, TAG, HIDDEN = 1, 2, 3, 4, 5


#: Article and main elements of one path are a page's own path if they hold this share of its prose; other containers need all of it.
SEMANTIC = 0.5
#: The share of its own path's prose that a page must have under its host's path to be extracted by it.
AGREES = 0.9


@dataclass
class Element:
    """An open block element: its innermost container and mark (itself included), and where an open paragraph lies that a block would end."""

    tag: str
    container: int
    mark: int
    paragraph: int


@dataclass
class Block:
    """A block of text: its innermost container, how much of it is link text, the innermost element around it that may be chrome."""

    text: str
    inside: int
    link_chars: int
    mark: int
    heading: bool
    chrome: bool = False


@dataclass
class Page:
    """Blocks in page order; containers and marks, each after the one around it, by their own numbers."""

    blocks: list[Block] = field(default_factory=list)
    #: Of containers: the label (tag and class), the container around it (-1: none), the hash of the labels down to it.
    labels: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    hashes: list[int] = field(default_factory=list)
    #: Of marks: how surely the element is chrome, the mark around it (-1: none), whether all down to it are PART.
    sure: list[int] = field(default_factory=list)
    around: list[int] = field(default_factory=list)
    all_part: list[bool] = field(default_factory=list)

    def path(self, container: int) -> str:
        labels = []
        while container >= 0:
            labels.append(self.labels[container])
            container = self.parents[container]
        return "".join(f">{x}" for x in reversed(labels))

    def open_container(self, label: str, parent: int) -> int:
        self.labels.append(label)
        self.parents.append(parent)
        self.hashes.append(_below(self.hashes[parent] if parent >= 0 else 0, label))
        return len(self.labels) - 1

    def open_mark(self, sure: int, around: int) -> int:
        self.sure.append(sure)
        self.around.append(around)
        self.all_part.append(sure == PART and (around < 0 or self.all_part[around]))
        return len(self.sure) - 1


def _below(above: int, label: str) -> int:
    return xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), above)


def _names_of(attributes: str) -> tuple[int, str]:
    """How surely class, id, role and hidden say chrome (0: they do not), and the generalised class."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), a or b or c)
    sure = 0
    for key in ("class", "id", "role"):
        for name in found.get(key, "").split():
            words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
            if name.lower() in CHROME_WORDS:
                sure = NAME
            elif name.lower() == "hidden" or (not ABOUT.intersection(words) and CHROME_WORDS.intersection(words)):
                sure = max(sure, PART if CHROME_WORDS.union(LAYOUT_WORDS).issuperset(words) else LOOSE)
    bare = _ATTRIBUTE.sub(" ", attributes).lower().replace("/", " ").split()
    if "hidden" in bare or "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display:\s*none", found.get("style", "")):
        sure = HIDDEN
    return sure, ".".join(sorted(re.sub(r"[\d>]+", "", x) for x in found.get("class", "").lower().split()))


def _pairs(source: str, tag: str) -> dict[int, int]:
    """The start of each start tag that has an end tag of its own, and where that begins."""
    pairs, opened = {}, []
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])", re.I).finditer(source):
        if not m[1]:
            opened.append(m.start())
        elif opened:
            pairs[opened.pop()] = m.start()
    return pairs


def _settle(page: Page) -> Page:
    """Decides which blocks are chrome by what their marks hold; marks give way, the least sure first, before a page is left empty."""
    chars, links = [0] * len(page.sure), [0] * len(page.sure)
    total = 0
    for b in page.blocks:
        if b.mark < 0 or page.all_part[b.mark]:
            total += len(b.text)
            if b.mark >= 0:
                chars[b.mark] += len(b.text)
                links[b.mark] += b.link_chars
    for m in range(len(page.sure) - 1, -1, -1):
        if page.around[m] >= 0:
            chars[page.around[m]] += chars[m]
            links[page.around[m]] += links[m]
    cleared = [sure == PART and 0 < c and 2 * c >= total and 2 * k < c for sure, c, k in zip(page.sure, chars, links, strict=True)]
    for least in (0, NAME, TAG, HIDDEN):
        chrome: list[bool] = []
        for m, sure in enumerate(page.sure):
            chrome.append((page.around[m] >= 0 and chrome[page.around[m]]) or (sure > least and not cleared[m]))
        for b in page.blocks:
            b.chrome = b.mark >= 0 and chrome[b.mark]
        if not all(b.chrome for b in page.blocks):
            break
    return page


def parse_page(source: str | None) -> Page:
    """Blocks of a page with unclosed, misnested or cut tags; only block elements are tracked."""
    page, stack, at = Page(), [Element("", -1, -1, 0)], 0
    opened: Counter[str] = Counter()  # elements on the stack by tag
    # The silent element that is open, where its end tag is (None: it has none), and the blocks open in it.
    silent, silent_end = "", None
    inner: list[str] = []
    pairs: dict[str, dict[int, int]] = {}
    parts: list[str] = []
    link, link_chars = 0, 0
    source = source or ""

    def close_from(k: int) -> None:
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    def flush() -> None:
        nonlocal link_chars
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            page.blocks.append(Block(text, stack[-1].container, link_chars, stack[-1].mark, stack[-1].tag[:1] == "h" and stack[-1].tag[1:].isdigit()))
        parts.clear()
        link_chars = 0

    def text_until(end: int) -> None:
        nonlocal link_chars
        if end > at and not silent:
            piece = source[at:end]
            parts.append(piece)
            if link:
                link_chars += len(piece)

    while m := _TAG.search(source, at):
        text_until(m.start())
        at = m.end()
        if m[3] is None:
            if m[1] and not silent:
                parts.append(entities.escape(m[1]))
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if not m[5]:
            continue  # the page is cut inside this tag
        if silent:
            if silent_end is not None and m.start() >= silent_end:
                silent = ""
                if m.start() == silent_end:
                    continue
        if silent:
            if closing and tag in inner:
                while inner.pop() != tag:
                    pass
                continue
            if closing:
                ended = tag in BLOCK and opened[tag] > 0
            elif silent_end is None:
                ended = tag not in LABEL
            elif silent in ("svg", "math"):
                ended = tag in BLOCK and "foreignobject" not in inner
            else:
                ended = tag in NO_LABEL and silent in ("button", "select")
            if not ended:
                if closing and tag == silent:
                    silent = ""
                elif not closing and tag in RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at, len(source) if silent_end is None else silent_end)
                    at = end.start() if end else at
                elif not closing and (tag in BLOCK or tag == "foreignobject") and not m[4].endswith("/"):
                    inner.append(tag)
                continue
            silent = ""
        if tag in SILENT and not closing:
            if not m[4].endswith("/") or tag in RAW:
                silent, inner = tag, []
                if tag in RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                    silent_end = end.start() if end else len(source) if tag in ("script", "style") else None
                    at = at if silent_end is None else silent_end
                else:
                    if tag not in pairs:
                        pairs[tag] = _pairs(source, tag)
                    silent_end = pairs[tag].get(m.start())
            continue
        if tag == "a":
            link = max(0, link - 1) if closing else 1
        elif tag in ("br", "wbr", "hr", "img"):
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
        elif tag in BLOCK:
            flush()
            if closing:
                if opened[tag]:
                    close_from(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
                    link = 0
            else:
                if tag in ENDS_P and stack[-1].paragraph:
                    close_from(stack[-1].paragraph)
                if tag in ("li", "dt", "dd", "tr", "td", "th") and stack[-1].tag == tag:
                    close_from(len(stack) - 1)
                sure, classes = _names_of(m[4]) if m[4].strip() else (0, "")
                top = stack[-1]
                in_article = opened["article"] + opened["main"] > 0
                if tag in ("html", "body", "article", "main") and sure != HIDDEN:
                    sure = 0
                if sure == LOOSE:
                    sure = 0 if in_article else PART
                if tag == "form":
                    sure = max(sure, PART)
                elif tag in CHROME_TAGS or (tag == "header" and not in_article):
                    sure = max(sure, TAG)
                mark = page.open_mark(sure, top.mark) if sure else top.mark
                container = page.open_container(f"{tag}{'.' + classes if classes else ''}", top.container) if tag in CONTAINER else top.container
                paragraph = len(stack) if tag == "p" else 0 if tag in CONTAINER else top.paragraph
                stack.append(Element(tag, container, mark, paragraph))
                opened[tag] += 1
    if not silent and at < len(source):
        rest = source[at:]
        cut = re.search(r"<[a-zA-Z/!]?[^<>]*\Z", rest)
        parts.append(rest[: cut.start()] if cut and re.match(r"<[a-zA-Z/!]|<\Z", cut[0]) else rest)
    flush()
    return _settle(page)


def _worth(page: Page) -> list[float]:
    """Of each block: characters of prose, which link text counts against; where a page has no prose, its characters. Chrome has none."""
    worth = [0.0 if b.chrome else max(0.0, len(b.text) - 2.0 * b.link_chars) for b in page.blocks]
    return worth if any(worth) else [0.0 if b.chrome else float(len(b.text)) for b in page.blocks]


def container_scores(page: Page) -> tuple[list[float], list[int], list[int], float]:
    """Prose, blocks that are no headings, and headings in each container; the prose of the page."""
    scores, blocks, headings = [0.0] * len(page.labels), [0] * len(page.labels), [0] * len(page.labels)
    total = 0.0
    for b, worth in zip(page.blocks, _worth(page), strict=True):
        total += worth
        if b.inside >= 0:
            scores[b.inside] += worth
            blocks[b.inside] += not (b.chrome or b.heading)
            headings[b.inside] += b.heading and not b.chrome
    for n in range(len(scores) - 1, 0, -1):
        if page.parents[n] >= 0:
            scores[page.parents[n]] += scores[n]
            blocks[page.parents[n]] += blocks[n]
            headings[page.parents[n]] += headings[n]
    return scores, blocks, headings, total


def best_path(page: Page) -> tuple[str, float]:
    """The path of the containers that hold the page's article, and their prose; an empty path if no container holds it.

    First the outermost article and main elements of one path that hold most of the page's prose together,
    else the innermost container that holds all of it, or one around that adds headings only (of links, which are no prose).
    """
    scores, blocks, headings, total = container_scores(page)
    semantic: dict[int, list[float]] = {}
    inside: list[bool] = []
    for n, label in enumerate(page.labels):
        within = page.parents[n] >= 0 and inside[page.parents[n]]
        named = label.split(".")[0] in ("article", "main")
        inside.append(within or named)
        if named and not within:
            held = semantic.setdefault(page.hashes[n], [0.0, -n])
            held[0] += scores[n]
    if semantic:
        held, first = max(semantic.values())
        if held >= SEMANTIC * total and held > 0:
            return page.path(int(-first)), held
    best = -1
    for n, score in enumerate(scores):
        if score >= total > 0:
            best = n
    if best < 0:
        return "", 0.0
    around = page.parents[best]
    while around >= 0 and blocks[around] == blocks[best]:
        if headings[around] > headings[best]:
            best = around
        around = page.parents[around]
    return page.path(best), scores[best]


def blocks_at(page: Page, path: str) -> list[bool]:
    """Whether each block lies in a container of this path; all do for an empty path."""
    if not path:
        return [True] * len(page.blocks)
    wanted = 0
    for label in path.split(">")[1:]:
        wanted = _below(wanted, label)
    held: list[bool] = []
    for n, value in enumerate(page.hashes):
        held.append(value == wanted or (page.parents[n] >= 0 and held[page.parents[n]]))
    return [b.inside >= 0 and held[b.inside] for b in page.blocks]


def text_at(page: Page, path: str) -> str:
    """The blocks inside containers of this path, without chrome, each on a line."""
    return "\n".join(b.text for b, held in zip(page.blocks, blocks_at(page, path), strict=True) if held and not b.chrome)


def agreed_path(page: Page, hosts: str | None) -> str:
    """The host's path where it holds most of what the page's own path holds, else the page's own."""
    own = best_path(page)[0]
    if not hosts or hosts == own:
        return own
    worth = _worth(page)
    under = lambda path: sum(w for w, held in zip(worth, blocks_at(page, path), strict=True) if held)
    by_host = under(hosts)
    return hosts if by_host > 0 and by_host >= AGREES * under(own) else own


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, path, text for each row of pages (page_id, url, html).

    text joins the blocks of the container path that won on the page's host; white space in a block is
    one space. Pages with less than AGREES of their own path's prose under it use their own path (see
    best_path), pages without one all blocks that are no chrome. A null html is empty and has an empty
    text; pages without a host vote together; an empty table gives an empty table. Votes that tie go to the higher total score, then to the smaller path. Repeated rows keep
    a row each; other columns are ignored.
    """
    rows = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"), host_of(F.col("url")).alias("host"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best_path(parse_page(x.as_py())) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([x[0] for x in found]), pa.array([round(x[1], 3) for x in found], pa.float64())], ["host", "path", "score"])

    votes = rows.select("host", "html").mapInArrow(vote, "host string, path string, score double").where("path <> ''")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum(F.col("score").cast("decimal(18,3)")).alias("score"))
    winners = counted.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "path"))["path"].alias("path"))
    winners = Scratch(pages.sparkSession).keep(winners, "winners")
    joined = rows.join(F.broadcast(winners) if winners.count() <= MOST_HOSTS else winners, "host", "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, paths = [], []
            for source, path in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                page = parse_page(source.as_py())
                path = agreed_path(page, path)
                texts.append(text_at(page, path))
                paths.append(path)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "path", "text"])

    return joined.select(F.col("page_id").cast("long"), "url", "html", "path").mapInArrow(extract, "page_id long, url string, path string, text string")
