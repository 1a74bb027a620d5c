"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

One pass over the documents slides windows of every item length. A window that could reach the threshold
holds most of its shingles among those of the items of that length, which a bitmap of bounded size shows;
these windows get a SimHash. Fingerprints of windows and items meet in a Spark join on the length and one
of BLOCKS blocks, for items within FLIPS flipped bits of it: that finds every fingerprint within RADIUS.
The weighted Jaccard similarity of the shingle counts then decides.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_WORDS, Scratch, WordHasher, mix, shingle_hashes, trim

SIZE, THRESHOLD = 5, 0.8
#: Blocks of a fingerprint, and bits by which a block may differ: fingerprints within RADIUS differ by no more in some block.
BLOCKS, FLIPS = 6, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Bits of the bitmap for each entry, and its most bits (128 MB); with more entries it only lets more windows pass.
ENTRY_BITS, MOST_BITS = 32, 1 << 30
#: Rows of the items' index that are broadcast, at most; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
_CUTS = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’…–—¿¡"


class PlainHasher(WordHasher):
    """Hashes of words in lower case without punctuation at their ends."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            # The words met last are mostly rare ones.
            for rare in list(self)[MEMO_WORDS // 2 :]:
                del self[rare]
        plain = word.decode("utf-8", "replace").lower().strip(_EDGES)
        value = self[word] = xxhash.xxh3_64_intdigest(plain)
        return value

    def text(self, text: str | None) -> np.ndarray:
        return self.of((text or "").encode("utf-8", "surrogatepass").split())


def expected_distance(similarity: float) -> tuple[float, float]:
    """Mean and standard deviation of the bits in which SimHashes of two sets of equal size with this Jaccard similarity differ.

    Each bit is the side of a random plane; the cosine of such sets is 2 J / (1 + J).
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return 64 * share, math.sqrt(64 * share * (1 - share))


def simhash(shingles: np.ndarray) -> int:
    """64 bits: on which side of 64 planes the sum of the shingles' vectors lies; a shingle's vector is 64 bytes drawn by its hash."""
    drawn = mix(shingles[:, None] + np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sums = (drawn.view(np.int8).reshape(len(shingles), 64).astype(np.int32) * 2 + 1).sum(axis=0)
    return int.from_bytes(np.packbits(sums > 0).tobytes(), "big")


def block_keys(value: int) -> list[int]:
    """The blocks of a fingerprint, each with its number in front."""
    return [k << 32 | (value >> _CUTS[k]) & ((1 << (_CUTS[k + 1] - _CUTS[k])) - 1) for k in range(BLOCKS)]


def near_keys(value: int) -> list[int]:
    """The keys of all blocks within FLIPS bits of this fingerprint's."""
    out = []
    for k, key in enumerate(block_keys(value)):
        width = _CUTS[k + 1] - _CUTS[k]
        for n in range(FLIPS + 1):
            out += [key ^ sum(1 << b for b in bits) for bits in itertools.combinations(range(width), n)]
    return out


def for_length(shingles: np.ndarray, length: int) -> np.ndarray:
    """Hashes of shingles together with the length of the items that hold them."""
    return mix(shingles + np.uint64(length * 0xC2B2AE3D27D4EB4F % (1 << 64)))


@dataclass
class Known:
    """The item lengths, and a bitmap of their shingles, alone and with the length of an item."""

    lengths: list[int]
    bits: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(8 * len(self.bits) - 1)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def least_known(span: int, threshold: float) -> int:
    """Shingles, counted with repeats, that a window of `span` shares with any item over the threshold."""
    return int(np.ceil(span * threshold - 1e-9))


def windows(words: np.ndarray, known: Known, threshold: float) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(item length, first word, words, shingles) of the windows that may reach the threshold with an item of that length."""
    n = len(words)
    if not n:
        return
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for m in known.lengths:
        length = min(m, n)
        size = min(SIZE, length)
        # Shingles of other sizes than the item's are never the same, and a much shorter document shares too few.
        if size < min(SIZE, m) or length - size + 1 < threshold * (m - size + 1) - 1e-9:
            continue
        if size not in by_size:
            s = shingle_hashes(words, size)
            by_size[size] = s, np.concatenate([np.zeros(1, np.int64), np.cumsum(known.has(s))])
        shingles, sums = by_size[size]
        span = length - size + 1
        least = least_known(span, threshold)
        if sums[-1] < least:
            continue
        at = np.flatnonzero(sums[span:] - sums[:-span] >= least)
        if not len(at):
            continue
        low, high = int(at[0]), int(at[-1]) + span
        own = np.concatenate([np.zeros(1, np.int64), np.cumsum(known.has(for_length(shingles[low:high], m)))])
        for p in at[own[at - low + span] - own[at - low] >= least].tolist():
            yield m, p, length, shingles[p : p + span]


def weighted_jaccard(a: Counter, b: Counter) -> float:
    low = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return low / (a.total() + b.total() - low)


def _bitmap(entries: DataFrame) -> np.ndarray:
    """Packed bits of (h long): the low bits of each h; put together from segments that Spark packs."""
    wanted = ENTRY_BITS * max(1, entries.count())
    bits = min(MOST_BITS, max(1 << 16, 1 << (wanted - 1).bit_length()))
    segment = 1 << 16
    placed = entries.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("at")).distinct()

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        held = np.zeros(segment, bool)
        held[table.column("at").to_numpy() % segment] = True
        return pa.table({"part": [key[0].as_py()], "bits": [np.packbits(held, bitorder="little").tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    for r in placed.groupBy(F.floor(F.col("at") / segment).alias("part")).applyInArrow(pack, "part long, bits binary").toLocalIterator():
        out[r.part * segment // 8 : (r.part + 1) * segment // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: the best window of a document for each item it holds.

    Words are compared in lower case without punctuation at their ends, by shingles of five (an item or
    text of fewer words is one shingle); the similarity is the weighted Jaccard of shingle counts of a
    window of the item's length (or the whole of a shorter document), at least `threshold`. Of equal
    windows the first counts. A window at the threshold is found if its SimHash lies within RADIUS of the
    item's, two and a half standard deviations beyond what 0.8 leads to expect (see expected_distance).
    Null texts and items without words match nothing; rows with a null doc_id or item_id are dropped;
    repeated rows give one row for each id; empty tables give an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null").dropDuplicates()

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = PlainHasher()
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = hasher.text(text.as_py())
                if len(words):
                    s = shingle_hashes(words, SIZE)
                    print_ = simhash(s)
                    entries = np.unique(np.concatenate([s, for_length(s, len(words))])).view(np.int64)
                    out.append((item, len(words), np.uint64(print_).view(np.int64), s.tobytes(), entries, near_keys(print_)))
            if out:
                columns = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["item_id", "m", "item_print", "item", "entries", "keys"])

    items = scratch.keep(items.mapInArrow(prepare, "item_id long, m int, item_print long, item binary, entries array<long>, keys array<long>"), "items")
    lengths = sorted(r.m for r in items.select("m").distinct().collect())
    known = spark.sparkContext.broadcast(Known(lengths, _bitmap(items.select(F.explode("entries").alias("h")).distinct())))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        hasher, found, size = PlainHasher(), [], 0
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], ["doc_id", "m", "start_word", "n_words", "print", "shingles", "keys"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for m, start, length, shingles in windows(hasher.text(text.as_py()), known.value, threshold):
                    value = simhash(shingles)
                    found.append((doc, m, start, length, np.uint64(value).view(np.int64), shingles.tobytes(), block_keys(value)))
                    size += shingles.nbytes
                    if size > 4_000_000:
                        yield out()
                        found, size = [], 0
        if found:
            yield out()

    seen = scratch.keep(rows.mapInArrow(scan, "doc_id long, m int, start_word long, n_words int, print long, shingles binary, keys array<long>"), "windows")
    index = items.select("item_id", "m", "item_print", F.explode("keys").alias("key"))
    asked = seen.select("doc_id", "m", "start_word", "n_words", "print", "shingles", F.explode("keys").alias("key"))
    few = index.count() <= MOST_BROADCAST
    pairs = asked.join(F.broadcast(index) if few else index, ["m", "key"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    # A pair that agrees in several blocks is taken at the first of them.
    block = F.shiftright("key", 32)
    differs = [F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")).bitwiseAND(F.lit(((1 << _CUTS[k + 1]) - (1 << _CUTS[k])) - (1 << 64 if k == BLOCKS - 1 else 0)))) > FLIPS for k in range(BLOCKS)]
    first = F.lit(True)
    for k in range(BLOCKS):
        first = first & ((block <= k) | differs[k])
    pairs = pairs.where(first)
    held = items.select("item_id", "m", "item_print", "item")
    pairs = pairs.drop("key").join(F.broadcast(held) if few else held, ["item_id", "m", "item_print"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for a, b in zip(batch.column("shingles"), batch.column("item"), strict=True):
                values.append(weighted_jaccard(*(Counter(np.frombuffer(x.as_buffer(), np.uint64).tolist()) for x in (a, b))))
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "item_id", "start_word", "n_words")), pa.array(values, pa.float64())], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

    checked = pairs.select("doc_id", "item_id", "start_word", F.col("n_words").cast("long").alias("n_words"), "shingles", "item").mapInArrow(verify, "doc_id long, item_id long, start_word long, n_words long, similarity double")
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "start_word", "n_words")).alias("b")
    return checked.where(F.col("similarity") >= threshold).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.s")).alias("similarity"), "b.start_word", "b.n_words")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose id holds no benchmark item; rows with a null id stay."""
    bad = contaminated(docs, benchmark, threshold).select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    bad = Scratch(docs.sparkSession).keep(bad, "contaminated")
    return docs.join(F.broadcast(bad) if bad.count() <= MOST_BROADCAST else bad, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
