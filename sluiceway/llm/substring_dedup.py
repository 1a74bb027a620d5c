"""Substring dedup by recompression.

Each document is recompressed in rounds: a run of one symbol gets a name, then every adjacent pair of
a left-type and a right-type symbol gets a name. Names are hashes of what they stand for, so every
document of the corpus uses the same ones, and the type of a symbol is a bit of its name: what a
symbol becomes depends on its neighbours alone, and equal substrings have equal symbols but for a few
at their ends. The least high-level symbol group within any stretch of STRETCH words is an anchor.
Anchors held by two documents reveal where windows can repeat; only windows around them are hashed,
compared over the whole corpus and, where an earlier document starts the same window, removed. An
anchor is compared together with the EDGE words on either side, which all its windows share.

Why no window is missed. A window has `window` words. Round 1 names runs of 2 or 3 equal words (a
longer run is an anchor of its own) and pairs of single words: at either end of the window a cut run
of up to 3 words and one paired word may differ. Round 2 names runs of round-1 symbols (each also an
anchor) and pairs: at either end one symbol of up to 3 words and one more may differ. So the symbols
that lie inside the window less EDGE = 10 words at either end are the same wherever the window
stands, unless a run that is an anchor lies in it. A round-2 symbol has at most 6 words, GROUP = 4
of them fit into any 29 words, and 50 - 2 * 10 = 30 remain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHasher, ascii_words, hot_join, mix

EDGE, GROUP, LONG_RUN = 10, 4, 4
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE, _BASE2 = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


def _name(*parts: np.ndarray | int) -> np.ndarray:
    out = np.uint64(0)
    for p in parts:
        out = (out ^ (p if isinstance(p, np.ndarray) else np.uint64(p))) * _MULT
        out = out ^ (out >> np.uint64(31))
    return mix(out)


def _runs(symbols: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal symbols; cut marks the first symbol of each document."""
    new = np.ones(len(symbols), bool)
    new[1:] = (symbols[1:] != symbols[:-1]) | cut[1:]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(symbols)))


def _pairs(symbols: np.ndarray, cut: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Where a left-type symbol stands before a right-type one: these pairs never overlap."""
    left = (symbols & np.uint64(1)) == 0
    at = np.zeros(len(symbols), bool)
    at[:-1] = left[:-1] & ~left[1:] & ~cut[1:] & single[:-1] & single[1:]
    return at


def recompress(words: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Two rounds over the words of many documents (docs: the document of each word).

    Returns each symbol's name, its first word and the word after its last; and the long runs of both
    rounds as (name, first word, word after the last).
    """
    cut = np.ones(len(words), bool)
    cut[1:] = docs[1:] != docs[:-1]
    symbols, start, end, special = words, np.arange(len(words)), np.arange(1, len(words) + 1), []
    for level in (1, 2):
        first, k = _runs(symbols, cut)
        base, start, end, cut = symbols[first], start[first], end[first + k - 1], cut[first]
        long = k >= (LONG_RUN if level == 1 else 2)
        special.append((_name(base[long], 7 + level), start[long], end[long]))
        symbols = np.where(k > 1, _name(base, k.astype(np.uint64), level), base)
        at = _pairs(symbols, cut, (k == 1) if level == 1 else np.ones(len(k), bool))
        second = np.zeros(len(symbols), bool)
        second[1:] = at[:-1]
        left = np.flatnonzero(at)
        symbols = symbols.copy()
        symbols[left] = _name(symbols[left], symbols[left + 1], 100 + level)
        end = end.copy()
        end[left] = end[left + 1]
        symbols, start, end, cut = symbols[~second], start[~second], end[~second], cut[~second]
    return symbols, start, end, special


def anchors(words: np.ndarray, docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """name, first word, word after the last, is_run: of every anchor of these documents."""
    none = np.zeros(0, np.int64)
    if not len(words):
        return words, none, none, none.astype(bool)
    symbols, start, end, special = recompress(words, docs)
    stretch, chosen = window - 2 * EDGE, none
    n = len(symbols) - GROUP + 1
    if n > 0:
        grams = _name(*(symbols[k : k + n] for k in range(GROUP)))
        first, after = start[:n], end[GROUP - 1 :]
        whole = docs[first] == docs[after - 1]
        grams, first, after = grams[whole], first[whole], after[whole]
        if len(grams):
            # The least name within the stretch that starts at each word, by a table of minima over 2^k groups.
            p = np.arange(len(words))
            low, high = np.searchsorted(first, p), np.searchsorted(after, p + stretch, side="right")
            # Stretches inside the edges of some window of one document.
            begins, ends = np.searchsorted(docs, docs, side="left"), np.searchsorted(docs, docs, side="right")
            fits = (high > low) & (p - EDGE >= begins) & (p + stretch + EDGE <= ends)
            low, count = low[fits], (high - low)[fits]
            bits = np.uint64(max(1, int(len(grams)).bit_length()))
            packed = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
            best, level, table = np.full(len(low), np.iinfo(np.uint64).max), 0, packed
            while len(low) and (1 << level) <= count.max():
                width = 1 << level
                here = (count >= width) & (count < 2 * width)
                best[here] = np.minimum(table[low[here]], table[low[here] + count[here] - width])
                if len(table) <= width:
                    break
                table = np.minimum(table[:-width], table[width:])
                level += 1
            chosen = np.unique(best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        else:
            first = after = none
    else:
        grams, first, after = words[:0], none, none
    name = np.concatenate([grams[chosen], *(s[0] for s in special)])
    begin = np.concatenate([first[chosen], *(s[1] for s in special)])
    stop = np.concatenate([after[chosen], *(s[2] for s in special)])
    return name, begin, stop, np.arange(len(name)) >= len(chosen)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.multiply.accumulate(np.full(n - 1, base, np.uint64)) if n > 1 else 1
    return out


def window_hashes(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every window of so many words: polynomials by prefix sums, modulo 2^64."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    found = []
    for base in (_BASE, _BASE2):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(base, len(words)))])
        found.append(mix((sums[window:] - sums[:-window]) * _powers(pow(base, -1, 1 << 64), n)))
    return found[0], found[1]


def in_context(name: np.ndarray, words: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Anchor names joined with the EDGE words on either side, which every window around the anchor holds."""
    low, high = begin - EDGE, stop + EDGE
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, len(words)))])
    return _name(name, (sums[high] - sums[low]) * _powers(pow(_BASE, -1, 1 << 64), len(words) + 1)[low])


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256 for each row of docs (doc_id long, text string).

    Every word covered by a window of `window` words whose sequence also starts in a document with a
    smaller doc_id is removed; windows are judged on the input. kept_text holds the kept words joined
    by one space and is null where nothing was removed (the text itself then has them). A null or
    blank text has no words; texts of fewer than `window` words lose nothing. Rows with a null doc_id
    are dropped; rows that share an id are one document to the rule and keep a row each. Other
    columns are ignored. An empty table gives an empty table. window is at least 50. Windows are told
    apart by a 64-bit and a 32-bit hash.
    """
    if window < 2 * EDGE + 7 * GROUP + 2:
        raise ValueError("windows under 50 words may have no anchor")
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            ids, held, lengths, digests, words, total = [], [], [], [], [], 0

            def out() -> pa.RecordBatch:
                doc = np.array(ids, np.int64)
                size = np.array(lengths, np.int64)
                flat = np.concatenate(words)
                of = np.repeat(np.arange(len(ids)), size)
                name, begin, stop, is_run = anchors(flat, of, window)
                owner = of[begin] if len(begin) else begin
                base = np.cumsum(size) - size
                keep = (size[owner] >= window) & (is_run | ((begin - EDGE >= base[owner]) & (stop + EDGE <= base[owner] + size[owner])))
                name, begin, stop, owner, is_run = name[keep], begin[keep], stop[keep], owner[keep], is_run[keep]
                name = name.copy()
                name[~is_run] = in_context(name[~is_run], flat, begin[~is_run], stop[~is_run])
                # The windows that hold the anchor inside their edges, or overlap a long run.
                low = np.where(is_run, begin - window + 1, stop - window + EDGE) - base[owner]
                high = np.where(is_run, stop - 1, begin - EDGE) - base[owner]
                low, high = np.maximum(low, 0), np.minimum(high, size[owner] - window)
                n = len(ids)
                some = low <= high
                m = int(some.sum())
                return pa.record_batch(
                    [
                        pa.concat_arrays([pa.array(doc), pa.array(doc[owner[some]])]),
                        pa.concat_arrays([pa.array(size), pa.nulls(m, pa.int64())]),
                        pa.concat_arrays([pa.array(digests, pa.string()), pa.nulls(m, pa.string())]),
                        pa.concat_arrays([pa.array(held, pa.int64()), pa.array(np.array(held, np.int64)[owner[some]])]),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), _signed(name[some])]),
                        pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(low[some].astype(np.int32))]),
                        pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(high[some].astype(np.int32))]),
                    ],
                    ["doc_id", "n_words", "sha", "text_hash", "anchor", "low", "high"],
                )

            for doc, text, text_hash in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                parts = ascii_words(text.as_py(), lower=False)
                ids.append(doc)
                held.append(text_hash)
                lengths.append(len(parts))
                digests.append(hashlib.sha256(b" ".join(parts)).hexdigest())
                words.append(hasher.of(parts))
                total += len(parts)
                if total > 500_000:
                    yield out()
                    ids, held, lengths, digests, words, total = [], [], [], [], [], 0
            if ids:
                yield out()

    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    first = scratch.keep(hashed.mapInArrow(sketch, "doc_id long, n_words long, sha string, text_hash long, anchor long, low int, high int"), "sketch")
    whole = first.where("anchor is null").select("doc_id", "n_words", "sha", "text_hash")
    spots = first.where("anchor is not null").select("anchor", "doc_id", "text_hash", "low", "high")
    # A text that an earlier document has as a whole needs no windows of its own: all its words go.
    owner = whole.where(F.col("n_words") >= window).groupBy("sha").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("sha", "owner")
    copies = scratch.keep(whole.join(owner, "sha").where("doc_id > owner").select("doc_id", "text_hash").distinct(), "copies")
    shared = spots.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("least < last").select("anchor", "n")
    shared = scratch.keep(shared, "shared")
    around = hot_join(spots, shared, ["anchor"], spots.count()).select("doc_id", "text_hash", "low", "high").distinct()
    around = around.join(copies, ["doc_id", "text_hash"], "left_anti")
    around = around.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("around"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            cols, n = [[], [], [], [], []], 0
            for doc, text_hash, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                words = hasher.of(ascii_words(text.as_py(), lower=False))
                h1, h2 = window_hashes(words, window)
                low = spans.values.field("low").to_numpy()
                high = spans.values.field("high").to_numpy()
                steps = np.zeros(len(h1) + 1, np.int32)
                np.add.at(steps, low, 1)
                np.add.at(steps, high + 1, -1)
                at = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
                for c, x in zip(cols, (h1[at].view(np.int64), (h2[at] >> np.uint64(32)).astype(np.uint32).view(np.int32), np.full(len(at), doc, np.int64), np.full(len(at), text_hash, np.int64), at.astype(np.int32)), strict=True):
                    c.append(x)
                n += len(at)
                if n > 200_000:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in cols], ["h1", "h2", "doc_id", "text_hash", "pos"])
                    cols, n = [[], [], [], [], []], 0
            if n:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in cols], ["h1", "h2", "doc_id", "text_hash", "pos"])

    suspects = scratch.keep(hashed.join(around, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "around"), "suspects")
    windows = scratch.keep(suspects.mapInArrow(hashes, "h1 long, h2 int, doc_id long, text_hash long, pos int"), "windows")
    earliest = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("least < last").select("h1", "h2", "least", "n")
    earliest = scratch.keep(earliest, "earliest")
    repeats = hot_join(windows, earliest, ["h1", "h2"], windows.count()).where("doc_id > least").groupBy("doc_id", "text_hash").agg(F.collect_list("pos").alias("at"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, removed, kept_text = [], [], [], []
            for doc, text_hash, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                words = ascii_words(text.as_py(), lower=False)
                steps = np.zeros(len(words) + 1, np.int32)
                at = at.values.to_numpy()
                np.add.at(steps, at, 1)
                np.add.at(steps, at + window, -1)
                gone = np.cumsum(steps[:-1]) > 0
                ids.append(doc)
                held.append(text_hash)
                removed.append(int(gone.sum()))
                kept_text.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode("utf-8", "replace"))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(held, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept_text, pa.string())], ["doc_id", "text_hash", "n_removed", "kept_text"])

    stripped = suspects.select("doc_id", "text_hash", "text").join(repeats, ["doc_id", "text_hash"]).mapInArrow(strip, "doc_id long, text_hash long, n_removed long, kept_text string")
    gone = stripped.unionByName(copies.select("doc_id", "text_hash", F.lit(-1).cast("long").alias("n_removed"), F.lit("").alias("kept_text"))).dropDuplicates(["doc_id", "text_hash"])
    found = whole.join(gone, ["doc_id", "text_hash"], "left")
    return found.select(
        "doc_id",
        "n_words",
        F.when(F.col("n_removed") == -1, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        "kept_text",
        F.when(F.col("kept_text").isNull(), F.col("sha")).otherwise(F.sha2("kept_text", 256)).alias("kept_sha256"),
    )
