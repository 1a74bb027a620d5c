"""Lexical retrieval packing: a sharded BM25 index finds unused neighbours that fill a seed's window.

Token statistics (document frequencies, mean length) are counted over all documents. Documents are dealt
by content: each gets the tokens that weigh most in it, the whole table is range-partitioned and sorted
by these, and runs of a bounded number of tokens are the shards, so that documents about the same lie in
the same shard. A seed document asks its shard's index, by all its tokens, for its nearest unused
documents, which follow it until the window is full; what is cut off the last one opens the next window
as its seed, so every window of a shard but its last is full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, trim
from .tokens import forget, load

WINDOW, END = 4096, 2
#: Tokens of a shard, at least, unless its partition ends.
SHARD_TOKENS = 2_000_000
#: Tokens by which a document is dealt, and the share of a shard's documents from which a token's weights are kept dense.
DEALT_BY, DENSE = 3, 0.1
#: Shards of a task that have a number of their own in sequence_id.
TASK_SHARDS = 4096
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bm25 float"


@dataclass
class Statistics:
    """Of all documents: the inverse document frequency of each token (0: no other document has it) and the mean length."""

    idf: np.ndarray
    mean: float

    def weights(self, token: np.ndarray, tf: np.ndarray, length: np.ndarray | float) -> np.ndarray:
        """BM25 of tokens that occur tf times in documents of these lengths."""
        return self.idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(self.mean, 1e-9)))


def distinct(ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token of a document once, in any order, and how often it occurs there; place has room for a number of each token."""
    place[ids] = np.arange(len(ids))
    tf = np.bincount(place[ids])
    at = np.flatnonzero(tf)
    return ids[at], tf[at]


def heaviest(ids: np.ndarray, stats: Statistics, place: np.ndarray | None = None) -> list[int]:
    """The DEALT_BY tokens that weigh most in a document, -1 where it has fewer; of equal weights the smaller token."""
    token, tf = distinct(ids, np.empty(len(stats.idf), np.int64) if place is None else place)
    weight = stats.weights(token, tf, len(ids))
    if len(weight) > DEALT_BY:
        top = np.flatnonzero(weight >= np.partition(weight, -DEALT_BY)[-DEALT_BY])
        token, weight = token[top], weight[top]
    best = np.lexsort((token, -weight))[:DEALT_BY]
    return [int(token[k]) if weight[k] > 0 else -1 for k in best] + [-1] * (DEALT_BY - len(best))


class ShardIndex:
    """BM25 weights of the documents of one shard: postings of rare tokens, a dense table of frequent ones."""

    def __init__(self, docs: list[np.ndarray], stats: Statistics):
        self.n = len(docs)
        flat = np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(self.n, dtype=np.int64), [len(d) for d in docs])
        known = stats.idf[flat] > 0
        cells, tf = np.unique(flat[known] << 32 | owner[known], return_counts=True)
        token, doc = cells >> 32, cells & 0xFFFFFFFF
        weight = stats.weights(token, tf, np.array([len(d) for d in docs], np.float64)[doc]).astype(np.float32)
        tokens, at, held = np.unique(token, return_inverse=True, return_counts=True)
        frequent = held > max(DENSE * self.n, 1)
        place = np.cumsum(frequent) - 1
        many = frequent[at]
        self.dense = np.zeros((self.n, int(frequent.sum())), np.float32)
        self.dense[doc[many], place[at[many]]] = weight[many]
        self.doc, self.weight = doc[~many], weight[~many]
        low = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.where(frequent, 0, held))])
        self.low, self.high = low[:-1], low[1:]
        # The tokens of each document, by their places in `tokens`.
        order = np.argsort(doc, kind="stable")
        self.terms, self.bounds = at[order], np.searchsorted(doc[order], np.arange(self.n + 1))
        self.frequent, self.place = frequent, place

    def scores(self, doc: int) -> np.ndarray:
        """Every document's score for the tokens of this one."""
        terms = self.terms[self.bounds[doc] : self.bounds[doc + 1]]
        often = self.frequent[terms]
        asked = np.zeros(self.dense.shape[1], np.float32)
        asked[self.place[terms[often]]] = 1
        out = (self.dense @ asked).astype(np.float64)
        low, size = self.low[terms[~often]], (self.high - self.low)[terms[~often]]
        if len(size):
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) + np.repeat(low - (ends - size), size)
            out += np.bincount(self.doc[at], self.weight[at], self.n)
        return out


def best_first(score: np.ndarray) -> Iterator[int]:
    """Places in falling order of score, of equal scores the first; sorts no more than it is asked for."""
    most = 64
    if len(score) > 4 * most:
        bar = np.partition(score, len(score) - most)[len(score) - most]
        top = np.flatnonzero(score > bar)
        yield from top[np.argsort(-score[top], kind="stable")].tolist()
        rest = np.flatnonzero(score <= bar)
    else:
        rest = np.arange(len(score))
    yield from rest[np.argsort(-score[rest], kind="stable")].tolist()


def fill(lengths: list[int], index: ShardIndex, window: int) -> list[tuple[int, int, int, int, int, float]]:
    """(document, start, length, sequence, offset, score) of every piece of a shard."""
    pieces, unused = [], np.ones(len(lengths), bool)
    sequence = offset = following = 0
    seed, rest = -1, 0  # the seed of this window and what is left of it

    def place(doc: int, start: int, score: float) -> int:
        """Puts what fits of the document from start on; the ids that are left."""
        nonlocal sequence, offset
        length = min(lengths[doc] - start, window - offset)
        pieces.append((doc, start, length, sequence, offset, score))
        offset += length
        if offset == window:
            sequence, offset = sequence + 1, 0
        return lengths[doc] - start - length

    while True:
        if rest == 0:
            while following < len(lengths) and not unused[following]:
                following += 1
            if following == len(lengths):
                break
            seed, rest = following, lengths[following]
            unused[seed] = False
        rest = place(seed, lengths[seed] - rest, 0.0)
        if rest or offset == 0:
            continue
        # The window has room: the seed's nearest unused documents, then any.
        score = np.where(unused, index.scores(seed), -1.0)
        for near in best_first(score):
            if score[near] <= 0:
                break
            unused[near] = False
            left = place(near, 0, float(score[near]))
            if left or offset == 0:
                seed, rest = near, left
                break
    return pieces


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all documents (doc_id, text) in sequences of at most `window` ids; see PIECES.

    A document's ids are those of its text and `end`; each lies in one piece. ids are little-endian
    unsigned 32-bit. A piece lies at `offset` of its sequence, without gaps from 0; start counts the
    document's ids before it; bm25 is its document's score for the seed (0 for seeds and their rests).
    A null text is empty (one id, `end`); a null doc_id is dropped; repeated rows are documents of their
    own; other columns are ignored; an empty table has no pieces. Of equal scores the document that
    comes first in its shard's order (heaviest tokens, hash of the ids, doc_id) comes first; rows that
    are equal in all of these have equal ids.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, then rows of the task's document frequencies."""
        trim()
        tokens = load(tokenizer)
        last = np.array([end], tokens.dtype).tobytes()
        df = np.zeros(tokens.tokenizer.get_vocab_size(), np.int64)
        place = np.empty(len(df), np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                coded = [x + last for x in tokens.encode(part.column(1).to_pylist())]
                n = part.num_rows
                for x in coded:
                    df[distinct(np.frombuffer(x, tokens.dtype), place)[0]] += 1
                yield pa.record_batch([part.column(0), pa.array(coded, pa.binary()), pa.array([len(x) // tokens.dtype.itemsize for x in coded], pa.int64()), pa.nulls(n, pa.int64())], ["doc_id", "ids", "n", "token"])
        seen = np.flatnonzero(df)
        if len(seen):
            yield pa.record_batch([pa.nulls(len(seen), pa.int64()), pa.nulls(len(seen), pa.binary()), pa.array(df[seen]), pa.array(seen)], ["doc_id", "ids", "n", "token"])

    coded = scratch.keep(rows.mapInArrow(tokenize, "doc_id long, ids binary, n long, token long"), "tokens")
    total = coded.where("doc_id is not null").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    # One row for each token of the vocabulary at most.
    frequent = coded.where("doc_id is null").groupBy("token").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(max([0, *(r.token for r in frequent)]) + 1)
    for r in frequent:
        df[r.token] = r.n
    idf = np.where(df > 1, np.log1p((total.docs - df + 0.5) / (df + 0.5)), 0.0)
    stats = spark.sparkContext.broadcast(Statistics(idf, total.tokens / max(1, total.docs)))
    keys = [f"k{k}" for k in range(DEALT_BY)]

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        """The ids of each row; every document has at least one, so the bytes tell how wide an id is."""
        cells = (x.as_buffer() for x in batch.column("ids"))
        return [np.frombuffer(x, f"<u{len(x) // n}") for x, n in zip(cells, batch.column("n").to_pylist(), strict=True)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        place = np.empty(len(stats.value.idf), np.int64)
        for batch in batches:
            found = np.array([heaviest(x, stats.value, place) for x in arrays(batch)], np.int32).reshape(-1, DEALT_BY)
            yield pa.record_batch([*batch.columns, *(pa.array(found[:, k]) for k in range(DEALT_BY))], [*batch.schema.names, *keys])

    dealt = coded.where("doc_id is not null").select("doc_id", "ids", "n").mapInArrow(deal, f"doc_id long, ids binary, n long, {', '.join(f'{k} int' for k in keys)}")
    dealt = scratch.keep(dealt.withColumn("salt", F.xxhash64("ids", "doc_id")), "dealt")
    scratch.free("tokens")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs each run of shard_tokens ids of the task's sorted rows."""
        forget()
        trim()
        shard, sequences, ids, texts, size = 0, TaskContext.get().partitionId() * TASK_SHARDS << 32, [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal shard, sequences
            pieces = fill([len(x) for x in texts], ShardIndex(texts, stats.value), window)
            columns = [
                pa.array([ids[p[0]] for p in pieces], pa.int64()),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([texts[p[0]][p[1] : p[1] + p[2]].astype("<u4").tobytes() for p in pieces], pa.binary()),
                pa.array([len(texts[p[0]]) for p in pieces], pa.int64()),
                pa.array([sequences + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
                pa.array([p[5] for p in pieces], pa.float32()),
            ]
            # The shard stands in the high bits; a task's shards beyond TASK_SHARDS go on numbering in the last.
            shard += 1
            sequences = sequences + pieces[-1][3] + 1 if shard >= TASK_SHARDS else (sequences >> 32) + 1 << 32
            return pa.record_batch(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bm25"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), arrays(batch), strict=True):
                ids.append(doc)
                texts.append(text)
                size += len(text)
                if size >= shard_tokens:
                    yield packed()
                    ids, texts, size = [], [], 0
        if ids:
            yield packed()

    order = [*keys, "salt", "doc_id"]
    return dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids", "n").mapInArrow(shards, PIECES)
