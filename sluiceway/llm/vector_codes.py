"""Compression of vectors to short codes by product quantisation, with exact assignment by annular norm pruning.

Components become integers floor(1024 * x), vectors are cut into equal parts, and the codebook of each part
position is refined over all vectors: tasks assign parts to entries and hand on one sum for each used entry,
Spark adds these up, and the next codebooks, which are bounded by entries x length, go back with the tasks.

An assignment sorts the entries by norm. By the triangle inequality an entry that is nearer than the best one
so far has a norm within the best distance of the point's, so a binary search gives the interval of entries
that can still win, ends included. Entries are evaluated in exact integers outwards from the point's own
norm, the interval shrinks with the best distance, and ties go to the lower index.

Vectors that are null or hold null or non-finite components are left out. Shorter vectors and lengths that
the parts do not divide are filled up with zeros, which changes no distance between them. Repeated rows and
ids count as often as they stand there; null ids come last among the first entries, equal ids go by their
components. With fewer vectors than entries, the codebooks have as many entries as there are vectors; an empty
table gives an empty table. Components beyond a limit of 2**27 and more (at 64 components; |x| >= 131,072) are
set to it, so that a squared distance fits 63 bits. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SCALE = 1024
#: Points whose interval is searched at once, and entries evaluated on each side of it in one step.
BATCH, STEP = 4096, 8
#: Tables of one row for each label are broadcast up to this many rows.
FEW_LABELS = 1_000_000


@dataclass(frozen=True)
class Codebooks:
    """entries[part, index] are integer vectors."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class Annuli:
    """The entries of one codebook by norm."""

    def __init__(self, book: np.ndarray):
        norms = np.sqrt((book * book).sum(axis=1).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.book = norms[self.order], book[self.order]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and exact squared distance of each point."""
        index, distance = np.empty(len(points), np.int64), np.empty(len(points), np.int64)
        for at in range(0, len(points), BATCH):
            index[at : at + BATCH], distance[at : at + BATCH] = self._nearest(points[at : at + BATCH])
        return index, distance

    def _nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, n = len(self.norms), len(points)
        far = np.iinfo(np.int64).max
        radius = np.sqrt((points * points).sum(axis=1).astype(np.float64))
        best, index = np.full(n, far), np.full(n, k)
        left = np.searchsorted(self.norms, radius)  # entries in [left, right) have been evaluated
        right = left.copy()
        low, high = np.zeros(n, np.int64), np.full(n, k)
        active = np.arange(n)
        while len(active):
            steps = np.arange(STEP)
            at = np.concatenate([left[active, None] - 1 - steps, right[active, None] + steps], axis=1)
            inside = (at >= low[active, None]) & (at < high[active, None])
            at = at.clip(0, k - 1)
            gap = self.book[at] - points[active, None, :]
            d = np.where(inside, (gap * gap).sum(axis=2), far)
            least = d.min(axis=1)
            first = np.where(d == least[:, None], np.where(inside, self.order[at], k), k).min(axis=1)
            nearer = (least < best[active]) | ((least == best[active]) & (first < index[active]))
            won = active[nearer]
            best[won], index[won] = least[nearer], first[nearer]
            left[active] = np.maximum(left[active] - STEP, low[active])
            right[active] = np.minimum(right[active] + STEP, high[active])
            reach = np.sqrt(best[active].astype(np.float64))
            reach += 1e-9 * (1 + reach + radius[active])  # floats round; the ends of the annulus belong to it
            low[active] = np.searchsorted(self.norms, radius[active] - reach, side="left")
            high[active] = np.searchsorted(self.norms, radius[active] + reach, side="right")
            active = active[(left[active] > low[active]) | (right[active] < high[active])]
        return index, best


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def integer_vectors(vectors: DataFrame, parts: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the usable vectors, v integers of one length, a multiple of `parts`; that length."""
    kept = vectors.where(usable(F.col("embedding"))).select("vec_id", "label", "embedding")
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    length = -(-longest // parts) * parts
    limit = float(2 ** int((62 - math.log2(max(1, length))) / 2 - 1))
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(limit)), F.lit(-limit))).cast("int"))
    filled = F.concat(whole, F.array_repeat(F.lit(0), F.lit(length) - F.size("embedding")))
    return scratch.keep(kept.select("vec_id", "label", filled.alias("v")), "vectors"), length


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), length)


def train(vectors: DataFrame, length: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks:
    """Codebooks that start as the parts of the first vectors by id, refined in so many rounds over all vectors."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, length // parts).transpose(1, 0, 2)
    for _ in range(rounds if len(first) else 0):

        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            rings, total, count = [Annuli(b) for b in books], np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                points = matrix(batch.column(0), length).reshape(batch.num_rows, parts, length // parts)
                for p, ring in enumerate(rings):
                    index, _ = ring.nearest(points[:, p])
                    np.add.at(total[p], index, points[:, p])
                    count[p] += np.bincount(index, minlength=count.shape[1])
            part, entry = np.nonzero(count)
            yield pa.RecordBatch.from_pydict({"part": part.astype(np.int32), "entry": entry.astype(np.int32), "n": count[part, entry], "sums": pa.array(list(total[part, entry]), pa.list_(pa.int64()))})

        told = vectors.select("v").mapInArrow(sums, "part int, entry int, n long, sums array<long>")
        spread = told.select("part", "entry", "n", F.posexplode("sums").alias("at", "x"))
        means = spread.groupBy("part", "entry", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
        books = books.copy()
        for r in means.collect():  # one row for each component of the codebooks
            books[r.part, r.entry, r["at"]] = int(r.x) // r.n
    return Codebooks(books)


def encode(vectors: DataFrame, length: int, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error (squared distances summed over the parts)."""
    entries = books.entries
    parts = len(entries)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = [Annuli(b) for b in entries]
        for batch in batches:
            points = matrix(batch.column("v"), length).reshape(batch.num_rows, parts, length // parts)
            found = [ring.nearest(points[:, p]) for p, ring in enumerate(rings)]
            code = ["".join(f"{x:02x}" for x in row) for row in zip(*(index.tolist() for index, _ in found), strict=True)]
            error = sum((d for _, d in found), np.zeros(batch.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(codes, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of all usable vectors."""
    scratch = scratch or Scratch(vectors.sparkSession)
    kept, length = integer_vectors(vectors, parts, scratch)
    books = train(kept, length, parts, entries, rounds)
    coded = scratch.keep(encode(kept, length, books), "codes")
    errors = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    few = errors.count() <= FEW_LABELS
    joined = coded.join(F.broadcast(errors) if few else errors, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
