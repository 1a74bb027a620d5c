"""Mixing sources to target weights by hash thresholds.

Every document has a 60-bit hash of its id. A source that is to give a budget of words gives the documents
whose hash lies below a threshold. The thresholds come from histograms: words are summed by source and the
hash's first bits, the bucket in which the running sum passes the budget is found, and only this bucket is
counted again by the next bits, until it holds one hash. Nothing is sorted but at most 2**LEVEL_BITS sums of
a source, and thresholds are nested: a smaller budget takes a subset of the documents of a larger one.

A budget above a source's size takes whole copies of all its documents first. The document on the threshold
gives just the words that are still wanted, so that a source misses its target by less than a word; documents
that share its hash (repeated ids) share these words by size.

Null texts have no words, a null source is a source of its own, null ids hash as the empty text. Repeated rows
count as often as they stand there. An empty table gives an empty table. Only doc_id, text and source are
read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh

#: Bits of a document's hash, and of these the ones that one histogram tells apart.
HASH_BITS, LEVEL_BITS = 60, 12
#: Tables of one row for each source are broadcast up to this many rows.
FEW_SOURCES = 100_000

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def place(doc_id: Column) -> Column:
    """The document's hash, as a number from 0 to 2**60 - 1."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def by_source(rows: DataFrame, sources: DataFrame, on: Column | None = None) -> DataFrame:
    """rows joined with what `sources` has for their source, which may be null; its column is named `of`."""
    few = sources.count() <= FEW_SOURCES
    match = F.col("source").eqNullSafe(F.col("of"))
    return rows.join(F.broadcast(sources) if few else sources, match if on is None else match & on).drop("of")


def source_targets(totals: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(source, source_size) -> also target: `share` of all sizes dealt by weight, at most `most` times a source's size.

    Weights repeat over the sources in the order of code points, null last. What a source cannot take is dealt
    again over the others by weight: with those that are full left out, the level (words for each unit of
    weight) rises until it fills no other source. Every round sums the table once.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * F.lit(float(most)))
    level = -1.0
    while True:
        full = F.col("most") < F.lit(level) * F.col("weight")
        got = weighed.agg(F.sum("source_size"), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        everything, filled, open_weight = got[0] or 0, got[1] or 0.0, got[2]
        raised = (share * everything - filled) / open_weight if open_weight else float("inf")
        if raised <= level or not open_weight:
            break
        level = raised
    return weighed.withColumn("target", F.least(F.lit(level) * F.col("weight"), F.col("most"))).drop("weight", "most")


def thresholds(rows: DataFrame, budgets: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, size, h) rows and (of, budget), each budget below its source's size -> (of, threshold, wanted, mass).

    Documents below the threshold are taken whole and those on it, which have `mass` words, give `wanted` of
    them. A source without words has no row.
    """
    found, shift = budgets.select("of", "budget", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("bucket")), HASH_BITS
    while shift:
        inside = by_source(rows, found.withColumnRenamed("bucket", "above"), F.shiftright("h", shift) == F.col("above") if shift < HASH_BITS else None)
        shift -= LEVEL_BITS
        counted = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("mass"), F.first("budget").alias("budget"), F.first("before").alias("before"), F.min("h").alias("low"), F.max("h").alias("high"))
        upto = F.col("before") + F.sum("mass").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        edge = counted.withColumn("upto", upto).where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("mass") <= F.col("budget")))
        found = edge.select(F.col("source").alias("of"), "budget", (F.col("upto") - F.col("mass")).alias("before"), "bucket", "mass", "low", "high")
        found = scratch.keep(found.coalesce(1), f"edge-{shift}")
        if found.where("low < high").isEmpty():
            break
    return found.select("of", F.col("low").alias("threshold"), (F.col("budget") - F.col("before")).alias("wanted"), "mass")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: the words that the mix takes of each document, copies counted."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), place(F.col("doc_id")).alias("h")), "sizes")
    totals = scratch.keep(rows.groupBy("source").agg(F.sum("size").alias("source_size")).coalesce(1), "totals")
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    planned = source_targets(totals, weights, share, most).withColumn("copies", copies)
    planned = planned.withColumn("budget", F.floor(F.col("target") - F.col("copies") * F.col("source_size"))).withColumnRenamed("source", "of")
    planned = scratch.keep(planned.coalesce(1), "targets")
    edges = thresholds(rows, planned.select("of", "budget"), scratch)
    plan = planned.alias("p").join(edges.alias("e"), F.col("p.of").eqNullSafe(F.col("e.of")), "left").select("p.*", "threshold", "wanted", "mass")
    part = F.expr("CASE WHEN h < threshold THEN size WHEN h = threshold THEN CAST(CAST(size AS DECIMAL(18, 0)) * wanted DIV mass AS BIGINT) ELSE 0L END")
    taken = (F.col("copies") * F.col("size") + part).alias("taken")
    return by_source(rows, scratch.keep(plan.coalesce(1), "plan")).select("doc_id", "source", "size", "source_size", "target", taken)


def mixed_texts(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of docs that the plan of mix() takes, a row for each copy; of a part, its first words. doc_id must be unique."""
    copy, size, taken, whole = (fresh(c, docs.columns) for c in ("copy", "size", "taken", "whole"))
    want = plan.where("taken > 0").select("doc_id", F.col("size").alias(size), F.col("taken").alias(taken))
    rows = docs.join(want, "doc_id").withColumn(copy, F.explode(F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int"))))
    left = (F.col(taken) - (F.col(copy) - 1) * F.col(size)).cast("int")
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORDS})")), F.lit(1), left), " ")
    return rows.withColumn(whole, left >= F.col(size)).withColumn("text", F.when(F.col(whole), F.col("text")).otherwise(words)).select(*docs.columns)
