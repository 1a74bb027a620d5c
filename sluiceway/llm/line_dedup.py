"""Line dedup with DataFrame functions only: range-partitioned hashes, first occurrences, keep bitmaps.

Line hashes are range-partitioned together with a block of documents, so the lines of one very
common hash lie in several partitions. Each partition is sorted by hash, document and position and
streamed once for the first document of a hash and block; a partial aggregate then merges the blocks
of a hash. What a document loses comes back as runs of dropped positions (a run-length coded
bitmap), never as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, hot_join

#: White space that a key sheds at its ends.
BLANKS = " \t\n\x0b\x0c\r"
#: Documents for each of the blocks into which the lines of one hash are dealt.
BLOCK_DOCS = 5_000


def lines_of(text: Column) -> Column:
    """The lines of a text; one empty line where there is none."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _runs(at: Column) -> Column:
    """Sorted positions -> runs: a position whose predecessor is absent opens one, one whose successor is absent closes it."""
    opens = F.filter(at, lambda p, i: (i == 0) | (F.get(at, i - 1) != p - 1))
    closes = F.filter(at, lambda p, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != p + 1))
    return F.arrays_zip(opens.alias("first"), closes.alias("last"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, text_hash, dropped: the runs (first, last) of line positions that a document loses.

    A line whose key has at least min_chars code points and lies in two documents or more is dropped
    everywhere but in the smallest doc_id that holds it. Documents that lose nothing have no row. A
    null or empty text is one empty line; a null doc_id is ignored. Rows that share an id are one
    document to the rule, and text_hash tells their bitmaps apart. Keys are told apart by two 64-bit
    hashes. Other columns are ignored; an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    blocks = 1 + rows.count() // BLOCK_DOCS
    lines = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    hashed = keyed.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"))
    placed = hashed.repartitionByRange("h1", "h2", "block")
    streamed = placed.withColumn("first_here", F.first("doc_id").over(Window.partitionBy("h1", "h2", "block").orderBy("doc_id", "pos")))
    spots = streamed.groupBy("h1", "h2", "block", "doc_id", "text_hash").agg(F.min("first_here").alias("first_here"), F.collect_set("pos").alias("at"))
    spots = scratch.keep(spots, "spots")
    firsts = spots.groupBy("h1", "h2").agg(F.min("first_here").alias("owner"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("owner < last").select("h1", "h2", "owner", "n")
    firsts = scratch.keep(firsts, "firsts")
    lost = hot_join(spots, firsts, ["h1", "h2"], spots.count()).where("doc_id > owner").select("doc_id", "text_hash", F.explode("at").alias("pos"))
    positions = lost.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    return scratch.last(positions.select("doc_id", "text_hash", _runs(F.col("at")).alias("dropped")), "bitmaps")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text; every row and column of docs stays.

    Columns of docs with these names are replaced; no other name is reserved.
    """
    new = ["n_lines", "n_dropped", "kept_text"]
    own = [c for c in docs.columns if c.lower() not in new]
    doc, mark, gone, parts, hashed = (fresh(x, own, new) for x in ("_doc", "_hash", "_dropped", "_lines", "_text_hash"))
    marks = bitmaps.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(mark), F.col("dropped").alias(gone))
    text, dropped, kept_columns = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col(gone), [F.col(f"`{c}`") for c in own]
    joined = docs.select(*kept_columns, F.xxhash64(F.col("text").cast("string")).alias(hashed)).join(marks, (F.col("doc_id") == F.col(doc)) & (F.col(hashed) == F.col(mark)), "left")
    joined = joined.withColumn(parts, lines_of(text))
    # The kept stretches lie between the dropped runs.
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda r: r["last"] + 1))
    ends = F.concat(F.transform(dropped, lambda r: r["first"]), F.array(F.size(parts)))
    stretches = F.zip_with(starts, ends, lambda a, b: F.slice(F.col(parts), a + 1, b - a))
    kept = F.when(dropped.isNull(), text).otherwise(F.array_join(F.flatten(stretches), "\n"))
    lost = F.aggregate(dropped, F.lit(0), lambda s, r: s + r["last"] - r["first"] + 1)
    return joined.select(*kept_columns, F.size(parts).cast("long").alias("n_lines"), F.coalesce(lost, F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text (see keep_bitmaps and apply_bitmaps)."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars))
