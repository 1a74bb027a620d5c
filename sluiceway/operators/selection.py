"""The least k of each group by a hash, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import kept

#: Hexadecimal digits of a hash that one count tells apart.
DIGITS = 3
#: Rows of one for each group that are broadcast, at most.
FEW_GROUPS = 100_000


def of_group(rows: DataFrame, groups: DataFrame, how: str = "inner", on: Column | None = None) -> DataFrame:
    """rows (g, ...) joined with groups (of, ...), null being a group of its own."""
    few = groups.count() <= FEW_GROUPS
    match = F.col("g").eqNullSafe(F.col("of"))
    return rows.join(F.broadcast(groups) if few else groups, match if on is None else match & on, how).drop("of")


def hash_thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, h) and (of, k) -> (of, threshold): the least hash up to which a group has k rows or more; none where it has fewer.

    Rows are counted by the first digits of their hash, the prefix in which the running count reaches k is
    found, and only its rows are counted by the next digits, until a prefix holds one hash.
    """
    found, digits = wanted.select("of", "k", F.lit(0).cast("long").alias("before"), F.lit("").alias("prefix")), 0
    while True:
        inside = of_group(rows, found.withColumnRenamed("prefix", "above"), on=F.startswith("h", F.col("above")))
        digits += DIGITS
        counted = inside.groupBy("g", F.substring("h", 1, digits).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.first("k").alias("k"), F.first("before").alias("before"), F.min("h").alias("low"), F.max("h").alias("high"))
        # At most 16 ** DIGITS rows of a group.
        upto = F.col("before") + F.sum("n").over(Window.partitionBy("g").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0))
        edge = counted.withColumn("upto", upto).where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))
        found = kept(edge.select(F.col("g").alias("of"), "k", (F.col("upto") - F.col("n")).alias("before"), "prefix", "low", "high").coalesce(1), f"edge-{digits}")
        if found.where("low < high").isEmpty():
            return found.select("of", F.col("low").alias("threshold"))


def holdout(samples: DataFrame, corpus_id: str, by: str = "email_type", sample: str = "sample_id", share: float = 0.2, least: int = 5) -> DataFrame:
    """samples with is_holdout: of each type the max(least, ceil(share n)) samples with the least hashes.

    Rows that repeat a sample are on one side together. A null type is a type of its own.
    """
    h = F.sha2(F.concat_ws("|", F.lit(corpus_id), F.col(sample).cast("string")), 256)
    rows = kept(samples.select(F.col(by).alias("g"), h.alias("h")), "hashes")
    sizes = rows.groupBy(F.col("g").alias("of")).agg(F.greatest(F.lit(least), F.ceil(F.count(F.lit(1)) * share)).cast("long").alias("k"))
    edges = hash_thresholds(rows, kept(sizes.coalesce(1), "sizes"))
    marked = of_group(samples.withColumns({"g": F.col(by), "_h": h}), edges, "left")
    return marked.withColumn("is_holdout", F.coalesce(F.col("_h") <= F.col("threshold"), F.lit(True))).select(*samples.columns, "is_holdout")


def propose_types(samples: DataFrame, k: int = 3, by: str = "email_type") -> DataFrame:
    """(type, n, exemplars) of each type, the exemplars with the least ids; a rank with a bound is cut in every task before the shuffle."""
    top = samples.select(by, "sample_id").withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("sample_id"))).where(F.col("_r") <= k)
    shown = top.groupBy(F.col(by).alias("of")).agg(F.array_sort(F.collect_list("sample_id")).alias("exemplars"))
    counted = samples.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(shown, F.col(by).eqNullSafe(F.col("of"))).select(by, "n", "exemplars")
