"""Deliveries of one message: the epochs of a dedupe window, found without gathering a key.

An epoch begins with a delivery and holds all that follow within the window; the next delivery after it
begins the next one. Whether a delivery begins an epoch depends on all before it, but only through one
function: which delivery is the first at or after "begin + window". Times are cut into buckets as wide as the
window, in each of which at most one epoch begins. A segment of buckets is a map from each delivery that may
enter it to the first begin behind it, and two neighbouring segments combine by looking the exits of the left
one up in the right one. Only the deliveries of a segment's first bucket and the first one behind that bucket
may enter it, so the maps halve from level to level. Going down again, every segment learns where it is
entered, and buckets where an epoch begins. The levels are the logarithm of the time range, not of the rows,
and no step needs the times of a key in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import kept

#: Parts of a window in which the next delivery is looked for, so that a window with very many is spread.
PARTS = 64


def following(times: DataFrame, span: int) -> DataFrame:
    """(k, t) distinct -> (k, t, next): the first time of the key at or after t + span, null if there is none."""
    width = max(1, span // PARTS)
    part = lambda c: F.floor(F.col(c) / width)
    asked = times.select("k", (F.col("t") + span).alias("at"), F.col("t").alias("ask"))
    both = times.select("k", F.col("t").alias("at"), F.lit(None).cast("bigint").alias("ask")).unionByName(asked).withColumn("part", part("at"))
    # Of equal times the delivery stands behind the question, so that it answers it.
    after = Window.partitionBy("k", "part").orderBy("at", F.col("ask").isNull()).rowsBetween(0, Window.unboundedFollowing)
    inside = F.first(F.when(F.col("ask").isNull(), F.col("at")), ignorenulls=True).over(after)
    # A row for each key and part: the first delivery in a later part.
    later = Window.partitionBy("k").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    edges = both.groupBy("k", "part").agg(F.min(F.when(F.col("ask").isNull(), F.col("at"))).alias("first")).withColumn("later", F.first("first", ignorenulls=True).over(later)).select("k", "part", "later")
    found = both.withColumn("inside", inside).where("ask IS NOT NULL").join(edges, ["k", "part"])
    return found.select("k", F.col("ask").alias("t"), F.coalesce("inside", "later").alias("next"))


def epoch_begins(times: DataFrame, span: int) -> DataFrame:
    """(k, t) distinct -> (k, t) of the times that begin an epoch."""
    ends = times.agg(F.min("t"), F.max("t")).first()
    if ends[0] is None:
        return times.limit(0)
    lowest = ends[0] // span
    levels = (ends[1] // span - lowest).bit_length()
    bucket = lambda c: F.floor(F.col(c) / span) - lowest
    segment = lambda c, level: F.shiftright(bucket(c), level)
    base = following(times, span).select("k", bucket("t").alias("seg"), F.col("t").alias("enter"), F.col("next").alias("leave"), F.lit(True).alias("first"))
    maps = [kept(base, "level-0")]
    for level in range(levels):
        here = maps[-1]
        left, right = here.where("seg % 2 = 0"), here.where("seg % 2 = 1")
        into = right.select("k", (F.col("seg") - 1).alias("seg"), F.col("enter").alias("leave"), F.col("leave").alias("through"), F.lit(True).alias("met"))
        passed = left.join(into, ["k", "seg", "leave"], "left").select("k", F.shiftright("seg", 1).alias("seg"), "enter", F.when(F.col("met"), F.col("through")).otherwise(F.col("leave")).alias("leave"), "first")
        # Behind the first bucket only the very first delivery can be entered: the left half's, else the right half's.
        rest = right.groupBy("k", F.shiftright("seg", 1).alias("seg")).agg(F.min(F.struct("enter", "leave")).alias("x")).join(left.where("NOT first").select("k", F.shiftright("seg", 1).alias("seg")), ["k", "seg"], "left_anti")
        maps.append(kept(passed.unionByName(rest.select("k", "seg", "x.enter", "x.leave", F.lit(False).alias("first"))), f"level-{level + 1}"))
    entered = times.groupBy("k").agg(F.min("t").alias("enter")).withColumn("seg", F.lit(0).cast("bigint"))
    for level in range(levels - 1, -1, -1):
        placed = entered.select("k", segment("enter", level).alias("seg"), "enter")
        through = placed.where("seg % 2 = 0").join(maps[level].select("k", "seg", "enter", "leave"), ["k", "seg", "enter"])
        beside = through.where(segment("leave", level) == F.col("seg") + 1).select("k", (F.col("seg") + 1).alias("seg"), F.col("leave").alias("enter"))
        entered = kept(placed.unionByName(beside), f"entered-{level}")
    return entered.select("k", F.col("enter").alias("t"))


def first_deliveries(messages: DataFrame, keys: list[str], at: str, days: int = 7) -> DataFrame:
    """messages with delivery_epoch (from 1) and is_first: a delivery within `days` of an epoch's first belongs to it.

    The window is fixed from the first delivery; one outside it opens another epoch. Of deliveries at the
    same time the one with the least other columns is the first, of equal rows one of them. A null in a key
    is a value of its own; a delivery without a time has no epoch and is a first one, since nothing tells
    that it repeats another.
    """
    span = days * 86_400_000_000
    rows = kept(messages.withColumns({"_t": F.unix_micros(F.col(at).cast("timestamp")), "_k": F.struct(*keys), "_row": F.monotonically_increasing_id()}), "deliveries")
    timed = rows.where("_t IS NOT NULL")
    times = kept(timed.select(F.col("_k").alias("k"), F.col("_t").alias("t")).distinct(), "times")
    begins = epoch_begins(times, span)
    bucket = F.floor(F.col("t") / span)
    # One row for each key and bucket: where in it an epoch begins, and how many have begun up to its end.
    begun = begins.select("k", "t", bucket.alias("b"))
    upto = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    seen = times.select("k", bucket.alias("b")).distinct().join(begun, ["k", "b"], "left").withColumn("n", F.count("t").over(upto))
    seen = kept(seen.select(F.col("k").alias("_k"), F.col("b").alias("_b"), F.col("t").alias("_begin"), F.col("n").alias("_n")), "epochs")
    placed = timed.withColumn("_b", F.floor(F.col("_t") / span)).join(seen, ["_k", "_b"])
    epoch = (F.col("_n") - F.when(F.col("_t") < F.col("_begin"), 1).otherwise(0)).cast("long")
    placed = kept(placed.withColumn("delivery_epoch", epoch).drop("_b", "_begin", "_n"), "placed")
    others = [c for c, kind in messages.dtypes if c not in keys and "map<" not in kind and kind != "variant"]
    first = placed.groupBy("_k", "delivery_epoch").agg(F.min(F.struct("_t", *others, "_row")).alias("x")).select(F.col("x._row").alias("_row"), F.lit(True).alias("_first"))
    marked = placed.join(first, "_row", "left").withColumn("is_first", F.coalesce("_first", F.lit(False))).drop("_first")
    untimed = rows.where("_t IS NULL").withColumns({"delivery_epoch": F.lit(None).cast("long"), "is_first": F.lit(True)})
    return marked.unionByName(untimed).select(*messages.columns, "delivery_epoch", "is_first")
