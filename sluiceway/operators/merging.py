"""Candidates to one value for each field, with conflicts, agreement and confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE = ("run_id", "field", "value_raw", "value_norm", "value_dec", "value_date", "source", "segment_index", "confidence", "producer")


def union_candidates(*branches: DataFrame) -> DataFrame:
    """All branches' candidates; those without a source or confidence are left out."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)
    return both.where("source is not null and confidence is not null")


def settle(candidates: DataFrame, by: tuple[str, ...] = ("run_id", "field")) -> DataFrame:
    """Each (run, field) in one grouping: its winner's columns, delta, days and values (see conflicts), and agreement.

    The winner has the highest confidence, then the newest segment, then the first source. agreement is the
    share of source kinds that give the value most of them give.
    """
    # What orders candidates is itself most of the winner: it is shuffled once, with the rest behind it.
    order = [(-F.col("confidence")).alias("_c"), F.coalesce("segment_index", F.lit(2**31 - 1)).alias("_s"), F.col("source").alias("_o"), F.coalesce("value_norm", F.lit("")).alias("_v")]
    unset = [F.col("segment_index").isNull().alias("_no_s"), F.col("value_norm").isNull().alias("_no_v")]
    ordered = {"confidence": -F.col("w._c"), "segment_index": F.when(~F.col("w._no_s"), F.col("w._s")), "source": F.col("w._o"), "value_norm": F.when(~F.col("w._no_v"), F.col("w._v"))}
    own = [c for c in candidates.columns if c not in by]
    kind = F.substring_index("source", ":", 1)
    per = candidates.groupBy(*by).agg(
        F.min(F.struct(*order, *unset, *[c for c in own if c not in ordered])).alias("w"),
        (F.max("value_dec") - F.min("value_dec")).alias("delta"),
        F.datediff(F.max("value_date"), F.min("value_date")).alias("days"),
        # A field of one run has few candidates.
        F.collect_set(F.struct(F.col("value_norm").alias("v"), kind.alias("k"))).alias("seen"),
    )
    values = F.array_distinct(F.transform("seen", lambda x: x["v"]))
    most = F.array_max(F.transform(values, lambda v: F.size(F.filter("seen", lambda x: x["v"].eqNullSafe(v)))))
    kinds = F.size(F.array_distinct(F.transform("seen", lambda x: x["k"])))
    winner = [ordered.get(c, F.col(f"w.{c}")).alias(c) for c in own]
    return per.select(*by, *winner, "delta", "days", F.size(F.array_compact(values)).cast("long").alias("values"), (most / kinds).cast("decimal(5,4)").alias("agreement"))


def resolve(candidates: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The winner of each (run, field): highest confidence, then newest segment, then source."""
    by = tuple(key or ("run_id", "field"))
    return settle(candidates, by).select(*by, *[c for c in candidates.columns if c not in by])


def conflicts(settled: DataFrame, tolerances: DataFrame) -> DataFrame:
    """(run_id, field, delta, days, values, beyond): how far a field's candidates lie apart, against its tolerance.

    settled: see settle, with type where tolerances (field, absolute, days) have one. A field without a
    tolerance must have one value.
    """
    on = ["type", "field"] if "type" in tolerances.columns else ["field"]
    # A package's tolerances, at most 10 MB.
    near = settled.join(F.broadcast(tolerances.withColumnRenamed("days", "most_days")), on, "left")
    beyond = F.when(F.col("absolute").isNotNull() & F.col("delta").isNotNull(), F.col("delta") > F.col("absolute")).when(F.col("most_days").isNotNull() & F.col("days").isNotNull(), F.col("days") > F.col("most_days")).otherwise(F.col("values") > 1)
    return near.select("run_id", "field", "delta", "days", "values", beyond.alias("beyond"))


def conflict_log(candidates: DataFrame, winners: DataFrame) -> DataFrame:
    """Every losing candidate beside the winner of its field, and the rule that decided."""
    won = winners.select("run_id", "field", F.struct("value_norm", "source", "confidence").alias("winner"))
    lost = candidates.select("run_id", "field", F.struct("value_norm", "source", "confidence").alias("loser"))
    rule = F.when(F.col("winner.confidence") > F.col("loser.confidence"), "confidence").otherwise("recency")
    return won.join(lost, ["run_id", "field"]).where("not (winner.value_norm <=> loser.value_norm)").withColumn("rule", rule)


def agreement(candidates: DataFrame) -> DataFrame:
    """(run_id, field, agreement): the share of source kinds that give the value most of them give."""
    return settle(candidates).select("run_id", "field", "agreement")


def overall_confidence(coverage: F.Column, agree: F.Column, certainty: F.Column) -> F.Column:
    """0.4 coverage + 0.3 agreement + 0.3 mean certainty."""
    dec = "decimal(10,4)"
    return (F.lit(0.4).cast(dec) * coverage.cast(dec) + F.lit(0.3).cast(dec) * agree.cast(dec) + F.lit(0.3).cast(dec) * certainty.cast(dec)).cast("decimal(5,4)")


def overlaps(trace: DataFrame) -> DataFrame:
    """(run_id, overlap): whether any agent of a run started before another had ended."""
    ends = F.max(F.col("started_ms") + F.col("duration_ms")).over(Window.partitionBy("run_id").orderBy("started_ms", "agent").rowsBetween(Window.unboundedPreceding, -1))
    return trace.withColumn("before", ends).groupBy("run_id").agg(F.coalesce(F.bool_or(F.col("started_ms") < F.col("before")), F.lit(False)).alias("overlap"))
