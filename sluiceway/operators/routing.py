"""Completeness and the routing rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import code, code_prefix
from .merging import overall_confidence


def required_of(runs: DataFrame, fields: DataFrame) -> DataFrame:
    """Runs (run_id, type) with each required field of their type; fields: type, field, required, critical."""
    return runs.join(F.broadcast(fields.where("required")), "type").select("run_id", "type", "field", "critical")


def missing(required: DataFrame, resolved: DataFrame) -> DataFrame:
    """Required fields that no candidate gave a value."""
    return required.join(resolved.where("value_norm is not null"), ["run_id", "field"], "left_anti").select("run_id", "field")


def confidence(required: DataFrame, settled: DataFrame) -> DataFrame:
    """(run_id, type, coverage, agreement, certainty, confidence) of every run with a required field; settled: see merging.settle."""
    have = required.join(settled.select("run_id", "field", "confidence", "agreement"), ["run_id", "field"], "left")
    # A run has one type, which is grouped by so that nobody has to join it again.
    per = have.groupBy("run_id", "type").agg(
        (F.count("confidence") / F.count(F.lit(1))).cast("decimal(5,4)").alias("coverage"),
        F.coalesce(F.avg("agreement"), F.lit(0)).cast("decimal(5,4)").alias("agreement"),
        F.coalesce(F.avg("confidence"), F.lit(0)).cast("decimal(5,4)").alias("certainty"),
    )
    return per.withColumn("confidence", overall_confidence(F.col("coverage"), F.col("agreement"), F.col("certainty")))


def reasons(flags: DataFrame, always_review: DataFrame, missing_fields: DataFrame, conflict: DataFrame, scores: DataFrame, bands: DataFrame, critical: DataFrame) -> DataFrame:
    """(run_id, code) of every rule that fires; codes accumulate.

    flags: run_id, type, code. always_review: type, prefix. conflict: run_id, field, beyond. scores:
    run_id, type, confidence. bands: type, accept_at, reject_below. critical: run_id, field.
    """
    flagged = flags.withColumn("prefix", code_prefix(F.col("code"))).join(F.broadcast(always_review), ["type", "prefix"]).select("run_id", "code")
    absent = missing_fields.select("run_id", code("missing_field", F.col("field")).alias("code"))
    torn = conflict.where("beyond").join(critical, ["run_id", "field"], "left_semi").select("run_id", code("critical_field_conflict", F.col("field")).alias("code"))
    low = scores.join(F.broadcast(bands), "type").where("confidence < reject_below or confidence < accept_at").select("run_id", F.lit("low_confidence").alias("code"))
    return flagged.unionByName(absent).unionByName(torn).unionByName(low).distinct()


def terminal(runs: DataFrame, codes: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(run_id, outcome, reasons): extracted only where no code fired; errors (run_id, code) end a run."""
    found = runs.join(codes.groupBy("run_id").agg(F.array_sort(F.collect_set("code")).alias("reasons")), "run_id", "left")
    found = found.withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
    outcome = F.when(F.size("reasons") > 0, "review_queued").otherwise("extracted")
    if errors is not None:
        found = found.join(errors.select("run_id", F.lit(True).alias("failed")).distinct(), "run_id", "left")
        outcome = F.when(F.col("failed"), "error").otherwise(outcome)
    return found.select("run_id", outcome.alias("outcome"), "reasons")


def empty_partials(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Review entries (run_id, partial_fields) without fields although candidates exist: must be none."""
    return entries.where(F.size("partial_fields") == 0).join(candidates.select("run_id").distinct(), "run_id", "left_semi")
