"""Run telemetry: throughput, latency, states, failures, cost and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def throughput(runs: DataFrame, at: str, client: str = "client_id", span: str = "1 hour") -> DataFrame:
    """(client, hour, n)."""
    return runs.groupBy(client, F.window(F.col(at).cast("timestamp"), span)["start"].alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def latency(runs: DataFrame, ms: str, by: str, exact: bool = True) -> DataFrame:
    """(by, n, p50, p95); approximate percentiles keep a bounded sketch for each group instead of its values."""
    if exact:
        p = [F.percentile(F.col(ms), F.lit(q)) for q in (0.5, 0.95)]
    else:
        p = [F.percentile_approx(F.col(ms), q, 10_000) for q in (0.5, 0.95)]
    return runs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), p[0].alias("p50"), p[1].alias("p95"))


#: A sketch's size, and how far the rank of a quantile that it gives may be off (as a share of the rows, for 99 of 100).
KLL_SIZE, RANK_ERROR = 400, 0.01


def latency_sketches(runs: DataFrame, ms: str, at: str, client: str = "client_id", span: str = "1 hour") -> DataFrame:
    """(client, hour, n, sketch): a KLL sketch of each client's hour, of bounded size whatever the number of runs; null values are left out."""
    rows = runs.where(F.col(ms).isNotNull()).select(F.col(client).alias("client_id"), F.window(F.col(at).cast("timestamp"), span)["start"].alias("hour"), F.col(ms).cast("double").alias("ms"))
    return rows.groupBy("client_id", "hour").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("ms", KLL_SIZE).alias("sketch"))


def merged_latency(sketches: DataFrame, *by: str) -> DataFrame:
    """(by, n, p50, p95) of stored sketches, over any window that `by` names; each rank is within RANK_ERROR."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", KLL_SIZE).alias("sketch"))
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(q).cast("double")).alias(name) for q, name in ((0.5, "p50"), (0.95, "p95"))])


def state_mix(runs: DataFrame, state: str, by: str) -> DataFrame:
    """(by, state, n, share)."""
    per = runs.groupBy(by, state).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def failure_rates(audits: DataFrame) -> DataFrame:
    """(agent, calls, failures, rate) from agent_trace."""
    calls = audits.select(F.explode("agent_trace").alias("t"))
    return calls.groupBy("t.agent").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("t.status") != "ok").alias("failures")).withColumn("rate", F.col("failures") / F.col("calls"))


def retries(attempts: DataFrame) -> DataFrame:
    """(run_id, agent, attempts, final_status)."""
    return attempts.groupBy("run_id", "agent").agg(F.max("attempt").alias("attempts"), F.max_by("status", "attempt").alias("final_status"))


def cost(usage: DataFrame, ceiling: float, by: str = "run_id") -> DataFrame:
    """(by, cost, over, code): a run over the ceiling goes to review."""
    per = usage.groupBy(by).agg(F.sum(F.col("cost").cast("decimal(18,6)")).alias("cost"))
    return per.withColumn("over", F.col("cost") > ceiling).withColumn("code", F.when(F.col("over"), "agent_failed:cost_controller"))


def sustained_review(hours: DataFrame, target: float, span: int = 3) -> DataFrame:
    """Hours (client_id, hour, runs, reviewed) at which the rolling review rate of `span` hours is above the target."""
    w = Window.partitionBy("client_id").orderBy("hour").rowsBetween(1 - span, 0)
    rolling = hours.withColumns({"rate": F.sum("reviewed").over(w) / F.sum("runs").over(w), "hours": F.count(F.lit(1)).over(w)})
    return rolling.where((F.col("hours") == span) & (F.col("rate") > target)).select("client_id", "hour", "rate")


def repeated_corrections(corrections: DataFrame, least: int = 3) -> DataFrame:
    """(workflow_id, field, n) of fields corrected at least so often."""
    return corrections.groupBy("workflow_id", "field").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def audit_completeness(runs: DataFrame, audits: DataFrame) -> DataFrame:
    """runs, audited and the ratio of runs with an audit record."""
    marks = audits.select("run_id").distinct().withColumn("has", F.lit(True))
    return runs.select("run_id").distinct().join(marks, "run_id", "left").agg(F.count(F.lit(1)).alias("runs"), F.count("has").alias("audited")).withColumn("ratio", F.col("audited") / F.col("runs"))


def without_content(log: DataFrame) -> DataFrame:
    """What may be logged of a run: ids, field names and confidences."""
    return log.select([c for c in log.columns if c in ("audit_id", "run_id", "client_id", "workflow_id", "package_version", "field", "confidence", "outcome", "agent", "status")])


def overdue(started: DataFrame, audits: DataFrame, now: F.Column, seconds: int = 300) -> DataFrame:
    """Start records without an audit after the run ceiling: they close as error with agent_timeout:orchestrator."""
    late = started.join(audits.select("run_id").distinct(), "run_id", "left_anti").where(F.col("started_at") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)")))
    return late.select("run_id", F.lit("error").alias("outcome"), F.lit("agent_timeout:orchestrator").alias("code"))


def queue_lag(messages: DataFrame, started: DataFrame, now: F.Column, by: str = "client_id", at: str = "received_at") -> DataFrame:
    """(by, waiting, oldest_s): messages (run_id, ...) without a start record, and how long the first of them has waited."""
    waiting = messages.join(started.select("run_id").distinct(), "run_id", "left_anti")
    oldest = F.unix_seconds(now) - F.unix_seconds(F.min(F.col(at).cast("timestamp")))
    return waiting.groupBy(by).agg(F.count(F.lit(1)).alias("waiting"), oldest.alias("oldest_s"))
