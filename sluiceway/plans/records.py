"""What a run leaves behind: one terminal object and one audit record, in the shape of their contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import code_prefix
from .contracts import TERMINAL_STATES, known_reason, schema

#: The agents of a run in their order, each with the reasons that it raises. The plan runs them as stages
#: over all runs of a batch, so a run's trace tells their order and what they said; times are known of the
#: parsers alone, which open files one by one.
AGENTS = (
    ("ingestion", ()),
    ("thread_decomposer", ()),
    ("signal_detection", ()),
    ("classification", ("classification_ambiguous",)),
    ("body_parser", ()),
    ("attachment_router", ("unsupported_attachment",)),
    ("encryption", ("encrypted_no_key",)),
    ("attachment_parsers", ("attachment_parse_failed", "agent_timeout")),
    ("embedded_email", ("embedded_depth_exceeded",)),
    ("merge", ("critical_field_conflict",)),
    ("completeness_checker", ("missing_field", "schema_validation_failed")),
    ("confidence_scorer", ("low_confidence",)),
    ("flag_router", ()),
)
_STEP = "struct<agent:string,started_ms:bigint,duration_ms:bigint,status:string,skill:string,skill_source:string,reason:string>"


def _first(codes: Column, prefixes: tuple[str, ...]) -> Column:
    """The first of these codes that has one of the prefixes."""
    return F.get(F.filter(codes, lambda c: code_prefix(c).isin(*prefixes)), F.lit(0))


def trace(codes: Column, error: Column, parsing_ms: Column) -> Column:
    """The agent_trace of a run with these codes, whose parsers took so long; a run with an error ends at ingestion."""

    def step(agent: str, reason: Column, status: Column) -> Column:
        none = F.lit(None)
        return F.struct(F.lit(agent).alias("agent"), none.cast("bigint").alias("started_ms"), (parsing_ms if agent == "attachment_parsers" else none).cast("bigint").alias("duration_ms"), status.alias("status"), none.cast("string").alias("skill"), none.cast("string").alias("skill_source"), reason.alias("reason")).cast(_STEP)

    steps = []
    for agent, raised in AGENTS:
        reason = _first(codes, raised) if raised else F.lit(None).cast("string")
        steps.append(step(agent, reason, F.when(reason.isNotNull(), "flagged").otherwise("ok")))
    return F.when(error.isNotNull(), F.array(step("ingestion", error, F.lit("failed")))).otherwise(F.array(*steps))


def records(done: DataFrame) -> dict[str, DataFrame]:
    """result, review_entry, dead_letter and audit of finished runs (see plans.runs.process).

    Every run is in audit, and in just one of the others under the same audit_id.
    """
    now = F.current_timestamp()
    values = F.map_from_entries(F.transform("fields", lambda f: F.struct(f["field"], f["triple"])))
    keys = ["audit_id", "client_id", "workflow_id", "package_version", "engine_version"]
    typed = [*keys, "type", "confidence"]
    return {
        "result": done.where("outcome = 'extracted'").select(*typed, values.alias("fields"), now.alias("completed_at"), F.lit(False).alias("human_corrected")),
        "review_entry": done.where("outcome = 'review_queued'").select(*typed, values.alias("partial_fields"), F.col("reasons").alias("review_reason"), "raw_sources", now.alias("queued_at")),
        "dead_letter": done.where("outcome = 'error'").select(*keys, "error", "raw_sources", now.alias("queued_at")),
        "audit": done.select(*keys, "received_at", "outcome", "agent_trace", "field_attribution", "retries", "conflicts", "chosen_sheets"),
    }


def sound(done: DataFrame) -> DataFrame:
    """Finished runs, those that would break a contract turned into errors that name the rule: one bad run must not stop its batch.

    Such a run goes to the dead letters and keeps its audit; what it lacks of its keys is filled in.
    """
    bare = F.exists("fields", lambda f: f["triple"]["source"].isNull() | f["triple"]["confidence"].isNull())
    rule = (
        F.when(F.col("audit_id").isNull() | F.col("package_version").isNull() | F.col("engine_version").isNull(), F.lit("a key is null"))
        .when(F.col("outcome").isNull() | ~F.col("outcome").isin(*TERMINAL_STATES), F.lit("unknown outcome"))
        .when((F.col("outcome") == "review_queued") & ~(F.coalesce(F.size("reasons") > 0, F.lit(False)) & F.coalesce(F.forall("reasons", known_reason), F.lit(False))), F.lit("unknown or no reason"))
        .when((F.col("outcome") == "extracted") & F.coalesce(bare, F.lit(True)), F.lit("a value without source or confidence"))
    )
    marked = done.withColumn("_rule", rule)
    broken = F.col("_rule").isNotNull()
    return marked.withColumns({
        "audit_id": F.coalesce("audit_id", F.sha2(F.concat(F.lit("broken|"), F.coalesce("run_id", F.lit(""))), 256)),
        "package_version": F.coalesce("package_version", F.lit("unknown")),
        "engine_version": F.coalesce("engine_version", F.lit("unknown")),
        "outcome": F.when(broken, "error").otherwise(F.col("outcome")),
        "error": F.when(broken, F.concat(F.lit("contract: "), F.col("_rule"))).otherwise(F.col("error")),
    }).drop("_rule")


def checked(done: DataFrame) -> dict[str, DataFrame]:
    """The records of finished runs, each in the shape of its contract (see sound). done is read several times and should be kept."""
    found = records(sound(done))
    for name in ("result", "review_entry", "audit"):
        assert found[name].columns == schema(name).names
    return found
