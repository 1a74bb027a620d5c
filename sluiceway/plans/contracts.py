"""Contracts: closed vocabularies and the schemas of every table that crosses a boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERMINAL_STATES = ("extracted", "review_queued", "error")
REASONS = (
    "low_confidence", "missing_field", "critical_field_conflict", "encrypted_no_key", "attachment_parse_failed", "unsupported_attachment",
    "embedded_depth_exceeded", "classification_ambiguous", "agent_timeout", "agent_failed", "schema_validation_failed",
)
LOADER_ERRORS = (
    "version_exists", "package_corrupt", "engine_incompatible", "type_incomplete", "schema_unsupported", "version_bump_insufficient",
    "signoff_required", "gate_failed", "package_unresolved",
)
LIFECYCLE = ("Draft", "Evaluated", "SignedOff", "Published", "Promoted", "Deprecated", "Withdrawn", "RolledBack")
#: Moves between lifecycle states; a package that failed its gate may be published for trial, never promoted.
MOVES = {
    "Draft": ("Evaluated", "Published"), "Evaluated": ("SignedOff",), "SignedOff": ("Published",), "Published": ("Promoted", "Withdrawn"),
    "Promoted": ("Deprecated", "RolledBack"), "RolledBack": ("Promoted", "Deprecated"), "Deprecated": (), "Withdrawn": (),
}
#: Prefixes that every package must send to review, so that the router can stay data-driven.
ALWAYS_REVIEW = ("attachment_parse_failed", "classification_ambiguous", "agent_timeout", "encrypted_no_key", "embedded_depth_exceeded")

TRIPLE = "struct<value:string,source:string,confidence:decimal(5,4)>"
SCHEMAS = {
    "result": f"audit_id string, client_id string, workflow_id string, package_version string, engine_version string, type string, confidence decimal(5,4), fields map<string,{TRIPLE}>, completed_at timestamp, human_corrected boolean",
    "review_entry": f"audit_id string, client_id string, workflow_id string, package_version string, engine_version string, type string, confidence decimal(5,4), partial_fields map<string,{TRIPLE}>, review_reason array<string>, raw_sources array<string>, queued_at timestamp",
    "audit": "audit_id string, client_id string, workflow_id string, package_version string, engine_version string, received_at timestamp, outcome string, agent_trace array<struct<agent:string,started_ms:bigint,duration_ms:bigint,status:string,skill:string,skill_source:string,reason:string>>, field_attribution array<struct<field:string,value:string,source:string,produced_by:string,confidence:decimal(5,4)>>, retries array<struct<agent:string,attempts:int,final_status:string>>, conflicts array<struct<field:string,winner:struct<value:string,source:string,confidence:decimal(5,4)>,loser:struct<value:string,source:string,confidence:decimal(5,4)>,rule:string>>, chosen_sheets array<struct<file:string,sheet:string,reason:string>>",
    "dead_letter": "audit_id string, client_id string, workflow_id string, package_version string, engine_version string, error string, raw_sources array<string>, queued_at timestamp",
    "manifest": "client_id string, workflow_id string, version string, engine_range string, email_types array<string>, created_at timestamp, created_by string, source_corpus_id string, artifacts array<struct<path:string,kind:string,sha256:string>>, eval struct<report:string,corpus_size:int,field_accuracy:double>",
    "field_schema": "schema_version string, email_type string, required_fields array<struct<name:string,type:string,critical:boolean,validation:struct<min:double,currency_required:boolean,format:string,not_before:string,pattern:string>>>, optional_fields array<struct<name:string,type:string>>, aliases map<string,array<string>>, generated_by string, reviewed_by string",
    "detection_rules": "schema_version string, types map<string,struct<keywords:array<struct<term:string,weight:double>>,patterns:array<struct<name:string,regex:string,weight:double>>,entity_weights:map<string,double>,classification_threshold:double,negative_signals:array<string>>>, generated_by string, reviewed_by string",
    "skill_manifest": "schema_version string, skill_id string, version string, body string, bound_agents array<string>, tools array<string>, inputs map<string,string>, outputs map<string,string>, token_budget int, timeout_ms int, generated_by string, reviewed_by string",
    "thresholds": "schema_version string, types map<string,struct<accept_at:double,review_below:double,reject_below:double,required_field_coverage:double,critical_field_tolerance:map<string,struct<absolute:double,days:int>>,always_review_if:array<string>>>, generated_by string, reviewed_by string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def known_reason(reason: Column) -> Column:
    """Whether a reason is one of the closed vocabulary, with an argument or without."""
    return F.substring_index(reason, ":", 1).isin(*REASONS)


def violations(df: DataFrame, name: str) -> DataFrame:
    """Rows that break a contract, with the rule: a missing key, an unknown reason or state, a bare value."""
    have = {f.name: f.dataType for f in df.schema}
    missing = [f.name for f in schema(name) if f.name not in have and f.name != "human_corrected"]
    if missing:
        return df.limit(1).select(F.lit(f"missing columns: {', '.join(missing)}").alias("rule"))
    rules = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in ("audit_id", "package_version", "engine_version") if c in have]
    if name == "review_entry":
        rules.append(F.when(~F.forall("review_reason", known_reason) | (F.size("review_reason") == 0), F.lit("unknown or no reason")))
    if name == "audit":
        rules.append(F.when(~F.col("outcome").isin(*TERMINAL_STATES), F.lit("unknown outcome")))
    if name == "result":
        rules.append(F.when(F.exists(F.map_values("fields"), lambda t: t["source"].isNull() | t["confidence"].isNull()), F.lit("a value without source or confidence")))
    return df.withColumn("rule", F.explode(F.array_compact(F.array(*rules)))).select("audit_id", "rule") if rules else df.limit(0).select(F.lit("").alias("rule"))
