"""Operators over time and identity: as-of versions, deliveries, registry states, diffs and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import in_range, phrase_in, self_contained, version_key
from ..plans.contracts import MOVES


def as_of(rows: DataFrame, activations: DataFrame, keys: list[str], at: str, activated_at: str = "activated_at", value: str = "version", buckets: str = "1 day") -> DataFrame:
    """rows with the value that was active at their time; null before the first activation.

    Both sides meet in one sorted stream for each key and time bucket, and a bucket without an activation
    takes the last one before it, so a key with very many rows is spread over its buckets.
    """
    span = F.window(F.col("_t").cast("timestamp"), buckets)["start"]
    left = rows.withColumns({"_t": F.col(at), "_row": F.struct(*rows.columns)}).select(*keys, "_t", "_row", F.lit(None).cast(activations.schema[value].dataType).alias("_v"), F.lit(1).alias("_o"))
    right = activations.select(*keys, F.col(activated_at).alias("_t"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"), F.lit(0).alias("_o"))
    both = left.unionByName(right).withColumn("_b", span)
    last = right.withColumn("_b", span).groupBy(*keys, "_b").agg(F.max_by("_v", "_t").alias("_last"))
    seen = left.withColumn("_b", span).select(*keys, "_b").distinct()
    # One row for each key and bucket: what was active when it began.
    edge = seen.unionByName(last.select(*keys, "_b")).distinct().join(last, [*keys, "_b"], "left")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).select(*keys, "_b", "_before")
    inside = Window.partitionBy(*keys, "_b").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_now", F.last("_v", ignorenulls=True).over(inside)).where("_o = 1").join(edge, [*keys, "_b"], "left")
    return found.select("_row.*", F.coalesce("_now", "_before").alias(value))


def resolve_packages(messages: DataFrame, routes: DataFrame, activations: DataFrame, at: str = "received_at") -> DataFrame:
    """messages (run_id, route, ...) with client_id, workflow_id, package_version and error: the version that was active when each arrived.

    routes: route, client_id, workflow_id. activations: client_id, workflow_id, version, activated_at. A
    message whose route is unknown or null, or whose workflow had no active package then, has the error
    package_unresolved and no version: nothing is extracted under a guessed one.
    """
    named = messages.join(routes.dropDuplicates(["route"]), "route", "left")
    found = as_of(named, activations, ["client_id", "workflow_id"], at)
    return found.withColumnRenamed("version", "package_version").withColumn("error", F.when(F.col("package_version").isNull(), F.lit("package_unresolved")))


def redelivered(messages: DataFrame, runs: DataFrame, keys: list[str], at: str, days: int = 7) -> DataFrame:
    """messages with original_audit_id: the run of the same key that started within `days` before, else null.

    Of several the first. Runs are matched by key and time alone, so nulls in other columns do not matter.
    """
    span = days * 86_400_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    moments = messages.select(*keys, F.col(at).alias("_at"), micros(at).alias("_t")).distinct().withColumn("_span", F.floor(F.col("_t") / span))
    prior = runs.select(*keys, micros("started_at").alias("_t"), F.struct("started_at", "audit_id").alias("_run"))
    # A run counts in its own span and the next, so a key with very many rows is spread over its spans.
    prior = prior.withColumn("_span", F.explode(F.array(F.floor(F.col("_t") / span), F.floor(F.col("_t") / span) + 1)))
    both = moments.unionByName(prior, allowMissingColumns=True)
    near = Window.partitionBy(*keys, "_span").orderBy("_t").rangeBetween(1 - span, 0)
    found = both.withColumn("_first", F.min("_run").over(near)).where("_run is null").select(*keys, F.col("_at").alias(at), F.col("_first.audit_id").alias("original_audit_id"))
    return messages.join(found, [*keys, at], "left").select(*messages.columns, "original_audit_id")


def audit_id(client: F.Column, workflow: F.Column, message: F.Column, epoch: F.Column) -> F.Column:
    return F.sha2(F.concat_ws("|", client, workflow, message, epoch.cast("string")), 256)


def current_state(events: DataFrame) -> DataFrame:
    """The last registry event of each version: client_id, workflow_id, version, state, at."""
    keys = ["client_id", "workflow_id", "version"]
    order = Window.partitionBy(*keys).orderBy(F.col("at").desc(), F.col("seq").desc())
    return events.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def illegal_moves(events: DataFrame) -> DataFrame:
    """Events whose state cannot follow the one before."""
    allowed = F.create_map(*[x for k, v in MOVES.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    order = Window.partitionBy("client_id", "workflow_id", "version").orderBy("at", "seq")
    step = events.withColumn("before", F.lag("state").over(order))
    return step.where(F.when(F.col("before").isNull(), F.col("state") != "Draft").otherwise(~F.array_contains(F.element_at(allowed, F.col("before")), F.col("state"))))


def previous_version(versions: DataFrame) -> DataFrame:
    """versions (client_id, workflow_id, version) with the one before in semantic order."""
    order = Window.partitionBy("client_id", "workflow_id").orderBy(version_key(F.col("version")))
    return versions.withColumn("previous", F.lag("version").over(order))


def artifact_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed, changed or same, by path and sha256."""
    a, b = old.select("path", F.col("sha256").alias("old")), new.select("path", F.col("sha256").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def reconcile(terminals: DataFrame, audits: DataFrame, key: str = "audit_id") -> DataFrame:
    """(key, side) of records without their partner, and of keys that either side has more than once."""
    t, a = terminals.groupBy(key).agg(F.count(F.lit(1)).alias("t")), audits.groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    side = F.when(F.col("t").isNull(), "audit_only").when(F.col("a").isNull(), "terminal_only").when((F.col("t") > 1) | (F.col("a") > 1), "repeated")
    return t.join(a, key, "full_outer").select(key, side.alias("side")).where("side is not null")


def publish_problems(manifest: DataFrame, files: DataFrame, existing: DataFrame, engine_version: str, supported: tuple[str, ...] = ("1",), keys: Sequence[str] = ()) -> DataFrame:
    """(code, detail) that forbid a publication; with keys, for each package that they name.

    manifest: one row of the manifest contract, or one for each package. files: path, size, sha256,
    schema_version, and the keys. existing: client_id, workflow_id, version.
    """
    listed = manifest.select(*keys, F.explode("artifacts").alias("a")).select(*keys, "a.path", F.col("a.sha256").alias("listed"))
    bad = listed.join(files.select(*keys, "path", "sha256"), [*keys, "path"], "full_outer").where("not (listed <=> sha256)").select(*keys, F.lit("package_corrupt").alias("code"), F.col("path").alias("detail"))
    paths = listed.where(~self_contained(F.col("path"))).select(*keys, F.lit("package_corrupt").alias("code"), F.col("path").alias("detail"))
    size = files.groupBy(*keys).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).where("n > 10 * 1024 * 1024").select(*keys, F.lit("package_corrupt").alias("code"), F.concat(F.lit("size "), F.col("n").cast("string")).alias("detail"))
    engine = manifest.where(~in_range(F.lit(engine_version), F.col("engine_range"))).select(*keys, F.lit("engine_incompatible").alias("code"), F.col("engine_range").alias("detail"))
    old = files.where(F.col("schema_version").isNotNull() & ~F.col("schema_version").isin(*supported)).select(*keys, F.lit("schema_unsupported").alias("code"), F.col("path").alias("detail"))
    taken = manifest.join(existing, ["client_id", "workflow_id", "version"], "left_semi").select(*keys, F.lit("version_exists").alias("code"), F.col("version").alias("detail"))
    out = bad
    for part in (paths, size, engine, old, taken):
        out = out.unionByName(part)
    return out.distinct()


def incomplete_types(email_types: DataFrame, schemas: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Declared types that lack a field schema or threshold entry, or have more than one."""
    s, t = schemas.groupBy("type").agg(F.count(F.lit(1)).alias("s")), thresholds.groupBy("type").agg(F.count(F.lit(1)).alias("t"))
    return email_types.join(s, "type", "left").join(t, "type", "left").where("coalesce(s, 0) <> 1 or coalesce(t, 0) <> 1").select("type", F.lit("type_incomplete").alias("code"))


def may_promote(candidates: DataFrame, reports: DataFrame, sign_offs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """candidates (version) with the code that forbids promotion, or null: gate_failed, then signoff_required."""
    passed = reports.where("passed").select("version", F.lit(True).alias("passed"), "report_hash")
    signed = sign_offs.select("version", F.lit(True).alias("signed"), F.col("report_hash").alias("signed_hash"))
    raw = artifacts.where("reviewed_by is null").select("version").distinct().withColumn("unreviewed", F.lit(True))
    joined = candidates.join(passed, "version", "left").join(signed, "version", "left").join(raw, "version", "left")
    refused = F.when(F.col("passed").isNull(), "gate_failed").when(F.col("signed").isNull() | (F.col("signed_hash") != F.col("report_hash")) | F.col("unreviewed").isNotNull(), "signoff_required")
    return joined.groupBy("version").agg(F.min(F.coalesce(refused, F.lit(""))).alias("c")).select("version", F.when(F.col("c") != "", F.col("c")).alias("code"))


def resolve_skills(used: DataFrame, package: DataFrame, defaults: DataFrame) -> DataFrame:
    """used (skill_id) with the package's body and version where it overrides, else the default's, and skill_source."""
    p = package.select("skill_id", F.col("body").alias("pb"), F.col("version").alias("pv"))
    d = defaults.select("skill_id", F.col("body").alias("db"), F.col("version").alias("dv"))
    joined = used.join(F.broadcast(p), "skill_id", "left").join(F.broadcast(d), "skill_id", "left")
    return joined.select("skill_id", F.coalesce("pb", "db").alias("body"), F.coalesce("pv", "dv").alias("version"), F.when(F.col("pb").isNotNull(), "package").when(F.col("db").isNotNull(), "default").alias("skill_source"))


def binding_violations(invocations: DataFrame, bindings: DataFrame, tools: DataFrame) -> DataFrame:
    """Invocations (agent, skill_id, tool) that the skill's manifest does not allow."""
    agents = invocations.join(bindings, ["skill_id", "agent"], "left_anti").withColumn("code", F.lit("skill_binding_violation"))
    calls = invocations.where("tool is not null").join(tools, ["skill_id", "tool"], "left_anti").withColumn("code", F.lit("skill_binding_violation"))
    return agents.unionByName(calls).distinct()


def undeclared_tools(skills: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """(skill_id, tool): tools that a skill's body names, as whole words, and its manifest does not declare."""
    named = F.array_compact(F.array(*[F.when(phrase_in(F.col("body"), t), F.lit(t)) for t in known]))
    return skills.select("skill_id", F.explode(F.array_except(named, F.coalesce("tools", F.array().cast("array<string>")))).alias("tool"))


def first_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """(run_id, stage_no, agent): the first stage whose output hash differs between two replays."""
    both = a.select("run_id", "stage_no", "agent", F.col("hash").alias("ha")).join(b.select("run_id", "stage_no", F.col("hash").alias("hb")), ["run_id", "stage_no"], "full_outer")
    return both.where("not (ha <=> hb)").groupBy("run_id").agg(F.min(F.struct("stage_no", "agent")).alias("s")).select("run_id", "s.stage_no", "s.agent")


def unevaluated(promoted: DataFrame, evaluations: DataFrame, engine_version: str) -> DataFrame:
    """Promoted packages without an evaluation on this engine: a rollout needs none."""
    return promoted.join(evaluations.where(F.col("engine_version") == engine_version), ["client_id", "workflow_id", "version"], "left_anti")


def retained(table: DataFrame, at: str, days: int, now: F.Column) -> DataFrame:
    """Rows that are still within their retention; write them over the partitions that lost rows."""
    return table.where(F.col(at) >= F.date_sub(now, days))


def for_client(table: DataFrame, client_id: str) -> DataFrame:
    """The rows of one client; every read of a shared table goes through here."""
    return table.where(F.col("client_id") == client_id)
