"""One plan for a batch of runs, used by batch jobs, streams and evaluations alike."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import dealt, kept
from ..operators import detection, extraction, history, merging, routing
from ..sources import files as sources
from .contracts import schema
from .records import trace

ENGINE_VERSION = "1.0.0"
#: Embedded messages are opened down to this depth.
MOST_DEPTH = 3


def run_key(messages: DataFrame, package: dict[str, DataFrame], version: str) -> str:
    """What the tables of a run depend on, as one name: the messages, the package's rows and the engine (see functions.frames.stages)."""
    parts = [version, ENGINE_VERSION]
    for df in (messages, *(package[k] for k in sorted(package))):
        # Sums of hashes do not depend on the order of the rows; two hashes with other seeds make 128 bits.
        columns = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in df.dtypes]
        row = df.select(*[F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)").alias(f"h{seed}") for seed in (0, 1)]).agg(F.count(F.lit(1)), F.sum("h0"), F.sum("h1")).first()
        parts.append("|".join(map(str, row)))
    return hashlib.sha256("#".join(parts).encode()).hexdigest()


def received(text: F.Column) -> F.Column:
    """The time of a Date header, or of an ISO timestamp; null if it is neither."""
    mail = F.regexp_extract(text, r"(\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4})", 1)
    return F.coalesce(F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(text))


def process(messages: DataFrame, package: dict[str, DataFrame], client_id: str, workflow_id: str, version: str, attempts: DataFrame | None = None) -> DataFrame:
    """messages (see sources.files.MESSAGE) -> one terminal row for each run, with what its records need.

    run_id, audit_id, client_id, workflow_id, package_version, engine_version, received_at, type, confidence,
    outcome, reasons, error, fields (array of field and triple), raw_sources, agent_trace,
    field_attribution, retries, conflicts and chosen_sheets (see plans.records), and stage_hashes (see
    replayed_stages). audit_id is that of the messages, or else
    follows from client, workflow, run and, where messages have it, delivery_epoch, so a replay keeps it. attempts (run_id, agent, attempt, status) are what a retry controller saw.
    """
    messages = kept(messages, "ingested")
    epoch = F.col("delivery_epoch") if "delivery_epoch" in messages.columns else F.lit(1)
    runs = messages.select(
        "run_id", "body", "depth", "error_code", "attachments", "embedded",
        (F.col("audit_id") if "audit_id" in messages.columns else history.audit_id(F.lit(client_id), F.lit(workflow_id), F.col("run_id"), epoch)).alias("audit_id"),
        received(F.col("received_at")).alias("received_at"),
    )
    errors = runs.where("error_code is not null").select("run_id", F.col("error_code").alias("code"))
    whole = runs.where("error_code is null").select("run_id", "body", "depth", "error_code", "attachments", "embedded")
    segments = detection.segment(whole)
    scores = detection.score_package(segments, package)
    locked = detection.lock_type(scores, package["types"])
    typed = locked.where("type is not null").select("run_id", "type")
    named = package["schema_fields"].select("type", "field", "field_type").join(package["aliases"], ["type", "field"], "left").select("type", "field", "field_type", F.explode(F.array_distinct(F.array(F.coalesce("alias", "field"), F.regexp_replace("field", "_", " ")))).alias("alias"))
    opened = kept(sources.expand_embedded(whole, MOST_DEPTH)[0], "messages")
    too_deep = opened.where((F.col("depth") == MOST_DEPTH) & (F.size("embedded") > 0)).select("run_id", F.lit("embedded_depth_exceeded").alias("code")).distinct()
    every = sources.away(opened)
    unread = sources.at_home(every.where("error_code is not null")).select("run_id", F.concat(F.lit("attachment_parse_failed:embedded:"), "origin").alias("code"))
    attached = sources.attachments(every)
    parsers = {"csv_parser": sources.parse_csv, "spreadsheet_parser": sources.parse_xlsx, "doc_parser": sources.parse_docx, "pdf_parser": sources.parse_pdf}
    read = {agent: kept(parse(attached), agent) for agent, parse in parsers.items()}
    csv_rows, sheet_rows, documents, pages = read.values()
    # The type is locked on the outer message, and every embedded one is read as of that type.
    typed_all = sources.away(opened.select("run_id", "origin").join(typed, "run_id")).select("run_id", "type")
    chosen = extraction.choose_sheet(sheet_rows.join(typed_all, "run_id"), named)
    of_chosen = sheet_rows.join(chosen.where("hits > 0").select("run_id", "file", "sheet"), ["run_id", "file", "sheet"], "left_semi")
    no_sheet = chosen.where("hits = 0").select("run_id", F.concat(F.lit("attachment_parse_failed:"), "file").alias("code"))
    parsed = merging.union_candidates(
        extraction.extract_body(detection.segment(every).join(typed_all, "run_id"), named),
        extraction.extract_rows(csv_rows, typed_all, named, "csv_parser"),
        extraction.extract_rows(of_chosen, typed_all, named, "spreadsheet_parser"),
        extraction.extract_texts(documents, typed_all, named, "doc_parser"),
        extraction.extract_texts(pages, typed_all, named, "pdf_parser"),
    )
    inside = F.when(F.col("origin") == "", F.col("source")).otherwise(F.concat(F.lit("embedded:"), "origin", F.lit("/"), "source"))
    candidates = kept(sources.at_home(parsed).withColumn("source", inside).drop("origin"), "candidates")
    settled = kept(merging.settle(candidates), "settled")
    required = routing.required_of(typed, package["schema_fields"])
    by_field = dealt(settled, "run_id", "field")
    scored = routing.confidence(required, by_field)
    called = sources.at_home(reduce(DataFrame.unionByName, [sources.calls(df, agent) for agent, df in read.items()]))
    of_files = sources.at_home(sources.attachment_flags(attached).unionByName(no_sheet)).select("run_id", "code").unionByName(called.where("code is not null").select("run_id", "code"))
    # What attachments and embedded messages say of the type comes after it is locked, and can only be flagged.
    said = [df.where("text is not null").select("run_id", "text") for df in (documents, pages)]
    later = sources.at_home(reduce(DataFrame.unionByName, said)).select("run_id", "text").unionByName(opened.where("depth > 0 and body is not null").select("run_id", F.col("body").alias("text")))
    later_types = detection.lock_type(detection.score_package(later, package), package["types"]).where("type is not null")
    of_files = of_files.unionByName(detection.contradicted(typed, later_types))
    invalid = extraction.validate(settled.join(typed, "run_id"), package["schema_fields"])
    flags = of_files.unionByName(unread).unionByName(too_deep).unionByName(locked.where("ambiguous").select("run_id", F.lit("classification_ambiguous").alias("code"))).join(typed, "run_id", "left")
    unclassified = flags.where("type is null").select("run_id", "code")
    codes = routing.reasons(
        flags.where("type is not null"),
        package["always_review"],
        routing.missing(required, by_field),
        merging.conflicts(settled.join(typed, "run_id"), package["tolerances"]),
        scored,
        package["bands"],
        required.where("critical").select("run_id", "field"),
    )
    codes = codes.unionByName(unclassified).unionByName(invalid).distinct()
    ends = routing.terminal(runs.select("run_id"), codes, errors)
    triple = F.struct(F.col("value_norm").alias("value"), "source", "confidence")
    made = F.struct("field", F.col("value_norm").alias("value"), "source", F.col("producer").alias("produced_by"), "confidence")
    fields = settled.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("field", triple.alias("triple")))).alias("fields"), F.array_sort(F.collect_list(made)).alias("field_attribution"))
    logged = merging.conflict_log(candidates, settled).select("run_id", F.struct("field", _value("winner"), _value("loser"), "rule").alias("x"))
    sheets = sources.at_home(chosen).select("run_id", F.struct(F.when(F.col("origin") == "", F.col("file")).otherwise(F.concat(F.lit("embedded:"), "origin", F.lit("/"), "file")).alias("file"), "sheet", "reason").alias("x"))
    listed = lambda df, name: df.groupBy("run_id").agg(F.array_sort(F.collect_set("x")).alias(name))
    gathered = candidates.groupBy("run_id").agg(F.sum(F.xxhash64("field", "value_norm", "source", "confidence", "producer").cast("decimal(38,0)")).alias("candidate_sum"))
    named = F.transform("attachments", lambda a: F.concat(F.lit("attachment:"), a["name"]))
    raw = F.concat(F.when(F.col("body").isNotNull(), F.array(F.lit("body"))).otherwise(F.array().cast("array<string>")), F.coalesce(named, F.array().cast("array<string>")))
    facts = runs.select("run_id", "audit_id", "received_at", F.col("error_code").alias("error"), raw.alias("raw_sources"))
    out = ends.join(facts, "run_id").join(locked.select("run_id", "type"), "run_id", "left").join(scored.select("run_id", "confidence"), "run_id", "left").join(fields, "run_id", "left")
    out = out.join(listed(logged, "conflicts"), "run_id", "left").join(listed(sheets, "chosen_sheets"), "run_id", "left").join(gathered, "run_id", "left")
    out = out.join(called.groupBy("run_id").agg(F.sum("elapsed_ms").alias("parsing_ms")), "run_id", "left")
    tried = "array<struct<agent:string,attempts:int,final_status:string>>"
    own = called.where("attempts > 1").select("run_id", "agent", F.col("attempts").alias("attempt"), F.when(F.col("code").isNull(), "ok").otherwise("failed").alias("status"))
    seen = own if attempts is None else own.unionByName(attempts.select("run_id", "agent", F.col("attempt").cast("int").alias("attempt"), "status"))
    per = seen.groupBy("run_id", "agent").agg(F.max("attempt").cast("int").alias("attempts"), F.max_by("status", "attempt").alias("final_status")).where("attempts > 1")
    out = out.join(per.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("agent", "attempts", "final_status"))).cast(tried).alias("retries")), "run_id", "left")
    out = out.join(locked.select("run_id", F.struct("type", "score", "ambiguous").alias("lock")), "run_id", "left").join(runs.select("run_id", F.sha2(F.to_json(F.struct("body", F.transform("attachments", lambda a: F.struct(a["name"], F.sha2(a["content"], 256))), "error_code")), 256).alias("arrived")), "run_id")
    return out.select(
        "run_id",
        "audit_id",
        F.lit(client_id).alias("client_id"),
        F.lit(workflow_id).alias("workflow_id"),
        F.lit(version).alias("package_version"),
        F.lit(ENGINE_VERSION).alias("engine_version"),
        "received_at",
        "type",
        "confidence",
        "outcome",
        "reasons",
        "error",
        F.coalesce("fields", F.array().cast("array<struct<field:string,triple:struct<value:string,source:string,confidence:decimal(5,4)>>>")).alias("fields"),
        "raw_sources",
        trace(F.col("reasons"), F.col("error"), F.col("parsing_ms")).alias("agent_trace"),
        F.coalesce("field_attribution", F.array().cast("array<struct<field:string,value:string,source:string,produced_by:string,confidence:decimal(5,4)>>")).alias("field_attribution"),
        F.coalesce("retries", F.array().cast(tried)).alias("retries"),
        F.coalesce("conflicts", F.array()).cast(schema("audit")["conflicts"].dataType).alias("conflicts"),
        F.coalesce("chosen_sheets", F.array()).cast(schema("audit")["chosen_sheets"].dataType).alias("chosen_sheets"),
        _chain(
            ("ingestion", F.col("arrived")),
            ("classification", F.to_json("lock")),
            ("attachment_parsers", F.col("candidate_sum").cast("string")),
            ("merge", F.to_json(F.struct("fields"))),
            ("confidence_scorer", F.col("confidence").cast("string")),
            ("flag_router", F.to_json(F.struct("outcome", "reasons"))),
        ).alias("stage_hashes"),
    )


def _value(side: str) -> Column:
    return F.struct(F.col(f"{side}.value_norm").alias("value"), F.col(f"{side}.source").alias("source"), F.col(f"{side}.confidence").alias("confidence")).alias(side)


def _chain(*outputs: tuple[str, Column]) -> Column:
    """Array of (stage_no, agent, hash): each stage's output hashed together with the hash of the stage before."""
    parts = F.array(*[F.struct(F.lit(k).alias("stage_no"), F.lit(agent).alias("agent"), F.coalesce(out, F.lit("")).alias("hash")) for k, (agent, out) in enumerate(outputs, 1)])
    none = F.array().cast("array<struct<stage_no:int,agent:string,hash:string>>")

    def add(done: Column, part: Column) -> Column:
        before = F.coalesce(F.get(done, F.size(done) - 1)["hash"], F.lit(""))
        return F.concat(done, F.array(F.struct(part["stage_no"].alias("stage_no"), part["agent"].alias("agent"), F.sha2(F.concat(before, F.lit("|"), part["hash"]), 256).alias("hash"))))

    return F.aggregate(parts, none, add)


def replayed_stages(done: DataFrame) -> DataFrame:
    """(run_id, stage_no, agent, hash) of finished runs, for history.first_divergence between two replays."""
    return done.select("run_id", F.explode("stage_hashes").alias("s")).select("run_id", "s.*")


def canonical_hash(terminals: DataFrame) -> DataFrame:
    """(run_id, hash) of what a replay must repeat: no time enters it."""
    return terminals.select("run_id", F.sha2(F.to_json(F.struct("client_id", "workflow_id", "package_version", "engine_version", "type", "confidence", "outcome", "reasons", "fields"), {"ignoreNullFields": "false"}), 256).alias("hash"))
