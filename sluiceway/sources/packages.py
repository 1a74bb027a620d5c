"""Packages, corpora and sinks: immutable folders in, append-only tables out."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import Files, kept
from ..operators.history import incomplete_types, publish_problems
from ..plans.contracts import schema
from ..plans.records import checked
from .commits import write_batch


def package_files(spark: SparkSession, path: str) -> DataFrame:
    """path (within the package), content, size and sha256 of every file of a package."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    bare = re.sub(r"^file:/+", "/", path).rstrip("/")
    return files.select(F.regexp_replace(F.substring_index("path", bare, -1), "^/", "").alias("path"), "content", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def load_package(spark: SparkSession, path: str, engine_version: str = "1.0.0") -> dict[str, DataFrame]:
    """The dimensions of a package, once all that its load is conditional on holds.

    Raises ValueError with the code of what does not: package_corrupt (a checksum, a path that leaves the
    package, more than 10 MB, a file that is not listed), engine_incompatible, schema_unsupported,
    type_incomplete (a declared type without exactly one schema and one threshold entry).

    manifest, schema_fields (type, field, field_type, required, critical, min, currency_required, format,
    not_before, pattern), aliases (type, field, alias), keywords, patterns, entities and negatives (type,
    ...), types (type, threshold), bands (type, accept_at, review_below, reject_below), tolerances
    (type, field, absolute, days), always_review (type, prefix), skills.
    """
    files = package_files(spark, path)
    manifest_text = files.where("path = 'manifest.json'").select(F.col("content").cast("string").alias("j"))
    manifest = manifest_text.select(F.from_json("j", schema("manifest")).alias("m")).select("m.*")
    listed = manifest.select(F.explode("artifacts").alias("a")).select("a.*")
    if manifest.isEmpty():
        raise ValueError("package_corrupt")
    stated = files.where("path <> 'manifest.json'").select("path", "size", "sha256", F.get_json_object(F.col("content").cast("string"), "$.schema_version").alias("schema_version"))
    none = spark.createDataFrame([], "client_id string, workflow_id string, version string")
    found = {r.code for r in publish_problems(manifest, stated, none, engine_version).select("code").distinct().collect()}
    for code in ("package_corrupt", "engine_incompatible", "schema_unsupported"):
        if code in found:
            raise ValueError(code)

    def artifacts(kind: str) -> DataFrame:
        chosen = files.join(F.broadcast(listed.where(F.col("kind") == kind).select("path")), "path")
        return chosen.select(F.from_json(F.col("content").cast("string"), schema(kind)).alias("a")).select("a.*")

    fields, rules, limits = artifacts("field_schema"), artifacts("detection_rules"), artifacts("thresholds")
    flat = "f.name as field", "f.type as field_type"
    required = fields.select(F.col("email_type").alias("type"), F.explode("required_fields").alias("f")).selectExpr("type", *flat, "true as required", "coalesce(f.critical, false) as critical", "f.validation.*")
    optional = fields.select(F.col("email_type").alias("type"), F.explode("optional_fields").alias("f")).selectExpr("type", *flat, "false as required", "false as critical")
    types = rules.select(F.explode("types").alias("type", "r"))
    bands = limits.select(F.explode("types").alias("type", "t"))
    declared = manifest.select(F.explode("email_types").alias("type")).distinct()
    if not incomplete_types(declared, fields.select(F.col("email_type").alias("type")), bands.select("type")).isEmpty():
        raise ValueError("type_incomplete")
    tables = {
        "manifest": manifest,
        "schema_fields": required.unionByName(optional, allowMissingColumns=True),
        "aliases": fields.select(F.col("email_type").alias("type"), F.explode("aliases").alias("field", "names")).select("type", "field", F.explode("names").alias("alias")),
        "keywords": types.select("type", F.explode("r.keywords").alias("k")).select("type", "k.term", "k.weight"),
        "patterns": types.select("type", F.explode("r.patterns").alias("p")).select("type", "p.regex", "p.weight"),
        "entities": types.select("type", F.explode("r.entity_weights").alias("entity", "weight")),
        "negatives": types.select("type", F.explode("r.negative_signals").alias("term")),
        "types": types.select("type", F.col("r.classification_threshold").cast("decimal(5,4)").alias("threshold")),
        "bands": bands.selectExpr("type", "cast(t.accept_at as decimal(5,4)) accept_at", "cast(t.review_below as decimal(5,4)) review_below", "cast(t.reject_below as decimal(5,4)) reject_below", "t.required_field_coverage"),
        "tolerances": bands.select("type", F.explode("t.critical_field_tolerance").alias("field", "v")).selectExpr("type", "field", "cast(v.absolute as decimal(18,2)) absolute", "v.days"),
        "always_review": bands.select("type", F.explode("t.always_review_if").alias("prefix")),
        "skills": artifacts("skill_manifest"),
    }
    # At most 10 MB, as checked above: read once here and not again by every stage of every run.
    return {name: spark.createDataFrame(df.collect(), df.schema) for name, df in tables.items()}


CORPUS = "id string, client string, date date, sample_count long, provenance string, consent string"


def load_corpus(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a corpus folder.

    samples (sample_id, file, content), labels, label_fields (sample_id, email_type, field, value, source), and
    corpus: what corpus.json says (see CORPUS, nulls where it says nothing or is missing), with content_hash,
    the SHA-256 of the sorted paths and hashes of all samples and of the labels, which names the version, and
    counted, how many samples there are.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/samples")
    samples = files.select(F.regexp_extract("path", r"/samples/([^/]+)/", 1).alias("sample_id"), F.regexp_extract("path", r"/samples/(.*)$", 1).alias("_path"), F.substring_index("path", "/", -1).alias("file"), "content")
    labels = spark.read.schema("sample_id string, email_type string, in_scope boolean, expected_unreadable boolean, fields map<string,string>, field_sources map<string,string>, labelled_by string, labelled_at date").json(f"{path}/labels.jsonl")
    fields = labels.where("in_scope").select("sample_id", "email_type", F.explode("fields").alias("field", "value"), F.col("field_sources").alias("_s"))
    lines = spark.read.text(f"{path}/labels.jsonl").select(F.sha2(F.concat(F.lit("label|"), "value"), 256).alias("h"))
    hashes = samples.select(F.sha2(F.concat(F.col("_path"), F.lit("|"), F.sha2("content", 256)), 256).alias("h")).unionByName(lines)
    # Two sums of hashes name the contents whatever their order, so no task holds them all.
    part = lambda k: F.sum(F.conv(F.substring("h", k, 15), 16, 10).cast("decimal(38,0)"))
    content = hashes.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *[part(k).cast("string") for k in (1, 16, 31, 46)]), 256).alias("content_hash"))
    head = spark.range(1).select(F.lit(_corpus_json(spark, path)).alias("j")).select(F.from_json("j", CORPUS).alias("c")).select("c.*")
    counted = samples.agg(F.count_distinct("sample_id").alias("counted"))
    return {
        "samples": samples.drop("_path"),
        "labels": labels,
        "label_fields": fields.select("sample_id", "email_type", "field", "value", F.try_element_at("_s", F.col("field")).alias("source")),
        "corpus": head.crossJoin(content).crossJoin(counted),
    }


def _corpus_json(spark: SparkSession, path: str) -> str | None:
    """The text of a small file."""
    if not Files(spark).exists(f"{path}/corpus.json"):
        return None
    return spark.read.text(f"{path}/corpus.json", wholetext=True).first().value


def write_once(df: DataFrame, path: str) -> None:
    """Writes an immutable version; a path that exists is refused (version_exists)."""
    df.write.mode("errorifexists").parquet(path)


def append(df: DataFrame, path: str, *partitions: str) -> None:
    """Appends to an append-only table, laid out by client or day."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def write_terminals(done: DataFrame, sink: str, batch: str) -> bool:
    """Result, review, dead-letter and audit rows of finished runs, committed together under the batch's name; False if it is committed already."""
    return write_batch(checked(kept(done, "done")), sink, batch)


def write_json(df: DataFrame, path: str) -> None:
    """The JSON view of a contract table."""
    df.write.mode("append").json(path)


def corrected_labels(corrections: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (sample_id, field, value) with the last correction (corrected, corrected_at) of each."""
    fixed = corrections.groupBy("sample_id", "field").agg(F.max_by("corrected", "corrected_at").alias("corrected"))
    return labels.join(fixed, ["sample_id", "field"], "left").withColumn("value", F.coalesce("corrected", "value")).drop("corrected")


def export_corrections(corrections: DataFrame, labels: DataFrame, path: str) -> None:
    """Labels with the corrected values, as a new corpus version."""
    write_once(corrected_labels(corrections, labels), path)


def manifest_json(client_id: str, workflow_id: str, version: str, engine_range: str, email_types: list[str], artifacts: list[tuple[str, str, str]]) -> str:
    """A manifest with artifacts (path, kind, sha256), in canonical order."""
    return json.dumps({"client_id": client_id, "workflow_id": workflow_id, "version": version, "engine_range": engine_range, "email_types": sorted(email_types), "artifacts": [dict(zip(("path", "kind", "sha256"), a, strict=True)) for a in sorted(artifacts)]}, sort_keys=True)
