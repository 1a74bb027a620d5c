"""Rules about records rather than transforms of them, each in a form that a query can check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The grammar of skill inputs and outputs.
SHAPES = {"string": T.StringType(), "string[]": T.ArrayType(T.StringType()), "float": T.DecimalType(5, 4), "row[]": T.ArrayType(T.MapType(T.StringType(), T.StringType())), "map<string,string>": T.MapType(T.StringType(), T.StringType()), "map<string,float>": T.MapType(T.StringType(), T.DecimalType(5, 4))}
AUTHORING_ENDS = ("published", "abandoned", "failed")


def package_path(root: str, client_id: str, workflow_id: str, version: str) -> str:
    """Where a registry keeps a package; versions are folders that are never written twice."""
    return f"{root.rstrip('/')}/{client_id}/{workflow_id}@{version}"


def stays_apart(path: str, root: str) -> bool:
    """Whether a path lies outside a root; trial jobs must stay apart from production."""
    return not (path.rstrip("/") + "/").startswith(root.rstrip("/") + "/")


def output_problems(output: DataFrame, declared: dict[str, str], agent: str) -> list[str]:
    """agent_failed for a skill output whose columns are not those of its manifest."""
    have = {f.name: f.dataType for f in output.schema}
    wrong = [n for n, shape in declared.items() if n not in have or (shape in SHAPES and have[n] != SHAPES[shape])]
    return [f"agent_failed:{agent}"] if wrong else []


def null_outputs(output: DataFrame, required: list[str], agent: str) -> DataFrame:
    """(run_id, code) of rows in which a required output is null."""
    return output.where(F.greatest(*[F.col(c).isNull().cast("int") for c in required], F.lit(0)) == 1).select("run_id", F.lit(f"agent_failed:{agent}").alias("code")).distinct()


def unreviewed(artifacts: DataFrame) -> DataFrame:
    """Artifacts without a reviewer; those without a generator as well never reach a trial."""
    return artifacts.where("reviewed_by is null").withColumn("publishable", F.col("generated_by").isNotNull())


def promotion_history(promotions: DataFrame, sign_offs: DataFrame, reports: DataFrame) -> DataFrame:
    """Promotions with who signed off which report; one without both is left out."""
    return promotions.join(sign_offs, ["client_id", "workflow_id", "version"]).join(reports, ["client_id", "workflow_id", "version", "report_hash"])


def reconstruct(audit_id: str, audits: DataFrame, attribution: DataFrame, registry: DataFrame) -> DataFrame:
    """Everything recorded of one run: package, engine, and each value with its source."""
    one = audits.where(F.col("audit_id") == audit_id)
    return one.join(attribution, "audit_id", "left").join(registry.withColumnRenamed("version", "package_version"), ["client_id", "workflow_id", "package_version"], "left")


def production_only(records: DataFrame) -> DataFrame:
    """Records that count for production metrics: neither shadow nor corrected by hand."""
    return records.where("not coalesce(is_shadow, false) and not coalesce(human_corrected, false)")


def correct(review: DataFrame, corrections: DataFrame) -> DataFrame:
    """Second terminal objects of resolved reviews: the same audit_id, corrected fields, marked as corrected by hand."""
    fixed = corrections.groupBy("audit_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "corrected")))).alias("corrected_fields"))
    return review.join(fixed, "audit_id").withColumn("human_corrected", F.lit(True))


def hops(trace: DataFrame) -> DataFrame:
    """Calls in a trace (run_id, agent, parent) that the orchestrator did not make: must be none."""
    return trace.where(~F.col("parent").eqNullSafe("orchestrator"))


def interventions(found: DataFrame, controller: str) -> DataFrame:
    """Controller events (run_id, code) as trace rows."""
    return found.select("run_id", F.lit(controller).alias("agent"), F.lit("orchestrator").alias("parent"), F.lit("flagged").alias("status"), F.col("code").alias("reason"))


def bad_ends(authoring_runs: DataFrame) -> DataFrame:
    """Authoring runs with an unknown end."""
    return authoring_runs.where(F.col("state").isNotNull() & ~F.col("state").isin(*AUTHORING_ENDS))


def folder_hash(spark: SparkSession, path: str) -> str:
    """One hash of all files below a path: equal before and after whatever must not write there.

    Files are summed by hash in partial aggregates, so no task gets them all.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    each = [F.xxhash64(F.lit(k), "path", F.sha2("content", 256)).cast("decimal(38,0)") for k in (1, 2)]
    found = files.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(h), F.lit(0)).alias(f"h{k}") for k, h in enumerate(each)]).first()
    return f"{found.n}:{found.h0}:{found.h1}"
