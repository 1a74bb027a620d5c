"""Metrics of predictions against labels, gates and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Default gates: metric, limit, and whether it is a least value.
GATES = (("type_accuracy", 0.95, True), ("field_accuracy", 0.90, True), ("critical_field_accuracy", 0.95, True), ("source_attribution", 0.85, True), ("review_rate", 0.20, False), ("false_accept_rate", 0.01, False), ("calibration", 0.10, False))
FALSE_ACCEPT_FLOOR = 0.01


def scored_fields(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """(sample_id, field, critical, expected, actual, correct): every label, with its prediction if there is one."""
    joined = labels.join(predictions.select("sample_id", "field", F.col("value_norm").alias("actual"), "confidence"), ["sample_id", "field"], "left")
    return joined.withColumn("correct", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


def accuracy(scored: DataFrame, by: str = "field", right: str = "correct") -> DataFrame:
    """(by, n, accuracy): overall (null) and for each value."""
    return scored.groupingSets([[], [F.col(by)]], by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(right).cast("double")).alias("accuracy"))


def attribution_accuracy(predicted: DataFrame, labelled: DataFrame) -> DataFrame:
    """accuracy over values with a labelled locator, and how many predictions had none."""
    joined = predicted.join(labelled.select("sample_id", "field", F.col("source").alias("expected_source")), ["sample_id", "field"], "left")
    has = F.col("expected_source").isNotNull()
    return joined.agg(F.avg(F.when(has, (F.col("source") == F.col("expected_source")).cast("double"))).alias("accuracy"), F.count_if(~has).alias("excluded"))


def false_accepts(terminals: DataFrame, scored: DataFrame) -> DataFrame:
    """accepted, wrong and rate: accepted samples with a wrong critical field; null where none was accepted."""
    bad = scored.groupBy("sample_id").agg(F.bool_or(F.col("critical") & ~F.col("correct")).alias("bad"))
    per = terminals.where("outcome = 'extracted'").join(bad, "sample_id", "left")
    return per.agg(F.count(F.lit(1)).alias("accepted"), F.count_if(F.col("bad")).alias("wrong")).withColumn("rate", F.when(F.col("accepted") > 0, F.col("wrong") / F.col("accepted")))


def calibration(predictions: DataFrame, confidence: str = "confidence", right: str = "correct", buckets: int = 10) -> DataFrame:
    """(bucket, n, mean_confidence, mean_correct, gap) of equal buckets; 1.0 belongs to the last."""
    bucket = F.least(F.floor(F.col(confidence) * buckets), F.lit(buckets - 1)).cast("long")
    per = predictions.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(confidence).cast("double")).alias("mean_confidence"), F.avg(F.col(right).cast("double")).alias("mean_correct"))
    return per.withColumn("gap", F.abs(F.col("mean_confidence") - F.col("mean_correct")))


def calibration_error(buckets: DataFrame) -> DataFrame:
    return buckets.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("calibration"))


def threshold_sweep(predictions: DataFrame, confidence: str = "confidence", right: str = "correct") -> DataFrame:
    """(band, review_share, residual_error) at each confidence seen, to four decimals, were it the acceptance band.

    Counts for each distinct confidence are summed in order; a band's rows are those below it.
    """
    per = predictions.groupBy(F.round(confidence, 4).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(right)).alias("wrong"))
    below = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row for each distinct confidence: at most 10,001 from 0 to 1.
    run = per.withColumns({"nb": F.coalesce(F.sum("n").over(below), F.lit(0)), "wb": F.coalesce(F.sum("wrong").over(below), F.lit(0)), "nt": F.sum("n").over(total), "wt": F.sum("wrong").over(total)})
    return run.select("band", (F.col("nb") / F.col("nt")).alias("review_share"), ((F.col("wt") - F.col("wb")) / (F.col("nt") - F.col("nb"))).alias("residual_error"))


def regressions(candidate: DataFrame, promoted: DataFrame) -> DataFrame:
    """(metric, field, delta, regressed) of a candidate against the promoted package on one holdout."""
    a, b = candidate.select("metric", "field", F.col("value").alias("a")), promoted.select("metric", "field", F.col("value").alias("b"))
    joined = a.join(b, ["metric", "field"], "full_outer")
    return joined.select("metric", "field", (F.col("a") - F.col("b")).alias("delta"), (F.coalesce("a", F.lit(0.0)) < F.coalesce("b", F.lit(0.0))).alias("regressed"))


def gates(metrics: DataFrame, client_limits: dict[str, float] | None = None) -> DataFrame:
    """(metric, value, limit, passed) of metrics (metric, value); a missing value fails, the floor cannot be loosened."""
    limits = client_limits or {}
    if limits.get("false_accept_rate", 0.0) > FALSE_ACCEPT_FLOOR:
        raise ValueError(f"the false-accept gate cannot be above {FALSE_ACCEPT_FLOOR}")
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(limits.get(m, v)).alias("limit"), F.lit(least).alias("least")) for m, v, least in GATES])
    table = metrics.sparkSession.range(1).select(F.explode(rows).alias("g")).select("g.*")
    passed = F.when(F.col("value").isNull(), False).when(F.col("least"), F.col("value") >= F.col("limit")).otherwise(F.col("value") <= F.col("limit"))
    return table.join(metrics, "metric", "left").select("metric", "value", "limit", passed.alias("passed"))


def exemplars(scored: DataFrame, k: int = 3) -> DataFrame:
    """The k most confident wrong fields of each field."""
    order = Window.partitionBy("field").orderBy(F.col("confidence").desc_nulls_last(), "sample_id")
    return scored.where("not correct").withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)


def skill_variants(default: DataFrame, variant: DataFrame, least_gain: float = 0.0, shown: int = 3) -> DataFrame:
    """(skill_id, n, before, after, fixed, broken, cases, proposed): a client's variant of each skill against the engine's default.

    Both: skill_id, sample_id, correct, over the same samples; one without a result counts as wrong. cases
    are the least ids of the default's errors that the variant mends. A variant is proposed only where it is
    more accurate by more than least_gain; elsewhere the default stays.
    """
    a, b = (df.groupBy("skill_id", "sample_id").agg(F.bool_and(F.coalesce("correct", F.lit(False))).alias(name)) for df, name in ((default, "was"), (variant, "now")))
    both = a.join(b, ["skill_id", "sample_id"], "full_outer").withColumns({"was": F.coalesce("was", F.lit(False)), "now": F.coalesce("now", F.lit(False))})
    per = both.groupBy("skill_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("was").cast("double")).alias("before"), F.avg(F.col("now").cast("double")).alias("after"), F.count_if(~F.col("was") & F.col("now")).alias("fixed"), F.count_if(F.col("was") & ~F.col("now")).alias("broken"))
    first = Window.partitionBy("skill_id").orderBy("sample_id")
    cases = both.where("NOT was AND now").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= shown).groupBy("skill_id").agg(F.array_sort(F.collect_list("sample_id")).alias("cases"))
    found = per.join(cases, "skill_id", "left")
    return found.withColumns({"cases": F.coalesce("cases", F.array().cast(cases.schema["cases"].dataType)), "proposed": F.col("after") - F.col("before") > least_gain})


def report(metrics: DataFrame, per_field: DataFrame) -> DataFrame:
    """One row: canonical JSON of metrics and per-field accuracies, and its SHA-256; no time enters it."""
    m = metrics.agg(F.array_sort(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    f = per_field.agg(F.array_sort(F.collect_list(F.struct("field", "n", "accuracy"))).alias("fields"))
    body = m.join(F.broadcast(f)).select(F.to_json(F.struct("metrics", "fields"), {"ignoreNullFields": "false"}).alias("report"))
    return body.withColumn("report_hash", F.sha2("report", 256))
