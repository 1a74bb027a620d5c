"""Queries over the star schema that put every operator to work, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions.frames import dealt, kept, spread
from ..operators import authoring, deliveries, detection, evaluation, extraction, governance, history, merging, monitoring, routing, selection
from ..sources import files, packages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLES[query.__name__] = sql
        return query

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stop words that stand for a type's keywords, with weights.
KEYWORDS = [("en", "the", 0.45), ("en", "and", 0.3), ("en", "that", 0.2), ("fr", "le", 0.45), ("fr", "les", 0.3), ("fr", "une", 0.2), ("de", "der", 0.45), ("de", "und", 0.3), ("de", "die", 0.2), ("es", "los", 0.45), ("es", "para", 0.3), ("es", "una", 0.2)]
_HIT = " + ".join("CASE WHEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}])' || '{0}' || '([^\\p{{L}}\\p{{N}}]|$)') AND type = '{1}' THEN {2} ELSE 0 END".format(w, k, s) for k, w, s in KEYWORDS)
_SCORES = f"SELECT doc_id, lang, type, CAST(least(1, {_HIT}) AS DOUBLE) AS score FROM documents, (VALUES ('en'), ('fr'), ('de'), ('es')) v(type)"
_LOCKED = f"""WITH s AS ({_SCORES}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, type) AS p, max(score) OVER (PARTITION BY doc_id) AS top FROM s),
  k AS (SELECT *, sum(CASE WHEN score = top THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS ties FROM r)
  SELECT doc_id, lang, CASE WHEN score >= 0.6 AND ties = 1 THEN type END AS type, score, NOT (score >= 0.6 AND ties = 1) AS ambiguous FROM k WHERE p = 1"""


def _type_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.score_types(spread(_t(spark, sf_dir, "documents").select("doc_id", "text")), KEYWORDS, [], key="doc_id")


def _locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.sql("SELECT type, CAST(0.6 AS DECIMAL(5,4)) AS threshold FROM VALUES ('en'), ('fr'), ('de'), ('es') v(type)")
    return detection.lock_type(_type_scores(spark, sf_dir), limits, "doc_id")


@register(f"SELECT doc_id, type, score FROM ({_SCORES})")
def q_type_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted signal scores of every type (OP-046, 065, 127, 128, 152)."""
    return _type_scores(spark, sf_dir).withColumn("score", F.col("score").cast("double"))


@register(f"SELECT doc_id, type, score, ambiguous FROM ({_LOCKED})")
def q_locked_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best type over its threshold, ties ambiguous (OP-095, 104, 117)."""
    return _locked(spark, sf_dir).withColumn("score", F.col("score").cast("double"))


@register(f"SELECT lang, count(*) AS n, round(avg(CASE WHEN type = lang THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM ({_LOCKED}) GROUP BY GROUPING SETS ((), (lang))")
def q_type_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the locked type, overall and by true type (OP-071, 072)."""
    joined = _t(spark, sf_dir, "documents").select("doc_id", "lang").join(_locked(spark, sf_dir), "doc_id")
    right = joined.withColumn("correct", F.coalesce(F.col("type") == F.col("lang"), F.lit(False)).cast("int"))
    return evaluation.accuracy(right, "lang").withColumn("accuracy", F.round("accuracy", 9))


@register(f"""WITH l AS ({_LOCKED}), b AS (SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bucket, score, CASE WHEN type = lang THEN 1.0 ELSE 0.0 END AS ok FROM l)
SELECT bucket, count(*) AS n, round(avg(score), 6) AS mean_confidence, round(avg(ok), 6) AS mean_correct, round(abs(avg(score) - avg(ok)), 6) AS gap FROM b GROUP BY bucket""")
def q_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence against correctness in ten buckets (OP-076)."""
    joined = _t(spark, sf_dir, "documents").select("doc_id", "lang").join(_locked(spark, sf_dir), "doc_id")
    rows = joined.select(F.col("score").alias("confidence"), F.coalesce(F.col("type") == F.col("lang"), F.lit(False)).cast("int").alias("correct"))
    return evaluation.calibration(rows).select("bucket", "n", *[F.round(c, 6).alias(c) for c in ("mean_confidence", "mean_correct", "gap")])


_RUNS = """a AS (SELECT o_orderkey AS run_id, CAST(o_totalprice AS DECIMAL(18,2)) AS body, (SELECT 1) AS one, o_orderdate FROM orders),
  b AS (SELECT l_orderkey AS run_id, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS att, count(*) AS n FROM lineitem GROUP BY 1),
  j AS (SELECT a.run_id, body, att, n, abs(body - att) AS delta FROM a LEFT JOIN b ON a.run_id = b.run_id)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in an order's body and in its lines, its date, and its number of lines."""
    conf, none = (lambda x: F.lit(x).cast("decimal(5,4)")), F.lit(None)
    cell = lambda field, dec, date, norm, source, seg, c: F.struct(F.lit(field).alias("field"), norm.cast("string").alias("value_raw"), norm.cast("string").alias("value_norm"), dec.cast("decimal(18,2)").alias("value_dec"), date.cast("date").alias("value_date"), F.lit(source).alias("source"), F.lit(seg).cast("int").alias("segment_index"), conf(c).alias("confidence"))
    shape = lambda df, *cells: df.select("run_id", F.inline(F.array(*cells)))
    body = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), "o_orderdate")
    lineitem = dealt(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_extendedprice"), "run_id")
    lines = lineitem.groupBy("run_id").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("amount"), F.count(F.lit(1)).alias("n"))
    # Both candidates of a row are made at once: the lines are grouped by one pass.
    return merging.union_candidates(
        shape(body, cell("amount", F.col("amount"), none, F.col("amount"), "body:segment:0", 0, 0.7), cell("invoice_date", none, F.col("o_orderdate"), F.to_date("o_orderdate"), "body:segment:0", 0, 0.8)),
        shape(lines, cell("amount", F.col("amount"), none, F.col("amount"), "attachment:lines.csv#total", None, 0.9), cell("line_count", F.col("n"), none, F.col("n"), "attachment:lines.csv#rows", None, 0.9)),
    )


@register(f"""WITH {_RUNS}, c AS (SELECT run_id, CASE WHEN n IS NULL THEN 'low_confidence|missing_field:line_count' WHEN delta > 20000 THEN 'critical_field_conflict:amount' ELSE '' END AS codes FROM j)
SELECT CASE WHEN codes = '' THEN 'extracted' ELSE 'review_queued' END AS outcome, codes, count(*) AS n FROM c GROUP BY 1, 2""")
def q_route_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by outcome and reason codes: candidates, merge, completeness, confidence, routing (OP-050, 066-070, 089, 103, 109, 115, 133)."""
    found = _candidates(spark, sf_dir)
    runs = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit("invoice").alias("type"))
    fields = spark.sql("SELECT 'invoice' AS type, field, true AS required, critical FROM VALUES ('amount', true), ('invoice_date', false), ('line_count', false) v(field, critical)")
    tolerances = spark.sql("SELECT 'amount' AS field, CAST(20000 AS DECIMAL(18,2)) AS absolute, CAST(NULL AS INT) AS days")
    bands = spark.sql("SELECT 'invoice' AS type, CAST(0.85 AS DECIMAL(5,4)) AS accept_at, CAST(0.5 AS DECIMAL(5,4)) AS reject_below")
    always = spark.sql("SELECT 'invoice' AS type, 'encrypted_no_key' AS prefix")
    no_flags = runs.where("false").select("run_id", "type", F.lit("").alias("code"))
    whole, required = kept(merging.settle(found), "settled"), routing.required_of(runs, fields)
    rows, keys = whole.count(), ("run_id", "field")
    settled = dealt(whole, *keys, rows=rows)
    scores = routing.confidence(required, settled)
    # Fields in conflict are told before they are dealt out to meet the critical ones.
    critical = dealt(required.where("critical").select("run_id", "field"), *keys, rows=rows)
    codes = routing.reasons(no_flags, always, routing.missing(required, settled), merging.conflicts(whole, tolerances), scores, bands, critical)
    return routing.terminal(dealt(runs, "run_id"), codes).groupBy("outcome", F.array_join("reasons", "|").alias("codes")).agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {_RUNS} SELECT run_id, 'amount' AS field, CAST(coalesce(att, body) AS DOUBLE) AS value, CASE WHEN att IS NULL THEN 'body:segment:0' ELSE 'attachment:lines.csv#total' END AS source FROM j")
def q_resolved_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winning amount of every order (OP-052, 066, 150)."""
    return merging.resolve(_candidates(spark, sf_dir).where("field = 'amount'")).select("run_id", "field", F.col("value_dec").cast("double").alias("value"), "source")


@register(f"WITH {_RUNS} SELECT run_id, CAST(delta AS DOUBLE) AS delta, delta > 20000 AS beyond FROM j WHERE att IS NOT NULL")
def q_amount_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far an order's amounts lie apart (OP-067, 133)."""
    both = merging.conflicts(merging.settle(_candidates(spark, sf_dir).where("field = 'amount'")), spark.sql("SELECT 'amount' AS field, CAST(20000 AS DECIMAL(18,2)) AS absolute, CAST(NULL AS INT) AS days"))
    return both.where("values > 1 or delta > 0").select("run_id", F.col("delta").cast("double").alias("delta"), "beyond")


@register("SELECT o_orderkey AS run_id, 'lines' AS field FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def q_missing_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without lines (OP-036, 050)."""
    required = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit("lines").alias("field"))
    have = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.lit("lines").alias("field"), F.lit("1").alias("value_norm")).distinct()
    return routing.missing(required, have)


@register("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS recency_index FROM conversations")
def q_recency_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0 for the newest turn of a thread (OP-094)."""
    return detection.recency(_t(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "recency_index")


@register("SELECT conv_id AS run_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) - 1 AS segment_index, length(trim(text)) AS n_chars FROM conversations")
def q_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads quoted newest first and cut into segments again (OP-139, 144)."""
    turns = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("turn", "text")))).alias("t"))
    bodies = turns.select(F.col("conv_id").alias("run_id"), F.array_join(F.transform("t", lambda x: x["text"]), "\n-----Original Message-----\n").alias("body"))
    return detection.segment(bodies).select("run_id", F.col("segment_index").cast("long").alias("segment_index"), F.char_length("text").cast("long").alias("n_chars"))


@register("SELECT count(*) FILTER (WHERE quality = 1) AS accepted, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS wrong, round(count(*) FILTER (WHERE quality = 1 AND toxic = 1) / count(*) FILTER (WHERE quality = 1), 9) AS rate FROM labels")
def q_false_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted samples with a wrong critical field (OP-075)."""
    labels = _t(spark, sf_dir, "labels").withColumnRenamed("doc_id", "sample_id")
    ends = labels.select("sample_id", F.when(F.col("quality") == 1, "extracted").otherwise("review_queued").alias("outcome"))
    scored = labels.select("sample_id", F.lit(True).alias("critical"), (F.col("toxic") == 0).alias("correct"))
    return evaluation.false_accepts(ends, scored).withColumn("rate", F.round("rate", 9))


@register("SELECT l.quality, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM labels l GROUP BY 1")
def q_review_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each terminal state (OP-074, 085)."""
    mix = monitoring.state_mix(_t(spark, sf_dir, "labels").withColumn("all", F.lit(1)), "quality", "all")
    return mix.select("quality", "n", F.round("share", 9).alias("share"))


@register("""WITH p AS (SELECT (n_chars % 100) / 100.0 AS band, quality = 1 AS ok FROM documents JOIN labels USING (doc_id)), g AS (SELECT band, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS w FROM p GROUP BY 1),
r AS (SELECT band, coalesce(sum(n) OVER (ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb, coalesce(sum(w) OVER (ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb, sum(n) OVER () AS nt, sum(w) OVER () AS wt FROM g)
SELECT round(CAST(band AS DOUBLE), 2) AS band, round(CAST(nb AS DOUBLE) / CAST(nt AS DOUBLE), 9) AS review_share, round(CAST(wt - wb AS DOUBLE) / CAST(nt - nb AS DOUBLE), 9) AS residual_error FROM r""")
def q_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review share and residual error at every band (OP-077, 101)."""
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id").select(F.round((F.col("n_chars") % 100) / 100, 2).alias("confidence"), (F.col("quality") == 1).alias("correct"))
    return evaluation.threshold_sweep(rows).select("band", F.round("review_share", 9).alias("review_share"), F.round("residual_error", 9).alias("residual_error"))


_HOLDOUT = "SELECT doc_id AS sample_id, lang AS email_type, row_number() OVER (PARTITION BY lang ORDER BY sha256('c1|' || CAST(doc_id AS VARCHAR)), doc_id) <= greatest(5, ceil(count(*) OVER (PARTITION BY lang) * 0.2)) AS is_holdout FROM documents"


def _holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.holdout(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("email_type")), "c1")


@register(_HOLDOUT)
def q_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic holdout of every type (OP-099)."""
    return _holdout(spark, sf_dir)


@register(f"SELECT count(*) AS overlap FROM (SELECT sample_id FROM ({_HOLDOUT}) WHERE is_holdout INTERSECT SELECT sample_id FROM ({_HOLDOUT}) WHERE NOT is_holdout)")
def q_holdout_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that generation and holdout share: none (OP-061, 112)."""
    both = _holdout(spark, sf_dir)
    return authoring.leaks(both.where("not is_holdout"), both.where("is_holdout")).agg(F.count(F.lit(1)).alias("overlap"))


@register("SELECT lang AS email_type, 250 - count(DISTINCT doc_id) AS lacking FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) < 250")
def q_corpus_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types with fewer labelled samples than asked for (OP-080)."""
    return authoring.shortfall(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("email_type")), least=250)


@register("SELECT lang AS email_type, count(*) AS n, (SELECT string_agg(CAST(d2.doc_id AS VARCHAR), ',' ORDER BY d2.doc_id) FROM (SELECT doc_id FROM documents d3 WHERE d3.lang = d.lang ORDER BY doc_id LIMIT 3) d2) AS exemplars FROM documents d GROUP BY lang")
def q_type_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types with their counts and exemplars (OP-081, 105)."""
    found = selection.propose_types(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("email_type")))
    return found.select("email_type", "n", F.array_join(F.transform("exemplars", lambda x: x.cast("string")), ",").alias("exemplars"))


@register("SELECT lang AS email_type, split_part(text, ' ', 1) AS pattern, count(DISTINCT doc_id) AS support FROM documents GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 3")
def q_pattern_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening words that at least three samples of a type share (OP-079, 082)."""
    matches = _t(spark, sf_dir, "documents").select(F.col("lang").alias("email_type"), F.col("doc_id").alias("sample_id"), F.split_part("text", F.lit(" "), F.lit(1)).alias("pattern")).withColumn("span", F.col("pattern"))
    return authoring.supported_patterns(matches).select("email_type", "pattern", "support")


@register("""WITH v AS (SELECT p_type AS email_type, p_partkey AS sample_id, 'large' AS field FROM part WHERE p_size > 20 UNION ALL SELECT p_type, p_partkey, 'dear' FROM part WHERE p_retailprice > 1500),
t AS (SELECT p_type AS email_type, count(DISTINCT p_partkey) AS total FROM part GROUP BY 1)
SELECT v.email_type, field, count(DISTINCT sample_id) AS n, round(count(DISTINCT sample_id) / any_value(total), 9) AS share FROM v JOIN t ON v.email_type = t.email_type GROUP BY 1, 2 HAVING count(DISTINCT sample_id) / any_value(total) >= 0.5""")
def q_field_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that stand in at least half of a type's samples (OP-078)."""
    part = _t(spark, sf_dir, "part").select(F.col("p_type").alias("email_type"), F.col("p_partkey").alias("sample_id"), "p_size", "p_retailprice")
    marks = F.array_compact(F.array(F.when(F.col("p_size") > 20, "large"), F.when(F.col("p_retailprice") > 1500, "dear")))
    return authoring.propose_fields(part.select("email_type", "sample_id", F.explode(marks).alias("field")), part, 0.5).withColumn("share", F.round("share", 9))


@register("""WITH w AS (SELECT DISTINCT lang AS email_type, doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')) AS term FROM documents), p AS (SELECT term, email_type, count(*) AS n FROM w WHERE length(term) >= 4 GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY term) AS total FROM p) SELECT email_type, term, n, round(n / total, 9) AS purity FROM t WHERE n >= 30 AND n / total >= 0.9""")
def q_mined_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that stand in one type above all (OP-082, 129)."""
    docs = _t(spark, sf_dir, "documents").select(F.col("lang").alias("email_type"), F.col("doc_id").alias("sample_id"), "text")
    return authoring.mine_keywords(docs, 30, 0.9).withColumn("purity", F.round("purity", 9))


_ACTIVE = "(VALUES ('1.0.0', TIMESTAMP '2024-01-01 00:00:00'), ('1.1.0', TIMESTAMP '2024-01-10 12:00:00'), ('1.2.0', TIMESTAMP '2024-01-21 06:30:00')) a(version, activated_at)"


@register(f"SELECT e.event_id, a.version FROM events e ASOF LEFT JOIN {_ACTIVE} ON e.ts >= a.activated_at")
def q_asof_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The package version active when each run began (OP-049, 102)."""
    events = _t(spark, sf_dir, "events").select("event_id", F.lit("w").alias("workflow_id"), F.col("ts").cast("timestamp").alias("ts"))
    active = spark.sql(f"SELECT 'w' AS workflow_id, version, activated_at FROM {_ACTIVE}")
    return history.as_of(events, active, ["workflow_id"], "ts").select("event_id", "version")


@register("""WITH RECURSIVE t AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS r FROM (SELECT DISTINCT user_id, event_type, ts FROM events)),
f AS (SELECT user_id, event_type, ts, r, ts AS start, 1 AS epoch FROM t WHERE r = 1 UNION ALL SELECT t.user_id, t.event_type, t.ts, t.r, CASE WHEN t.ts >= f.start + INTERVAL 7 DAY THEN t.ts ELSE f.start END, CASE WHEN t.ts >= f.start + INTERVAL 7 DAY THEN f.epoch + 1 ELSE f.epoch END FROM t JOIN f ON t.user_id = f.user_id AND t.event_type = f.event_type AND t.r = f.r + 1)
SELECT e.event_id, CAST(f.epoch AS BIGINT) AS delivery_epoch, row_number() OVER (PARTITION BY e.user_id, e.event_type, f.epoch ORDER BY e.ts, e.event_id) = 1 AS is_first FROM events e JOIN f ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.ts = f.ts""")
def q_dedupe_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First deliveries of each key within seven days (OP-098, 121)."""
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return deliveries.first_deliveries(events, ["user_id", "event_type"], "ts").select("event_id", "delivery_epoch", "is_first")


@register("SELECT coalesce(a.k, b.k) AS audit_id, CASE WHEN a.k IS NULL THEN 'audit_only' ELSE 'terminal_only' END AS side FROM (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 7 <> 0) a FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def q_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without their partner, both ways (OP-018, 051)."""
    terminals = _t(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("audit_id"))
    audits = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("audit_id")).distinct()
    return history.reconcile(terminals, audits)


@register("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95 FROM events GROUP BY 1")
def q_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles by group (OP-084)."""
    found = monitoring.latency(_t(spark, sf_dir, "events"), "value", "event_type")
    return found.select("event_type", "n", F.round("p50", 9).alias("p50"), F.round("p95", 9).alias("p95"))


@register("SELECT event_type AS client_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def q_throughput_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each client and hour (OP-083)."""
    runs = _t(spark, sf_dir, "events").select(F.col("event_type").alias("client_id"), "ts")
    return monitoring.throughput(runs, "ts").select("client_id", F.col("hour").cast("timestamp_ntz").alias("hour"), "n")


@register("SELECT event_type AS agent, count(*) AS calls, count(*) FILTER (WHERE value > 90) AS failures, round(count(*) FILTER (WHERE value > 90) / count(*), 9) AS rate FROM events GROUP BY 1")
def q_failure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure rate of each agent from traces (OP-086)."""
    trace = F.struct(F.col("event_type").alias("agent"), F.when(F.col("value") > 90, "failed").otherwise("ok").alias("status"))
    audits = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(trace).alias("agent_trace"))
    return monitoring.failure_rates(audits).withColumn("rate", F.round("rate", 9))


@register("SELECT user_id AS run_id, round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE), 4) AS cost, sum(CAST(value AS DECIMAL(18,6))) > 1500 AS over FROM events GROUP BY 1")
def q_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of each run against a ceiling (OP-087)."""
    usage = _t(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("value").alias("cost"))
    return monitoring.cost(usage, 1500).select("run_id", F.round(F.col("cost").cast("double"), 4).alias("cost"), "over")


@register("SELECT user_id AS run_id, event_type AS agent, count(*) AS attempts, arg_max(CASE WHEN value > 90 THEN 'failed' ELSE 'ok' END, event_id) AS final_status FROM events GROUP BY 1, 2")
def q_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of each agent and how they ended (OP-088)."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    attempts = _t(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("agent"), F.row_number().over(w).cast("long").alias("attempt"), F.when(F.col("value") > 90, "failed").otherwise("ok").alias("status"))
    return monitoring.retries(attempts)


@register("""WITH h AS (SELECT event_type AS client_id, date_trunc('hour', ts) AS hour, count(*) AS runs, count(*) FILTER (WHERE value > 60) AS reviewed FROM events GROUP BY 1, 2),
r AS (SELECT client_id, hour, sum(reviewed) OVER w / sum(runs) OVER w AS rate, count(*) OVER w AS hours FROM h WINDOW w AS (PARTITION BY client_id ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT client_id, hour, round(rate, 9) AS rate FROM r WHERE hours = 3 AND rate > 0.5""")
def q_review_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with a sustained review rate over the target (OP-090)."""
    hours = _t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("client_id"), F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("value") > 60).alias("reviewed"))
    return monitoring.sustained_review(hours, 0.5).select("client_id", F.col("hour").cast("timestamp_ntz").alias("hour"), F.round("rate", 9).alias("rate"))


@register("SELECT user_id AS workflow_id, event_type AS field, count(*) AS n FROM events WHERE value > 50 GROUP BY 1, 2 HAVING count(*) >= 3")
def q_repeated_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields corrected again and again (OP-091)."""
    return monitoring.repeated_corrections(_t(spark, sf_dir, "events").where("value > 50").select(F.col("user_id").alias("workflow_id"), F.col("event_type").alias("field")))


@register("SELECT count(*) AS runs, count(l.k) AS audited, round(count(l.k) / count(*), 9) AS ratio FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON o_orderkey = l.k")
def q_audit_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with an audit record (OP-092)."""
    runs, audits = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id")), _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"))
    return monitoring.audit_completeness(runs, audits).withColumn("ratio", F.round("ratio", 9))


@register("""WITH t AS (SELECT user_id AS run_id, event_id, epoch_ms(ts) AS s, CAST(value * 1000 AS BIGINT) AS d FROM events), b AS (SELECT run_id, s, max(s + d) OVER (PARTITION BY run_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM t)
SELECT run_id, coalesce(bool_or(s < e), false) AS overlap FROM b GROUP BY 1""")
def q_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose branches overlapped in time (OP-100, 114)."""
    trace = _t(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("agent"), F.unix_millis(F.col("ts").cast("timestamp")).alias("started_ms"), F.round(F.col("value") * 1000).cast("long").alias("duration_ms"))
    return merging.overlaps(trace)


@register("""WITH o AS (SELECT p_name AS path, sha256(p_brand || '|' || p_type) AS h, p_partkey AS k FROM part), a AS (SELECT CAST(k AS VARCHAR) AS path, h FROM o WHERE k % 10 <> 1), b AS (SELECT CAST(k AS VARCHAR) AS path, CASE WHEN k % 10 = 3 THEN sha256(h) ELSE h END AS h FROM o WHERE k % 10 <> 2)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path""")
def q_artifact_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts added, removed, changed or the same (OP-058, 110, 134)."""
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.sha2(F.concat_ws("|", "p_brand", "p_type"), 256).alias("h"))
    old = part.where("k % 10 <> 1").select(F.col("k").cast("string").alias("path"), F.col("h").alias("sha256"))
    new = part.where("k % 10 <> 2").select(F.col("k").cast("string").alias("path"), F.when(F.col("k") % 10 == 3, F.sha2("h", 256)).otherwise(F.col("h")).alias("sha256"))
    return history.artifact_diff(old, new)


@register("""WITH a AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark), b AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
x AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM a), y AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM b)
SELECT item_id AS artifact, doc_id AS sample_id, count(*) AS shingles FROM x JOIN y ON x.s = y.s GROUP BY 1, 2""")
def q_leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus texts that share five-word runs with artifact strings (OP-062)."""
    strings = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("artifact"), "text")
    return authoring.corpus_leaks(strings, _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "text"))


_PII = "len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS emails, len(regexp_extract_all(text, '\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}')) AS addresses, len(regexp_extract_all(text, '[0-9]{12,19}')) AS accounts"


@register(f"SELECT * FROM (SELECT doc_id AS sample_id, {_PII} FROM documents) WHERE emails + addresses + accounts > 0")
def q_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with addresses or account numbers (OP-140)."""
    return authoring.pii_scan(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "text"))


@register("SELECT p_partkey AS file, p_brand AS header, CASE WHEN upper(p_brand) = 'BRAND#1' THEN 'first' ELSE 'second' END AS field FROM part WHERE upper(p_brand) IN ('BRAND#1', 'BRAND#2')")
def q_alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers that are an alias of a field, compared as normal labels (OP-060, 129, 148)."""
    aliases = spark.sql("SELECT * FROM VALUES ('first', ' BRAND 1 '), ('second', 'brand-2') v(field, alias)")
    return authoring.map_headers(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("header")), aliases)


@register("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]*)', 1) AS route FROM pages")
def q_url_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and first path segment of an ingress address (OP-127)."""
    return _t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/]*/([^/?#]*)", 1).alias("route"))


@register("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def q_props_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fields of JSON payloads (OP-136)."""
    return _t(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k")).groupBy("event_type").agg(F.sum("k").alias("k"))


@register("SELECT user_id AS version, event_type AS state FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def q_registry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every version (OP-096)."""
    events = _t(spark, sf_dir, "events").select(F.lit("c").alias("client_id"), F.lit("w").alias("workflow_id"), F.col("user_id").alias("version"), F.col("event_type").alias("state"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return history.current_state(events).select("version", "state")


@register("""WITH v AS (SELECT CAST(p_size % 3 AS VARCHAR) || '.' || CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 12 AS VARCHAR) AS version, [p_size % 3, p_size, p_partkey % 12] AS k FROM part), d AS (SELECT DISTINCT version, k FROM v), l AS (SELECT version, k, lag(version) OVER (ORDER BY k) AS previous, lag(k) OVER (ORDER BY k) AS pk FROM d)
SELECT version, previous, CASE WHEN previous IS NULL THEN NULL WHEN k[1] <> pk[1] THEN 'major' WHEN k[2] <> pk[2] THEN 'minor' ELSE 'patch' END AS bump FROM l""")
def q_version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions in semantic order, with the one before and the bump between (OP-097, 135)."""
    v = _t(spark, sf_dir, "part").select(F.lit("c").alias("client_id"), F.lit("w").alias("workflow_id"), F.concat_ws(".", (F.col("p_size") % 3).cast("string"), F.col("p_size").cast("string"), (F.col("p_partkey") % 12).cast("string")).alias("version")).distinct()
    found = history.previous_version(v)
    return found.select("version", "previous", F.when(F.col("previous").isNotNull(), fn.bump_between(F.col("previous"), F.col("version"))).alias("bump"))


@register("SELECT p_partkey, (p_size >= 2 AND (p_size > 2 OR p_partkey % 9 >= 1)) AND (p_size < 30) AS compatible FROM part")
def q_engine_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine versions inside a range (OP-044)."""
    version = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 9).cast("string"), F.lit("0"))
    return _t(spark, sf_dir, "part").select("p_partkey", fn.in_range(version, F.lit(">=2.1.0 <30.0.0")).alias("compatible"))


@register("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount, CASE WHEN o_orderkey % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CAST(o_orderdate AS DATE) AS due FROM orders")
def q_parsed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts, currencies and dates read from text (OP-031, 032, 130, 131, 132)."""
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    european = F.concat(F.lit("€ "), F.translate(F.format_number(amount, 2), ",.", ".,"))
    text = F.when(F.col("o_orderkey") % 2 == 0, european).otherwise(F.concat(F.lit("USD "), F.format_number(amount, 2)))
    day = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", fn.parse_amount(text).cast("double").alias("amount"), fn.currency_of(text).alias("currency"), fn.parse_date(day).alias("due"))


@register("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 'schema_validation_failed:quantity' END AS bad_quantity, NOT (l_shipdate >= o_orderdate) AS too_early FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def q_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least values and dates that must not come before others (OP-030, 033, 035)."""
    joined = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", F.when(~fn.at_least(F.col("l_quantity"), F.lit(5)), fn.code("schema_validation_failed", F.lit("quantity"))).alias("bad_quantity"), (~fn.not_before(F.col("l_shipdate"), F.col("o_orderdate"))).alias("too_early"))


@register("SELECT l_orderkey, l_linenumber, 'attachment' AS kind, 'inv' || l_orderkey || '.xlsx' AS file, 'Lines!B' || l_linenumber AS locator, 0 AS depth FROM lineitem")
def q_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source strings built and read again (OP-028, 029)."""
    source = fn.cell_locator(F.concat(F.lit("inv"), F.col("l_orderkey").cast("string"), F.lit(".xlsx")), F.lit("Lines"), F.concat(F.lit("B"), F.col("l_linenumber").cast("string")))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fn.parse_locator(source).alias("p")).select("l_orderkey", "l_linenumber", "p.*")


@register("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS used, ceil(length(text) / 4.0) <= 500 AS ok FROM documents")
def q_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size accounting against a budget (OP-144)."""
    return _t(spark, sf_dir, "documents").select("doc_id", fn.token_budget(F.col("text"), F.lit(500)).alias("b")).select("doc_id", "b.*")


@register("SELECT round(avg(CASE WHEN o_orderkey % 3 = 0 THEN (CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) END), 9) AS accuracy, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS excluded FROM orders")
def q_source_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locators against labelled ones, and how many have no label (OP-054, 073)."""
    orders = _t(spark, sf_dir, "orders")
    predicted = orders.select(F.col("o_orderkey").alias("sample_id"), F.lit("amount").alias("field"), F.col("o_orderpriority").alias("source"))
    labelled = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("sample_id"), F.lit("amount").alias("field"), F.lit("1-URGENT").alias("source"))
    return evaluation.attribution_accuracy(predicted, labelled).withColumn("accuracy", F.round("accuracy", 9))


@register("""WITH a AS (SELECT event_type AS field, avg(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS field, avg(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT 'mean' AS metric, coalesce(a.field, b.field) AS field, round(a.v - b.v, 6) AS delta, a.v < b.v AS regressed FROM a FULL JOIN b ON a.field = b.field""")
def q_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate's metrics against the promoted package's (OP-055)."""
    side = lambda k: _t(spark, sf_dir, "events").where(f"event_id % 2 = {k}").groupBy(F.col("event_type").alias("field")).agg(F.avg("value").alias("value")).withColumn("metric", F.lit("mean"))
    return evaluation.regressions(side(0), side(1)).withColumn("delta", F.round("delta", 6))


@register("SELECT p_type AS kind, p_name AS key, p_brand AS payload FROM part WHERE p_size >= 10 EXCEPT SELECT p_type, p_name, p_brand FROM part WHERE p_size < 20")
def q_rejected_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals without those rejected unchanged (OP-111)."""
    part = _t(spark, sf_dir, "part").select(F.col("p_type").alias("kind"), F.col("p_name").alias("key"), F.col("p_brand").alias("payload"), "p_size")
    return authoring.without_rejected(part.where("p_size >= 10").drop("p_size"), part.where("p_size < 20").drop("p_size")).distinct()


@register("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'package' WHEN p_size < 40 THEN 'default' END AS skill_source FROM part")
def q_skill_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package's skill where it overrides the default, else the default (OP-056)."""
    part = _t(spark, sf_dir, "part")
    skills = part.select(F.col("p_size").alias("skill_id")).distinct().select("skill_id", F.lit("b").alias("body"), F.lit("1.0.0").alias("version"))
    found = history.resolve_skills(part.select(F.col("p_partkey"), F.col("p_size").alias("skill_id")).select("skill_id").distinct(), skills.where("skill_id < 10"), skills.where("skill_id < 40"))
    return part.select("p_partkey", F.col("p_size").alias("skill_id")).join(found, "skill_id").select("p_partkey", "skill_source")


@register("SELECT event_id, event_type AS skill_id, user_id AS agent FROM events WHERE NOT (user_id % 5 = 0)")
def q_binding_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by agents that a skill is not bound to (OP-057)."""
    calls = _t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("skill_id"), F.col("user_id").alias("agent"), F.lit(None).cast("string").alias("tool"))
    bindings = calls.where("agent % 5 = 0").select("skill_id", "agent").distinct()
    return history.binding_violations(calls, bindings, calls.select("skill_id", "tool").limit(0)).select("event_id", "skill_id", "agent")


@register("SELECT o_orderkey AS sample_id, o_orderpriority AS field, o_totalprice AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus <> 'F') WHERE r <= 3")
def q_failure_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most confident errors of each field (OP-106)."""
    scored = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("field"), F.col("o_totalprice").alias("confidence"), (F.col("o_orderstatus") == "F").alias("correct"))
    return evaluation.exemplars(scored).select("sample_id", "field", "confidence")


def _messages(customers: DataFrame) -> DataFrame:
    """A raw message of each customer with a table attached, opened and parsed."""
    crlf = "\r\n"
    raw = F.concat(
        F.lit(f"From: a@example.org{crlf}Message-ID: c"), F.col("c_custkey").cast("string"), F.lit(f"@example.org{crlf}Content-Type: multipart/mixed; boundary=x{crlf}{crlf}--x{crlf}Content-Type: text/plain{crlf}{crlf}Amount: "),
        F.col("c_acctbal").cast("string"), F.lit(f"{crlf}--x{crlf}Content-Type: text/csv{crlf}Content-Disposition: attachment; filename=t.csv{crlf}{crlf}name,amount{crlf}"), F.col("c_name"), F.lit(f",1{crlf}"), F.col("c_name"), F.lit(f",2{crlf}--x--{crlf}"),
    )
    # The small table makes much work: it is dealt over the cores, and each message is parsed once.
    messages = kept(files.ingest(spread(customers).select(F.col("c_custkey").alias("path"), raw.cast("binary").alias("content"))), "messages")
    attached = files.attachments(messages)
    rows = files.parse_csv(attached).where("error_code is null").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return messages.select("run_id", "message_id").join(attached.select("run_id", "kind"), "run_id").join(rows, "run_id").select(F.col("run_id").cast("long").alias("c_custkey"), "message_id", "kind", "n")


@register("SELECT c_custkey, 'c' || c_custkey || '@example.org' AS message_id, 'csv' AS kind, count(*) AS n FROM customer JOIN (VALUES (1), (2)) v(k) ON true GROUP BY 1")
def q_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages of all customers with a table attached, opened and parsed (OP-001, 002, 003, 008, 039, 116)."""
    return _messages(_t(spark, sf_dir, "customer"))


@register("SELECT c_custkey, 'c' || c_custkey || '@example.org' AS message_id, 'csv' AS kind, count(*) AS n FROM customer JOIN (VALUES (1), (2)) v(k) ON true GROUP BY 1")
def q_messages_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages of all customers with a table attached, opened and parsed (OP-001, 002, 003, 008, 039, 116)."""
    return _messages(_t(spark, sf_dir, "customer"))


def _table_candidates(spark: SparkSession, items: DataFrame) -> DataFrame:
    """The greatest amount of each order among candidates from its lines as a CSV file."""
    lines = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.concat_ws(";", F.col("l_linenumber").cast("string"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")))).alias("l"))
    attached = lines.select(F.col("l_orderkey").cast("string").alias("run_id"), F.lit("l.csv").alias("name"), F.concat(F.lit("line;Total Price\n"), F.array_join("l", "\n")).cast("binary").alias("content"), F.lit("csv").alias("kind"), F.lit(False).alias("encrypted"))
    rows = files.parse_csv(attached)
    fields = spark.sql("SELECT 'invoice' AS type, 'amount' AS field, 'decimal' AS field_type, 'total price' AS alias")
    types = items.select(F.col("l_orderkey").cast("string").alias("run_id"), F.lit("invoice").alias("type")).distinct()
    found = extraction.extract_rows(rows, types, fields, "csv_parser")
    return found.groupBy("run_id", "field").agg(F.max("value_dec").cast("double").alias("value")).withColumn("run_id", F.col("run_id").cast("long"))


@register("SELECT l_orderkey AS run_id, 'amount' AS field, CAST(CAST(max(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS DOUBLE) AS value FROM lineitem GROUP BY 1")
def q_table_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from CSV rows of all orders by the aliases of their headers (OP-003, 060, 148)."""
    return _table_candidates(spark, _t(spark, sf_dir, "lineitem"))


@register("SELECT l_orderkey AS run_id, 'amount' AS field, CAST(CAST(max(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS DOUBLE) AS value FROM lineitem GROUP BY 1")
def q_table_candidates_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from CSV rows of all orders by the aliases of their headers (OP-003, 060, 148)."""
    return _table_candidates(spark, _t(spark, sf_dir, "lineitem"))


@register("SELECT count(*) AS kept, min(CAST(ts AS DATE)) AS oldest FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-30' - 14")
def q_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within their retention (OP-025, 041)."""
    events = _t(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return history.retained(events, "day", 14, F.lit("2024-01-30").cast("date")).agg(F.count(F.lit(1)).alias("kept"), F.min("day").alias("oldest"))


@register("SELECT c_mktsegment AS client_id, c_custkey FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer)")
def q_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of one client and of no other (OP-041)."""
    table = _t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("client_id"), "c_custkey")
    return history.for_client(table, table.agg(F.min("client_id")).first()[0])


@register("SELECT o_orderkey, 'EUR ' || CAST(o_orderkey AS VARCHAR) || '.50' AS money, strftime(o_orderdate, '%Y-%m-%d') AS day, 'Acme Widgets GmbH' AS org FROM orders")
def q_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money, dates and organisations in a text (OP-138, 146)."""
    text = F.concat(F.lit("pay EUR "), F.col("o_orderkey").cast("string"), F.lit(".50 to Acme Widgets GmbH before "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    first = lambda found: F.get(found(F.col("text")), F.lit(0))
    return rows.select("o_orderkey", first(fn.money_entities).alias("money"), first(fn.date_entities).alias("day"), first(fn.org_entities).alias("org"))


@register("SELECT c_custkey, 'k' || c_custkey AS candidate, 'body:segment:' || (c_custkey % 3) AS source FROM customer WHERE c_custkey % 2 = 0")
def q_key_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate keys named in a thread, with their segment (OP-141, 151)."""
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("the Password is k"), F.col("c_custkey").cast("string"), F.lit(" for you"))).otherwise("no secret")
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.explode(fn.key_candidates(text)).alias("candidate"))
    return rows.select("c_custkey", "candidate", fn.body_locator(F.col("c_custkey") % 3).alias("source"))


@register(f"WITH {_RUNS} SELECT run_id, CAST(att AS VARCHAR) AS winner, CAST(body AS VARCHAR) AS loser, 'confidence' AS rule FROM j WHERE att IS NOT NULL AND att <> body")
def q_conflict_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every losing amount beside the one that won (OP-066, 150)."""
    found = _candidates(spark, sf_dir).where("field = 'amount'")
    return merging.conflict_log(found, merging.resolve(found)).select("run_id", F.col("winner.value_norm").alias("winner"), F.col("loser.value_norm").alias("loser"), "rule")


@register(f"WITH {_RUNS} SELECT run_id, CAST(CASE WHEN att IS NULL OR att = body THEN 1.0 ELSE 0.5 END AS DOUBLE) AS agreement FROM j")
def q_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the kinds of sources agree on the amount (OP-068)."""
    return merging.agreement(_candidates(spark, sf_dir).where("field = 'amount'")).select("run_id", F.col("agreement").cast("double").alias("agreement"))


@register(f"WITH {_RUNS} SELECT run_id, CAST(CASE WHEN n IS NULL THEN 0.6667 ELSE 1.0 END AS DOUBLE) AS coverage FROM j")
def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of required fields that have a value (OP-047, 048, 069, 070, 149)."""
    found = _candidates(spark, sf_dir)
    runs = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit("invoice").alias("type"))
    fields = spark.sql("SELECT 'invoice' AS type, field, true AS required, false AS critical FROM VALUES ('amount'), ('invoice_date'), ('line_count') v(field)")
    scores = routing.confidence(routing.required_of(runs, fields), dealt(kept(merging.settle(found), "settled"), "run_id", "field"))
    return scores.select("run_id", F.col("coverage").cast("double").alias("coverage"))


@register("SELECT DISTINCT p_type AS type, 'type_incomplete' AS code FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size = 7 GROUP BY 1 HAVING count(*) = 1)")
def q_incomplete_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared types without exactly one schema (OP-059)."""
    part = _t(spark, sf_dir, "part").withColumnRenamed("p_type", "type")
    types = part.select("type").distinct()
    return history.incomplete_types(types, part.where("p_size = 7"), types)


@register("SELECT o_orderkey AS version, CASE WHEN o_orderkey % 5 = 0 THEN 'gate_failed' WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 THEN 'signoff_required' END AS code FROM orders")
def q_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What forbids each promotion (OP-063, 154)."""
    v = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version"))
    reports = v.select("version", (F.col("version") % 5 != 0).alias("passed"), F.lit("h").alias("report_hash"))
    signed = v.where("version % 3 <> 0").select("version", F.lit("h").alias("report_hash"))
    return history.may_promote(v, reports, signed, v.select("version", F.when(F.col("version") % 7 != 0, "me").alias("reviewed_by")))


@register("""WITH t AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS stage_no, event_type AS agent, value > 95 AS differs FROM events)
SELECT run_id, min(stage_no) AS stage_no, arg_min(agent, stage_no) AS agent FROM t WHERE differs GROUP BY 1""")
def q_first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stage at which two replays differ (OP-159)."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    a = _t(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), number.alias("stage_no"), F.col("event_type").alias("agent"), F.lit("x").alias("hash"), "value")
    return history.first_divergence(a, a.withColumn("hash", F.when(F.col("value") > 95, "y").otherwise("x")))


@register("SELECT 'c' AS client_id, 'w' AS workflow_id, p_partkey AS version FROM part WHERE p_size % 4 <> 0")
def q_unevaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promoted packages without an evaluation on the engine that is rolled out (OP-167)."""
    promoted = _t(spark, sf_dir, "part").select(F.lit("c").alias("client_id"), F.lit("w").alias("workflow_id"), F.col("p_partkey").alias("version"), "p_size")
    done = promoted.withColumn("engine_version", F.when(F.col("p_size") % 4 == 0, "2.0.0").otherwise("1.0.0"))
    return history.unevaluated(promoted.drop("p_size"), done, "2.0.0")


@register("SELECT conv_id AS sample_id, string_agg(DISTINCT role, ',' ORDER BY role) AS kinds, count(*) AS files, max(turn) AS depth FROM conversations GROUP BY 1")
def q_corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of each sample (OP-093)."""
    turns = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sample_id"), F.col("role").alias("kind"), F.lit(False).alias("encrypted"), F.array("role").alias("headers"), F.array().cast("array<string>").alias("sheets"), F.col("turn").alias("depth"))
    return authoring.profile(turns).select("sample_id", F.array_join("kinds", ",").alias("kinds"), "files", "depth")


@register("SELECT user_id AS message_id, count(*) AS attempts, arg_max(event_type, event_id) AS error FROM events WHERE value > 90 GROUP BY 1 HAVING count(*) >= 5")
def q_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that failed too often (OP-021, 122)."""
    from pyspark.sql import Window

    from ..streaming.runs import poisoned

    w = Window.partitionBy("user_id").orderBy("event_id")
    attempts = _t(spark, sf_dir, "events").where("value > 90").select(F.col("user_id").alias("message_id"), F.col("event_type").alias("error"), F.row_number().over(w).cast("long").alias("attempt"))
    return poisoned(attempts, 5)


@register("SELECT user_id AS run_id, CASE WHEN NOT bool_or(event_type = 'click') THEN 'click' WHEN NOT bool_or(event_type = 'view') THEN 'view' WHEN NOT bool_or(event_type = 'purchase') THEN 'purchase' END AS next_stage FROM events WHERE value > 110 GROUP BY 1")
def q_next_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage at which an authoring run resumes (OP-125)."""
    stages = _t(spark, sf_dir, "events").where("value > 110").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"))
    return authoring.next_stage(stages, ("click", "view", "purchase"))


@register("SELECT p_type AS kind, p_partkey AS key, CASE WHEN p_size < 5 THEN upper(p_brand) ELSE p_brand END AS payload, CASE WHEN p_size < 5 THEN 'edit' WHEN p_size < 25 THEN 'accept' ELSE 'waiting' END AS decision FROM part")
def q_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals after the designer's decisions (OP-126)."""
    part = _t(spark, sf_dir, "part")
    proposals = part.select(F.col("p_type").alias("kind"), F.col("p_partkey").alias("key"), F.col("p_brand").alias("payload"))
    decisions = part.where("p_size < 25").select(F.col("p_type").alias("kind"), F.col("p_partkey").alias("key"), F.when(F.col("p_size") < 5, "edit").otherwise("accept").alias("decision"), F.when(F.col("p_size") < 5, F.upper("p_brand")).alias("payload"))
    return authoring.apply_decisions(proposals, decisions)


@register("SELECT metric, value, value >= lim AS passed FROM (SELECT 'type_accuracy' AS metric, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 9) AS value, 0.95 AS lim FROM labels UNION ALL SELECT 'review_rate', round(avg(CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END), 9), NULL FROM labels) WHERE metric = 'type_accuracy'")
def q_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric against its gate (OP-155)."""
    metric = _t(spark, sf_dir, "labels").agg(F.round(F.avg((F.col("quality") == 1).cast("double")), 9).alias("value")).select(F.lit("type_accuracy").alias("metric"), "value")
    return evaluation.gates(metric).where("metric = 'type_accuracy'").select("metric", "value", "passed")


@register("SELECT o_orderkey AS audit_id, o_totalprice AS value FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 9 <> 0")
def q_production_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that count for production metrics (OP-013, 168)."""
    records = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("audit_id"), F.col("o_totalprice").alias("value"), (F.col("o_orderkey") % 4 == 0).alias("is_shadow"), (F.col("o_orderkey") % 9 == 0).alias("human_corrected"))
    return governance.production_only(records).select("audit_id", "value")


@register("SELECT p_partkey, p_name || '/x.json' AS path, p_size % 4 <> 0 AS inside FROM part")
def q_self_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundle paths that never leave their package (OP-042)."""
    path = F.concat("p_name", F.lit("/x.json"))
    climbing = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("a/../"), path)).otherwise(path)
    return _t(spark, sf_dir, "part").select("p_partkey", path.alias("path"), fn.self_contained(climbing).alias("inside"))


@register("SELECT p_partkey AS run_id, CASE p_size % 5 WHEN 0 THEN 'encrypted_no_key' WHEN 1 THEN 'unsupported_attachment:image/png' WHEN 2 THEN 'encrypted_no_key' END AS code FROM part WHERE p_size % 5 < 3")
def q_attachment_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by first bytes, locked containers and unsupported types (OP-008, 039, 040)."""
    kind = F.col("p_size") % 5
    content = F.when(kind == 0, F.lit("%PDF-1.4 /Encrypt 5 0 R").cast("binary")).when(kind == 1, F.unhex(F.lit("89504E470D0A1A0A"))).when(kind == 2, F.unhex(F.lit("504B030414000100080000"))).when(kind == 3, F.lit("a,b").cast("binary")).otherwise(F.lit("%PDF-1.4 plain").cast("binary"))
    one = F.struct(F.when(kind == 3, "t.csv").otherwise("f.bin").alias("name"), F.when(kind == 1, "image/png").otherwise("text/csv").alias("mime"), content.alias("content"))
    messages = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("run_id"), F.array(one).alias("attachments"))
    return files.attachment_flags(files.attachments(messages))


@register("SELECT o.o_orderkey AS sample_id, CASE WHEN l.v IS NULL THEN o.o_orderpriority ELSE l.v END AS value FROM orders o LEFT JOIN (SELECT l_orderkey, arg_max(l_returnflag || l_linestatus, l_extendedprice) AS v FROM lineitem WHERE l_quantity > 40 GROUP BY 1) l ON o.o_orderkey = l.l_orderkey")
def q_corrected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the last correction of each field (OP-020)."""
    labels = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.lit("f").alias("field"), F.col("o_orderpriority").alias("value"))
    fixes = _t(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("sample_id"), F.lit("f").alias("field"), F.concat("l_returnflag", "l_linestatus").alias("corrected"), F.col("l_extendedprice").alias("corrected_at"))
    return packages.corrected_labels(fixes, labels).select("sample_id", "value")


@register("SELECT p_partkey AS skill_id, CASE WHEN p_size % 3 = 0 THEN 'OCR' ELSE 'NER' END AS tool FROM part WHERE p_size % 3 < 2")
def q_undeclared_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools that a skill names and does not declare (OP-153)."""
    third = F.col("p_size") % 3
    body = F.when(third == 0, "use OCR and regex").when(third == 1, "use ner").otherwise("use regex")
    skills = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("skill_id"), body.alias("body"), F.array(F.lit("Regex")).alias("tools"))
    return history.undeclared_tools(skills, ("OCR", "NER", "Regex"))


@register("SELECT event_id AS run_id, 'error' AS outcome, 'agent_timeout:orchestrator' AS code FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 300 SECOND AND event_id % 3 <> 0")
def q_overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Started runs without an audit after the ceiling (OP-119)."""
    started = _t(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("started_at"))
    return monitoring.overdue(started, started.where("run_id % 3 = 0"), F.lit("2024-01-15 00:00:00").cast("timestamp"))


@register("SELECT event_id AS run_id, event_type AS agent FROM events WHERE event_type = 'click'")
def q_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that the orchestrator did not make (OP-171)."""
    trace = _t(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("agent"), F.when(F.col("event_type") != "click", "orchestrator").alias("parent"))
    return governance.hops(trace).select("run_id", "agent")


@register("SELECT o_orderkey AS run_id FROM orders WHERE o_orderkey % 4 = 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def q_empty_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review entries without fields although something was extracted (OP-165)."""
    fields = F.when(F.col("o_orderkey") % 4 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("a"), F.lit("b")))
    entries = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), fields.alias("partial_fields"))
    return routing.empty_partials(entries, _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"))).select("run_id")


@register("SELECT CAST(l_orderkey AS VARCHAR) AS audit_id, l_linenumber AS field, l_shipdate AS value, o_orderstatus AS state FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey = (SELECT min(l_orderkey) FROM lineitem)")
def q_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything recorded of one run (OP-166)."""
    orders, lines = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    first = lines.agg(F.min("l_orderkey")).first()[0]
    audits = orders.select(F.col("o_orderkey").cast("string").alias("audit_id"), F.lit("c").alias("client_id"), F.lit("w").alias("workflow_id"), F.col("o_orderkey").alias("package_version"))
    attribution = lines.select(F.col("l_orderkey").cast("string").alias("audit_id"), F.col("l_linenumber").alias("field"), F.col("l_shipdate").alias("value"))
    registry = orders.select(F.lit("c").alias("client_id"), F.lit("w").alias("workflow_id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("state"))
    return governance.reconstruct(str(first), audits, attribution, registry).select("audit_id", "field", "value", "state")


_PACKAGES = "p AS (SELECT p_brand AS client_id, p_type AS workflow_id, '1.' || (p_partkey // 100000) || '.0' AS version, p_partkey || '.json' AS path, p_size FROM part)"


@register(f"""WITH {_PACKAGES}, k AS (SELECT client_id, workflow_id, version, sum(p_size) * 1000000 AS n FROM p GROUP BY 1, 2, 3)
SELECT client_id, workflow_id, version, 'package_corrupt' AS code, path AS detail FROM p WHERE p_size % 2 = 0 UNION SELECT client_id, workflow_id, version, 'schema_unsupported', path FROM p WHERE p_size > 40
UNION SELECT client_id, workflow_id, version, 'package_corrupt', 'size ' || CAST(n AS VARCHAR) FROM k WHERE n > 10485760
UNION SELECT client_id, workflow_id, version, 'engine_incompatible', '>=2.0.0' FROM k WHERE client_id < 'Brand#3' UNION SELECT client_id, workflow_id, version, 'version_exists', version FROM k WHERE workflow_id LIKE 'PROMO%'""")
def q_publish_problems_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What forbids the publication of each package; brand, type and a block of keys name one, so a manifest stays small (OP-010, 022, 043, 045)."""
    keys = ["client_id", "workflow_id", "version"]
    version = F.concat(F.lit("1."), F.floor(F.col("p_partkey") / 100_000).cast("string"), F.lit(".0"))
    part = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("client_id"), F.col("p_type").alias("workflow_id"), version.alias("version"), F.concat(F.col("p_partkey").cast("string"), F.lit(".json")).alias("path"), "p_size")
    listed = part.groupBy(*keys).agg(F.collect_list(F.struct("path", F.lit("thresholds").alias("kind"), F.lit("h").alias("sha256"))).alias("artifacts"))
    manifests = listed.withColumn("engine_range", F.when(F.col("client_id") < "Brand#3", ">=2.0.0").otherwise(">=1.0.0"))
    found = part.select(*keys, "path", (F.col("p_size").cast("long") * 1_000_000).alias("size"), F.when(F.col("p_size") % 2 == 0, "x").otherwise("h").alias("sha256"), F.when(F.col("p_size") > 40, "9").otherwise("1").alias("schema_version"))
    return history.publish_problems(manifests, found, part.where("workflow_id like 'PROMO%'").select(*keys).distinct(), "1.0.0", keys=keys)


# The name of the query before packages were told apart; both run over the whole table.
QUERIES["q_publish_problems"], ORACLES["q_publish_problems"] = q_publish_problems_all, ORACLES["q_publish_problems_all"]


@register(f"""WITH l AS ({_LOCKED}), b AS (SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bucket, score, CASE WHEN type = lang THEN 1.0 ELSE 0.0 END AS ok FROM l),
g AS (SELECT count(*) AS n, abs(avg(score) - avg(ok)) AS gap FROM b GROUP BY bucket) SELECT round(sum(n * gap) / sum(n), 6) AS calibration FROM g""")
def q_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-number calibration metric: the mean gap over the buckets' rows (OP-076)."""
    joined = _t(spark, sf_dir, "documents").select("doc_id", "lang").join(_locked(spark, sf_dir), "doc_id")
    rows = joined.select(F.col("score").alias("confidence"), F.coalesce(F.col("type") == F.col("lang"), F.lit(False)).cast("int").alias("correct"))
    return evaluation.calibration_error(evaluation.calibration(rows)).select(F.round("calibration", 6).alias("calibration"))


@register(f"SELECT doc_id, 'classification_ambiguous' AS code FROM ({_LOCKED}) WHERE type IS NOT NULL AND type <> lang")
def q_contradicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose locked type the declared language contradicts: flagged, not changed (OP-117)."""
    later = _t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("type"))
    return detection.contradicted(_locked(spark, sf_dir), later, "doc_id")


@register("""SELECT l.doc_id AS sample_id, 'toxic' AS field, l.quality = 1 AS critical, CAST(l.toxic AS VARCHAR) AS expected, CASE WHEN d.n_chars > 500 THEN '0' ELSE '1' END AS actual,
coalesce(CAST(l.toxic AS VARCHAR) = CASE WHEN d.n_chars > 500 THEN '0' ELSE '1' END, false) AS correct FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id""")
def q_scored_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label beside its prediction (OP-053)."""
    labels = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"), F.lit("toxic").alias("field"), (F.col("quality") == 1).alias("critical"), F.col("toxic").cast("string").alias("expected"))
    predictions = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.lit("toxic").alias("field"), F.when(F.col("n_chars") > 500, "0").otherwise("1").alias("value_norm"), F.lit(1.0).alias("confidence"))
    return evaluation.scored_fields(labels, predictions).drop("confidence")


@register("SELECT doc_id, round(length(text) / greatest(len(string_split(text, chr(10))), 1), 6) AS density, length(text) / greatest(len(string_split(text, chr(10))), 1) < 40 AS scanned FROM documents")
def q_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters for each line as for each page of a document, and which are so thin that they may be scans (OP-143)."""
    density = fn.text_density(F.col("text"), F.size(F.split("text", "\n")))
    return _t(spark, sf_dir, "documents").select("doc_id", F.round(density, 6).alias("density"), (density < 40).alias("scanned"))


@register("""WITH h AS (SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS a, trim(regexp_replace(lower(CASE WHEN p_size > 25 THEN p_type ELSE split_part(p_type, ' ', 1) END), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS b, p_size FROM part)
SELECT p_partkey, CAST(CAST(least(1.0, CASE WHEN a = b THEN 0.9 WHEN contains(a, b) OR contains(b, a) THEN 0.6 ELSE 0.0 END + 0.1 * p_size / 50) AS DECIMAL(5,4)) AS DOUBLE) AS confidence FROM h""")
def q_mapping_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How surely a header means a field, from its words and how full its column is (OP-145)."""
    alias = F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.substring_index("p_type", " ", 1))
    return _t(spark, sf_dir, "part").select("p_partkey", fn.mapping_confidence(F.col("p_type"), alias, F.col("p_size"), F.lit(50)).cast("double").alias("confidence"))


@register("""SELECT n_nationkey, '{"name":"' || n_name || '","region":' || n_regionkey || ',"none":null}' AS record, '[{"key":"a","value":"' || n_regionkey || '"},{"key":"b","value":"' || n_name || '"}]' AS entries FROM nation""")
def q_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as canonical JSON: fields in their order, nulls kept, maps as sorted entries (OP-136, 137)."""
    none = F.lit(None).cast("string").alias("none")
    entries = fn.sorted_entries(F.create_map(F.lit("b"), F.col("n_name"), F.lit("a"), F.col("n_regionkey").cast("string")))
    return _t(spark, sf_dir, "nation").select("n_nationkey", fn.canonical_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), none)).alias("record"), F.to_json(entries).alias("entries"))


@register("SELECT doc_id AS sample_id FROM documents WHERE length(text) < 300 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def q_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples too short to read that were not expected to be so (OP-038)."""
    inventory = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), (F.char_length("text") >= 300).alias("readable"))
    return authoring.unreadable(inventory, _t(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("sample_id")))


@register("SELECT 'alias' AS kind, c_custkey AS key, c_mktsegment AS payload, s AS delta FROM customer LEFT JOIN (SELECT o_custkey, CAST(count(*) AS BIGINT) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def q_review_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals with what each would change, for a decision (OP-156)."""
    proposals = _t(spark, sf_dir, "customer").select(F.lit("alias").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("payload"))
    deltas = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("delta")).withColumn("kind", F.lit("alias"))
    return authoring.review_surface(proposals, deltas).select("kind", "key", "payload", "delta")


@register("""SELECT o_custkey AS client_id, o_orderkey AS version, o_orderpriority AS report_hash, o_orderstatus AS state, c_name AS signed_by FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'O' AND c_acctbal > 0""")
def q_promotion_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotions with who signed off which report (OP-158)."""
    orders = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("client_id"), F.lit("w").alias("workflow_id"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("report_hash"), "o_orderstatus")
    signed = orders.join(_t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("client_id"), F.col("c_name").alias("signed_by")), "client_id").select("client_id", "workflow_id", "version", "signed_by")
    reports = orders.where("o_orderstatus <> 'O'").select("client_id", "workflow_id", "version", "report_hash", F.col("o_orderstatus").alias("state"))
    return governance.promotion_history(orders.select("client_id", "workflow_id", "version", "report_hash"), signed, reports).select("client_id", "version", "report_hash", "state", "signed_by")


@register("SELECT o_orderkey AS run_id, 'controller' AS agent, 'orchestrator' AS parent, 'flagged' AS status, 'low_confidence' AS reason FROM orders WHERE o_totalprice < 50000")
def q_interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a controller said of runs, as rows of their traces; none is a call past the orchestrator (OP-115, 171)."""
    found = _t(spark, sf_dir, "orders").where("o_totalprice < 50000").select(F.col("o_orderkey").alias("run_id"), F.lit("low_confidence").alias("code"))
    rows = governance.interventions(found, "controller")
    return rows.join(governance.hops(rows.select("run_id", "agent", "parent")).select("run_id"), "run_id", "left_anti")


@register("""WITH m AS (SELECT DISTINCT user_id, ts FROM events), r AS (SELECT user_id, ts AS started_at, CAST(event_id AS VARCHAR) AS audit_id FROM events WHERE event_type = 'signup'),
f AS (SELECT m.user_id, m.ts, arg_min(audit_id, (started_at, audit_id)) AS a FROM m JOIN r ON m.user_id = r.user_id AND started_at <= m.ts AND started_at > m.ts - INTERVAL 2 DAY GROUP BY 1, 2)
SELECT e.event_id, f.a AS original_audit_id FROM events e LEFT JOIN f ON f.user_id = e.user_id AND f.ts = e.ts""")
def q_redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the first run of their user within two days before, whatever else is null (OP-064)."""
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.lit(None).cast("string").alias("subject"), "event_type")
    runs = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("started_at"), F.col("event_id").cast("string").alias("audit_id"))
    return history.redelivered(events, runs, ["user_id"], "ts", 2).select("event_id", "original_audit_id")


@register("""SELECT n_regionkey AS run_id, 'book.xlsx' AS file, 'amounts' AS sheet, '2 headers mean a field' AS reason FROM nation GROUP BY 1""")
def q_chosen_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet of a workbook with most headers that mean a field (OP-104, 147)."""
    nations = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("run_id"), F.lit("book.xlsx").alias("file"), "n_name")
    notes = nations.select("run_id", "file", F.lit("notes").alias("sheet"), F.create_map(F.lit("Vendor"), F.col("n_name"), F.lit("Remark"), F.col("n_name")).alias("cells"))
    amounts = nations.select("run_id", "file", F.lit("amounts").alias("sheet"), F.create_map(F.lit("Vendor"), F.col("n_name"), F.lit("Total  Amount"), F.lit("1")).alias("cells"))
    aliases = spark.sql("SELECT alias FROM VALUES ('vendor'), ('total amount') v(alias)")
    return extraction.choose_sheet(notes.unionByName(amounts), aliases).drop("hits")


@register("""SELECT c_custkey, CAST(CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS DOUBLE) AS amount, 'embedded:1:0/attachment:bill.pdf#p1' AS source FROM customer""")
def q_embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in a PDF of a message that is embedded in each customer's message (OP-005, 014, 113, 116)."""
    crlf = "\r\n"
    pdf = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<< /Length 40 >>\nstream\nBT (Amount: "), F.abs("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit(") Tj ET\nendstream\nendobj\n%%EOF\n"))
    part = lambda head, body: F.concat(F.lit(f"--x{crlf}{head}{crlf}{crlf}"), body, F.lit(crlf))
    inner = F.concat(F.lit(f"From: b@example.org{crlf}Message-ID: <i@x>{crlf}Content-Type: multipart/mixed; boundary=y{crlf}{crlf}--y{crlf}Content-Type: application/pdf; name=bill.pdf{crlf}Content-Disposition: attachment; filename=bill.pdf{crlf}Content-Transfer-Encoding: base64{crlf}{crlf}"), F.base64(pdf.cast("binary")), F.lit(f"{crlf}--y--{crlf}"))
    raw = F.concat(F.lit(f"From: a@example.org{crlf}Message-ID: <o@x>{crlf}Content-Type: multipart/mixed; boundary=x{crlf}{crlf}"), part("Content-Type: text/plain", F.lit("see the message")), part("Content-Type: message/rfc822", inner), F.lit(f"--x--{crlf}"))
    messages = kept(files.ingest(spread(_t(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("path"), raw.cast("binary").alias("content"))), "messages")
    opened = kept(files.expand_embedded(messages.where("error_code is null"), 1)[0], "opened")
    every = files.away(opened)
    pages = files.parse_pdf(files.attachments(every))
    types = every.select("run_id", F.lit("invoice").alias("type"))
    fields = spark.sql("SELECT 'invoice' AS type, 'amount' AS field, 'decimal' AS field_type, 'amount' AS alias")
    found = files.at_home(extraction.extract_texts(pages, types, fields, "pdf_parser"))
    return found.select(F.col("run_id").cast("long").alias("c_custkey"), F.col("value_dec").cast("double").alias("amount"), F.concat(F.lit("embedded:"), "origin", F.lit("/"), "source").alias("source"))


from . import authoring_queries, operations_queries  # noqa: E402,F401  register their queries
