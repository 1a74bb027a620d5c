"""Queries of rule mining and rule tables over whole tables, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import kept, spread
from ..operators import mining, rules
from .queries import _SCORES, _t, _type_scores, register

_LEAST, _LONGEST = 4, 4
_WHITE = r" \t\r\n\f\x0b"
_SHAPE = rf"""CASE WHEN regexp_matches(x, '^\d') THEN '\d{{' || length(x) || '}}' WHEN regexp_matches(x, '^[{_WHITE}]') THEN '\s+' WHEN regexp_matches(x, '^\p{{Lu}}+$') THEN '\p{{Lu}}{{' || length(x) || '}}' WHEN regexp_matches(x, '^\p{{Ll}}+$') THEN '\p{{Ll}}+' WHEN regexp_matches(x, '^\p{{Lu}}\p{{Ll}}+$') THEN '\p{{Lu}}\p{{Ll}}+' WHEN regexp_matches(x, '^\p{{L}}') THEN '\p{{L}}+' ELSE '\' || x END"""
_GRAMS = " UNION ALL ".join(
    f"SELECT email_type, sample_id, p - 1 AS pos, {n} AS n, array_to_string(s[p:p + {n - 1}], '') AS pattern, array_to_string(s[p:p + {n - 2}], '') AS head, array_to_string(s[p + 1:p + {n - 1}], '') AS rest, array_to_string(k[p:p + {n - 1}], '') AS text FROM p WHERE p + {n - 1} <= len(k)" for n in range(1, _LONGEST + 1)
)


@register(rf"""WITH k AS (SELECT lang AS email_type, doc_id AS sample_id, regexp_extract_all(text, '\d+|\p{{L}}+|[{_WHITE}]+|[^\d\p{{L}}{_WHITE}]') AS k FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
t AS (SELECT *, list_transform(k, lambda x: {_SHAPE}) AS s FROM k), p AS (SELECT *, unnest(range(1, len(k) + 1)) AS p FROM t),
g AS (SELECT * FROM ({_GRAMS}) WHERE contains(pattern, '\d{{')),
f AS (SELECT email_type, n, pattern, any_value(head) AS head, any_value(rest) AS rest, count(DISTINCT sample_id) AS support, list(DISTINCT {{'a': sample_id, 'b': pos, 'c': text}} ORDER BY {{'a': sample_id, 'b': pos, 'c': text}})[1:3] AS e FROM g GROUP BY 1, 2, 3 HAVING count(DISTINCT sample_id) >= {_LEAST})
SELECT email_type, pattern, n AS tokens, support, array_to_string(list_transform(e, lambda x: x.a || ':' || x.b || ':' || x.c), '|') AS evidence FROM f
WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.email_type = f.email_type AND b.n = f.n + 1 AND b.support = f.support AND (b.head = f.pattern OR b.rest = f.pattern))""")
def q_mined_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed patterns of token shapes with their support and evidence, of every type (OP-079, 082)."""
    samples = spread(_t(spark, sf_dir, "documents").select(F.col("lang").alias("email_type"), F.col("doc_id").alias("sample_id"), "text"))
    found = mining.mine_patterns(samples, _LEAST, _LONGEST)
    shown = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["sample_id"].cast("string"), e["pos"].cast("string"), e["text"])), "|")
    return found.select("email_type", "pattern", "tokens", "support", shown.alias("evidence"))


#: Rounds that the SQL writes out; the last find nothing left.
_ROUNDS = 12
_VOTES = "\n".join(
    f"""g{i} AS (SELECT email_type, term, count(*) AS gain FROM l{i} GROUP BY 1, 2), v{i} AS (SELECT email_type, sample_id, min({{'g': -gain, 'term': term}}) AS v FROM l{i} JOIN g{i} USING (email_type, term) GROUP BY 1, 2),
p{i} AS MATERIALIZED (SELECT email_type, v.term AS term, -v.g AS covers FROM v{i} GROUP BY 1, 2, 3 HAVING 2 * count(*) >= -v.g),
l{i + 1} AS MATERIALIZED (SELECT * FROM l{i} WHERE (email_type, sample_id) NOT IN (SELECT email_type, sample_id FROM l{i} SEMI JOIN p{i} USING (email_type, term))),"""
    for i in range(_ROUNDS)
)
_PICKED = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(_ROUNDS))


@register(rf"""WITH d AS (SELECT doc_id AS sample_id, lang, CASE WHEN quality = 0 THEN NULL ELSE lang END AS own, text FROM documents LEFT JOIN labels USING (doc_id)),
y AS (SELECT DISTINCT lang AS email_type FROM documents WHERE lang IS NOT NULL), s AS ({_SCORES}),
t AS (SELECT email_type, sample_id FROM d, y WHERE own IS NULL UNION SELECT s.type, s.doc_id FROM s JOIN d ON s.doc_id = d.sample_id WHERE s.score >= 0.45 AND own <> s.type),
w AS (SELECT DISTINCT own, sample_id, unnest(string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')) AS term FROM d), x AS (SELECT * FROM w WHERE length(term) >= 3),
l0 AS MATERIALIZED (SELECT t.email_type, x.sample_id, x.term FROM x JOIN t USING (sample_id) WHERE (t.email_type, x.term) NOT IN (SELECT own, term FROM x WHERE own IS NOT NULL)),
{_VOTES}
h AS (SELECT email_type, term, count(*) AS holds FROM l0 GROUP BY 1, 2), a AS (SELECT email_type, count(*) AS targets FROM t GROUP BY 1), o AS (SELECT own AS email_type, count(*) AS own FROM d WHERE own IS NOT NULL GROUP BY 1)
SELECT email_type, term, covers, round(ln((holds + 0.5) / (targets - holds + 0.5)) - ln(0.5 / (coalesce(own, 0) + 0.5)), 6) AS log_odds FROM ({_PICKED}) JOIN h USING (email_type, term) JOIN a USING (email_type) LEFT JOIN o USING (email_type)""")
def q_negative_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that keep out-of-scope documents and those that a type's keywords attract out of it, and veto none of its own (OP-079; the negative signals of detection rules)."""
    documents = _t(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    marked = documents.join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    samples = marked.select(F.when(F.coalesce(F.col("quality") != 0, F.lit(True)), F.col("lang")).alias("email_type"), F.col("doc_id").alias("sample_id"), "text")
    types = documents.where("lang IS NOT NULL").select(F.col("lang").alias("email_type")).distinct()
    outside = samples.where("email_type IS NULL").select("sample_id", F.explode(F.array(*[F.lit(r.email_type) for r in types.orderBy("email_type").collect()])).alias("email_type"))
    attracted = _type_scores(spark, sf_dir).where("score >= 0.45").join(samples.select(F.col("sample_id").alias("doc_id"), F.col("email_type").alias("own")), "doc_id").where("own <> type")
    targets = outside.select("email_type", "sample_id").unionByName(attracted.select(F.col("type").alias("email_type"), F.col("doc_id").alias("sample_id")))
    return mining.mine_negatives(samples, targets).withColumn("log_odds", F.round("log_odds", 6))


_PAIRS = r"""k AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS k FROM documents), i AS (SELECT *, unnest(range(1, len(k) - 1)) AS i FROM k),
p AS (SELECT DISTINCT doc_id, lang, k[i] || ' ' || k[i + 2] AS term FROM i WHERE k[i + 1] = ' ' AND regexp_matches(k[i], '^[\p{L}\p{N}]'))"""


@register(f"""WITH {_PAIRS}, r AS (SELECT DISTINCT lang AS type, term, (1 + length(term) % 7) * 0.0004 AS weight FROM p WHERE lang IS NOT NULL), v AS (SELECT type, min(term) AS term FROM r GROUP BY 1),
z AS (SELECT DISTINCT doc_id, type FROM p JOIN v USING (term)), h AS (SELECT doc_id, type, least(1, sum(weight)) AS score FROM p JOIN r USING (term) GROUP BY 1, 2),
s AS (SELECT doc_id, h.type, CASE WHEN z.type IS NULL THEN score ELSE 0 END AS score FROM h LEFT JOIN z USING (doc_id, type) UNION ALL SELECT doc_id, (SELECT min(type) FROM r), 0 FROM documents)
SELECT doc_id, type, max(score)::DOUBLE AS score FROM s GROUP BY 1, 2""")
def q_rule_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by a rule table of every pair of neighbouring words of the documents, over 100,000 rules, and a veto of each type (OP-046, 065, 152)."""
    documents = spread(_t(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    pairs = rules.phrases(F.col("text"), [" "])
    terms = documents.where("lang IS NOT NULL").select(F.col("lang").alias("type"), F.explode(F.array_distinct(pairs)).alias("term")).where("term <> ''")
    # Most pairs are rare: tasks that made them distinct before they are dealt would hold, then sort, almost all that they read.
    terms = kept(terms.repartition("type", "term").distinct(), "terms")
    table = terms.withColumn("weight", ((1 + F.length("term") % 7) * F.lit("0.0004").cast("decimal(5,4)")).cast("decimal(5,4)"))
    # A least string for each type without a group, for which Spark would sort all terms.
    kinds = sorted(r.lang for r in documents.select("lang").where("lang IS NOT NULL").distinct().collect())
    least = terms.agg(*[F.min(F.when(F.col("type") == kind, F.col("term"))).alias(f"_{k}") for k, kind in enumerate(kinds)] or [F.count(F.lit(1))])
    rows = F.array(F.struct(F.lit("").alias("type"), F.lit(None).cast("string").alias("term")), *[F.struct(F.lit(kind).alias("type"), F.col(f"_{k}").alias("term")) for k, kind in enumerate(kinds)])
    vetoes = least.select(F.explode(rows).alias("v")).select("v.*").where("term IS NOT NULL")
    return rules.score_by_index(documents, table, vetoes, key="doc_id", repeated=False).withColumn("score", F.col("score").cast("double"))
