"""Rule mining and the rule index against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.operators import detection, mining, rules

WORDS = ["invoice", "total", "net", "due", "Amount", "übrig", "naïve", "c", "x1", "42", "1", "pay", "ÉTÉ"]
BETWEEN = [" ", "  ", "-", ", ", "\n", "++ ", " #", ".", " ("]


def text(r: random.Random, n: int) -> str:
    return r.choice(["", "#", " "]) + "".join(r.choice(WORDS) + r.choice(BETWEEN) for _ in range(n))


def term(r: random.Random) -> str:
    core = "".join(r.choice(WORDS) + r.choice(BETWEEN[:4]) for _ in range(r.randrange(1, 4)))
    return r.choice(["", "", "", "#"]) + core.strip(" ,-") + r.choice(["", "", "", "++"])


def test_rule_index_scores_as_expressions_do(spark: SparkSession) -> None:
    r = random.Random(2)
    rows = [(k % 150, text(r, r.choice([0, 1, 4, 30]))) for k in range(200)] + [(200, None), (201, ""), (7, "net due"), (7, "net due")]
    segments = spark.createDataFrame([(*x, 1) for x in rows], "run_id long, text string, term int").repartition(3)
    keywords = [(r.choice("abc"), term(r), round(r.random() / 4, 4)) for _ in range(120)] + [("a", "NET due", 0.1)] * 2
    negatives = [("a", "pay-total"), ("b", "42, net"), ("c", "#1")]
    patterns = [("a", r"\d\d", 0.05), ("b", "übrig", 0.15)]
    want = {(x.run_id, x.type): x.score for x in detection.score_types(segments, keywords, patterns, negatives).collect()}
    table = spark.createDataFrame(keywords, "type string, term string, weight double")
    vetoes = spark.createDataFrame(negatives, "type string, term string")
    more = [(kind, F.col("text").rlike(regex), weight) for kind, regex, weight in patterns]
    before = rules.MOST_BROADCAST
    for most in (before, 0):
        rules.MOST_BROADCAST = most
        try:
            found = {(x.run_id, x.type): x.score for x in rules.score_by_index(segments, table, vetoes, more=more).collect()}
        finally:
            rules.MOST_BROADCAST = before
        assert {k: v for k, v in found.items() if v} == {k: v for k, v in want.items() if v}
        assert {k for k, _ in found} == {k for k, _ in want} and sum(v > 0 for v in want.values()) > 100
    assert rules.score_by_index(segments.limit(0), table, vetoes).isEmpty()
    assert rules.score_by_index(segments, table.limit(0)).isEmpty()
    odd = spark.createDataFrame([("a", None, 0.5), (None, "net", 0.5), ("a", "+++", 0.5), ("a", "", 0.5)], "type string, term string, weight double")
    assert {x.score for x in rules.score_by_index(segments, odd).collect()} == {Decimal("0.0000")}


def test_many_rules_make_no_larger_plan(spark: SparkSession) -> None:
    segments = spark.createDataFrame([(k, f"word{k} and word{k + 1}, pair {k} here") for k in range(50)], "run_id long, text string")
    none = spark.createDataFrame([], "type string, term string")
    package = {"keywords": spark.range(30_000).select(F.concat(F.lit("t"), F.col("id") % 3).alias("type"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("word"), "id")).otherwise(F.concat(F.lit("Pair "), "id")).alias("term"), F.lit(0.25).alias("weight")), "negatives": none}
    package |= {"patterns": spark.createDataFrame([(f"t{k % 3}", f"word{k}\\b", 0.5) for k in range(300)], "type string, regex string, weight double"), "entities": spark.createDataFrame([], "type string, entity string, weight double")}
    found = {(x.run_id, x.type): float(x.score) for x in detection.score_package(segments, package).where("score > 0").collect()}
    want: dict[tuple, float] = defaultdict(float)
    for k in range(50):
        for j in (k, k + 1):
            want[k, f"t{j % 3}"] += 0.5 + (0.25 if j % 2 == 0 else 0)
        if k % 2:
            want[k, f"t{k % 3}"] += 0.25
    assert found == {k: min(1.0, v) for k, v in want.items()}


TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[ \t\r\n\f\x0b]+|[^\w \t\r\n\f\x0b]|_")


def token_shape(x: str) -> str:
    if x[0].isdigit():
        return rf"\d{{{len(x)}}}"
    if x[0] in " \t\r\n\f\x0b":
        return r"\s+"
    if x.isalpha():
        upper, lower = [c.isupper() for c in x], [c.islower() for c in x]
        return rf"\p{{Lu}}{{{len(x)}}}" if all(upper) else r"\p{Ll}+" if all(lower) else r"\p{Lu}\p{Ll}+" if upper[0] and len(x) > 1 and all(lower[1:]) else r"\p{L}+"
    return "\\" + x


def patterns(rows: list[tuple], least: int, longest: int, shown: int) -> dict[tuple, tuple]:
    places: dict[tuple, set] = defaultdict(set)
    for kind, sample, value in rows:
        if kind is None or sample is None or value is None:
            continue
        tokens = TOKEN.findall(value)
        for p in range(len(tokens)):
            for n in range(1, min(longest, len(tokens) - p) + 1):
                cut = tokens[p : p + n]
                places[kind, tuple(map(token_shape, cut))].add((sample, p, "".join(cut)))
    support = {k: len({x[0] for x in v}) for k, v in places.items()}
    frequent = {k for k, n in support.items() if n >= least}
    explained = {(kind, part) for kind, shapes in frequent for part in (shapes[:-1], shapes[1:]) if part and support.get((kind, part)) == support[kind, shapes]}
    return {(kind, "".join(shapes)): (len(shapes), support[kind, shapes], sorted(places[kind, shapes])[:shown]) for kind, shapes in frequent - explained if any(s.startswith(r"\d") for s in shapes)}


def samples(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(*x, 1, "s") for x in rows], "email_type string, sample_id long, text string, pos int, pattern string").repartition(3)


def test_mined_patterns(spark: SparkSession) -> None:
    r = random.Random(4)
    rows: list[tuple] = [(None, 1, "INV-1"), ("a", None, "INV-1"), ("a", 2, None), ("a", 3, ""), ("a", 4, "no number at all")]
    for k in range(60):
        kind = "hot" if k % 3 else "b"
        rows.append((kind, 100 + k, f"Dear all,\n{r.choice(['INV', 'inv', 'Ref'])}-{r.randrange(10**4, 10**5)} of 2024-{r.randrange(10, 13)}-05: {r.choice(['EUR', 'USD'])} {r.randrange(1000)}.{r.randrange(10, 100)} ümlaut_9"))
    rows += [rows[-1], rows[-1], ("b", 100, "another 77 text")]
    for least, longest in ((3, 4), (10, 6)):
        found = {(x.email_type, x.pattern): (x.tokens, x.support, [tuple(e) for e in x.evidence]) for x in mining.mine_patterns(samples(spark, rows), least, longest).collect()}
        assert found == patterns(rows, least, longest, 3)
        for (_, pattern), (_, _, evidence) in found.items():
            plain = pattern.replace(r"\p{Lu}", "[A-Z]").replace(r"\p{Ll}", "[a-zü]").replace(r"\p{L}", r"[^\W\d_]")
            assert all(re.fullmatch(plain, e[2]) for e in evidence)
    assert mining.mine_patterns(samples(spark, rows).limit(0)).isEmpty()


def test_negative_signals(spark: SparkSession) -> None:
    r = random.Random(6)
    vocabulary = [f"word{k}" for k in range(120)]
    own = [("ab"[k % 2] if k % 5 else None, k, " ".join(r.choice(vocabulary[: 60 + 30 * (k % 3)]) for _ in range(12))) for k in range(150)]
    own += [(None, 500, "unheard entirely"), (None, 501, "unheard also"), (None, 502, None), ("a", 503, None), (None, 504, own[1][2]), (None, 505, "unheard entirely"), (None, 505, "unheard entirely")]
    targets = [(kind, i) for kind in "ab" for k, i, _ in own if k is None] + [("a", i) for k, i, _ in own if k == "b" and i % 4 == 1] + [(None, 3), ("c", 500), ("a", 999)]
    found = mining.mine_negatives(samples(spark, own), spark.createDataFrame(targets, "email_type string, sample_id long")).collect()
    words: dict[tuple, set] = defaultdict(set)
    for kind, i, t in own:
        words[kind, i] |= {w for w in (t or "").split()}
    by_sample: dict[int, set] = defaultdict(set)
    for (_, i), w in words.items():
        by_sample[i] |= w
    for kind in "abc":
        terms = {x.term for x in found if x.email_type == kind}
        mine = set().union(*(w for (k, _), w in words.items() if k == kind))
        assert not terms & mine, "a sample of the type is vetoed"
        wanted = {i for k, i in targets if k == kind}
        assert all(by_sample[i] & terms for i in wanted if by_sample[i] - mine)
        best = max((sum(t in by_sample[i] for i in wanted) for t in set().union(*(by_sample[i] for i in wanted)) - mine), default=0)
        assert max(x.covers for x in found if x.email_type == kind) == best and len(terms) <= len(wanted)
    assert all(x.log_odds > 0 for x in found if x.email_type in "ab")
    none = spark.createDataFrame([], "email_type string, sample_id long")
    assert mining.mine_negatives(samples(spark, own), none).isEmpty() and mining.mine_negatives(samples(spark, own).limit(0), none).isEmpty()
    once = [("t", 1, "the usual words"), (None, 2, "the odd words")]
    assert [tuple(x)[:3] for x in mining.mine_negatives(samples(spark, once), spark.createDataFrame([("t", 2)], "email_type string, sample_id long")).collect()] == [("t", "odd", 1)]


def test_targets_of_terms_are_counted_once(spark: SparkSession) -> None:
    """The first round's counts were made again from all words of all targets to weigh the chosen terms; words that one target holds are not written."""
    own = [("t", 1, "the usual words"), (None, 2, "odd shared"), (None, 3, "odd shared"), (None, 4, "shared alone"), (None, 5, "alpha beta"), (None, 5, "alpha gamma")]
    found = mining.mine_negatives(samples(spark, own), spark.createDataFrame([("t", k) for k in range(2, 6)], "email_type string, sample_id long"))
    files = {f.split("/")[-2]: f.rpartition("/")[0] for f in found.inputFiles()}
    assert "contrast" not in files
    assert sorted(tuple(x) for x in spark.read.parquet(files["holds"]).collect()) == [("t", "odd", 2), ("t", "shared", 3)]
    odds = lambda n: math.log((n + 0.5) / (4 - n + 0.5)) - math.log(0.5 / 1.5)
    assert sorted((x.term, x.covers, round(x.log_odds, 9)) for x in found.collect()) == [("alpha", 1, round(odds(1), 9)), ("shared", 3, round(odds(3), 9))]


@pytest.mark.parametrize("n", [200])
def test_a_type_with_most_samples(spark: SparkSession, n: int) -> None:
    rows = [("hot", k, f"No. {k:05}/24") for k in range(n)] + [("cold", n, "No. 1/24")]
    found = [(x.email_type, x.pattern, x.support) for x in mining.mine_patterns(samples(spark, rows), 3, 6).collect()]
    assert ("hot", r"\p{Lu}\p{Ll}+\.\s+\d{5}\/\d{2}", n) in found and {x[0] for x in found} == {"hot"}


def test_rules_with_a_common_first_word_do_not_meet(spark: SparkSession) -> None:
    """3,000 rules begin with one word, which a text has 3,000 times: a row for each rule that stands there, not for each pair (F4)."""
    table = spark.range(3_000).select(F.lit("t").alias("type"), F.concat(F.lit("the w"), "id").alias("term"), F.lit(0.0001).alias("weight"))
    index = rules.rule_index(table.withColumn("veto", F.lit(False)))
    assert index.groupBy("phrase").count().agg(F.max("count")).first()[0] == 1
    texts = spark.range(20).select(F.col("id").alias("run_id"), F.concat_ws(" ", F.transform(F.sequence(F.col("id"), F.col("id") + 2_999), lambda k: F.concat(F.lit("the w"), k))).alias("text"))
    assert {r.run_id: float(r.score) for r in rules.score_by_index(texts, table).collect()} == {k: round((3_000 - k) * 0.0001, 4) for k in range(20)}


def test_many_patterns_are_not_broadcast(spark: SparkSession) -> None:
    """A table beyond the bound is joined by a shuffle, though Spark takes it to be small; only words of targets are dealt out (F9, F6)."""
    many = mining._small(spark.range(rules.MOST_BROADCAST // 20)).alias("m")
    assert "SortMergeJoin" in spark.range(100).join(many, "id", "left_semi")._jdf.queryExecution().executedPlan().toString()
    words = mining.sample_terms(spark.createDataFrame([(None, 1, "alpha beta alpha"), ("t", 2, "beta of"), (None, 3, "gamma")], "email_type string, sample_id long, text string"))
    found = mining.contrast_terms(words, spark.createDataFrame([("t", 1)], "email_type string, sample_id long"))
    assert [tuple(x) for x in found.collect()] == [("t", 1, "alpha")]


def test_rules_and_phrases_move_as_hashes(spark: SparkSession) -> None:
    """What meets in the join is a long on both sides, and no text is shuffled unless a key has it twice (F1)."""
    rows = [(1, "net due, net total"), (2, "Net  due"), (3, "𝒜 net-due"), (4, None)]
    texts = spark.createDataFrame(rows, "run_id long, text string")
    table = spark.createDataFrame([("a", "net due", 0.1), ("a", "NET DUE", 0.1), ("b", "total", 0.2), ("b", "net-due", 0.3)], "type string, term string, weight double")
    before, threshold = rules.MOST_BROADCAST, "spark.sql.autoBroadcastJoinThreshold"
    rules.MOST_BROADCAST = 0
    spark.conf.set(threshold, "-1")
    try:
        for repeated in (True, False):
            scored = rules.score_by_index(texts, table, repeated=repeated)
            dealt = re.findall(r"hashpartitioning\((.*?), \d+\)", scored._jdf.queryExecution().executedPlan().toString())
            assert any(re.fullmatch(r"phrase#\d+L", x) for x in dealt) and not any("_text" in x or re.fullmatch(r"_key#\d+L, _segment#\d+L", x) for x in dealt)
            assert {(r.run_id, r.type): float(r.score) for r in scored.where("score > 0").collect()} == {(1, "a"): 0.2, (1, "b"): 0.2, (3, "b"): 0.3}
            twice = rules.score_by_index(texts.unionByName(texts), table, repeated=repeated)
            assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, scored.collect()))
    finally:
        rules.MOST_BROADCAST = before
        spark.conf.unset(threshold)
    index = rules.rule_index(table.withColumn("veto", F.lit(False)), grouped=False)
    assert index.count() == 4 and {index.schema[c].dataType.simpleString() for c in ("phrase", "check")} == {"bigint", "int"}
    single = texts.select("run_id", "text")
    assert rules.index_hits(single, index, ["run_id"], "text").count() == 4
    assert rules.index_hits(single, index.withColumn("check", F.col("check") + 1), ["run_id"], "text").isEmpty(), "64 equal bits are not enough"


def test_phrases_of_many_shapes_and_lengths(spark: SparkSession) -> None:
    """Gaps written into the pattern, any gap, and phrases cut from pieces give what expressions give."""
    r = random.Random(9)
    segments = spark.createDataFrame([(k, text(r, r.choice([0, 1, 5, 40])) + r.choice(["", "𝒜𝒷 net", "|", "\\E due"])) for k in range(120)], "run_id long, text string").repartition(3)
    keywords = [(r.choice("abc"), term(r), round(r.random() / 9, 4)) for _ in range(90)] + [("a", "net|due", 0.1), ("b", "c++ pay", 0.1), ("c", "𝒷 net", 0.1), ("c", "𝒜𝒷 net", 0.1)]
    want = {(x.run_id, x.type): x.score for x in detection.score_types(segments, keywords, []).collect() if x.score}
    table = spark.createDataFrame(keywords, "type string, term string, weight double").withColumn("weight", F.col("weight").cast("decimal(5,4)"))
    before = rules._MOST_SHAPES, rules._MOST_PATTERN
    for shapes, pattern in (before, (1, before[1]), (before[0], 1)):
        rules._MOST_SHAPES, rules._MOST_PATTERN = shapes, pattern
        try:
            found = {(x.run_id, x.type): x.score for x in rules.score_by_index(segments, table, repeated=False).collect() if x.score}
        finally:
            rules._MOST_SHAPES, rules._MOST_PATTERN = before
        assert found == want and len(want) > 100
