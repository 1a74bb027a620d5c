"""Signal scores from rule tables of any size: an index of the rules' phrases, joined with the phrases of the texts.

The plan's size does not depend on the number of rules. A rule's key is its phrase from its first to its last
word; a text gives the phrases of each length that rules have, and these meet in an equal join, so that a
common first word brings no rules but those that stand in the text. Both sides are as many rows as there are
phrases, so they move as 96 bits of hash instead of strings. A rule that begins or ends with other characters
is verified there, at its place. Weights are summed by groupBy. What a rule matches is what scalars.phrase_in
matches: whole words, whatever the case, with just the characters between them that the rule has.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions.frames import kept
from ..functions.scalars import LETTER

#: Rules that are broadcast, at most (a term has some 20 bytes); a larger table is joined by a shuffle.
MOST_BROADCAST = 500_000
_PIECES = rf"([{LETTER}]+|[^{LETTER}]+)"
_WEIGHT, _SHORT = "decimal(18,4)", "decimal(8,4)"
#: Pieces of a phrase that a pattern is written for, at most; longer ones are cut from the text's pieces.
_MOST_PATTERN = 63
#: Shapes of rules whose gaps are written into the pattern, at most; with more, any gap is taken.
_MOST_SHAPES = 100
_GAP = f"[^{LETTER}]++"


def pieces(text: Column) -> Column:
    """Words and what stands between them, in turn, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_PIECES), F.lit(1))


def _is_word(piece: Column) -> Column:
    return piece.rlike(f"^[{LETTER}]")


def phrases(text: Column, gaps: list[str]) -> Column:
    """The phrases, in lower case, that begin with each word of a text and have these patterns of gaps between their words, by one pass; an empty one for a word that none begins with."""
    phrase = f"[{LETTER}]++" + "".join(f"(?:{gap})[{LETTER}]++" for gap in gaps)
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?:(?=({phrase}))|)[{LETTER}]++"), F.lit(1))


def _keys(phrase: Column) -> list[Column]:
    """96 bits that stand for a phrase: `phrase`, by which it is joined, and `check`."""
    return [F.xxhash64(phrase).alias("phrase"), F.hash(phrase).alias("check")]


def rule_index(rules: DataFrame, grouped: bool = True) -> DataFrame:
    """(type, phrase, check, lead, trail, shape, weight, veto): each term once for a type, keyed by its phrase of whole words.

    rules: type, term, weight, veto. Equal terms of a type add up. lead and trail are what stands before the
    first word and after the last, shape is the phrase with an x for each word. Terms without a letter or
    digit, and null ones, match nothing and are left out. Without `grouped`, equal terms stay rows of their own.
    """
    term = rules.where("type IS NOT NULL").select("type", F.lower("term").alias("t"), F.col("weight").cast(_narrow(rules)).alias("weight"), "veto").where(F.col("t").rlike(f"[{LETTER}]"))
    # Words with one space between them are told at once; others are cut.
    told = term.select("*", F.col("t").rlike(rf"^[{LETTER}]++(?: [{LETTER}]++)*+\z").alias("plain"))
    cut = lambda k: F.regexp_extract("t", rf"(?s)^([^{LETTER}]*+)(.*[{LETTER}])([^{LETTER}]*+)$", k)
    part = lambda k: F.when(F.col("plain"), F.col("t") if k == 2 else F.lit("")).otherwise(cut(k))
    parts = told.select("type", "weight", "veto", "plain", part(2).alias("t"), part(1).alias("lead"), part(3).alias("trail"))
    spaces = F.length("t") - F.length(F.replace("t", F.lit(" ")))
    shape = F.when(F.col("plain"), F.concat(F.lit("x"), F.repeat(F.lit(" x"), spaces))).otherwise(F.regexp_replace("t", f"[{LETTER}]++", "x"))
    keyed = parts.select("type", *_keys(F.col("t")), "lead", "trail", shape.alias("shape"), "weight", "veto")
    return _summed(keyed) if grouped else keyed


def _summed(index: DataFrame) -> DataFrame:
    return index.groupBy("type", "phrase", "check", "lead", "trail", "shape").agg(F.sum("weight").alias("weight"), F.bool_or("veto").alias("veto"))


def _narrow(rules: DataFrame) -> str:
    """The type that weights are summed in: Spark sums decimals of up to 8 digits as long integers."""
    kind = rules.schema["weight"].dataType
    return _SHORT if isinstance(kind, DecimalType) and kind.scale <= 4 and kind.precision - kind.scale <= 4 else _WEIGHT


def _places(p: Column, length: int) -> Column:
    """Where phrases of so many pieces begin among pieces, counted from 1; null if there are none."""
    start = F.when(_is_word(F.get(p, F.lit(0))), 1).otherwise(2)
    return F.when(F.size(p) >= start + (length - 1), F.sequence(start, F.size(p) - (length - 1), F.lit(2)))


def index_hits(texts: DataFrame, index: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, type, weight, veto): the rules that stand in each text, each row of the index at most once for a key; texts have one row for a key."""
    index = index.withColumn("bounded", F.expr("lead <> '' OR trail <> ''"))
    per = lambda by: index.groupBy("bounded", by.alias("by")).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("weight")).alias("most"))
    told = per(F.col("shape")).limit(_MOST_SHAPES + 1).collect()
    few = len(told) <= _MOST_SHAPES
    if few:
        shapes = [(r.bounded, [re.escape(gap) for gap in r.by.split("x")[1:-1]]) for r in told]
    else:
        told = per(F.regexp_count("shape", F.lit("x"))).collect()
        shapes = [(r.bounded, [_GAP] * (r.by - 1)) for r in told]
    if all(r.most is None or r.most < 10_000 for r in told):
        index = index.withColumn("weight", F.col("weight").cast(_SHORT))
    plain, bounded = index.where("NOT bounded"), index.where("bounded")
    side = lambda df, bound: F.broadcast(df) if sum(r.n for r in told if r.bounded == bound) <= MOST_BROADCAST else df
    lengths = lambda bound: sorted({2 * len(gaps) + 1 for b, gaps in shapes if b == bound})
    # What stands at each place between the words of rules of one length.
    gaps_of = lambda length: ["|".join(sorted(set(at))) for at in zip(*[gaps for b, gaps in shapes if not b and 2 * len(gaps) + 1 == length])]
    none = F.array().cast("array<string>")
    at = lambda p, length: F.coalesce(F.transform(_places(p, length), lambda i: F.array_join(F.slice(p, i, F.lit(length)), "")), none)
    of = lambda length: phrases(F.col(text), gaps_of(length)) if length <= _MOST_PATTERN else at(pieces(F.col(text)), length)
    found = texts.select(*key, F.explode(F.array_distinct(F.concat(none, *[of(n) for n in lengths(False)]))).alias("phrase")).where("phrase <> ''")
    hits = _met(found.select(*key, *_keys(F.col("phrase"))), side(plain, False)).select(*key, "type", "weight", "veto")
    if lengths(True):
        # The gap after a phrase must go on beyond the rule's, or end the text.
        cut = texts.select(*key, pieces(F.col(text)).alias("p")).where(F.size("p") > 0)
        around = lambda n: F.transform(_places(F.col("p"), n), lambda i: F.struct(F.array_join(F.slice("p", i, F.lit(n)), "").alias("phrase"), F.get("p", i - 2).alias("before"), (i == 2).alias("opens"), F.coalesce(F.get("p", i + (n - 1)), F.lit("")).alias("after"), (i + n >= F.size("p")).alias("closes")))
        every = F.flatten(F.array_compact(F.array(*[around(n) for n in lengths(True)])))
        placed = cut.select(*key, F.explode(every).alias("at")).select(*key, *_keys(F.col("at.phrase")), "at.before", "at.opens", "at.after", "at.closes")
        led = (F.col("lead") == "") | (F.endswith("before", F.col("lead")) & (F.col("opens") | (F.length("before") > F.length("lead"))))
        trailed = (F.col("trail") == "") | (F.startswith("after", F.col("trail")) & (F.col("closes") | (F.length("after") > F.length("trail"))))
        met = _met(placed, side(_summed(bounded), True)).where(led & trailed).groupBy(*key, "type", "phrase", "check", "lead", "trail").agg(F.first("weight").alias("weight"), F.bool_or("veto").alias("veto"))
        hits = hits.unionByName(met.select(*key, "type", "weight", "veto"))
    return hits


def _met(found: DataFrame, index: DataFrame) -> DataFrame:
    """Phrases of texts with their rules: joined by one long, which Spark sorts by its bits; `check` is compared afterwards, not another key."""
    rules = index.withColumnRenamed("check", "_check")
    return found.join(rules, "phrase").where(F.col("check").bitwiseXOR(F.col("_check")) == 0)


def score_by_index(segments: DataFrame, keywords: DataFrame, negatives: DataFrame | None = None, key: str = "run_id", text: str = "text", more: list[tuple[str, Column, float]] | None = None, repeated: bool = True) -> DataFrame:
    """(key, type, score) as detection.score_types gives them, for keyword tables (type, term, weight) of any size.

    negatives: (type, term); more: rules (type, condition on a segment's columns, weight) that no index holds,
    such as patterns. Types that nothing of a key hits have no row but the least type, which has a score of 0
    there, so that no key is lost. Null texts are empty; without rules there are no scores. repeated: whether
    the tables may have many rows of one term and type; these add up in any case, but then they do so before
    they meet the texts, which moves all rules once more.
    """
    more = more or []
    typed = keywords.where("type IS NOT NULL").select("type", "term", "weight", F.lit(False).alias("veto"))
    kinds = typed.select("type").distinct()
    if more:
        kinds = kinds.union(segments.sparkSession.createDataFrame([(k,) for k, *_ in more], "type string")).distinct()
    kinds = kept(kinds, "kinds")
    least = kinds.agg(F.min("type")).first()[0]
    if least is None:
        return segments.select(key, F.lit("").alias("type"), F.lit(0).cast("decimal(5,4)").alias("score")).where("false")
    if negatives is not None:
        vetoes = negatives.join(kinds, "type", "left_semi").select("type", "term", F.lit(0).cast(_narrow(typed)).alias("weight"), F.lit(True).alias("veto"))
        typed = typed.select("type", "term", F.col("weight").cast(_narrow(typed)).alias("weight"), "veto").unionByName(vetoes)
    # Segments of one key with equal texts score alike, so the text's hash tells segments apart.
    texts = segments.select("*", F.xxhash64(text).alias("_segment"))
    once = texts.select(F.col(key).alias("_key"), "_segment", F.col(text).alias("_text"))
    # Texts are moved only where a key has one twice.
    if not once.groupBy("_key", "_segment").count().where("count > 1").isEmpty():
        once = once.dropDuplicates(["_key", "_segment"])
    # Types go by their hash until each key has its sums.
    typed = typed.withColumn("type", F.xxhash64("type"))
    hits = index_hits(once, kept(rule_index(typed, repeated), "rule-index", hashed=True), ["_key", "_segment"], "_text").select("_key", "_segment", "type", "weight", "veto")
    if more:
        tests = F.array(*[F.struct(F.xxhash64(F.lit(kind)).alias("type"), F.when(hit, F.lit(weight)).cast(_WEIGHT).alias("weight"), F.lit(False).alias("veto")) for kind, hit, weight in more])
        hits = hits.unionByName(_once(texts, tests, key))
    capped = F.least(F.lit(1).cast("decimal(10,4)"), F.sum("weight")).cast("decimal(5,4)")
    each = hits.groupBy("_key", "_segment", "type").agg(F.when(F.bool_or("veto"), F.lit(0).cast("decimal(5,4)")).otherwise(capped).alias("score"))
    base = segments.select(F.col(key).alias("_key"), F.lit(least).alias("type"), F.lit(0).cast("decimal(5,4)").alias("score"))
    named = each.join(kinds.withColumnRenamed("type", "_type"), F.col("type") == F.xxhash64("_type")).select("_key", F.col("_type").alias("type"), "score")
    return named.unionByName(base).groupBy(F.col("_key").alias(key), "type").agg(F.max("score").alias("score"))


def _once(texts: DataFrame, tests: Column, key: str) -> DataFrame:
    """The hits of `tests` in each segment; equal segments of a key count once."""
    summed = texts.select(F.col(key).alias("_key"), "_segment", F.filter(tests, lambda x: x["weight"].isNotNull()).alias("x")).groupBy("_key", "_segment").agg(F.first("x").alias("x"))
    return summed.select("_key", "_segment", F.explode("x").alias("x")).select("_key", "_segment", "x.*")
