"""Mining of detection rules from labelled samples: patterns of token shapes, and negative signals.

Both take samples (email_type, sample_id, text); rows without one of the three are left out, repeated rows of
a sample count once, and an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import kept
from ..functions.scalars import normal_label

#: Patterns or terms that are broadcast, at most; a larger table is joined by a shuffle, however small Spark takes its packed files to be.
MOST_BROADCAST = 10_000
_TOKENS = r"(\d+|\p{L}+|[ \t\r\n\f\x0b]+|[^\d\p{L} \t\r\n\f\x0b])"


def shape(token: Column) -> Column:
    """A token as the part of a regular expression: digits by their number, letters by case, white space as one, other characters themselves."""
    n = F.length(token).cast("string")
    return (
        F.when(token.rlike(r"^\d"), F.concat(F.lit(r"\d{"), n, F.lit("}")))
        .when(token.rlike(r"^[ \t\r\n\f\x0b]"), F.lit(r"\s+"))
        .when(token.rlike(r"^\p{Lu}+$"), F.concat(F.lit(r"\p{Lu}{"), n, F.lit("}")))
        .when(token.rlike(r"^\p{Ll}+$"), F.lit(r"\p{Ll}+"))
        .when(token.rlike(r"^\p{Lu}\p{Ll}+$"), F.lit(r"\p{Lu}\p{Ll}+"))
        .when(token.rlike(r"^\p{L}"), F.lit(r"\p{L}+"))
        .otherwise(F.concat(F.lit("\\"), token))
    )


def near_digits(samples: DataFrame, reach: int) -> DataFrame:
    """(email_type, sample_id, pos, token) of the tokens that lie within `reach` of one of digits: no pattern of interest has others."""
    cut = samples.where("email_type IS NOT NULL AND sample_id IS NOT NULL AND text IS NOT NULL").select("email_type", "sample_id", F.regexp_extract_all("text", F.lit(_TOKENS), F.lit(1)).alias("tokens")).where(F.size("tokens") > 0)
    last = F.size("tokens") - 1
    digits = F.filter(F.sequence(F.lit(0), last), lambda i: F.substring(F.get("tokens", i), 1, 1).between("0", "9"))
    around = F.array_distinct(F.flatten(F.transform(digits, lambda i: F.sequence(F.greatest(i - reach, F.lit(0)), F.least(i + reach, last)))))
    rows = cut.select("email_type", "sample_id", F.explode(F.transform(around, lambda i: F.struct(i.alias("pos"), F.get("tokens", i).alias("token")))).alias("x"))
    return rows.select("email_type", "sample_id", "x.pos", "x.token")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df.hint("merge")


def mine_patterns(samples: DataFrame, least: int = 3, longest: int = 5, shown: int = 3) -> DataFrame:
    """(email_type, pattern, tokens, support, evidence): patterns of up to `longest` token shapes with a number in them.

    Sequences of neighbouring tokens grow level by level: a sequence of n is counted only where both of its
    parts of n - 1 are supported, that is, stand in `least` distinct samples of the type. A pattern is left
    out where a longer one of the same support contains it. evidence: the first `shown` places by sample
    and token, each (sample_id, pos, text).
    """
    rows = near_digits(samples, longest - 1).withColumn("shape", shape(F.col("token")))
    # A sample may stand there twice with other texts: its places are those of all of them.
    level = rows.select("email_type", "sample_id", "pos", F.col("shape").alias("pattern"), F.col("shape").alias("last"), F.col("token").alias("text"), F.col("token").alias("end"), F.lit(None).cast("string").alias("head"), F.lit(None).cast("string").alias("rest")).distinct()
    kinds, found, occurrences = ["email_type", "pattern"], [], []
    for n in range(1, longest + 1):
        support = level.groupBy(*kinds).agg(F.count_distinct("sample_id").alias("support"), F.first("head").alias("head"), F.first("rest").alias("rest")).where(F.col("support") >= least)
        support = kept(support.withColumn("tokens", F.lit(n)), f"support-{n}")
        level = kept(level.join(_small(support.select(*kinds)), kinds, "left_semi"), f"level-{n}")
        found.append(support)
        occurrences.append(level.select(*kinds, "sample_id", "pos", "text"))
        after = level.select("email_type", "sample_id", (F.col("pos") - 1).alias("pos"), F.col("pattern").alias("rest"), "last", "end")
        level = level.select("email_type", "sample_id", "pos", F.col("pattern").alias("head"), F.col("text").alias("begin")).join(after.hint("merge"), ["email_type", "sample_id", "pos"])
        level = level.select("email_type", "sample_id", "pos", F.concat("head", "last").alias("pattern"), "last", F.concat("begin", "end").alias("text"), "end", "head", "rest").distinct()
    every = reduce(DataFrame.unionByName, found)
    part = lambda c: every.select("email_type", F.col(c).alias("pattern"), "support").where("pattern IS NOT NULL")
    closed = every.join(part("head").unionByName(part("rest")).distinct().hint("merge"), [*kinds, "support"], "left_anti").where(F.contains("pattern", F.lit(r"\d{")))
    closed = kept(closed.select(*kinds, "tokens", "support"), "closed")
    places = reduce(DataFrame.unionByName, occurrences).join(_small(closed.select(*kinds)), kinds, "left_semi")
    # A rank with a bound is cut in every task before the shuffle.
    first = Window.partitionBy(*kinds).orderBy("sample_id", "pos", "text")
    top = places.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= shown)
    evidence = top.groupBy(*kinds).agg(F.array_sort(F.collect_list(F.struct("sample_id", "pos", "text"))).alias("evidence"))
    return closed.hint("merge").join(evidence, kinds)


def sample_terms(samples: DataFrame, shortest: int = 3) -> DataFrame:
    """(own, sample_id, terms): the distinct words of each row, own being its type."""
    terms = F.filter(F.array_distinct(F.split(normal_label(F.col("text")), " ")), lambda t: F.char_length(t) >= shortest)
    return samples.where("sample_id IS NOT NULL AND text IS NOT NULL").select(F.col("email_type").alias("own"), "sample_id", terms.alias("terms"))


def contrast_terms(words: DataFrame, targets: DataFrame) -> DataFrame:
    """(email_type, sample_id, term): the words (see sample_terms) of each target that no sample of the target's type has.

    targets: (email_type, sample_id) - the samples, of whatever type or out of scope, that must not be taken for email_type.
    """
    of_type = words.where("own IS NOT NULL").select(F.col("own").alias("email_type"), F.explode("terms").alias("term")).distinct()
    wanted = targets.where("email_type IS NOT NULL").select("email_type", "sample_id").distinct()
    # Only the words of targets are dealt out, and of them only what their type lacks is made distinct.
    found = words.select("sample_id", "terms").join(wanted, "sample_id").select("email_type", "sample_id", F.explode("terms").alias("term"))
    return found.join(of_type.hint("merge"), ["email_type", "term"], "left_anti").select("email_type", "sample_id", "term").distinct()


def mine_negatives(samples: DataFrame, targets: DataFrame, shortest: int = 3) -> DataFrame:
    """(email_type, term, covers, log_odds): words that veto email_type in its targets and in none of its own samples.

    samples: email_type is null for those out of scope. A small set of terms that covers all targets that
    any term covers is chosen greedily in rounds: every target that is left votes for the term of its own
    with the most targets left (ties: the least term), and a term that gets the votes of half of these
    targets is chosen. The best term of a type always is, so every round covers something, and terms that do
    not compete are chosen together. covers counts targets at the choice; log_odds is the smoothed log-odds
    of the term in the targets against the type's samples, which have none.
    """
    words = kept(sample_terms(samples, shortest), "words")
    targets = kept(targets.select("email_type", "sample_id"), "targets")
    counted = words.where("own IS NOT NULL").groupBy(F.col("own").alias("email_type")).agg(F.count_distinct("sample_id").alias("own"))
    left = kept(contrast_terms(words, targets), "contrast")
    total = targets.where("email_type IS NOT NULL").groupBy("email_type").agg(F.count_distinct("sample_id").alias("targets"))
    key, chosen = ["email_type", "term"], []

    def shared(rows: DataFrame) -> DataFrame:
        """How many targets hold a term, of the terms that more than one holds."""
        return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("holds")).where("holds > 1")

    # The first round's counts are asked for again where the chosen terms are weighed; a term that is not there is held once.
    every = kept(shared(left), "holds")
    gain = _small(every)
    while not left.isEmpty():
        # The least of (-gain, term) is the vote.
        vote = left.join(gain, key, "left").groupBy("email_type", "sample_id").agg(F.min(F.struct((-F.coalesce("holds", F.lit(1))).alias("g"), "term")).alias("v"))
        votes = vote.groupBy("email_type", F.col("v.term").alias("term"), (-F.col("v.g")).alias("covers")).agg(F.count(F.lit(1)).alias("votes"))
        picked = kept(votes.where("2 * votes >= covers").select(*key, "covers"), "picked")
        chosen.append(picked)
        covered = left.join(_small(picked.select(*key)), key, "left_semi").select("email_type", "sample_id").distinct()
        left = kept(left.join(covered, ["email_type", "sample_id"], "left_anti"), "left")
        gain = shared(left)
    if not chosen:
        return left.select(*key, F.lit(0).cast("long").alias("covers"), F.lit(0.0).alias("log_odds"))
    terms = reduce(DataFrame.unionByName, chosen).join(_small(every), key, "left").withColumn("holds", F.coalesce("holds", F.lit(1))).join(_small(total), "email_type").join(_small(counted), "email_type", "left")
    odds = lambda n, of: F.log((n + 0.5) / (of - n + 0.5))
    return terms.select(*key, "covers", (odds(F.col("holds"), F.col("targets")) - odds(F.lit(0), F.coalesce("own", F.lit(0)))).alias("log_odds"))
