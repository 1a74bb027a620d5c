"""Authoring: corpus profile, holdout, proposals and their evidence, leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_label, pii_findings


#: Hashes that are broadcast, at most (8 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def leaks(generation: DataFrame, held: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Samples on both sides: must be none."""
    return generation.select(sample).intersect(held.select(sample))


def shortfall(labels: DataFrame, by: str = "email_type", least: int = 25) -> DataFrame:
    """Types with too few labelled samples, and how many lack."""
    return labels.groupBy(by).agg(F.count_distinct("sample_id").alias("n")).where(F.col("n") < least).select(by, (F.lit(least) - F.col("n")).alias("lacking"))


def propose_fields(values: DataFrame, samples: DataFrame, share: float = 0.6) -> DataFrame:
    """(type, field, n, share) of fields that stand in at least this share of a type's samples."""
    total = samples.groupBy("email_type").agg(F.count_distinct("sample_id").alias("total"))
    found = values.groupBy("email_type", "field").agg(F.count_distinct("sample_id").alias("n")).join(F.broadcast(total), "email_type")
    return found.withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= share).select("email_type", "field", "n", "share")


def supported_patterns(matches: DataFrame, least: int = 3) -> DataFrame:
    """(type, pattern, support, evidence): patterns that hold in at least so many samples, with their evidence."""
    per = matches.groupBy("email_type", "pattern").agg(F.count_distinct("sample_id").alias("support"), F.array_sort(F.collect_set(F.struct("sample_id", "span"))).alias("evidence"))
    return per.where(F.col("support") >= least)


def propose_aliases(headers: DataFrame, labels: DataFrame, least: int = 1) -> DataFrame:
    """(field, alias, support): column headers whose cells hold a labelled value of the field."""
    joined = headers.join(labels, ["sample_id", "value_norm"])
    return joined.groupBy("field", normal_label(F.col("header")).alias("alias")).agg(F.count_distinct("sample_id").alias("support")).where(F.col("support") >= least)


def map_headers(headers: DataFrame, aliases: DataFrame) -> DataFrame:
    """(file, header, field): headers that are an alias of a field; aliases: field, alias."""
    named = aliases.select("field", normal_label(F.col("alias")).alias("label")).distinct()
    return headers.withColumn("label", normal_label(F.col("header"))).join(named, "label").drop("label")


def mine_keywords(texts: DataFrame, least: int = 3, purity: float = 0.8) -> DataFrame:
    """(type, term, n, purity): words that stand in samples of one type above all."""
    words = texts.select("email_type", "sample_id", F.explode(F.array_distinct(F.split(normal_label(F.col("text")), " "))).alias("term")).where(F.char_length("term") >= 4)
    per = words.groupBy("term", "email_type").agg(F.count(F.lit(1)).alias("n"))
    total = per.withColumn("total", F.sum("n").over(Window.partitionBy("term")))
    return total.withColumn("purity", F.col("n") / F.col("total")).where((F.col("n") >= least) & (F.col("purity") >= purity)).select("email_type", "term", "n", "purity")


def without_rejected(proposals: DataFrame, rejections: DataFrame) -> DataFrame:
    """Proposals (kind, key, payload) that were not rejected unchanged."""
    return proposals.join(rejections, ["kind", "key", "payload"], "left_anti")


def corpus_leaks(strings: DataFrame, corpus: DataFrame, size: int = 5) -> DataFrame:
    """(artifact, sample_id, shingles): how many runs of `size` words of an artifact string stand in a corpus text.

    Both sides are cut into 64-bit hashes of word shingles, each counted once for a string and text, and
    joined on these, never by a substring test of every string against every text. The artifacts' hashes
    are broadcast only where a count shows them few.
    """

    def shingles(df: DataFrame, key: str, text: str) -> DataFrame:
        # Generated once for each text, so that the words are not split again for every shingle.
        words = df.select(key, F.explode(F.array(F.split(normal_label(F.col(text)), " "))).alias("words")).where(F.size("words") >= size)
        cut = F.transform(F.sequence(F.lit(0), F.size("words") - size), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(size)]))
        return words.select(key, F.explode(F.array_distinct(cut)).alias("shingle"))

    a, b = shingles(strings, "artifact", "text").distinct(), shingles(corpus, "sample_id", "text")
    few = a.count() <= MOST_BROADCAST
    return b.join(F.broadcast(a) if few else a, "shingle").groupBy("artifact", "sample_id").agg(F.count_distinct("shingle").alias("shingles"))


def pii_scan(texts: DataFrame, key: str = "sample_id", text: str = "text") -> DataFrame:
    """(key, emails, addresses, accounts) of texts with any finding."""
    return texts.select(key, pii_findings(F.col(text)).alias("f")).where("f.emails + f.addresses + f.accounts > 0").select(key, "f.*")


def profile(attachments: DataFrame) -> DataFrame:
    """sample_id, kinds, files, encrypted, headers, sheets, depth: the inventory of each sample."""
    return attachments.groupBy("sample_id").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.count(F.lit(1)).alias("files"),
        F.bool_or("encrypted").alias("encrypted"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("headers")))).alias("headers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sheets")))).alias("sheets"),
        F.max("depth").alias("depth"),
    )


def unreadable(inventory: DataFrame, expected: DataFrame) -> DataFrame:
    """Unreadable samples that were not expected to be so."""
    return inventory.where("not readable").join(expected, "sample_id", "left_anti").select("sample_id")


def next_stage(stages: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(run_id, next_stage): the first stage of an authoring run without a marker; null when all are done."""
    done = stages.groupBy("run_id").agg(F.collect_set("stage").alias("done"))
    todo = F.filter(F.array(*[F.lit(s) for s in order]), lambda s: ~F.array_contains(F.col("done"), s))
    return done.select("run_id", F.get(todo, F.lit(0)).alias("next_stage"))


def review_surface(proposals: DataFrame, deltas: DataFrame) -> DataFrame:
    """Proposals with their metric deltas, for a decision to accept, edit or reject."""
    return proposals.join(deltas, ["kind", "key"], "left")


def apply_decisions(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals with decision and payload after edits; those without a decision wait."""
    d = decisions.select("kind", "key", "decision", F.col("payload").alias("edited"))
    joined = proposals.join(d, ["kind", "key"], "left")
    return joined.select("kind", "key", F.coalesce("edited", "payload").alias("payload"), F.coalesce("decision", F.lit("waiting")).alias("decision"))
