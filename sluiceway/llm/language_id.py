"""Language ID by Bayesian evidence fusion.

log P(lang | evidence) = text log-likelihood + log P(declared | lang) + log P(suffix | lang) + log host prior.

The text's likelihood is that of its hashed character trigrams, tempered since they overlap. Declared
markup languages and address suffixes are noisy channels, whose confusion tables are counted by grouped
aggregation over all rows and smoothed. A host's prior is its own language counts, smoothed by those of
its domain, smoothed by the whole table's, each counted by grouped aggregation as well. A row's own text
is taken out of the counts of its host, domain and channels before they judge it. One more language,
unknown, finds all trigrams equally likely; texts in scripts or languages never learned fall to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh

BUCKETS = 1 << 15
#: Labelled rows from which trigram counts are learned, at most: those with the least id hashes.
TRAIN_ROWS = 20_000
#: Overlapping trigrams repeat each other's evidence, so their log-likelihood is scaled down.
TEMPER = 0.3
#: Pseudo-counts: of a domain's prior in a host's, of the whole table's in a domain's, of a channel's table.
HOST_WEIGHT, DOMAIN_WEIGHT, CHANNEL_WEIGHT = 20.0, 50.0, 5.0
#: Log-likelihoods of one text are held within so much of the best.
MOST_EVIDENCE = 60.0
#: Log-prior odds of the unknown language against all others together.
UNKNOWN_ODDS = -7.0
#: Hosts, domains or channel values whose tables are broadcast, at most; more are joined by a shuffle.
MOST_BROADCAST = 100_000
#: Rejected rows (two longs each) that are broadcast, at most; more are joined by a shuffle.
MOST_REJECTED = 1_000_000
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def buckets_of(text: str | None) -> np.ndarray:
    """A bucket for each character trigram of the lower-cased letters, words parted by one space."""
    plain = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if not plain:
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ c[2:] * np.uint64(0x165667B19E3779F9)
    return ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64)


@dataclass
class TextModel:
    """Log-probabilities of the buckets by language, in the order of languages."""

    languages: list[str]
    table: np.ndarray


def fit_text(rows: DataFrame, train_rows: int = TRAIN_ROWS) -> TextModel:
    """Learns from rows (id, text, lang) with a language, at most train_rows of them."""
    known = rows.where("lang is not null and text is not null and lang <> ''")
    picked = known.select("id", "lang").orderBy(F.xxhash64("id"), "id", "lang").limit(train_rows).select("id").distinct()
    sample = known.join(F.broadcast(picked), "id", "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                held[lang] += np.bincount(buckets_of(text.as_py()), minlength=BUCKETS)
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    counted = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in counted})
    table = np.full((BUCKETS, max(1, len(languages))), 0.5)
    place = {lang: k for k, lang in enumerate(languages)}
    for r in counted:
        table[r.bucket, place[r.lang]] += r.n
    return TextModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def text_evidence(text: str | None, model: TextModel) -> list[float] | None:
    """The tempered log-likelihood of each language and, last, of the unknown one, less the best language's; none without letters."""
    at = buckets_of(text)
    if not len(at):
        return None
    total = model.table[at].sum(axis=0, dtype=np.float64) * TEMPER
    unknown = -np.log(BUCKETS) * len(at) * TEMPER - total.max()
    return np.round([*np.maximum(total - total.max(), -MOST_EVIDENCE), min(max(unknown, -MOST_EVIDENCE), MOST_EVIDENCE)], 6).tolist()


def _best(scores: Column, languages: list[str]) -> Column:
    names = F.array(*[F.lit(x) for x in languages])
    return F.get(names, F.array_position(scores, F.array_max(scores)).cast("int") - 1)


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]+(?:\.[^.]+)?)$", 1)


def _sum(n: Column) -> Column:
    return F.aggregate(n, F.lit(0.0), lambda s, x: s + x)


def identify(rows: DataFrame, model: TextModel, least: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """rows with lang_id, posterior, text_lang and accepted.

    rows has text, host, declared and suffix (strings, any of them null or empty: no evidence of that
    kind). Counts for priors and channels cover all rows whose text has letters. accepted is false
    where the text has no letters, the posterior of the best language is under `least`, or the unknown
    language is likelier than all others together. The posterior is among the languages learned. Ties go
    to the language that sorts first. Without a trained language everything is null and rejected; an
    empty table gives an empty table. Every row stays, with its `columns` (all unless others are asked
    for); columns of the new names are replaced, and no other name is reserved.

    Each text is scored once: the scores are written with the columns that stay, and read from there.
    """
    new = ("lang_id", "posterior", "text_lang", "accepted")
    own = [c for c in (rows.columns if columns is None else columns) if c.lower() not in new]
    languages = model.languages
    if not languages:
        none = F.lit(None)
        return rows.select(*own, none.cast("string").alias("lang_id"), none.cast("double").alias("posterior"), none.cast("string").alias("text_lang"), F.lit(False).alias("accepted"))
    scratch = Scratch(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    text, host, declared, suffix, scores, unknown = (fresh(x, own, list(new)) for x in ("_text", "_host", "_declared", "_suffix", "_scores", "_unknown"))
    keys = {"host": host, "declared": declared, "suffix": suffix}
    plain = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(k) for c, k in keys.items()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_evidence(x.as_py(), shared.value) for x in batch.column(0)]
            columns = [*batch.columns[1:], pa.array([x[:-1] if x else None for x in found], pa.list_(pa.float64())), pa.array([x[-1] if x else None for x in found], pa.float64())]
            yield pa.record_batch(columns, [*batch.schema.names[1:], scores, unknown])

    full = rows.select(F.col("text").cast("string").alias(text), *[F.col(f"`{c}`") for c in own], *plain)
    schema = T.StructType([*full.schema.fields[1:], T.StructField(scores, T.ArrayType(T.DoubleType())), T.StructField(unknown, T.DoubleType())])
    scored = scratch.keep(full.mapInArrow(score, schema), "scored").withColumn("text_lang", _best(F.col(scores), languages))
    tally = scored.where("text_lang is not null").groupBy(F.col(host).alias("host"), F.col(declared).alias("declared"), F.col(suffix).alias("suffix"), "text_lang").agg(F.count(F.lit(1)).alias("n"))
    tally = scratch.keep(tally, "tally")

    def counts(key: Column, name: str) -> DataFrame:
        """name, n: occurrences by language."""
        keyed = tally.withColumn(name, key).where(F.col(name) != "")
        return keyed.groupBy(name).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("text_lang") == x, F.col("n"))), F.lit(0)).cast("double") for x in languages]).alias("n"))

    everywhere = tally.agg(*[F.coalesce(F.sum(F.when(F.col("text_lang") == x, F.col("n"))), F.lit(0)).alias(f"l{k}") for k, x in enumerate(languages)]).first()
    total = sum(everywhere)
    prior = [(everywhere[k] + 1.0) / (total + len(languages)) for k in range(len(languages))]
    whole = F.array(*[F.lit(p) for p in prior])
    domains = counts(domain_of(F.col("host")), "domain").withColumnRenamed("n", "of_domain")
    hosts = counts(F.col("host"), "host").withColumn("domain", domain_of(F.col("host"))).join(domains, "domain", "left").select("host", F.struct("n", "of_domain").alias("found"))

    joined, found = scored, {}
    for c, table in (("host", hosts), ("declared", counts(F.col("declared"), "declared")), ("suffix", counts(F.col("suffix"), "suffix"))):
        key, found[c] = fresh("_key", joined.columns), fresh(f"_found_{c}", joined.columns)
        table = scratch.keep(table, c)
        table = table.select(F.col(c).alias(key), F.col("found" if c == "host" else "n").alias(found[c]))
        joined = joined.join(F.broadcast(table) if table.count() <= MOST_BROADCAST else table, F.col(keys[c]) == F.col(key), "left").drop(key)

    # What the row's own text added to each count.
    mine = F.array(*[F.when(F.col("text_lang") == x, 1.0).otherwise(0.0) for x in languages])

    def others(n: Column) -> Column:
        return F.zip_with(n, mine, lambda a, b: F.greatest(a - b, F.lit(0.0)))

    def smoothed(n: Column, by: Column, weight: float) -> Column:
        return F.zip_with(n, by, lambda x, p: (x + weight * p) / (_sum(n) + weight))

    def channel(n: Column) -> Column:
        """log P(value | language) up to a term common to all languages, from smoothed counts."""
        per = F.array(*[F.lit(float(everywhere[k]) + CHANNEL_WEIGHT * len(languages)) for k in range(len(languages))])
        return F.zip_with(F.zip_with(n, whole, lambda x, p: x + CHANNEL_WEIGHT * (_sum(n) + 1) / (_sum(n) + CHANNEL_WEIGHT) * p), per, lambda x, t: F.log(x / t))

    zero = F.array(*[F.lit(0.0)] * len(languages))
    at_host = F.col(found["host"])
    host_prior = F.coalesce(smoothed(others(at_host["n"]), smoothed(others(at_host["of_domain"]), whole, DOMAIN_WEIGHT), HOST_WEIGHT), whole)
    fused = F.coalesce(F.col(scores), zero)
    for part in (F.transform(host_prior, lambda p: F.log(p)), F.coalesce(channel(others(F.col(found["declared"]))), zero), F.coalesce(channel(others(F.col(found["suffix"]))), zero)):
        fused = F.zip_with(fused, part, lambda a, b: a + b)
    name = fresh("_fused", joined.columns)
    joined = joined.withColumn(name, fused)
    top = F.array_max(name)
    sure = F.aggregate(F.transform(name, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    posterior = F.round(1 / sure, 9)
    # The text alone tells the unknown language from the others, whose best likelihood is 0.
    known = F.col(unknown) + UNKNOWN_ODDS < 0
    return joined.select(*[F.col(f"`{c}`") for c in own], _best(F.col(name), languages).alias("lang_id"), posterior.alias("posterior"), "text_lang", F.coalesce(known & (posterior >= least), F.lit(False)).alias("accepted"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, host, declared and suffix of pages (page_id, url, html).

    declared is the primary tag of the html element's lang; suffix is the first path segment if it has
    two letters, else the last label of the host. The text is the html without scripts, styles and tags.
    """
    url, source = F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    segment = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    text = F.regexp_replace(F.regexp_replace(source, r"(?is)<(script|style|title)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&#?\w+;", " ")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        text.alias("text"),
        host.alias("host"),
        F.lower(F.regexp_extract(source, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)).alias("declared"),
        F.when(segment != "", segment).otherwise(F.regexp_extract(host, r"([^.]+)$", 1)).alias("suffix"),
    )


def document_evidence(docs: DataFrame) -> DataFrame:
    """doc_id, text, host (the source), declared and suffix of documents, which declare nothing and have no address."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("suffix")
    )


def text_model(docs: DataFrame) -> TextModel:
    """The text model of documents (doc_id, text, lang)."""
    return fit_text(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs (documents' columns and any others) whose language is accepted, unchanged.

    The decision goes by a row's text and source; rows are told apart by a 64-bit hash of these, and
    by doc_id. Rows with a null doc_id are judged like others; an empty table stays empty.
    """
    mark = fresh("_mark", docs.columns)
    evidence = document_evidence(docs).withColumn("mark", F.xxhash64("text", "host"))
    judged = identify(evidence, text_model(docs), least, ["doc_id", "mark"])
    rejected = Scratch(docs.sparkSession).keep(judged.where("not accepted").select("doc_id", "mark").distinct(), "rejected")
    rejected = rejected.select(F.col("doc_id").alias(f"{mark}_doc"), F.col("mark").alias(f"{mark}_bad"))
    marked = docs.withColumn(mark, F.xxhash64(F.col("text").cast("string"), F.col("source").cast("string")))
    same = (marked[mark] == rejected[f"{mark}_bad"]) & marked["doc_id"].cast("long").eqNullSafe(rejected[f"{mark}_doc"])
    return marked.join(F.broadcast(rejected) if rejected.count() <= MOST_REJECTED else rejected, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
