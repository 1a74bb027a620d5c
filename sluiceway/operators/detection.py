"""Segments, type scores and the locked type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import LETTER, date_entities, money_entities, org_entities, phrase_in
from .rules import score_by_index

#: Keywords and negative signals that are written out as expressions, at most; larger tables are joined as an index.
MOST_EXPRESSIONS = 64
_ENTITIES = {"MONEY": money_entities, "DATE": date_entities, "ORG": org_entities}

#: Lines that open a quoted reply.
REPLY = r"(?m)^(?:-{2,}\s*Original Message\s*-{2,}.*|On .{4,120} wrote:\s*|Am .{4,120} schrieb.*:\s*|Le .{4,120} a écrit\s*:\s*|El .{4,120} escribió\s*:\s*)$"


def segment(bodies: DataFrame) -> DataFrame:
    """run_id, body -> run_id, segment_index, text; 0 is the newest, a body without replies is one segment."""
    parts = F.split(F.coalesce("body", F.lit("")), REPLY)
    cut = bodies.select("run_id", F.posexplode(parts).alias("segment_index", "text"))
    return cut.withColumn("text", F.btrim("text", F.lit(" \t\r\n"))).where((F.col("text") != "") | (F.col("segment_index") == 0))


def recency(rows: DataFrame, thread: str, order: str, tie: str | None = None) -> DataFrame:
    """Adds recency_index, 0 for the newest row of a thread."""
    by = [F.col(order).desc(), *([F.col(tie).desc()] if tie else [])]
    return rows.withColumn("recency_index", (F.row_number().over(Window.partitionBy(thread).orderBy(*by)) - 1).cast("long"))


def rule_hits(text: Column, words: Column, keywords: list[tuple[str, str, float]], patterns: list[tuple[str, str, float]], entities: list[tuple[str, str, float]] | None = None) -> dict[str, list[Column]]:
    """type -> one weight column for each rule, a rule counting once: rules become expressions, never a join.

    words are the terms of one word that stand in the text (see one_word); phrases are looked up in the text.
    """
    found: dict[str, list[Column]] = {}
    weigh = lambda hit, weight: F.when(hit, F.lit(weight).cast("decimal(5,4)")).otherwise(F.lit(0).cast("decimal(5,4)"))
    for kind, term, weight in keywords:
        found.setdefault(kind, []).append(weigh(_stands(text, words, term), weight))
    for kind, regex, weight in patterns:
        found.setdefault(kind, []).append(weigh(text.rlike(regex), weight))
    for kind, entity, weight in entities or []:
        found.setdefault(kind, []).append(weigh(F.size(_ENTITIES[entity](text)) > 0, weight))
    return found


def one_word(term: str) -> bool:
    """Whether a term is one word in lower case, so that it can be met among a text's words."""
    return bool(term) and all(c.isalnum() for c in term)


def _stands(text: Column, words: Column, term: str) -> Column:
    return F.array_contains(words, term.lower()) if one_word(term) else phrase_in(text, term)


def score_types(segments: DataFrame, keywords: list[tuple[str, str, float]], patterns: list[tuple[str, str, float]], negatives: list[tuple[str, str]] | None = None, key: str = "run_id", text: str = "text", entities: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """(key, type, score): the weights of the rules that hold, at most 1; a negative signal vetoes its type.

    A text is cut into words once, and these are met with the terms of all rules; each key leaves its task
    as one row. Without rules there are no scores.
    """
    terms = sorted({t.lower() for _, t, *_ in [*keywords, *(negatives or [])] if one_word(t)})
    cut = F.array_intersect(F.split(F.lower(F.col(text)), f"[^{LETTER}]+"), F.array(*[F.lit(t) for t in terms]).cast("array<string>"))
    found = segments.select(key, F.col(text).alias("_text"), cut.alias("_words"))
    hits = rule_hits(F.col("_text"), F.col("_words"), keywords, patterns, entities)
    veto: dict[str, Column] = {}
    for kind, term in negatives or []:
        veto[kind] = veto.get(kind, F.lit(False)) | _stands(F.col("_text"), F.col("_words"), term)
    kinds = sorted(hits)
    if not kinds:
        return segments.select(key, F.lit("").alias("type"), F.lit(0).cast("decimal(5,4)").alias("score")).where("false")
    score = {
        kind: F.when(veto.get(kind, F.lit(False)), F.lit(0)).otherwise(F.least(F.lit(1).cast("decimal(10,4)"), sum(hits[kind][1:], hits[kind][0]).cast("decimal(10,4)"))).cast("decimal(5,4)")
        for kind in kinds
    }
    per = found.select(key, *[score[kind].alias(f"_s{k}") for k, kind in enumerate(kinds)]).groupBy(key).agg(*[F.max(f"_s{k}").alias(f"_s{k}") for k in range(len(kinds))])
    rows = F.array(*[F.struct(F.lit(kind).alias("type"), F.col(f"_s{k}").alias("score")) for k, kind in enumerate(kinds)])
    return per.select(key, F.explode(rows).alias("s")).select(key, "s.type", "s.score")


def score_package(segments: DataFrame, package: dict[str, DataFrame], key: str = "run_id", text: str = "text") -> DataFrame:
    """(key, type, score) by a package's keywords, patterns, negatives and entities: as expressions where they are few, else by the rule index."""
    tuples = lambda name, *columns: sorted((tuple(r[c] for c in columns) for r in package[name].select(*columns).collect()), key=repr)
    patterns, entities = tuples("patterns", "type", "regex", "weight"), tuples("entities", "type", "entity", "weight")
    few = [package[name].limit(MOST_EXPRESSIONS + 1).count() for name in ("keywords", "negatives")]
    if sum(few) <= MOST_EXPRESSIONS:
        return score_types(segments, tuples("keywords", "type", "term", "weight"), patterns, tuples("negatives", "type", "term"), key, text, entities)
    more = [(kind, F.col(text).rlike(regex), weight) for kind, regex, weight in patterns] + [(kind, F.size(_ENTITIES[entity](F.col(text))) > 0, weight) for kind, entity, weight in entities]
    return score_by_index(segments, package["keywords"], package["negatives"], key, text, more)


def lock_type(scores: DataFrame, thresholds: DataFrame, key: str = "run_id") -> DataFrame:
    """The best type that reaches its threshold (type, threshold), else null; ambiguous if none does or two tie."""
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "type")
    ranked = scores.join(F.broadcast(thresholds), "type").withColumn("place", F.row_number().over(order)).withColumn("top", F.max("score").over(Window.partitionBy(key)))
    ties = F.sum(F.when(F.col("score") == F.col("top"), 1).otherwise(0)).over(Window.partitionBy(key))
    best = ranked.withColumn("ties", ties).where("place = 1")
    reaches = F.col("score") >= F.col("threshold")
    return best.select(key, F.when(reaches & (F.col("ties") == 1), F.col("type")).alias("type"), "score", (~reaches | (F.col("ties") > 1)).alias("ambiguous"))


def contradicted(locked: DataFrame, later: DataFrame, key: str = "run_id") -> DataFrame:
    """Runs whose locked type later evidence (key, type) contradicts: flagged, never changed."""
    other = later.select(key, F.col("type").alias("later_type")).distinct()
    return locked.join(other, key).where("type <> later_type").select(key, F.lit("classification_ambiguous").alias("code")).distinct()
