"""Toxicity by a weighted lexicon.

Texts are folded (compatibility forms, case, look-alike letters of other scripts, digits and signs that
stand for letters inside words) and matched by an Aho-Corasick automaton of word starts. The lexicon joins
a short list of insults with words and word starts learned from labelled rows, each weighted by its
log-odds. Matches inside exception phrases do not count. The sum of weights, the same in proportion to the
length, and the heaviest match go into a logistic model. It is fitted on all labelled rows, each with the
features that a lexicon learned from the other folds gives; the lexicon that serves is learned from all.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Labelled rows that are learned from, at most; of more, those with the least id hashes.
TRAIN_ROWS = 20_000
#: A learned term: the toxic texts that hold it at least, its log-odds, and these in standard deviations.
LEAST_DOCS, LEAST_ODDS, LEAST_SURE = 5, 1.5, 4.0
#: Letters of the word starts that are weighed beside whole words, and parts of the labelled rows.
STARTS, FOLDS = range(3, 9), 3

# Insults of the base lexicon, phrases in which they are harmless, and look-alikes.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "disgusting", "trash", "clown", "imbecile", "cretin", "dumbass", "bastard", "vermin", "filth")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "circus clown", "clown fish", "pond scum", "soap scum", "sore loser rule", "idiot proof", "stupid simple")
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ⅼ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
    "​": "", "‌": "", "‍": "", "﻿": "", "­": "",
}
_FOLD = str.maketrans(LOOK_ALIKES)
_GAPS = re.compile(r"[\W_]+")
_NUMBER = re.compile(r"(?<![^\W_])\d+(?![^\W_])")


def fold(text: str | None) -> str:
    """Folded words, each after one space, and a space at the end; numbers are no words."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = _NUMBER.sub(" ", text)
    return " " + _GAPS.sub(" ", text.lower().translate(_FOLD)).strip() + " "


@dataclass
class Lexicon:
    """Word starts with weights, exception phrases, and the logistic model over the features."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    model: list[float] = field(default_factory=lambda: [-4.0, 2.0, 1.0, 0.5])


class Matcher:
    """The automaton of a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.auto = ahocorasick.Automaton()
        for term, weight in lexicon.weights.items():
            self.auto.add_word(" " + term, (len(term) + 1, weight, term))
        for phrase in lexicon.exceptions:
            whole = fold(phrase)
            if whole.strip() and whole.rstrip() not in self.auto:
                self.auto.add_word(whole.rstrip(), (len(whole) - 1, 0.0, ""))
        self.auto.make_automaton()

    def matches(self, folded: str) -> Counter:
        """Word start -> times, the longest at each place and none inside an exception."""
        found: dict[int, tuple[int, str]] = {}
        free_until, out = -1, Counter()
        spans = []
        for end, (size, _, term) in self.auto.iter(folded):
            start = end - size + 1
            if not term:
                if folded[end + 1 : end + 2] == " ":
                    spans.append((start, end))
            elif start not in found or found[start][0] < size:
                found[start] = (size, term)
        spans.sort()
        k = 0
        for start in sorted(found):
            while k < len(spans) and spans[k][0] <= start:
                free_until = max(free_until, spans[k][1])
                k += 1
            if start >= free_until:
                out[found[start][1]] += 1
        return out

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """1, log of the weight sum, the same by length, and the heaviest match."""
        folded = fold(text)
        hits = self.matches(folded)
        weights = self.lexicon.weights
        total = sum(weights[t] * (1 + math.log(n)) for t, n in hits.items())
        words = max(1, folded.count(" ") - 1)
        return 1.0, math.log1p(total), 10 * total / math.sqrt(words + 25), max((weights[t] for t in hits), default=0.0)


def starts_of(text: str | None) -> set[str]:
    """Folded words of three letters or more, and their starts."""
    out = set()
    for w in set(fold(text).split()):
        out.update(w[:k] for k in STARTS if k <= len(w))
        if len(w) >= STARTS[0]:
            out.add(w)
    return out


def fold_of(doc: int) -> int:
    return doc * 2654435761 % 2**32 % FOLDS


def choose_terms(counted: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """(start, toxic texts, clean texts) -> weights; of starts of one another the surest, drawn out as far as nearly all its toxic texts go."""
    odds: dict[str, float] = {}
    sure: dict[str, tuple[float, int]] = {}
    for t, p, n in counted:
        value = math.log((p + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1))
        z = value / math.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
        if p >= LEAST_DOCS and value >= LEAST_ODDS and z >= LEAST_SURE:
            odds[t], sure[t] = value, (z, p)
    longest: dict[str, str] = {}
    for t in sorted(odds, key=lambda t: (len(t), t)):
        longest[t] = t
        for s in (t[:k] for k in range(STARTS[0], len(t))):
            if s in longest and sure[t][1] >= 0.95 * sure[s][1]:
                longest[s] = t
    chosen: dict[str, float] = {}
    taken: set[str] = set()  # the starts of all chosen
    for t in sorted(odds, key=lambda t: (-sure[t][0], len(t), t)):
        t = longest[t]
        if t in taken or any(t[:k] in chosen for k in range(STARTS[0], len(t) + 1)):
            continue
        chosen[t] = odds[t]
        taken.update(t[:k] for k in range(STARTS[0], len(t) + 1))
    return chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 0.05) -> list[float]:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Lexicon:
    """Learns from at most train_rows labelled rows (doc_id, toxic) that are not held out.

    Of more rows those with the least id hashes count. Null labels, ids and texts are left out; a doc_id
    with several labels is toxic if one of them is. Other columns are ignored. Without toxic and clean
    rows in every part the base lexicon and a fixed model serve, as for empty tables.
    """
    base = {w: 6.0 for w in INSULTS}
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null").join(F.broadcast(known), "doc_id")
    names = [f"{c}{f}" for c in ("toxic", "clean") for f in range(FOLDS)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts in which a start stands, by label and fold; the empty start stands in all."""
        seen = [Counter() for _ in names]
        for batch in batches:
            for doc, text, toxic in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                part = seen[(0 if toxic > 0 else FOLDS) + fold_of(doc)]
                part.update(starts_of(text.as_py()))
                part[""] += 1
        terms = list(set().union(*seen))
        for k in range(0, len(terms), 100_000):
            part = terms[k : k + 100_000]
            yield pa.record_batch([pa.array(part, pa.string()), *(pa.array([c[t] for t in part], pa.int64()) for c in seen)], ["term", *names])

    counted = rows.mapInArrow(sketch, f"term string, {', '.join(f'{c} long' for c in names)}").groupBy("term").agg(*[F.sum(c).alias(c) for c in names])
    counted = Scratch(docs.sparkSession).keep(counted, "counted")
    whole = counted.where("term = ''").first()
    if whole is None or any(not whole[c] for c in names):
        return Lexicon(base)

    def of(without: int | None) -> list[list[str]]:
        """The toxic and the clean counts of all folds but this one."""
        return [[c for k, c in enumerate(names[at : at + FOLDS]) if k != without] for at in (0, FOLDS)]

    def passes(without: int | None) -> F.Column:
        (p, toxic), (n, clean) = ((sum(F.col(c) for c in group) + 0.5, sum(whole[c] for c in group) + 1) for group in of(without))
        value = F.log(p / toxic) - F.log(n / clean)
        # Rounding may differ from choose_terms, which decides.
        return (p > LEAST_DOCS) & (value >= LEAST_ODDS - 1e-6) & (value / F.sqrt(1 / p + 1 / n) >= LEAST_SURE - 1e-6)

    # Terms of some lexicon; the bound on labelled rows bounds them.
    choices = [*range(FOLDS), None]
    found = counted.where("term <> ''").where(functools.reduce(lambda a, b: a | b, map(passes, choices))).collect()

    def lexicon(without: int | None) -> Lexicon:
        toxic, clean = of(without)
        total = lambda r, group: sum(r[c] for c in group)
        weights = choose_terms([(r.term, total(r, toxic), total(r, clean)) for r in found], total(whole, toxic), total(whole, clean))
        return Lexicon({w: v for w, v in base.items() if not any(w[:k] in weights for k in range(STARTS[0], len(w) + 1))} | weights)

    shared = docs.sparkSession.sparkContext.broadcast([lexicon(k) for k in range(FOLDS)])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [Matcher(x) for x in shared.value]
        for batch in batches:
            rows = [matchers[fold_of(doc)].features(text.as_py()) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            yield pa.record_batch([pa.array([r[c] for r in rows], pa.float64()) for c in range(4)] + [batch.column(2)], ["a", "b", "c", "d", "y"])

    sample = np.array([tuple(r) for r in rows.mapInArrow(features, "a double, b double, c double, d double, y int").collect()], np.float64).reshape(-1, 5)
    out = lexicon(None)
    out.model = fit_logistic(sample[:, :4], (sample[:, 4] > 0).astype(float))
    return out


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text); the text alone gives the score.

    An empty table gives an empty table. A null text is empty; empty texts have the score of no match. A null doc_id is kept and counts as
    not held out. Repeated rows keep a row each; other columns are ignored. predicted is 1 from
    `threshold` on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        model = np.array(shared.value.model)
        for batch in batches:
            rows = np.array([matcher.features(x.as_py()) for x in batch.column(1)], np.float64).reshape(-1, 4)
            value = 1 / (1 + np.exp(-np.clip(rows @ model, -30, 30)))
            yield pa.record_batch([batch.column(0), pa.array(np.round(value, 9))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(fn, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
