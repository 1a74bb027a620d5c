"""The prefix trie, the mix and the vector codes against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import frame, hard_texts, words
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm.common import Scratch
from sluiceway.llm.mixing import mix, mixed_texts, source_targets
from sluiceway.llm.prefix_trie import prefix_trie
from sluiceway.llm.vector_codes import Annuli, compress


def turn_key(role: str | None, text: str | None) -> str:
    return hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()


def trie(rows: list[tuple]) -> list[tuple]:
    """The trie with all its nodes, from the rule."""
    own: dict[int, list] = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, turn_key(role, text), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members: dict[tuple, list[int]] = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids: dict[tuple, list[tuple]] = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own_saving = (len(members[node]) - 1) * (len(words(node[-1][1])) if node else 0)
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        saved[node] = own_saving + sum(saved[k] for k in kids[node])
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if built[c] == node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    full = [(*r, None, 1, "x", 2) for r in rows]
    return spark.createDataFrame(full, "conv_id long, turn long, role string, text string, low string, n int, point string, run int").repartition(3)


def hard_conversations(seed: int) -> list[tuple]:
    """Few different turns, so that prefixes are shared at all depths; copies, nulls, gaps, ties, long and turnless ones."""
    r = random.Random(seed)
    rows: list[tuple] = [(None, 0, "user", "nobody"), (-3, 1, "user", "minus three"), (2_000_011, None, None, None), (2_000_011, 1, "user", "a b")]
    for c in range(400):
        if c % 20 == 0 and c % 40:
            continue  # a family without its first
        if c % 3 == 0:
            turns = ["hello there you", "yes", "no no"][: r.randrange(4)] or ["hello there you"]
        else:
            turns = [r.choice(["a", "b c", "", "d e f"]) for _ in range(r.choice([1, 2, 3, 8, 20]))]
        rows += [(c, k if r.random() < 0.95 else None, r.choice(["user", "user", None]), t) for k, t in enumerate(turns)]
    rows += [(7_000, k, "user", "again and again") for k in range(300)] + [(7_001, k, "user", "again and again") for k in range(250)] + [(7_020, 0, "user", "x"), (7_020, 0, "user", "x"), (7_020, 0, "user", "y")]
    return rows


@pytest.mark.parametrize("partitions", ["1", "4", "37"])
def test_prefix_trie(spark: SparkSession, partitions: str) -> None:
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for seed in (1, 2):
            rows = hard_conversations(seed)
            found = prefix_trie(conversations(spark, rows))
            assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, trie(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_prefix_trie_of_little(spark: SparkSession) -> None:
    assert prefix_trie(conversations(spark, [(None, 1, "user", "x")])).isEmpty()
    for rows in ([(1, 0, "user", "x")], [(2, 0, "user", "x")], [(2, 0, "user", "x"), (3, 0, "user", "y y"), (3, 1, None, None)]):
        assert sorted(map(repr, map(tuple, prefix_trie(conversations(spark, rows)).collect()))) == sorted(map(repr, trie(rows)))


def test_ends_of_many_copies(spark: SparkSession) -> None:
    """A sequence whose ids lie in several groups."""
    rows = [(c, 0, "user", "the same") for c in range(0, 60_000, 7)]
    found = {tuple(r) for r in prefix_trie(conversations(spark, rows)).collect()}
    assert found == set(trie(rows))


def filled(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Targets by dealing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    got, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in list(open_):
            got[s] += left * weight[s] / total
        left = sum(max(0.0, got[s] - 2 * sizes[s]) for s in open_)
        for s in list(open_):
            if got[s] >= 2 * sizes[s]:
                got[s] = 2.0 * sizes[s]
                open_.discard(s)
    return got


def test_mix(spark: SparkSession) -> None:
    r = random.Random(3)
    rows = [(i, t, r.choice(["b", "a", "é", "", None, "a", "a"])) for i, t in hard_texts()] + [(k, "one two three " * r.randrange(30), r.choice(["a", "c", "z"])) for k in range(1000, 1400)]
    rows += [(5_000, "five words are right here", "hot")] * 40 + [(9, None, "empty"), (None, "no id", None)]
    docs = spark.createDataFrame([(*x, 1, "s") for x in rows], "doc_id long, text string, source string, size int, h string").repartition(5)
    plan = mix(docs)
    found = [x.asDict() for x in plan.collect()]
    assert len(found) == len(rows)
    sizes: dict[str | None, int] = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    targets = filled(sizes)
    taken: dict[str | None, int] = defaultdict(int)
    for x in found:
        assert x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(targets[x["source"]], rel=1e-9)
        assert 0 <= x["taken"] <= 2 * x["size"]
        taken[x["source"]] += x["taken"]
    for s, target in targets.items():
        assert target - 41 < taken[s] <= target, s  # a word, or one for each of 40 rows with one id
    assert sorted(map(repr, map(tuple, plan.collect()))) == sorted(map(repr, map(tuple, mix(docs.repartition(2)).collect())))
    assert mix(docs.limit(0)).isEmpty()
    # A smaller share takes of each document what the larger takes, or less.
    less = {(x.doc_id, x.source): x.taken for x in mix(docs, share=0.4).where("doc_id >= 1000").collect()}
    more = {(x.doc_id, x.source): x.taken for x in mix(docs, share=0.8).where("doc_id >= 1000").collect()}
    assert all(less[k] <= more[k] for k in less)


def test_source_targets_fill_one_after_another(spark: SparkSession) -> None:
    sizes = {f"s{k:02}": 2**k for k in range(30)}
    totals = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in source_targets(totals, (5, 2, 1), 1.5, 2.0).collect()}
    assert found == pytest.approx(filled(sizes), rel=1e-9)


def test_mixed_texts(spark: SparkSession) -> None:
    rows = [(k, " ".join(f"w{k}_{j}" for j in range(k % 50)), "ab"[k % 10 == 0]) for k in range(200)]
    docs = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, source string, copy int")
    plan = Scratch(spark).keep(mix(docs), "plan")
    want = {r.doc_id: r.taken for r in plan.collect()}
    got: dict[int, int] = defaultdict(int)
    texts = {i: t for i, t, _ in rows}
    for r in mixed_texts(docs, plan).collect():
        got[r.doc_id] += len(words(r.text))
        assert texts[r.doc_id].startswith(r.text) and r["copy"] == 7
    assert dict(got) == {i: t for i, t in want.items() if t}


def codes(rows: list[tuple], parts: int = 4, entries: int = 256, rounds: int = 4) -> dict[int, tuple]:
    kept = sorted(((i, [int(np.floor(1024 * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)), key=lambda x: x[0])
    v = np.array([x[1] for x in kept], object).reshape(len(kept), parts, -1)
    books = [list(v[:entries, p]) for p in range(parts)]
    near = lambda x, book: min((int(((x - c) ** 2).sum()), k) for k, c in enumerate(book))
    for step in range(rounds + 1):
        found = [[near(x, books[p]) for x in v[:, p]] for p in range(parts)]
        if step < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [x for x, (_, k) in zip(v[:, p], found[p], strict=True) if k == e]
                    if mine:
                        books[p][e] = np.array([int(s) // len(mine) for s in sum(mine)], object)
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    error = [sum(found[p][k][0] for p in range(parts)) for k in range(len(kept))]
    label_error: dict = defaultdict(int)
    for (_, _, label), e in zip(kept, error, strict=True):
        label_error[label] += e
    return {i: ("".join(f"{found[p][k][1]:02x}" for p in range(parts)), error[k], label_error[label], sha) for k, (i, _, label) in enumerate(kept)}


def test_vector_codes(spark: SparkSession) -> None:
    r = random.Random(5)
    base = [[r.gauss(0, 0.2) for _ in range(8)] for _ in range(150)]
    rows = [(1000 - k, r.choice(base) if k % 3 == 0 else [r.gauss(0, 0.1 * (1 + k % 5)) for _ in range(8)], r.choice([None, 1, 2, 3])) for k in range(500)]
    rows += [(1, None, 1), (2, [None] * 8, 1), (3, [float("nan")] * 8, 2), (4, [float("inf")] + [0.0] * 7, None), (5, [0.0] * 8, None), (6, [-0.0] * 8, 9), (7, [30_000.5] * 8, 9), (8, [1e-9, -1e-9] * 4, 9)]
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], "vec_id long, embedding array<double>, label int, v int, code string").repartition(4)
    for entries in (256, 20):
        found = {x.vec_id: (x.code, x.error, x.label_error, x.codebooks_sha256) for x in compress(df, entries=entries).collect()}
        assert found == codes(rows, entries=entries)
    assert compress(df.limit(0)).isEmpty()
    few = df.where("vec_id IN (5, 6, 7)")
    assert {x.vec_id: x.error for x in compress(few).collect()} == {5: 0, 6: 0, 7: 0}


def test_vectors_of_other_lengths(spark: SparkSession) -> None:
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1), (1, [1.0, 2.0, 3.0], 1), (None, [4.0] * 5, 2), (2, [], None), (3, [3e38] * 5, 3)], "vec_id long, embedding array<float>, label int")
    found = compress(df).collect()
    assert len(found) == 5 and all(len(x.code) == 8 and x.error == 0 for x in found)
    assert {x.code for x in compress(df.where("vec_id = 2")).collect()} == {"00000000"}


def test_annuli_find_the_nearest() -> None:
    rng = np.random.default_rng(1)
    for spread in (3, 300, 2**26):
        book, points = rng.integers(-spread, spread, (256, 16)), rng.integers(-spread, spread, (700, 16))
        index, distance = Annuli(book).nearest(points)
        every = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_whole_tables(spark: SparkSession, sf: str) -> None:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    assert all(x.target - 1 < x.t <= x.target for x in taken)
    assert frame(spark, hard_texts()).count() == mix(frame(spark, hard_texts())).count()
