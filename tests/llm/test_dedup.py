"""Line dedup, substring dedup and the n-gram join against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import time

import numpy as np
import pytest
from helpers import WHITE, frame, hard_texts, words
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sluiceway.llm import ngram_join, substring_dedup
from sluiceway.llm.common import Scratch, connected_components, hot_join
from sluiceway.llm.line_dedup import dedup_lines, keep_bitmaps

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_line_dedup(spark: SparkSession) -> None:
    rows = hard_texts()
    key = lambda line: line.strip(WHITE).translate(LOWER)
    holders: dict[str, set[int]] = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    expected = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) > 1 and min(holders[key(x)]) != i)]
        expected.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    docs = frame(spark, rows)
    found = dedup_lines(docs)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()) == sorted(expected)
    assert found.columns[: len(docs.columns)] == docs.columns
    assert dedup_lines(docs.limit(0)).isEmpty()
    odd = docs.withColumns({c: F.lit(1) for c in ("_doc", "_lines", "_dropped", "_hash", "dropped", "kept_text", "a.b")})
    renamed = dedup_lines(odd)
    assert renamed.columns == [*(c for c in odd.columns if c != "kept_text"), "n_lines", "n_dropped", "kept_text"]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in renamed.collect()) == sorted(expected)
    assert any(len(r.dropped) < 2 < sum(d.last - d.first + 1 for d in r.dropped) for r in keep_bitmaps(docs).collect())


def windows_removed(rows: list[tuple[int, str | None]], size: int) -> list[tuple[int, int, int, str]]:
    first: dict[tuple, int] = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < i:
                gone[p : p + size] = [True] * size
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def test_substring_dedup(spark: SparkSession) -> None:
    rows = hard_texts()
    found = substring_dedup.remove_repeats(frame(spark, rows))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()) == sorted(windows_removed(rows, 50))
    assert substring_dedup.remove_repeats(frame(spark, rows).limit(0)).isEmpty()
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(frame(spark, rows), 20)


@pytest.mark.parametrize("letters", [1, 2, 3, 5, 50])
def test_equal_windows_share_an_anchor(letters: int) -> None:
    """Any two equal windows, whatever stands around them, share an anchor that marks both."""
    r = random.Random(letters)
    for _ in range(60):
        values = np.array([r.getrandbits(64) for _ in range(letters)], np.uint64)
        window = values[[r.randrange(letters) for _ in range(50)]]
        marked = []
        for _ in range(2):
            left, right = (values[[r.randrange(letters) for _ in range(r.randrange(40))]].astype(np.uint64) if r.random() < 0.9 else np.zeros(0, np.uint64) for _ in range(2))
            flat = np.concatenate([left, window, right])
            name, begin, stop, is_run = substring_dedup.anchors(flat, np.zeros(len(flat), np.int64), 50)
            p, edge = len(left), substring_dedup.EDGE
            inside = np.where(is_run, (begin < p + 50) & (stop > p), (begin >= p + edge) & (stop <= p + 50 - edge))
            plain = ~is_run & inside
            names = name.copy()
            names[plain] = substring_dedup.in_context(name[plain], flat, begin[plain], stop[plain])
            marked.append(set(names[inside].tolist()))
        assert marked[0] & marked[1]


def ngrams(text: str | None, size: int) -> frozenset:
    w = words(text, lower=True)
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components(rows: list[tuple[int, str | None]], size: int, percent: int, roots: bool = False) -> list[tuple[int, int, int]]:
    """(id, size of the set, least id of its component, or the number of a row of it) of each row."""
    sets = [ngrams(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), find(k) if roots else least[find(k)]) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark: SparkSession, size: int, percent: int) -> None:
    rows = hard_texts(2)
    found = ngram_join.jaccard_components(frame(spark, rows), size, percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == sorted(components(rows, size, percent))


def test_every_round_of_pivots(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """All rounds, and every fragment a large one, lose no link."""
    monkeypatch.setattr(ngram_join, "FEW", -1)
    monkeypatch.setattr(ngram_join, "LARGE", 1)
    rows = hard_texts(2)
    found = ngram_join.jaccard_components(frame(spark, rows), 5, 80)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == sorted(components(rows, 5, 80))


def test_keep_one_of_each(spark: SparkSession) -> None:
    """Repeated rows leave one, and a copy goes even if it shares its id with a row that stays."""
    rows = hard_texts(3)
    base = dict(rows)[5]
    rows += [(3, base), (3, base), (5, "another text than the other row of this id has"), (None, base), (None, base)]
    known = [r for r in rows if r[0] is not None]
    docs = frame(spark, rows).withColumns({"_hash": F.lit(1), "component": F.lit(2), "text_hash": F.lit(3), "a.b": F.lit(4)})
    found = ngram_join.keep_one_of_each(docs, 5, 80)
    kept = sorted(((r.doc_id, r.text) for r in found.where("doc_id is not null").collect()), key=repr)
    members: dict[int, set] = {}
    for (i, t), (_, n, c) in zip(known, components(known, 5, 80, roots=True), strict=True):
        if n:
            members.setdefault(c, set()).add((i, t))
    least = sorted(min(i for i, _ in m) for m in members.values())
    wordless = [r for r in known if not words(r[1])]
    assert sorted(i for i, t in kept if words(t)) == least and [r for r in kept if not words(r[1])] == sorted(wordless, key=repr)
    assert all(sum(r in m for r in kept) == 1 for m in members.values())
    assert found.columns == docs.columns and found.where("doc_id is null").count() == 2
    assert ngram_join.keep_one_of_each(docs.limit(0)).isEmpty()


def test_common_fragments_lose_no_link(spark: SparkSession) -> None:
    """Near copies in a crowd of documents that share a passage."""
    r = random.Random(8)
    text = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    passage, rows = text(60), []
    for k in range(60):
        w = [*text(r.randrange(20, 200)), *passage, *text(r.randrange(20, 200))]
        rows.append((k, " ".join(w)))
        if k % 3 == 0:
            for n in range(2):
                near = list(w)
                for _ in range(r.randrange(1, 4)):
                    near[r.randrange(len(near))] = "new"
                rows.append((100 + 10 * k + n, " ".join(near)))
    for size, percent in ((3, 90), (5, 80)):
        found = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), size, percent)
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in found.collect()) == sorted(components(rows, size, percent))


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_fragment(percent: int) -> None:
    r = random.Random(percent)
    for _ in range(300):
        a = {r.getrandbits(64) for _ in range(r.randrange(1, 400))}
        b = set(a)
        most = int(len(a) * (100 - percent) / 100)
        for _ in range(r.randrange(0, most + 1)):
            if r.random() < 0.5 and len(b) > 1:
                b.remove(next(iter(b)))
            else:
                b.add(r.getrandbits(64))
        if 100 * len(a & b) >= percent * len(a | b):
            x, y = (np.sort(np.array(list(s), np.uint64)) for s in (a, b))
            assert a == b or set(ngram_join.fragment_keys(x, percent)[0].tolist()) & set(ngram_join.fragment_keys(y, percent)[0].tolist())
            px, py = ngram_join.parity_sketch(x), ngram_join.parity_sketch(y)
            while len(px) > len(py):
                px = px[: len(px) // 2] ^ px[len(px) // 2 :]
            while len(py) > len(px):
                py = py[: len(py) // 2] ^ py[len(py) // 2 :]
            assert sum(int(v).bit_count() for v in (px ^ py).view(np.uint64)) <= len(a ^ b)


def test_hot_keys_are_joined_apart(spark: SparkSession) -> None:
    rows = spark.createDataFrame([(k, 7 if k % 2 else k) for k in range(1000)], "id long, key long")
    keyed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    found = {r.id: r.least for r in hot_join(rows, keyed, ["key"], 1000).collect()}
    assert found == {k: 1 if k % 2 else k for k in range(1000)}


def test_connected_components(spark: SparkSession) -> None:
    chain = [(k, k + 1) for k in range(300, 800)] + [(k, k + 1) for k in range(60)] + [(100, 200 + k) for k in range(20)] + [(7, 7)]
    found = connected_components(spark.createDataFrame(chain, "u long, v long"), Scratch(spark))
    assert {r.node: r.component for r in found.collect()} == {k: 300 for k in range(300, 801)} | {k: 0 for k in range(61)} | {100: 100} | {200 + k: 100 for k in range(20)}
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark)).isEmpty()


def test_kept_tables_leave_no_shuffle_files(spark: SparkSession) -> None:
    """What a kept table shuffled is deleted when it is written, and the session's setting is as before."""
    from sluiceway.llm import common

    def shuffled() -> set[str]:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if "/shuffle_" in f and f.endswith(".data")}

    before, setting = shuffled(), spark.conf.get(common.CLEANUP, None)
    rows = spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).count()
    scratch = common.Scratch(spark)
    kept = scratch.keep(rows, "rows")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(common.CLEANUP, None) == setting
    assert kept.count() == rows.count() == 1000
    scratch.free("rows")
