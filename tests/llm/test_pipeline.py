"""The pipeline's stages, each on all that the stage before kept, against brute force."""

from __future__ import annotations

import importlib.util
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from helpers import WHITE, words
from pyspark.sql import SparkSession
from test_dedup import LOWER, components
from test_models import brute
from tokenizers import Tokenizer

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")


def without_lines(rows: list[tuple]) -> list[tuple]:
    key = lambda line: line.strip(WHITE).translate(LOWER)
    holders: dict[str, set] = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders[key(line)].add(i)
    drop = lambda i, line: i is not None and len(holders.get(key(line), ())) > 1 and min(holders[key(line)]) != i
    return [(i, "\n".join(x for x in (t or "").split("\n") if not drop(i, x))) for i, t in rows]


def one_of_each(rows: list[tuple]) -> list[tuple]:
    named = [r for r in rows if r[0] is not None]
    groups: dict[int, set] = defaultdict(set)
    free = [r for r in rows if r[0] is None or not words(r[1])]
    for (i, n, root), (_, t) in zip(components(named, 5, 80, roots=True), named, strict=True):
        if n:
            groups[root].add((i, t))
    # Ids are distinct here, so the least id is one row.
    return free + [min(g) for g in groups.values()]


def test_pipeline(spark: SparkSession, sf: str, tmp_path: Path) -> None:
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    base = [tuple(r) for r in docs.orderBy("doc_id").limit(70).collect()]
    at = {c: k for k, c in enumerate(docs.columns)}

    def like(k: int, i: int | None, text: str | None) -> tuple:
        row = list(base[k])
        row[at["doc_id"]], row[at["text"]] = i, text
        return tuple(row)

    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    prose = max((r for r in base if r[at["lang"]] == "en"), key=lambda r: len(r[at["text"]] or ""))[at["text"]].split()
    near = list(prose[:400])
    near[200] = "altered"
    planted = [like(0, 9_000, " ".join(prose[:400])), like(0, 9_001, " ".join(near)), like(0, 9_002, f"{' '.join(prose[50:90])} {items[0][1]} {' '.join(prose[90:120])}"), like(0, 9_003, None), like(0, 9_004, ""), like(0, None, " ".join(prose[10:60]))]
    table = spark.createDataFrame(base + planted, docs.schema)
    (tmp_path / "sf").mkdir()
    table.write.parquet(f"{tmp_path}/sf/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/sf/benchmark.parquet")
    place, out, kept = f"file://{tmp_path}/sf", table, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out, place).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = out
        assert name == "packing" or out.columns == docs.columns
    rows = {name: [(r.doc_id, r.text) for r in df.collect()] for name, df in kept.items() if name != "packing"}
    spelled = lambda rs: sorted(map(repr, rs))
    assert {9_000, 9_001, 9_002, None} <= {i for i, _ in rows["language_id"]} and not {9_003, 9_004} & {i for i, _ in rows["language_id"]}
    assert spelled(rows["line_dedup"]) == spelled(without_lines(rows["language_id"]))
    assert spelled(rows["ngram_join"]) == spelled(one_of_each(rows["line_dedup"]))
    assert len({9_000, 9_001} & {i for i, _ in rows["ngram_join"]}) <= 1
    bad = {i for i, _ in brute([r for r in rows["ngram_join"] if r[0] is not None], items, 0.8)}
    assert spelled(rows["decontaminate"]) == spelled(r for r in rows["ngram_join"] if r[0] not in bad) and 9_002 in bad
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces: dict[int, list] = defaultdict(list)
    sequences: dict[int, list] = defaultdict(list)
    for p in kept["packing"].collect():
        pieces[p.doc_id].append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
        sequences[p.sequence_id].append((p.offset, p.length))
    told = {i: [x for _, ids in sorted(own) for x in ids] for i, own in pieces.items()}
    assert told == {i: [*plain.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows["decontaminate"] if i is not None}
    assert all(sum(n for _, n in own) <= 4096 and sorted(own)[0][0] == 0 for own in sequences.values())
    whole = corpus_pipeline.run(spark, place)
    assert {(p.doc_id, p.start, p.length) for p in whole.select("doc_id", "start", "length").collect()} == {(i, s, len(ids)) for i, own in pieces.items() for s, ids in own}
