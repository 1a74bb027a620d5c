"""Plain versions of the operators' rules, and documents that are hard on them."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

WHITE = " \t\n\x0b\x0c\r"


def words(text: str | None, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def hard_texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Copies, near copies, runs of one word, shared passages, empty and very long texts, repeated rows."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage = text(300), text(70)
    rows: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, "one"), (3, "one two"), (4, " \t\n "), (5, base), (6, base), (7, base.upper())]
    for k in range(30):
        w = base.split()
        for _ in range(k % 6):
            w[r.randrange(len(w))] = f"x{r.randrange(10_000)}"
        rows.append((10 + k, " ".join(w)))
    rows += [(50 + k, f"{text(40 + k)}\n{passage}\n{text(30)}") for k in range(8)]
    rows += [(60, "a " * 200), (61, "b " + "a " * 90 + "c"), (62, "a b " * 60), (63, "x " + "a b " * 70), (64, text(20_000)), (65, "line one is long\n" * 5 + "Line One Is Long \nother line here"), (66, "other line here\r\nshort\nshort\nline one is long"), (67, "line one is long\n" * 3 + "kept here, only here")]
    rows += [(70, "é É ß     x"), (70, "é É ß     x"), (71, "né " * 60)]
    return rows


def frame(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    """Documents with clashing extra columns and nulls in them."""
    full = [(i, t, None, None, None, 1, "x") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n int, key string").repartition(3)
