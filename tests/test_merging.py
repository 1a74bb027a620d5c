"""The settling of candidates against plain Python, and what of them is shuffled."""

from __future__ import annotations

import random
from datetime import date
from decimal import Decimal

from pyspark.sql import SparkSession

from sluiceway.operators import merging

SCHEMA = "run_id long, field string, value_raw string, value_norm string, value_dec decimal(18,2), value_date date, source string, segment_index int, confidence decimal(5,4), producer string"


def rows_of(n: int) -> list[tuple]:
    """Candidates with nulls in every column but the keys, ties of confidence and of segment, and rows that come twice."""
    r = random.Random(5)
    made = []
    for k in range(n):
        norm = r.choice([None, "", "a", "b", "12.50"])
        source = r.choice([f"body:segment:{k}", f"attachment:f{k}.csv#row2", f"embedded:1:m{k}", None])
        made.append((r.randrange(12), r.choice("xy"), f"raw {k}", norm, r.choice([None, Decimal(r.randrange(9)) / 2]), r.choice([None, date(2024, 1, r.randrange(1, 9))]), source, r.choice([None, 0, 1, 2**31 - 1]), r.choice([None, Decimal("0.5"), Decimal("0.9"), Decimal("0")]), r.choice([None, "p"])))
    # Without a source, the text of the value decides; nothing else may be equal then.
    seen, out = set(), []
    for x in made:
        tie = (*x[:2], x[8], 2**31 - 1 if x[7] is None else x[7], x[6], x[3] or "")
        if tie not in seen:
            out.append(x)
        seen.add(tie)
    return out + out[::3]


def test_settled_as_in_plain_python(spark: SparkSession) -> None:
    rows = rows_of(400)
    found = {(x.run_id, x.field): tuple(x)[2:] for x in merging.settle(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    groups: dict[tuple, list[tuple]] = {}
    for x in rows:
        groups.setdefault(x[:2], []).append(x)
    assert set(found) == set(groups)
    lowest = lambda v: (v is not None, v)
    for key, group in groups.items():
        best = min(group, key=lambda x: (lowest(None if x[8] is None else -x[8]), 2**31 - 1 if x[7] is None else x[7], (x[6] is not None, x[6] or ""), x[3] or ""))
        decs, dates = ([x[k] for x in group if x[k] is not None] for k in (4, 5))
        seen = {(x[3], None if x[6] is None else x[6].partition(":")[0]) for x in group}
        most = max(sum(v == w for w, _ in seen) for v, _ in seen)
        agreement = (Decimal(most) / len({k for _, k in seen})).quantize(Decimal("0.0001"))
        expected = (*best[2:], max(decs) - min(decs) if decs else None, (max(dates) - min(dates)).days if dates else None, len({v for v, _ in seen} - {None}))
        assert found[key][:-1] == expected and abs(found[key][-1] - agreement) <= Decimal("0.0001")


def test_what_orders_candidates_is_shuffled_once(spark: SparkSession) -> None:
    """The winner's columns went beside a second copy of those that order them."""
    settled = merging.settle(spark.createDataFrame(rows_of(20), SCHEMA))
    assert settled.schema.simpleString() == f"struct<{','.join(f.replace(' ', ':').replace('long', 'bigint') for f in SCHEMA.split(', '))},delta:decimal(19,2),days:int,values:bigint,agreement:decimal(5,4)>"
    partial = next(x for x in settled._jdf.queryExecution().executedPlan().toString().splitlines() if "partial_" in x)
    assert "partial_min(struct(_c" in partial and "min_by" not in partial
