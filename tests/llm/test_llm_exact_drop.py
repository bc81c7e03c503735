"""Rows that the exact drop leaves, with repeated and null ids."""

import random

import pytest

from tagspace.llm import exact_dedup


def left(spark, rows, support=exact_dedup.SUPPORT):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, own_id long")
    out = exact_dedup.drop_exact_copies(docs, support)
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def brute(rows):
    best = {}
    for i, t in rows:
        t = t or ""
        best[t] = max((x for x in (best.get(t), i) if x is not None), default=None)
    return sorted(((i, t) for t, i in best.items()), key=str)


@pytest.mark.parametrize("rows", [
    [(1, "A"), (1, "B"), (2, "A")],
    [(1, "A"), (1, "A")],
    [(None, "A"), (None, "A"), (2, "A"), (None, "B"), (None, "B")],
])
def test_drop_of_repeated_and_null_ids(spark, rows):
    assert left(spark, rows) == brute(rows)


def test_drop_against_all_rows(spark):
    r = random.Random(7)
    rows = [(r.choice([None, *range(12)]), r.choice("ABCDEFGH") * r.randrange(1, 4)) for _ in range(150)]
    assert left(spark, rows) == left(spark, rows, 0.5) == brute(rows)
