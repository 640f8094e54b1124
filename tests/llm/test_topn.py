from __future__ import annotations

import random
from datetime import date

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkledger.llm.topn import merge_runs, top_n


@given(st.lists(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), max_size=20), max_size=9), st.integers(1, 4))
def test_merge_against_sorting(runs, n):
    runs = [sorted(r) for r in runs]
    got = [runs[i][at] for i, at, _ in merge_runs(runs, n)]
    want, seen = [], {}
    for x in sorted(x for r in runs for x in r):
        seen[x[0]] = seen.get(x[0], 0) + 1
        if seen[x[0]] <= n:
            want.append(x)
    assert got == want


@pytest.mark.parametrize("batch", [10_000, 3])
def test_against_brute_force(spark, batch):
    """Groups may end anywhere in the batches that the merge gets."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        against_brute_force(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", "ü", None, ""]), rng.choice([date(2024, 1, 1 + rng.randrange(5)), None]), rng.choice(["k", "K", "é", "z", None]) and f"{rng.choice('kKéz')}{i}", 1, 2) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, d date, t string, place int, _run int").repartition(7)
    got = {}
    for r in top_n(df, F.col("g"), [("d", F.col("d"), True), ("t", F.col("t"), False)], 3).collect():
        got.setdefault(r["group"], []).append((r["place"], r["d"], r["t"]))
    key = lambda r: (r[1] is None, -(r[1] or date(1, 1, 1)).toordinal(), r[2] is None, (r[2] or "").encode())
    for g in {r[0] for r in rows}:
        want = sorted((r for r in rows if r[0] == g), key=key)[:3]
        assert sorted(got[g]) == [(i, r[1], r[2]) for i, r in enumerate(want, 1)], g


def test_empty_and_bad_n(spark):
    df = spark.createDataFrame([], "g string, d date")
    assert top_n(df, F.col("g"), [("d", F.col("d"), True)], 2).count() == 0
    with pytest.raises(ValueError):
        top_n(df, F.col("g"), [("d", F.col("d"), True)], 0)
