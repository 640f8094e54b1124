from __future__ import annotations

from collections import Counter
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from sparkledger.operators.skew import chunked_totals, number_within_key

SCHEMA = "k string, amount decimal(20,2), day date, key string, chunk long, _part int"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", 7, 9) for r in rows], SCHEMA).repartition(parts)


def test_numbers_have_no_gaps_and_chunks_are_equal(spark):
    rows = [("hot", None, None)] * 1000 + [(f"k{i % 40}", None, None) for i in range(200)] + [(None, None, None)] * 30
    df = frame(spark, rows).cache()
    df.count()
    out, n = number_within_key(df, F.col("k"), {}, chunk_rows=100)
    got = out.collect()
    assert n == 1230 and len(got) == 1230
    assert sorted(r["key_no"] for r in got if r["key"] == "hot") == list(range(1000))
    assert Counter(r["chunk"] for r in got if r["key"] == "hot") == dict.fromkeys(range(10), 100)
    assert {(r["key_no"], r["chunk"]) for r in got if r["key"] == "k3"} == {(None, 0)}
    out, _ = number_within_key(df, F.col("k"), {}, chunk_rows=0)
    every = {}
    for r in out.collect():
        every.setdefault(r["key"], []).append(r["key_no"])
    assert all(sorted(v) == list(range(len(v))) for v in every.values()) and len(every[None]) == 30


def test_offsets_by_join_give_the_same(spark, monkeypatch):
    import sparkledger.operators.skew as s

    df = frame(spark, [("hot", Decimal(i), date(2024, 1, 1 + i % 28)) for i in range(500)] + [("b", Decimal(1), None)]).cache()
    want = chunked_totals(df, F.col("k"), F.col("amount"), F.col("day")).collect()
    monkeypatch.setattr(s, "MAX_BROADCAST_OFFSETS", 0)
    assert sorted(chunked_totals(df, F.col("k"), F.col("amount"), F.col("day")).collect()) == sorted(want)


def test_totals(spark):
    rows = [("a", Decimal("1.50"), date(2024, 1, 1)), ("a", None, date(2024, 3, 1)), ("a", Decimal("-0.25"), None), ("b", None, None), (None, Decimal(9), date(2025, 1, 1)), ("a", Decimal("1.50"), date(2024, 1, 1))]
    got = {r["key"]: (r["n_rows"], r["amount_sum"], r["latest"], r["heavy"]) for r in chunked_totals(frame(spark, rows), F.col("k"), F.col("amount"), F.col("day"), heavy_percent=50).collect()}
    assert got == {"a": (4, Decimal("2.75"), date(2024, 3, 1), True), "b": (1, None, None, False)}
    assert chunked_totals(frame(spark, []), F.col("k"), F.col("amount"), F.col("day")).collect() == []


def test_heavy_counts_null_rows_and_ties_exactly(spark):
    rows = [("edge", None, None)] * 3 + [(None, None, None)] * 97
    assert [r["key"] for r in chunked_totals(frame(spark, rows), F.col("k"), F.col("amount"), F.col("day")).where("heavy").collect()] == ["edge"]
