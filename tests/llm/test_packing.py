from __future__ import annotations

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkledger.llm.packing import fill_report, pack, plan_packing, reduce_dominated, token_counts


def least_bins(sizes, capacity):
    """Exact by trying every way, for a handful of items."""
    best = len(sizes)

    def place(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + rest[0] <= capacity:
                place(rest[1:], [*bins[:i], bins[i] + rest[0], *bins[i + 1 :]])
        place(rest[1:], [*bins, rest[0]])

    place(sorted(sizes, reverse=True), [])
    return best


def expand(counts):
    return [s for s, n in counts.items() for _ in range(n)]


def count(sizes):
    return {s: len([*g]) for s, g in itertools.groupby(sorted(sizes))}


@settings(max_examples=300, deadline=None)
@given(st.integers(4, 20).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=8))))
def test_reduction_never_costs_a_container(case):
    capacity, sizes = case
    left = count(sizes)
    fixed = reduce_dominated(left, capacity)
    n = sum(t for _, t in fixed)
    assert n + (least_bins(expand(left), capacity) if left else 0) == least_bins(sizes, capacity)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_plan_holds_every_item_once(case):
    capacity, sizes = case
    plan, _ = plan_packing(count(sizes), capacity)
    assert all(t > 0 and sum(s * m for s, m in p) <= capacity for p, t in plan)
    assert sorted(s for p, t in plan for s, m in p for _ in range(m * t)) == sorted(sizes)
    n, volume = sum(t for _, t in plan), -(-sum(sizes) // capacity)
    assert volume <= n <= 11 * max(1, volume) // 9 * 2 + 1


def test_sizes_out_of_range():
    for bad in ({0: 1}, {11: 1}):
        with pytest.raises(ValueError):
            plan_packing(bad, 10)


def test_pack_rows(spark):
    sizes = [3, 7, 10, 25, 0, None, 5, 5, 4, 6, 2, 8, 10] * 20
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)] + [(0, 3, "x")], "id long, n long, container string").repartition(5, "id").cache()
    rows = pack(df, F.col("id"), F.col("n"), 10).collect()
    fill, pieces = {}, {}
    for r in rows:
        fill[r["container"]] = fill.get(r["container"], 0) + r["piece_size"]
        pieces.setdefault(r["item"], []).append((r["piece"], r["piece_offset"], r["piece_size"]))
    assert max(fill.values()) == 10 and min(fill) == 1 and len(fill) == max(fill) == -(-(sum(x or 0 for x in sizes) + 3) // 10)
    assert sorted(pieces[3]) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)] and pieces[4] == [(0, 0, 0)] and len(pieces[0]) == 2
    assert fill_report(pack(df, F.col("id"), F.col("n"), 10), 10).where("fill > 10").count() == 0


def test_empty_and_capacity(spark):
    df = spark.createDataFrame([], "id long, n long")
    assert pack(df, F.col("id"), F.col("n"), 10).count() == 0
    with pytest.raises(ValueError):
        pack(df, F.col("id"), F.col("n"), 0)


def test_tokens_of_whole_texts(spark):
    public = pytest.importorskip("public_tokenizers")
    long = "word " * 50_000
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, long), (5, "<|endoftext|>")], "id long, t string")
    got = {r["item"]: r["n_tokens"] for r in token_counts(df, "id", "t", public.path("byte_bpe_50k.tiktoken"), public.PATTERN).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 50_000 and got[5] > 1
