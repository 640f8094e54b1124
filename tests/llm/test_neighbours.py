from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import sparkledger.llm.neighbours as m
from sparkledger.llm.neighbours import buckets, hadamard, nearest, signs


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), 8 * np.linalg.norm(x, axis=1)) and np.allclose(hadamard(hadamard(x)), 64 * x)


def test_buckets_are_distinct_probes_and_equal_for_equal_vectors():
    x = np.random.default_rng(2).normal(size=(50, 64)).astype(np.float32)
    b = buckets(np.r_[x, x], signs(1, 3, 2, 64), 4)
    assert b.shape == (3, 100, 4) and (b[:, :50] == b[:, 50:]).all()
    assert all(len(set(b[t, i])) == 4 for t in range(3) for i in range(50))


def brute(ids, x, k, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    out = {}
    for i in range(len(ids)):
        c = [(-s[i, j], ids[j]) for j in range(len(ids)) if ids[j] != ids[i] and s[i, j] >= least]
        out[ids[i]] = [(j, -v) for v, j in sorted(c)[:k]]
    return out


def clusters(rng, n, spread):
    centres = rng.normal(size=(8, 64))
    return (centres[rng.integers(0, 8, n)] + spread * rng.normal(size=(n, 64))).astype(np.float32).astype(np.float64)


def frame(spark, ids, x):
    rows = [(int(i), [float(v) for v in r], "c", 1) for i, r in zip(ids, x, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, vec array<float>, cid string, bucket int").repartition(4)


def lists(df, **kw):
    out = {}
    for r in nearest(df, F.col("doc_id"), F.col("vec"), **kw).orderBy("id", "place").collect():
        out.setdefault(r["id"], []).append((r["other"], r["cosine"]))
    return out


def test_recall_and_exact_cosines(spark):
    x = clusters(np.random.default_rng(3), 600, 0.25)
    x[100:140] = x[100]  # one class of copies
    ids = np.random.default_rng(4).permutation(5000)[:600]
    want, got = brute(ids, x, 5, 0.9), lists(frame(spark, ids, x))
    pairs = lambda d: {(i, j, c) for i, js in d.items() for j, c in js}
    assert len(pairs(want) & pairs(got)) >= 0.98 * len(pairs(want))
    for i in ids[100:140]:
        assert got[i] == want[i]


def test_crowded_buckets_lose_nothing(spark, monkeypatch):
    x = clusters(np.random.default_rng(5), 200, 0.02)
    want = brute(range(200), x, 5, 0.9)
    monkeypatch.setattr(m, "TILE", 4)
    got = lists(frame(spark, range(200), x))
    assert sum(got.get(i) == want[i] for i in want) >= 198


def test_what_takes_no_part(spark):
    good = [0.0] * 63 + [1.0]
    rows = [(1, good), (2, good), (3, None), (4, [0.0] * 64), (5, [1.0] * 63), (6, [float("nan")] + good[1:]), (None, good), (7, [None, *good[1:]]), (2, good), (8, [float("inf"), *good[1:]])]
    df = spark.createDataFrame(rows, "doc_id long, vec array<float>")
    assert lists(df) == {1: [(2, 1.0)], 2: [(1, 1.0)]}
    assert lists(df.where("false")) == {}


def test_buckets_grow_with_the_vectors():
    """About as many vectors to a bucket at every size, and the whole last rotation before another one is joined."""
    assert [m.shape(n, 64) for n in (0, 8, 1000, 95_000, 10**6, 10**9)] == [(1, 1), (1, 1), (1, 64), (2, 64), (3, 4), (4, 32)]
    x = np.random.default_rng(6).normal(size=(4000, 64)).astype(np.float32)
    for n in (4000, 64_000, 10**6):
        hashes, last = m.shape(n, 64)
        codes = buckets(x, signs(1, 2, hashes, 64), 2, last)
        assert len(np.unique(codes[0, :, 0])) > min(0.5 * 128 ** (hashes - 1) * 2 * last, 1500)
        assert (codes[:, :, 0] != codes[:, :, 1]).all()
