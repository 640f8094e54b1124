from __future__ import annotations

import random

import numpy as np
import pytest

from sparkledger.llm.leaks import align, in_common, leaked, words


def test_words():
    assert words("A&nbsp;'''bo'''ld [[Link|te­xt]] <b>x</b>y<ref>n</ref> z<!-- c -->​d_e 1st") == ["a", "bold", "link", "text", "xy", "n", "z", "c", "d", "e", "1st"]
    assert words(None) == words("") == words("--- ''") == []


def test_align_by_hand():
    a = np.array([1, 2, 3, 4, 5])
    assert align(a, np.array([9, 1, 2, 3, 4, 5, 8])) == (10, 5)
    assert align(a, np.array([1, 2, 7, 3, 4, 5])) == (9, 3)
    assert align(a, np.array([0, 0])) == (0, 0)


def brute(docs, items, window):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - window + 1):
            grams.setdefault(tuple(w[k : k + window]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words(t)] for k in range(len(w) - window + 1) for i in grams.get(tuple(w[k : k + window]), ())}


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 50)))) for i in range(40)] + [(40, None), (41, ""), (None, "x y z"), (7, "again " * 20)]
    docs = []
    for d in range(120):
        w = rng.choices(vocabulary, k=rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            i, t = items[rng.randrange(40)]
            t = t.split()
            lo = rng.randrange(len(t))
            at = rng.randrange(len(w) + 1)
            w[at:at] = t[lo : lo + rng.choice([9, 12, 13, 14, 40])]
        docs.append((d, " ".join(w)))
    docs += [(200, None), (201, ""), (202, docs[0][1]), (0, docs[0][1]), (203, "long " * 100_000 + items[1][1])]
    frame = spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id long, text string, score int, item_id string").repartition(5)
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = leaked(frame, tests).collect()
    assert len({(r["doc_id"], r["item_id"]) for r in got}) == len(got)
    assert {(r["doc_id"], r["item_id"]) for r in got if r["longest_run"] >= 13} == brute(docs, [x for x in items if x[0] is not None], 13)


def test_edited_copies_score(spark):
    text = " ".join(f"t{i}" for i in range(40))
    edited = " ".join("zz" if i in (12, 25) else f"t{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"a b {edited} c"), (2, "nothing here at all"), (3, "t1 t2 t3 t4 t5 t6")], "doc_id long, text string")
    got = leaked(docs, spark.createDataFrame([(9, text)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["longest_run"]) for r in got] == [(1, 9, 14)] and got[0]["share"] > 0.9


def test_edited_copies_without_rare_seeds_score(spark):
    """Only the seeds that are rarest of their windows are edited: a copy of a high share all the same."""
    w = [f"t{i}" for i in range(60)]
    # seeds that start from 12k to 12k + 4 are the rare ones: every other run of eight seeds stands in more documents
    edited = ["zz" if i % 12 == 4 else x for i, x in enumerate(w)]
    common = [(10 + i, " ".join(edited)) for i in range(3)]
    docs = spark.createDataFrame([(1, " ".join(w)), *common, (2, " ".join([*w[5:15], *(["q"] * 200)]))], "doc_id long, text string")
    tests = spark.createDataFrame([(9, " ".join(w))], "item_id long, text string")
    got = {r["doc_id"]: r for r in leaked(docs, tests).collect()}
    assert {d for d, r in got.items() if r["share"] >= 0.5} == {1, 10, 11, 12} and got[10]["longest_run"] == 11
    assert in_common(np.array([1, 2, 2, 3]), np.array([2, 2, 2, 0, 3, 9])) == 3
    assert {r["doc_id"] for r in leaked(docs, tests, share=None).collect() if r["longest_run"] >= 13} == {1}


@pytest.mark.parametrize(("rate", "recall"), [(0.05, 1.0), (0.1, 1.0), (0.2, 0.97)])
def test_recall_of_edited_copies(spark, rate, recall):
    """Words replaced, left out and added at random, of items of 28 to 84 words, with the seeds that p9_scores takes."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, rng.choices(vocabulary, k=rng.randint(28, 84))) for i in range(150)]
    docs = []
    for i, w in items:
        copy = [y for x in w for y in ([x] if rng.random() >= rate else rng.choice([[rng.choice(vocabulary)], [], [x, rng.choice(vocabulary)]]))]
        docs.append((i, " ".join([*rng.choices(vocabulary, k=80), *copy, *rng.choices(vocabulary, k=80)])))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = leaked(frame, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"), share=0.5, n=4, least=4).collect()
    assert sum(r["doc_id"] == r["item_id"] and r["share"] >= 0.5 for r in got) >= recall * len(items)


def test_blocks_of_items_and_empty_sides(spark, monkeypatch):
    import sparkledger.llm.leaks as m

    docs = spark.createDataFrame([(i, " ".join(f"d{i}x{k}" for k in range(20))) for i in range(6)], "doc_id long, text string")
    tests = docs.withColumnRenamed("doc_id", "item_id")
    monkeypatch.setattr(m, "BLOCK_WORDS", 50)
    assert {(r["doc_id"], r["item_id"]) for r in leaked(docs, tests).collect()} == {(i, i) for i in range(6)}
    assert leaked(docs, tests.where("false")).count() == leaked(docs.where("false"), tests).count() == 0
    with pytest.raises(ValueError):
        leaked(docs, tests, window=8)
