from __future__ import annotations

import random
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from sparkledger.llm import survivors as module
from sparkledger.llm.survivors import fit_quality, survivors, truth

SCHEMA = "e string, row_id long, source string, day date, name string, parent string, entity string, field string"
TRUST = ("award_detail", "transaction", "none")


def run(spark, rows, trust=TRUST, several=()):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    out, q = survivors(df, F.col("e"), F.col("row_id"), F.col("source"), F.col("day"), {"name": F.col("name"), "parent": F.col("parent")}, trust, several)
    return {r["entity"]: r for r in out.collect()}, q


def test_order_of_survival(spark):
    d = date
    got, _ = run(spark, [
        ("A", 1, "transaction", d(2024, 5, 1), "new", None), ("A", 2, "award_detail", d(2024, 1, 1), "trusted", None), ("A", 3, "award_detail", None, "undated", "P"), ("A", 4, "none", d(2025, 1, 1), "x", "Q"),
        ("B", 5, "transaction", d(2024, 1, 1), "b", None), ("B", 6, "transaction", d(2024, 1, 1), "a", None), ("B", 6, "transaction", d(2024, 1, 1), "a", None),
        ("C", 7, None, None, None, None), (None, 8, "none", None, "z", None), ("D", 9, "other", d(2024, 1, 1), "o", None), ("D", 10, "none", d(2020, 1, 1), "n", None),
    ])
    assert (got["A"]["name"], got["A"]["name_row_id"], got["A"]["parent_row_id"], got["A"]["n_rows"]) == ("trusted", 2, 3, 4)
    assert (got["B"]["name"], got["B"]["name_row_id"], got["B"]["n_rows"]) == ("b", 5, 3)
    assert (got["C"]["name"], got["C"]["name_row_id"], got["C"]["parent_row_id"]) == (None, 0, 0)
    assert got["D"]["name"] == "n" and set(got) == {"A", "B", "C", "D"}


def test_model_tells_good_sources_from_bad(spark):
    rows, n, rng = [], 0, random.Random(4)
    for i in range(300):
        for s, p in (("good", 0.97), ("sound", 0.95), ("fair", 0.85), ("bad", 0.3)):
            n += 1
            right = rng.random() < p
            rows.append((f"E{i}", n, s, date(2024, 1, 1), f"true{i}" if right else f"{s}{i}", None))
    got, q = run(spark, rows, trust=None)
    bad, fair, good, sound = q.sensitivity  # sources in alphabetical order
    assert min(good, sound) > fair > bad and min(q.specificity[2:]) > q.specificity[1] > q.specificity[0]
    assert np.mean([got[f"E{i}"]["name"] == f"true{i}" for i in range(300)]) > 0.93
    assert np.mean([got[f"E{i}"]["name_values"] == [f"true{i}"] for i in range(300)]) > 0.85


def test_several_true_values_are_kept(spark):
    rows = [(f"E{i}", 4 * i + k, s, date(2024, 1, 1), v, None) for i in range(60) for k, (s, v) in enumerate((("a", "x"), ("b", "x"), ("a", "y"), ("b", "y")))]
    got, _ = run(spark, rows, several=("name",))
    assert sorted(got["E1"]["name_values"]) == ["x", "y"]


def test_rows_come_from_the_posterior(spark, monkeypatch):
    """With a posterior that is the same for all, the latest day wins in place of the most trusted source."""
    rows = [("A", 1, "award_detail", date(2024, 1, 1), "trusted", None), ("A", 2, "transaction", date(2024, 5, 1), "late", None), ("A", 3, "none", date(2024, 5, 1), "late", None)]
    assert run(spark, rows)[0]["A"]["name_row_id"] == 1
    monkeypatch.setattr(module, "log_odds", lambda *_: F.lit(0.0))
    assert run(spark, rows)[0]["A"]["name_row_id"] == 2


def test_trust_outweighs_all_below(spark):
    """However often the claims say otherwise, and however many sources agree against it."""
    sources = [f"s{i:02}" for i in range(14)]
    rows = [(f"E{e}", 100 * e + i, s, date(2024, 1, 1), "first" if i == 0 else "others", None) for e in range(30) for i, s in enumerate(sources)]
    got, q = run(spark, rows, trust=sources)
    assert {r["name"] for r in got.values()} == {"first"}
    w = np.array(q.stated) - np.array(q.silent)
    assert all(w[i] > w[i + 1 :].sum() for i in range(13))
    assert {r["name"] for r in run(spark, rows, trust=None)[0].values()} == {"others"}


def test_superseded_values_are_no_claims(spark):
    rows = [("A", i, "transaction", date(2024, i, 1), f"v{i}", None) for i in range(1, 6)] + [("B", 9, "none", date(2024, 1, 1), "w", None), ("B", 10, "none", date(2024, 1, 2), None, None)]
    got, _ = run(spark, rows)
    assert got["A"]["name_values"] == ["v5"] and got["B"]["name_row_id"] == 9


def test_em_by_hand_and_empty(spark):
    said, covers = np.array([[True, False]]), np.array([[True, True]])
    q = fit_quality(said, covers, np.array([1.0]))
    assert 0 < truth(said, covers, q)[0] < 1 and all(0 < x < 1 for x in (*q.sensitivity, *q.specificity))
    assert run(spark, [])[0] == {}


def test_many_patterns_give_the_same_model(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(f"E{e}", 10 * e + i, s, date(2024, 1, 1), rng.choice("xyz"), None) for e in range(50) for i, s in enumerate("abcd") if rng.random() < 0.8]
    monkeypatch.setattr(module.fit_quality, "__defaults__", (None, None, 6, 1e-6))
    monkeypatch.setattr(module._fit_over, "__defaults__", (6, 1e-6))
    for trust in (None, ("b", "a")):
        got, here = run(spark, rows, trust)
        with monkeypatch.context() as m:
            m.setattr(module, "MAX_PATTERNS", 0)
            also, there = run(spark, rows, trust)
        assert np.allclose(np.r_[here.prior, here.stated, here.silent], np.r_[there.prior, there.stated, there.silent], rtol=1e-4)
        assert {k: r["name"] for k, r in got.items()} == {k: r["name"] for k, r in also.items()}


def test_long_value(spark):
    got, _ = run(spark, [("A", 1, "none", None, "x" * 100_000, None)])
    assert len(got["A"]["name"]) == 100_000
