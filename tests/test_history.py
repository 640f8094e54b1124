from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from sparkledger.functions.text import non_blank
from sparkledger.operators.history import attribute_history, change_log

SCHEMA = "row_id long, uei string, name string, parent_uei string, observed_on date, entity string, attribute string, valid_from string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = attribute_history(df, "uei", "observed_on", "row_id", {"name": non_blank("name"), "parent_uei": non_blank("parent_uei")}).collect()
    return sorted(((r["entity"], r["name"], r["parent_uei"], r["valid_from"], r["valid_to"]) for r in got), key=lambda x: (x[0], x[3]))


def brute(rows):
    """Replays every row; a version starts where the state after a day differs."""
    out = []
    blank = lambda v: v is None or v.strip(" ") == "" or v.strip(" ").upper() in ("N/A", "UNKNOWN", "NOT AVAILABLE", "-")
    for uei in sorted({r[1] for r in rows if r[1] is not None}):
        state, days = [None, None], {}
        for r in sorted((r for r in rows if r[1] == uei and r[4] is not None), key=lambda r: (r[4], r[0])):
            state = [s if blank(v) else v.strip(" ") for s, v in zip(state, r[2:4], strict=True)]
            days[r[4]] = tuple(state)
        versions = []
        for day, s in sorted(days.items()):
            if not versions or versions[-1][1] != s:
                versions.append((day, s))
        ends = ([v[0] for v in versions[1:]] + [None])[: len(versions)]
        out += [(uei, *s, day, end) for (day, s), end in zip(versions, ends, strict=True)]
    return out


def d(n):
    return date(2024, 1, n)


CASES = [
    (1, "A", "Old", None, d(1)), (2, "A", " n/a ", "P1", d(2)), (3, "A", "New", "-", d(3)), (4, "A", "Old", "", d(3)), (5, "A", "Old", "P1", d(4)),
    (6, "B", None, " ", d(5)), (7, "B", "B1 ", None, d(6)), (8, "B", "B1", None, d(7)), (8, "B", "B1", None, d(7)), (9, None, "x", "y", d(1)), (10, "C", "x", "y", None),
    (12, "D", "late", None, d(1)), (11, "D", "early", None, d(1)), (13, "D", "b1", "Q", d(9)), (14, "D", "B1", "Q", d(10)),
]


def test_against_replay(spark):
    assert run(spark, CASES) == brute(CASES)


def test_random_snapshots_against_replay(spark):
    import random

    rng = random.Random(5)
    rows = [(i, rng.choice(["E1", "E2", "E3", None]), rng.choice(["a", "b", " a", "", None, "-"]), rng.choice(["p", "q", None]), rng.choice([d(1), d(2), d(3), d(4), None])) for i in range(300)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_intervals_per_attribute(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in CASES], SCHEMA)
    log = change_log(df, F.col("uei"), F.col("observed_on"), F.col("row_id"), {"name": non_blank("name")})
    got = {(r["value"], r["valid_from"], r["valid_to"]) for r in log.where("entity = 'D' and attribute = 'name'").collect()}
    assert got == {("late", d(1), d(9)), ("b1", d(9), d(10)), ("B1", d(10), None)}


def test_long_values(spark):
    long = "x" * 200_000
    assert run(spark, [(1, "A", long, None, d(1)), (2, "A", long + "y", None, d(2))])[1][1] == long + "y"
