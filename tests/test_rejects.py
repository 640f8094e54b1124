from __future__ import annotations

import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkledger.operators.rejects import load_lines, load_table, split_record
from sparkledger.sources.columns import PROJECTED

BASE = dict.fromkeys(PROJECTED) | {"contract_transaction_unique_key": "T1", "contract_award_unique_key": "A1", "action_date": "2025-01-15"}


def raw(spark, rows):
    schema = ", ".join(f"{c} string" for c in PROJECTED) + ", _source_path string, _input_index int, _load_seq long, reason string, _key string"
    return spark.createDataFrame([tuple({**BASE, **r}[c] for c in PROJECTED) + ("f", 0, i, "clash", "clash") for i, r in enumerate(rows)], schema)


def reasons(found):
    out = {}
    for r in found.collect():
        out.setdefault(r["load_seq"], set()).add(r["reason"])
    return out


def test_reasons_and_loaded(spark):
    rows = [
        {}, {}, {"action_date": " 2025-01-15 "}, {"contract_transaction_unique_key": "T2"}, {"contract_transaction_unique_key": "T2", "action_type": "x"},
        {"contract_transaction_unique_key": " ", "action_date": "2025-02-30", "federal_action_obligation": "1e3"}, {"contract_transaction_unique_key": "T3", "federal_action_obligation": "+12.345"},
        {"contract_transaction_unique_key": "T4", "action_date": "2025-1-15"}, {"contract_transaction_unique_key": "T5", "total_dollars_obligated": "1" * 19}, {"contract_transaction_unique_key": "T2", "action_date": None},
        {"contract_transaction_unique_key": "T6", "action_date": "2025-01-15\n"}, {"contract_transaction_unique_key": "T7", "action_date": "0000-01-01"}, {"contract_transaction_unique_key": "T8", "action_type": "z" * 100_000},
    ]
    loaded, rest = load_table(raw(spark, rows))
    assert reasons(rest) == {
        3: {"identity_collision"}, 4: {"identity_collision"}, 5: {"missing_required:contract_transaction_unique_key", "malformed:action_date", "malformed:federal_action_obligation"},
        7: {"malformed:action_date"}, 8: {"malformed:total_dollars_obligated"}, 9: {"missing_required:action_date"}, 10: {"malformed:action_date"}, 11: {"malformed:action_date"},
    }
    got = {r["_load_seq"]: r for r in loaded.collect()}
    assert set(got) == {0, 1, 2, 6, 12} and str(got[6]["federal_action_obligation"]) == "12.35" and got[2]["action_date"].isoformat() == "2025-01-15"


def test_empty_table(spark):
    loaded, rest = load_table(raw(spark, []))
    assert loaded.count() == rest.count() == 0
    loaded, rest = load_lines(spark.createDataFrame([], "_source_path string, _input_index int, _load_seq long, record_text string"))
    assert loaded.count() == rest.count() == 0


def lines(spark, rows):
    return spark.createDataFrame([(p, 0, i, t, "x", "y") for i, (p, t) in enumerate(rows)], "_source_path string, _input_index int, _load_seq long, record_text string, _text string, reason string")


def test_lines(spark):
    some = ["action_date", "contract_award_unique_key", "extra", "contract_transaction_unique_key", "transaction_description"]
    rows = [("f", ",".join(some)), ("f", '2025-01-15,A,"x,y",T,"two\nlines ""q"""'), ("f", "2025-01-15,A,x,T"), ("f", '2025-01-15,A,3" hose,T,x'), ("f", '2025-01-15,A,"x",T,"x'),
            ("f", "2025-01-15,,x,,x"), ("f", None), ("f", ""), ("g", "contract_transaction_unique_key"), ("g", "T9"), ("f", '"a\\"b",1,2,3,4'), ("f", '"2025-01-15","A","","T2",""'), (None, "only"), (None, "a,b")]
    loaded, rest = load_lines(lines(spark, rows))
    got = {r["_load_seq"]: r for r in loaded.collect()}
    assert set(got) == {1, 11} and got[1]["transaction_description"] == 'two\nlines "q"' and got[11]["contract_transaction_unique_key"] == "T2" and got[11]["transaction_description"] is None
    key = "missing_required:contract_transaction_unique_key"
    award, day = "missing_required:contract_award_unique_key", "missing_required:action_date"
    assert reasons(rest) == {2: {"column_count"}, 3: {"broken_quoting"}, 4: {"broken_quoting"}, 5: {key, award}, 6: {"column_count"}, 7: {"column_count"}, 9: {award, day}, 10: {"broken_quoting"}, 13: {"column_count"}}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab,"\n \x1f\x1e', max_size=6), min_size=1, max_size=5))
def test_round_trip_of_written_records(record):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(record)
    assert split_record(out.getvalue()) == record


def strict_parse(text):
    """A character machine for RFC 4180; None if the quoting is broken."""
    out, i = [], 0
    while True:
        if i < len(text) and text[i] == '"':
            i, f = i + 1, ""
            while True:
                if i >= len(text):
                    return None
                if text[i] == '"':
                    if text[i + 1 : i + 2] == '"':
                        f, i = f + '"', i + 2
                        continue
                    i += 1
                    break
                f, i = f + text[i], i + 1
            if i < len(text) and text[i] != ",":
                return None
        else:
            j = text.find(",", i)
            f = text[i:] if j < 0 else text[i:j]
            if '"' in f:
                return None
            i += len(f)
        out.append(f)
        if i >= len(text):
            return out
        i += 1


@settings(max_examples=1000, deadline=None)
@given(st.text(alphabet='a,"', max_size=12))
def test_quoting_rule_against_a_character_machine(text):
    assert split_record(text) == strict_parse(text)


@pytest.mark.parametrize("n", [1, 50_000])
def test_very_long_record(spark, n):
    """Through Spark: the long field is a projected one, and one that breaks at its very end is rejected."""
    head = "contract_transaction_unique_key,contract_award_unique_key,action_date,transaction_description"
    loaded, rest = load_lines(lines(spark, [("f", head), ("f", 'T,A,2025-01-15,"' + 'x""' * n + '"'), ("f", 'T,A,2025-01-15,"' + 'x""' * n + '"x')]))
    assert [r["transaction_description"] for r in loaded.collect()] == ['x"' * n] and reasons(rest) == {2: {"broken_quoting"}}


def test_records_are_split_once(spark):
    """No function of the plan splits a text; the scanner stands once in the load, twice in the diagnosis."""
    loaded, rest = load_lines(lines(spark, [("f", "a"), ("f", "b")]))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan(loaded).replace("split(_", "") and plan(loaded).count("MapInArrow") == 1 and plan(rest).count("MapInArrow") == 2
