from __future__ import annotations

import json
from datetime import date

import pytest

from sparkledger.plans.dialogue import SUBMIT, TOOLS, Call, Dialogue, Message, ScriptedModel, cited, observe


class Evidence:
    """Stands in for a session: keeps what it is asked and gives cards."""

    def __init__(self):
        self.cards, self.asked, self.closed = {}, [], False

    def resolve(self, preview, place, **ids):
        self.asked.append(("resolve", preview, place, ids))
        self.cards["A1"] = {"award_id": "A1"}
        return {"selection": "sel_1", "count": 1}

    def aggregate(self, *a):
        self.asked.append(("aggregate", *a))
        return {"rows": []}

    def traverse(self, *a):
        raise KeyError("no selection")

    def close(self):
        self.closed = True


def call(name, **arguments):
    return Call(f"id_{name}", name, arguments)


def says(*calls, text=""):
    return Message("assistant", text, calls)


SUBMITS = says(call(SUBMIT, answer=" done ", citation_award_ids=["A1", "NO", "A1"]))


def ask(*replies, **budget):
    e, m = Evidence(), ScriptedModel(replies)
    return Dialogue(e, m, **budget).ask(" who? "), e, m


def test_evidence_then_answer():
    a, e, m = ask(says(call("resolve_awards", filters={"recipient_ids": ["U1"], "location": {"role": "recipient", "state_code": "VA"}}, preview_limit=3)), SUBMITS)
    assert (a.text, a.ended, a.rounds, a.calls) == ("done", "answered", 2, 1) and a.citations == [{"award_id": "A1"}] and a.dropped == ["NO"]
    (_, preview, place, ids), = e.asked
    assert preview == 3 and ids == {"recipient_ids": ["U1"]} and (place.role, place.state_code) == ("recipient", "VA")
    assert [t["name"] for t in a.trace] == ["resolve_awards", SUBMIT] and all(t["ok"] for t in a.trace)
    conversation, tools, must = m.asked[1]
    assert [x.role for x in conversation] == ["user", "assistant", "tool"] and conversation[0].content == "who?" and must is None and set(tools) == {*TOOLS, SUBMIT}
    assert json.loads(conversation[2].content)["result"]["selection"] == "sel_1" and conversation[2].call_id == "id_resolve_awards"
    json.dumps(a.as_dict())


def test_errors_come_back_as_observations():
    e = Evidence()
    for c in (call("nothing"), call("traverse_relationships", selection="x"), call("traverse_relationships"), call("resolve_awards", filters={"no": ["x"]}), call("resolve_awards", preview_limit="3"), call("resolve_awards", preview_limit=True),
              call("aggregate_activity", selection="s", window={"from_date": "2025-13-01", "to_date": "2025-01-01"}), call("aggregate_activity", selection="s", window={"from_date": "2025-01-01"}), call("traverse_relationships", selection="s", include=["planet"]),
              call("resolve_awards", filters={"location": {"state_code": "VA"}}), call("resolve_awards", filters=[]), call(SUBMIT, answer="  ", citation_award_ids=[]), call(SUBMIT, answer="x"), call(SUBMIT, answer="x", citation_award_ids="A1")):
        seen = observe(e, c)
        assert seen["ok"] is False and seen["error"] and seen["detail"], c
    assert observe(e, call("aggregate_activity", selection="s", window={"from_date": "2025-01-01", "to_date": "2025-02-01"}, group_by="recipient", limit=None))["ok"]
    assert e.asked == [("aggregate", "s", date(2025, 1, 1), date(2025, 2, 1), "recipient", None)]


def test_budgets_end_in_one_forced_turn():
    tool = call("resolve_awards")
    a, e, m = ask(says(tool, tool, tool), SUBMITS, calls=2)
    assert a.ended == "budget_exhausted" and (a.rounds, a.calls) == (2, 2) and len(e.asked) == 2 and [t["ok"] for t in a.trace] == [True, True, False, True]
    assert m.asked[-1][1:] == ((SUBMIT,), SUBMIT)
    a, _, m = ask(says(tool), says(tool), SUBMITS, rounds=2)
    assert a.ended == "budget_exhausted" and a.rounds == 3 and len(m.asked) == 3
    a, _, _ = ask(says(tool), says(tool), rounds=1)
    assert a.ended == "error" and a.text and a.citations == []


def test_talk_without_tools_and_refused_answers_go_on():
    a, _, m = ask(says(text="hm"), says(call(SUBMIT, answer="", citation_award_ids=[])), SUBMITS)
    assert a.ended == "answered" and a.dropped == ["A1", "NO"] and [x.role for x in m.asked[1][0]][-1] == "user"


def test_errors_of_the_model_end_it():
    a, _, _ = ask(says(call("resolve_awards")), RuntimeError("gone"))
    assert a.ended == "error" and "gone" in a.text and len(a.trace) == 1
    a, _, _ = ask()
    assert a.ended == "error"
    with pytest.raises(ValueError):
        Dialogue(Evidence(), ScriptedModel([])).ask("  ")
    with pytest.raises(ValueError):
        Dialogue(Evidence(), ScriptedModel([]), rounds=0)
    d = Dialogue(Evidence(), ScriptedModel([]), rounds=99, calls=99)
    assert (d.rounds, d.calls) == (10, 24)
    d.close()
    assert d.model.closed and d.evidence.closed
    with pytest.raises(RuntimeError):
        d.model.complete([], [])


def test_citations():
    assert cited(["b", "x", "b", "a"], {"a": {"n": 1}, "b": {"n": 2}}) == ([{"n": 2}, {"n": 1}], ["x"])


def test_command_line(tmp_path, capsys):
    from sparkledger.cli import main, plugged

    (tmp_path / "enrichment" / "awards").mkdir(parents=True)
    (tmp_path / "enrichment" / "awards" / "A.json").write_text("{}")
    assert main(["clear-test-cache", "--root", str(tmp_path)]) == 0 and json.loads(capsys.readouterr().out) == {"removed": 1} and not (tmp_path / "enrichment").exists()
    assert plugged("builtins:dict") == {}
    for bad in ("builtins", "no_such_module_x:f", "builtins:no_such"):
        with pytest.raises(ValueError):
            plugged(bad)
