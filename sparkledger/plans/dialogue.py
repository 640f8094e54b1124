"""Answering a question with a language model that works through evidence tools.

The model is a plug. It sees the conversation and the tools, asks for calls or
says something, and ends with submit_answer; whatever goes wrong in a call comes
back to it as an observation. Rounds and calls are bounded: when they are used
up it gets one last turn in which it can only submit.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from datetime import date
from typing import Any, Protocol

from sparkledger.operators.query import ENTITY_KINDS, FILTERS, PLACE_COLUMNS, PLACE_FIELDS, PlaceFilter
from sparkledger.plans.evidence import EvidenceSession

# Rounds and tool calls by default and at most, and the tool that ends a dialogue.
ROUNDS, CALLS = (6, 10), (12, 24)
SUBMIT = "submit_answer"


@dataclass(frozen=True)
class Call:
    """A tool call that the model asks for."""

    id: str
    name: str
    arguments: Mapping[str, Any]


@dataclass(frozen=True)
class Message:
    """An entry of the conversation: role is user, assistant or tool."""

    role: str
    content: str
    calls: tuple[Call, ...] = ()
    call_id: str | None = None


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    parameters: Mapping[str, Any]


class Model(Protocol):
    """``must`` names the one tool that the turn has to call, if any."""

    def complete(self, conversation: Sequence[Message], tools: Sequence[Tool], must: str | None = None) -> Message: ...

    def close(self) -> None: ...


class ScriptedModel:
    """Gives prepared replies in turn, an exception among them is raised; keeps what it was asked."""

    def __init__(self, replies: Sequence[Message | Exception]) -> None:
        self.replies = list(replies)
        self.asked: list[tuple[tuple[Message, ...], tuple[str, ...], str | None]] = []
        self.closed = False

    def complete(self, conversation: Sequence[Message], tools: Sequence[Tool], must: str | None = None) -> Message:
        if self.closed:
            raise RuntimeError("the model is closed")
        self.asked.append((tuple(conversation), tuple(t.name for t in tools), must))
        if not self.replies:
            raise RuntimeError("the script is at its end")
        reply = self.replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply

    def close(self) -> None:
        self.closed = True


@dataclass
class Answer:
    """What came out: ended is answered, budget_exhausted or error."""

    text: str
    ended: str
    citations: list[dict] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    rounds: int = 0
    calls: int = 0
    trace: list[dict] = field(default_factory=list)

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


def cited(ids: Sequence[str], cards: Mapping[str, dict]) -> tuple[list[dict], list[str]]:
    """The cards of the ids that were seen as evidence, each once in their order, and the ids that never were."""
    wanted = list(dict.fromkeys(ids))
    return [cards[i] for i in wanted if i in cards], [i for i in wanted if i not in cards]


# --- arguments, each read by a function that refuses what isn't of its kind ---


def _text(v: Any) -> str:
    if not isinstance(v, str) or not v.strip():
        raise ValueError("must be text that isn't blank")
    return v.strip()


def _whole(v: Any) -> int:
    if isinstance(v, bool) or not isinstance(v, int):
        raise ValueError("must be a whole number")
    return v


def _number(v: Any) -> float:
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise ValueError("must be a number")
    return float(v)


def _texts(v: Any) -> list[str]:
    if not isinstance(v, (list, tuple)) or not all(isinstance(x, str) for x in v):
        raise ValueError("must be a list of texts")
    return [x for x in map(str.strip, v) if x]


def _one_of(*allowed: str) -> Callable[[Any], str]:
    def read(v: Any) -> str:
        if v not in allowed:
            raise ValueError(f"must be one of {', '.join(allowed)}")
        return v

    return read


def _kinds(v: Any) -> list[str]:
    return [_one_of(*ENTITY_KINDS)(x) for x in _texts(v)]


def _fields(given: Any, readers: Mapping[str, Callable[[Any], Any]], required: Sequence[str] = ()) -> dict[str, Any]:
    """The named values of an object; null is as good as absent, an unknown name an error."""
    if not isinstance(given, Mapping):
        raise ValueError("must be an object")
    if unknown := sorted(set(given) - set(readers)):
        raise ValueError(f"unknown: {', '.join(unknown)}")
    out = {}
    for name, read in readers.items():
        if given.get(name) is None:
            if name in required:
                raise ValueError(f"{name} is required")
            continue
        try:
            out[name] = read(given[name])
        except ValueError as e:
            raise ValueError(f"{name}: {e}") from e
    return out


def _place(v: Any) -> PlaceFilter:
    return PlaceFilter(**_fields(v, {"role": _one_of(*PLACE_COLUMNS), "location_ids": _texts, **dict.fromkeys(PLACE_FIELDS, _text)}, ["role"]))


def _window(v: Any) -> tuple[date, date]:
    day = lambda x: date.fromisoformat(_text(x))
    w = _fields(v, {"from_date": day, "to_date": day}, ["from_date", "to_date"])
    return w["from_date"], w["to_date"]


def _filters(v: Any) -> dict[str, Any]:
    return _fields(v, {**dict.fromkeys(FILTERS, _texts), "location": _place})


# --- the tools ---


def _search(e: EvidenceSession, a: dict) -> dict:
    return e.search(a["query"], a.get("top_k"), a.get("min_score"), a.get("candidates"))


def _resolve(e: EvidenceSession, a: dict) -> dict:
    filters = dict(a.get("filters", {}))
    return e.resolve(a.get("preview_limit"), filters.pop("location", None), **filters)


def _aggregate(e: EvidenceSession, a: dict) -> dict:
    return e.aggregate(a["selection"], *a["window"], a.get("group_by", "award"), a.get("limit"))


def _traverse(e: EvidenceSession, a: dict) -> dict:
    return e.traverse(a["selection"], a.get("include"), a.get("limit"))


def _evidence(e: EvidenceSession, a: dict) -> dict:
    return e.evidence(a.get("selection"), a.get("award_ids"), a.get("limit"))


_T, _N, _L = {"type": "string"}, {"type": "integer"}, {"type": "array", "items": {"type": "string"}}
_PLACE = {"type": "object", "properties": {"role": {"type": "string", "enum": list(PLACE_COLUMNS)}, "location_ids": _L, **dict.fromkeys(PLACE_FIELDS, _T)}, "required": ["role"]}


def _tool(name: str, description: str, properties: Mapping[str, Any], required: Sequence[str] = ()) -> Tool:
    return Tool(name, description, {"type": "object", "properties": dict(properties), "required": list(required)})


#: Tool, what reads its arguments, and what runs it.
TOOLS: dict[str, tuple[Tool, Mapping[str, Callable[[Any], Any]], Callable[[EvidenceSession, dict], dict]]] = {
    t.name: (t, readers, run)
    for t, readers, run in (
        (_tool("search_contract_work", "Awards whose work is most like a text", {"query": _T, "top_k": _N, "min_score": {"type": "number"}, "candidates": _T}, ["query"]), {"query": _text, "top_k": _whole, "min_score": _number, "candidates": _text}, _search),
        (_tool("resolve_awards", "Awards that pass every filter", {"filters": {"type": "object", "properties": {**dict.fromkeys(FILTERS, _L), "location": _PLACE}}, "preview_limit": _N}), {"filters": _filters, "preview_limit": _whole}, _resolve),
        (_tool("aggregate_activity", "Obligations of a selection in a period, ranked", {"selection": _T, "window": {"type": "object", "properties": {"from_date": _T, "to_date": _T}, "required": ["from_date", "to_date"]}, "group_by": {"type": "string", "enum": ["award", "recipient"]}, "limit": _N}, ["selection", "window"]), {"selection": _text, "window": _window, "group_by": _one_of("award", "recipient"), "limit": _whole}, _aggregate),
        (_tool("traverse_relationships", "What the awards of a selection lead to", {"selection": _T, "include": {"type": "array", "items": {"type": "string", "enum": list(ENTITY_KINDS)}}, "limit": _N}, ["selection"]), {"selection": _text, "include": _kinds, "limit": _whole}, _traverse),
        (_tool("get_award_evidence", "Cards of awards, which can then be cited", {"selection": _T, "award_ids": _L, "limit": _N}), {"selection": _text, "award_ids": _texts, "limit": _whole}, _evidence),
    )
}
SUBMIT_TOOL = _tool(SUBMIT, "The final answer, with the awards that it rests on", {"answer": _T, "citation_award_ids": _L}, ["answer", "citation_award_ids"])


def observe(evidence: EvidenceSession, call: Call) -> dict[str, Any]:
    """What a call gives: ok with its result, or not ok with the error. Nothing that a model asks for raises."""
    try:
        if call.name == SUBMIT:
            a = _fields(call.arguments, {"answer": _text, "citation_award_ids": _texts}, ["answer", "citation_award_ids"])
            cards, dropped = cited(a["citation_award_ids"], evidence.cards)
            return {"ok": True, "answer": a["answer"], "citations": cards, "dropped": dropped}
        if call.name not in TOOLS:
            raise LookupError(f"no tool {call.name}; there are {', '.join([*TOOLS, SUBMIT])}")
        tool, readers, run = TOOLS[call.name]
        return {"ok": True, "result": run(evidence, _fields(call.arguments, readers, tool.parameters["required"]))}
    except (ValueError, TypeError, LookupError, RuntimeError) as e:
        return {"ok": False, "error": type(e).__name__, "detail": str(e)}


class Dialogue:
    """One question worked through with a model over an evidence session."""

    def __init__(self, evidence: EvidenceSession, model: Model, rounds: int = ROUNDS[0], calls: int = CALLS[0]) -> None:
        if rounds <= 0 or calls <= 0:
            raise ValueError("rounds and calls must be positive")
        self.evidence, self.model = evidence, model
        self.rounds, self.calls = min(rounds, ROUNDS[1]), min(calls, CALLS[1])

    def ask(self, question: str) -> Answer:
        """The answer; errors of the model or of the session end it as such, with what was done until then."""
        if not question.strip():
            raise ValueError("the question is blank")
        said = [Message("user", question.strip())]
        state = Answer("", "error")
        try:
            while state.rounds < self.rounds and state.calls < self.calls:
                if self._turn(said, state, None):
                    state.ended = "answered"
                    return state
            said.append(Message("user", "Your rounds or tool calls are used up. Call submit_answer now with what you have."))
            if self._turn(said, state, SUBMIT):
                state.ended = "budget_exhausted"
            else:
                state.text = "The budget was used up and no usable answer was submitted."
        except Exception as e:  # noqa: BLE001
            state.text = f"Stopped before an answer: {type(e).__name__}: {e}"
        return state

    def _turn(self, said: list[Message], state: Answer, must: str | None) -> bool:
        """One reply of the model and its calls in order; True once an answer was accepted."""
        tools = [SUBMIT_TOOL] if must else [*(t for t, _, _ in TOOLS.values()), SUBMIT_TOOL]
        reply = self.model.complete(said, tools, must)
        state.rounds += 1
        said.append(Message("assistant", reply.content, reply.calls))
        if not reply.calls and not must:
            said.append(Message("user", "Use a tool, or call submit_answer to finish."))
        for call in reply.calls:
            if must and call.name != must:
                continue
            counted = call.name in TOOLS
            if counted and state.calls >= self.calls:
                seen = {"ok": False, "error": "BudgetExhausted", "detail": "no tool calls are left; call submit_answer"}
            else:
                seen = observe(self.evidence, call)
                state.calls += counted
            state.trace.append({"round": state.rounds, "name": call.name, "arguments": dict(call.arguments), "ok": seen["ok"], "observation": seen})
            said.append(Message("tool", json.dumps(seen, ensure_ascii=False, default=str), call_id=call.id))
            if call.name == SUBMIT and seen["ok"]:
                state.text, state.citations, state.dropped = seen["answer"], seen["citations"], seen["dropped"]
                return True
        return False

    def close(self) -> None:
        self.model.close()
        self.evidence.close()
