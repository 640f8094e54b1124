"""Bounded views on a session, with all that was found kept as evidence."""

from __future__ import annotations

import json
import secrets
from collections.abc import Collection
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame

from sparkledger.operators import query as q
from sparkledger.plans.dataset import ProcurementSession, Selection
from sparkledger.plans.semantic_index import SemanticIndex

# What a view shows by default and at most.
BOUNDS = {"top_k": (10, 50), "aggregate": (10, 100), "cards": (10, 50), "traversal": (50, 200)}


def clamp(what: str, n: int | None) -> int:
    default, most = BOUNDS[what]
    if n is None:
        return default
    if n <= 0:
        raise ValueError(f"the {what} bound must be positive")
    return min(n, most)


def public(v: Any) -> Any:
    """A value as JSON has it: decimals and days as text, tuples as lists."""
    if isinstance(v, (Decimal, date, datetime)):
        return str(v)
    if isinstance(v, dict):
        return {k: public(x) for k, x in v.items()}
    return [public(x) for x in v] if isinstance(v, (list, tuple)) else v


class EvidenceSession:
    """Tools that show a bounded part and keep the selections, cards and hits behind it."""

    def __init__(self, session: ProcurementSession, index: SemanticIndex | None = None) -> None:
        self.session, self.index = session, index
        self.selections: dict[str, Selection] = {}
        self.cards: dict[str, dict] = {}
        self.hits: list[dict] = []
        self.totals: list[dict] = []
        self.traversals: list[dict] = []
        self._token = secrets.token_hex(4)

    def _keep(self, s: Selection) -> str:
        ref = f"sel_{self._token}_{len(self.selections) + 1:04d}"
        self.selections[ref] = s
        return ref

    def _of(self, ref: str) -> Selection:
        if ref not in self.selections:
            raise KeyError(f"no selection {ref}")
        return self.selections[ref]

    def _cards(self, ids: DataFrame) -> list[dict]:
        found = [public(r.asDict()) for r in q.cards(self.session.tables, ids).collect()]
        self.cards.update({c["award_id"]: c for c in found})
        return found

    def search(self, text: str, top_k: int | None = None, min_score: float | None = None, candidates: str | None = None) -> dict:
        k = clamp("top_k", top_k)
        if self.index is None:
            raise ValueError("there is no index")
        within = self._of(candidates).award_ids if candidates else None
        hits = [public(r.asDict()) for r in self.index.search(text, k, min_score, within).collect()]
        self.hits += [{"query": text, **h} for h in hits]
        s = self.session.select([h["award_id"] for h in hits])
        return {"selection": self._keep(s), "count": s.count, "hits": hits, **self.index.counts(within)}

    def resolve(self, preview: int | None = None, place: q.PlaceFilter | None = None, **ids: Collection[str] | None) -> dict:
        n = clamp("cards", preview)
        s = self.session.resolve(place, **ids)
        return {"selection": self._keep(s), "count": s.count, "preview": sorted(self._cards(q.first_ids(s.award_ids, n)), key=lambda c: c["award_id"])}

    def aggregate(self, ref: str, start: date, end: date, by: str = "award", limit: int | None = None) -> dict:
        n = clamp("aggregate", limit)
        rows = [public(r.asDict()) for r in self.session.activity(self._of(ref), start, end, by, n).collect()]
        self.totals += rows
        return {"rows": rows}

    def traverse(self, ref: str, include: Collection[str] | None = None, limit: int | None = None) -> dict:
        """The first entities in order, and whether there are more. All of them are kept as evidence, as a relation."""
        n = clamp("traversal", limit)
        entities = self.session.traverse(self._of(ref), include)
        rows = entities.limit(n + 1).collect()
        self.traversals.append({"selection": ref, "entities": entities})
        return {"entities": [public(r.asDict()) for r in rows[:n]], "truncated": len(rows) > n}

    def evidence(self, ref: str | None = None, award_ids: Collection[str] | None = None, limit: int | None = None) -> dict:
        """Cards in the order asked for; unknown awards are left out."""
        n = clamp("cards", limit)
        if (ref is None) == (award_ids is None):
            raise ValueError("give a selection or ids, not both")
        if ref is not None:
            return {"cards": sorted(self._cards(q.first_ids(self._of(ref).award_ids, n)), key=lambda c: c["award_id"])}
        wanted = list(dict.fromkeys(award_ids))
        if len(wanted) > BOUNDS["cards"][1]:
            raise ValueError("too many ids")
        found = {c["award_id"]: c for c in self._cards(q.select_ids(self.session.tables, wanted[:n]))}
        return {"cards": [found[i] for i in wanted[:n] if i in found]}

    def dumps(self, view: dict) -> str:
        return json.dumps(view, sort_keys=True)

    def close(self) -> None:
        self.session.close()
        for kept in (self.selections, self.cards, self.hits, self.totals, self.traversals):
            kept.clear()
