"""A read-only session on one published set."""

from __future__ import annotations

import secrets
from collections.abc import Collection
from dataclasses import dataclass
from datetime import date
from typing import Self

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from sparkledger.operators import query as q
from sparkledger.sources.files import SharedPath, shared
from sparkledger.sources.published import open_set


class StaleSelection(RuntimeError):
    """The selection belongs to another session, or this one is closed."""


@dataclass(frozen=True)
class Selection:
    """A set of awards held by a session."""

    award_ids: DataFrame
    count: int
    session_id: str


class ProcurementSession:
    """Pinned to the set that CURRENT named when it was opened."""

    def __init__(self, run_id: str, tables: dict[str, DataFrame], root: SharedPath) -> None:
        self.run_id, self.tables, self.root = run_id, tables, root
        self.session_id = secrets.token_hex(8)
        self._held: list[DataFrame] = []
        self._open = True

    @classmethod
    def open(cls, spark: SparkSession, root: str | SharedPath) -> Self:
        return cls(*open_set(spark, root), shared(spark, root))

    def __enter__(self) -> Self:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        for df in self._held:
            df.unpersist()
        self._held, self._open = [], False

    def _alive(self) -> None:
        if not self._open:
            raise StaleSelection("the session is closed")

    def _own(self, s: Selection) -> DataFrame:
        self._alive()
        if s.session_id != self.session_id:
            raise StaleSelection("the selection is of another session")
        return s.award_ids

    @staticmethod
    def _none_of(s: Selection, found: DataFrame) -> DataFrame:
        """An empty selection has nothing behind it: the plan is an empty relation, and no job runs."""
        return found if s.count else found.limit(0)

    def _hold(self, ids: DataFrame) -> Selection:
        ids = ids.persist(StorageLevel.MEMORY_AND_DISK)
        self._held.append(ids)
        return Selection(ids, ids.count(), self.session_id)

    def resolve(self, place: q.PlaceFilter | None = None, **ids: Collection[str] | None) -> Selection:
        self._alive()
        return self._hold(q.resolve(self.tables, place, **ids))

    def select(self, award_ids: Collection[str]) -> Selection:
        self._alive()
        return self._hold(q.select_ids(self.tables, award_ids))

    def award_ids(self, s: Selection) -> frozenset[str]:
        return frozenset(r[0] for r in self._own(s).collect())

    def activity(self, s: Selection, start: date, end: date, by: str = "award", limit: int | None = None) -> DataFrame:
        if by not in ("award", "recipient"):
            raise ValueError(f"activity is by award or recipient, not {by}")
        return self._none_of(s, (q.activity_by_award if by == "award" else q.activity_by_recipient)(self.tables, self._own(s), start, end, limit))

    def traverse(self, s: Selection, include: Collection[str] | None = None) -> DataFrame:
        return self._none_of(s, q.traverse(self.tables, self._own(s), include))

    def cards(self, s: Selection) -> DataFrame:
        return self._none_of(s, q.cards(self.tables, self._own(s)))
