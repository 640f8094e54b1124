"""Downloads of a period in shards that the service accepts, resumable."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from sparkledger.plans.materialize import Materialized, materialize
from sparkledger.sources.remote import Downloads, JobFailed, TransientError

#: Records that the service gives in one file at most.
ROW_CAP = 500_000


class ShardTooLarge(RuntimeError):
    """A single day holds more than a file can."""


@dataclass(frozen=True, order=True)
class Shard:
    """A part of the period, both days included, and the records expected in it."""

    start: date
    end: date
    expected: int = 0

    @property
    def name(self) -> str:
        return f"{self.start}_{self.end}"

    def halves(self) -> tuple[Shard, Shard]:
        if self.start >= self.end:
            raise ValueError("a single day has no halves")
        middle = self.start + timedelta(days=(self.end - self.start).days // 2)
        return Shard(self.start, middle), Shard(middle + timedelta(days=1), self.end)


def plan_shards(service: Downloads, start: date, end: date, cap: int = ROW_CAP) -> list[Shard]:
    """Shards of at most ``cap`` records in the order of their days; days without records are left out.

    A period that is too large, or too large to be counted, is halved.
    """
    if cap < 1:
        raise ValueError("the cap must be positive")
    if start > end:
        raise ValueError("the period ends before it starts")
    whole = Shard(start, end)
    try:
        n = service.count(start, end)
    except TransientError:
        if start == end:
            raise
        n = None
    if n is not None and n < 0:
        raise ValueError(f"a count of {n}")
    if n == 0:
        return []
    if n is not None and n <= cap:
        return [Shard(start, end, n)]
    if start == end:
        raise ShardTooLarge(f"{start} has {n} records, more than {cap}")
    return [s for half in whole.halves() for s in plan_shards(service, half.start, half.end, cap)]


def write_json(path: Path, value: Mapping[str, Any]) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    tmp = path.with_name(path.name + ".tmp")
    tmp.write_text(json.dumps(value, indent=2, sort_keys=True))
    os.replace(tmp, path)


def digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def complete(csv: Path, manifest: Path) -> bool:
    """True if the file is there and is the one that its manifest describes."""
    try:
        return csv.is_file() and json.loads(manifest.read_text())["sha256"] == digest(csv)
    except (OSError, ValueError, KeyError):
        return False


def ingest(spark: SparkSession, service: Downloads, start: date, end: date, root: str | Path, load: bool = True, allow_rejects: bool = False, cap: int = ROW_CAP) -> Materialized | None:
    """Download a period and, unless told not to, build and publish a set of it.

    The plan, with filters, counts and checksums by shard, and a manifest per
    shard are kept under ``root``/ingest on this machine, so that a
    run that broke off goes on with what is missing. A shard of several days
    whose download fails is halved. The job counts as materialized only if the
    set was published. Without any record there is nothing to build: None.
    """
    job = Path(root) / "ingest" / f"{start}_{end}"
    plan = job / "job.json"
    if plan.is_file():
        shards = [Shard(date.fromisoformat(a), date.fromisoformat(b), n) for a, b, n in json.loads(plan.read_text())["shards"]]
    else:
        shards = plan_shards(service, start, end, cap)

    filters = getattr(service, "filters", None)
    told = {"filters": filters(start, end)} if callable(filters) else {}
    got: dict[str, dict[str, Any]] = {}

    def note(status: str, run: str | None = None) -> None:
        counts = {"shards": len(shards), "complete": len(got), "expected": sum(s.expected or 0 for s in shards), "rows": sum(m["rows"] for m in got.values())}
        files = {name: {k: m.get(k) for k in ("rows", "sha256", "source")} for name, m in sorted(got.items())}
        write_json(plan, {"status": status, "run_id": run, **told, "counts": counts, "files": files, "shards": [[str(s.start), str(s.end), s.expected] for s in sorted(shards)]})

    note("downloading")
    files, todo = [], list(shards)
    while todo:
        s = todo.pop(0)
        csv, manifest = job / "shards" / f"{s.name}.csv", job / "shards" / f"{s.name}.json"
        if not complete(csv, manifest):
            csv.unlink(missing_ok=True)
            manifest.unlink(missing_ok=True)
            try:
                rows = service.fetch(s.start, s.end, csv)
            except JobFailed:
                if s.start == s.end:
                    raise
                parts = [p for half in s.halves() for p in plan_shards(service, half.start, half.end, cap)]
                shards[:] = [x for x in shards if x != s] + parts
                note("downloading")
                todo[:0] = parts
                continue
            write_json(manifest, {"start": str(s.start), "end": str(s.end), "expected": s.expected, "rows": rows, "sha256": digest(csv), "bytes": csv.stat().st_size, "source": getattr(service, "base", None), "retrieved_at": datetime.now(UTC).isoformat()})
        got[s.name] = json.loads(manifest.read_text())
        files.append(csv)
    note("acquired")
    if not load or not files:
        return None
    done = materialize(spark, sorted(files), root, allow_rejects)
    note("materialized" if done.published else "acquired", done.run_id)
    return done
