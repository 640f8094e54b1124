"""Planning, resuming, fetching and bounds, with a scripted service; no network."""

from __future__ import annotations

import csv
import io
import json
import urllib.error
import zipfile
from datetime import date, timedelta

import pytest

from sparkledger.plans.enrichment import award_fields, cached
from sparkledger.plans.evidence import clamp, public
from sparkledger.plans.ingest import Shard, ShardTooLarge, complete, ingest, plan_shards
from sparkledger.sources.columns import PROJECTED
from sparkledger.sources.remote import HttpService, JobFailed, RemoteError, TransientError

D = date(2025, 1, 1)


class Scripted:
    """One record a day unless told otherwise; fails where told."""

    def __init__(self, per_day=1, busy=(), fails=()):
        self.per_day, self.busy, self.fails, self.fetched = per_day, set(busy), set(fails), []

    def count(self, start, end):
        if (start, end) in self.busy:
            raise TransientError("busy")
        return self.per_day * ((end - start).days + 1)

    def fetch(self, start, end, target):
        self.fetched.append((start, end))
        if (start, end) in self.fails:
            raise JobFailed("failed")
        target.parent.mkdir(parents=True, exist_ok=True)
        with target.open("w", newline="") as f:
            csv.writer(f).writerow(PROJECTED)
        return 0


def test_plan_covers_the_period_once():
    shards = plan_shards(Scripted(10), D, D + timedelta(days=30), cap=45)
    days = [s.start + timedelta(days=i) for s in shards for i in range((s.end - s.start).days + 1)]
    assert days == [D + timedelta(days=i) for i in range(31)] and all(s.expected <= 45 for s in shards)
    assert plan_shards(Scripted(0), D, D) == []
    end = D + timedelta(days=3)
    assert [s.name for s in plan_shards(Scripted(busy=[(D, end)]), D, end)] == ["2025-01-01_2025-01-02", "2025-01-03_2025-01-04"]
    with pytest.raises(ShardTooLarge):
        plan_shards(Scripted(9), D, D + timedelta(days=1), cap=5)
    with pytest.raises(TransientError):
        plan_shards(Scripted(busy=[(D, D)]), D, D)
    for bad in ((D, D - timedelta(days=1), 1), (D, D, 0)):
        with pytest.raises(ValueError):
            plan_shards(Scripted(), *bad)
    with pytest.raises(ValueError):
        Shard(D, D).halves()


def test_resume_and_halving(tmp_path):
    end = D + timedelta(days=3)
    service = Scripted(fails=[(D, end)])
    assert ingest(None, service, D, end, tmp_path, load=False) is None
    assert len(service.fetched) == 3
    again = Scripted()
    ingest(None, again, D, end, tmp_path, load=False)
    assert again.fetched == []
    shard = next((tmp_path / "ingest").rglob("*.csv"))
    assert complete(shard, shard.with_suffix(".json"))
    shard.write_text("spoilt")
    ingest(None, again, D, end, tmp_path, load=False)
    assert len(again.fetched) == 1


class Reply(io.BytesIO):
    def __enter__(self):
        return self


def service(replies):
    """An HTTP service that gives the replies in turn: bytes, objects as JSON, or status codes."""
    waits, replies = [], list(replies)

    def opener(request, timeout):
        r = replies.pop(0)
        if isinstance(r, int):
            raise urllib.error.HTTPError(request.full_url, r, "x", {}, None)
        return Reply(r if isinstance(r, bytes) else json.dumps(r).encode())

    return HttpService("http://service.invalid", lambda a, b: {"from": str(a), "to": str(b)}, sleep=waits.append, opener=opener), waits


def archive(name="x_PrimeTransactions_1.csv", columns=PROJECTED, rows=2):
    text = io.StringIO()
    csv.writer(text).writerows([columns, *[["v"] * len(columns)] * rows])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, "﻿" + text.getvalue())
    return out.getvalue()


def test_http(tmp_path):
    s, waits = service([503, {"calculated_count": 7}])
    assert s.count(D, D) == 7 and waits == [2.0]
    with pytest.raises(TransientError):
        service([504] * 5)[0].count(D, D)
    def down(request, timeout):
        raise urllib.error.URLError("no route")

    with pytest.raises(RemoteError) as e:  # an outage is no reason to ask for less
        HttpService("http://service.invalid", lambda a, b: {}, sleep=lambda _: None, opener=down).count(D, D)
    assert not isinstance(e.value, TransientError)
    for bad in ([404], [{"calculated_count": True}], [b"no json"], [[1]]):
        with pytest.raises(RemoteError):
            service(bad)[0].count(D, D)
    job = [{"file_name": "f"}, {"status": "running"}, {"status": "finished", "file_url": "http://service.invalid/f.zip"}]
    s, _ = service([*job[:1], {"status": "failed"}, *job, archive()])
    assert s.fetch(D, D, tmp_path / "a" / "f.csv") == 2 and [p.name for p in (tmp_path / "a").iterdir()] == ["f.csv"]
    for spoilt in (archive("other.csv"), archive(columns=PROJECTED[1:])):
        with pytest.raises(RemoteError):
            service([*job, spoilt])[0].fetch(D, D, tmp_path / "b.csv")
    with pytest.raises(JobFailed):
        service([*job[:1], {"status": "error"}] * 3)[0].fetch(D, D, tmp_path / "c.csv")


def test_details_have_their_own_patience():
    s, waits = service([503] * 3 + [{"id": 1}, 404, {"id": 3}])
    got = dict(s.details(["a", "b", "a", "c"]))
    assert got["a"] == {"id": 1} and got["c"] == {"id": 3} and isinstance(got["b"], RemoteError) and len(waits) == 3
    with pytest.raises(TransientError):
        service([503] * 4)[0].detail("a")


def test_bounds_and_values(tmp_path):
    assert clamp("top_k", None) == 10 and clamp("top_k", 999) == 50
    with pytest.raises(ValueError):
        clamp("cards", 0)
    assert public({"d": D, "t": (1, None)}) == {"d": "2025-01-01", "t": [1, None]}
    assert award_fields({"total_obligation": 1e6, "base_exercised_options": True, "date_signed": "2024-02-03T00:00"}) == {"total_obligation": "1000000.0", "current_value": None, "potential_value": None, "date_signed": "2024-02-03"}
    p = tmp_path / "x.json"
    assert cached(p, "A") is None
    p.write_text('{"source_id": "B"}')
    assert cached(p, "A") is None and cached(p, "B") == {"source_id": "B"}
