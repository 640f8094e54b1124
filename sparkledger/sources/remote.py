"""A remote service of transaction files and award details, over plain HTTP."""

from __future__ import annotations

import csv
import json
import shutil
import tempfile
import time
import urllib.error
import urllib.request
import zipfile
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, replace
from datetime import date
from pathlib import Path
from typing import Any, BinaryIO, Protocol

from sparkledger.sources.columns import PROJECTED
from sparkledger.sources.projected import header, require_columns


class RemoteError(RuntimeError):
    """The service answered with something that can't be used."""


class TransientError(RemoteError):
    """The service was too busy; a smaller request may succeed."""


class JobFailed(RemoteError):
    """A download was accepted and then failed."""


class Downloads(Protocol):
    """What the ingest needs of the service."""

    def count(self, start: date, end: date) -> int: ...

    def fetch(self, start: date, end: date, target: Path) -> int: ...


class Details(Protocol):
    def detail(self, source_id: str) -> dict[str, Any]: ...


# Answers that say that the service is too busy.
BUSY = {502, 503, 504}
#: Seconds of rest before a failed job is put again, times the jobs so far.
REST = 5.0


@dataclass
class HttpService:
    """Counts, file downloads and details of the service at ``base``.

    A call is tried ``tries`` times with growing pauses; a busy answer that
    persists is transient, any other is an error at once. A download is a job:
    asked for, polled, fetched and unpacked, and asked for again if it fails.
    """

    base: str
    filters: Callable[[date, date], Mapping[str, Any]]
    tries: int = 5
    jobs: int = 3
    polls: int = 300
    pause: float = 2.0
    timeout: float = 180.0
    detail_tries: int = 4
    detail_timeout: float = 60.0
    sleep: Callable[[float], None] = time.sleep
    opener: Callable[..., Any] = urllib.request.urlopen

    def _open(self, url: str, body: Mapping[str, Any] | None = None) -> Any:
        data = None if body is None else json.dumps(body).encode()
        for attempt in range(1, self.tries + 1):
            try:
                return self.opener(urllib.request.Request(url, data=data, headers={"Content-Type": "application/json"}), timeout=self.timeout)
            except urllib.error.HTTPError as e:
                if e.code not in BUSY:
                    raise RemoteError(f"{url}: status {e.code}") from e
                last: Exception = e
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                last = e
            if attempt < self.tries:
                self.sleep(self.pause * attempt)
        # only a service that says it is too busy is asked for less; an outage is not
        raise (TransientError if isinstance(last, urllib.error.HTTPError) else RemoteError)(f"{url}: {last}") from last

    def _json(self, url: str, body: Mapping[str, Any] | None = None) -> dict[str, Any]:
        with self._open(url, body) as r:
            try:
                out = json.loads(r.read())
            except ValueError as e:
                raise RemoteError(f"{url}: no JSON") from e
        if not isinstance(out, dict):
            raise RemoteError(f"{url}: not an object")
        return out

    def count(self, start: date, end: date) -> int:
        said = self._json(f"{self.base}/download/count/", {"filters": self.filters(start, end)})
        for key in ("calculated_transaction_count", "calculated_count"):
            if isinstance(said.get(key), (int, float)) and not isinstance(said[key], bool):
                return int(said[key])
        raise RemoteError("the count is missing")

    def fetch(self, start: date, end: date, target: Path) -> int:
        """Records written to ``target``; a job that fails is put again, after a longer rest each time."""
        target.parent.mkdir(parents=True, exist_ok=True)
        for left in reversed(range(self.jobs)):
            try:
                with tempfile.TemporaryFile(dir=target.parent) as packed:
                    with self._open(self._product(start, end)) as r:
                        shutil.copyfileobj(r, packed)
                    return unpack(packed, target)
            except JobFailed:
                if not left:
                    raise
                self.sleep(REST * (self.jobs - left))
        raise ValueError("at least one job must be allowed")

    def _product(self, start: date, end: date) -> str:
        """Put a job and follow it to the address of its file."""
        job = self._json(f"{self.base}/download/transactions/", {"filters": self.filters(start, end), "columns": list(PROJECTED), "file_format": "csv"})
        if not (name := job.get("file_name")):
            raise RemoteError("the download has no file name")
        watch = job.get("status_url") or f"{self.base}/download/status/?file_name={name}"
        for turn in range(self.polls):
            if turn:
                self.sleep(self.pause)
            news = self._json(watch)
            match str(news.get("status") or "").lower():
                case "failed" | "error":
                    raise JobFailed(f"{name} failed")
                case "" | "finished" | "ready" if address := news.get("file_url") or news.get("url"):
                    return str(address)
        raise RemoteError(f"{name} was not ready in time")

    def detail(self, source_id: str) -> dict[str, Any]:
        return replace(self, tries=self.detail_tries, timeout=self.detail_timeout)._json(f"{self.base}/awards/{source_id}/")

    def details(self, source_ids: Iterable[str]) -> Iterator[tuple[str, dict[str, Any] | RemoteError]]:
        """Many details one after the other, each once: what the service gave, or why it gave nothing."""
        for i in dict.fromkeys(source_ids):
            try:
                yield i, self.detail(i)
            except RemoteError as e:
                yield i, e


def unpack(packed: BinaryIO, target: Path) -> int:
    """Take the file of prime transactions out of an archive; its number of data records.

    The file is checked under a name of its own and takes its place only if it
    has the columns that it must have.
    """
    with zipfile.ZipFile(packed) as archive:
        member = next((n for n in archive.namelist() if n.endswith(".csv") and "PrimeTransactions" in n), None)
        if member is None:
            raise RemoteError("the archive has no file of prime transactions")
        aside = target.with_name(f"~{target.name}")
        try:
            with archive.open(member) as inside, aside.open("wb") as outside:
                shutil.copyfileobj(inside, outside)
            require_columns(target, header(aside))
            aside.replace(target)
        except ValueError as e:
            raise RemoteError(str(e)) from e
        finally:
            aside.unlink(missing_ok=True)
    with target.open(encoding="utf-8-sig", newline="", errors="replace") as f:
        return max(0, sum(1 for _ in csv.reader(f)) - 1)
