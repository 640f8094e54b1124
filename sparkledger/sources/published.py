"""Published sets: immutable folders of tables behind one pointer file."""

from __future__ import annotations

import re
import secrets
from collections.abc import Callable, Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from sparkledger.operators.star import KEYS
from sparkledger.sources.files import SharedPath, place, remove, shared

RUN_ID = re.compile(r"\d{8}T\d{6}Z_[0-9a-f]{6}")
# Where each table lies in a set.
FILES = {
    "transaction_fact": "transactions.parquet", "award_record": "awards.parquet", "ref_recipients": "refs/recipients.parquet", "ref_agencies": "refs/agencies.parquet",
    "ref_offices": "refs/offices.parquet", "ref_classifications": "refs/classifications.parquet", "ref_idvs": "refs/idvs.parquet", "ref_locations": "refs/locations.parquet",
}


class DatasetError(RuntimeError):
    """A published set cannot be used."""


class NoCurrentSet(DatasetError):
    pass


class IncompleteSet(DatasetError):
    pass


def new_run_id(when: datetime | None = None, suffix: str | None = None) -> str:
    run = f"{(when or datetime.now(UTC)).astimezone(UTC):%Y%m%dT%H%M%SZ}_{suffix or secrets.token_hex(3)}"
    if not RUN_ID.fullmatch(run):
        raise ValueError(f"not a run id: {run}")
    return run


def set_path(root: str | SharedPath, run: str) -> SharedPath:
    if not RUN_ID.fullmatch(run):
        raise ValueError(f"not a run id: {run}")
    return place(root) / "sets" / run


def read_current(root: str | SharedPath) -> str | None:
    p = place(root) / "CURRENT"
    return (p.read_text().strip() or None) if p.is_file() else None


def write_current(root: str | SharedPath, run: str) -> None:
    """Point to a set; readers see the old pointer or the new one, never a part."""
    if not set_path(root, run).is_dir():
        raise ValueError(f"there is no set {run}")
    tmp = place(root) / f".CURRENT.{run}.tmp"
    tmp.write_text(run + "\n")
    tmp.replace(place(root) / "CURRENT")


def write_set(root: str | SharedPath, run: str, tables: Mapping[str, DataFrame], rejects: DataFrame | None = None, check: Callable[[dict[str, DataFrame]], None] | None = None) -> SharedPath:
    """Write all tables aside, then move them into place at once; a set is never written twice.

    ``check`` is given the tables as written, before the move; if it raises,
    nothing of the set remains. So every table is computed once.
    """
    target = set_path(root, run)
    if target.exists():
        raise ValueError(f"set {run} is there already")
    tmp = target.parent / f".tmp-{run}"
    remove(tmp)
    try:
        for name, file in FILES.items():
            tables[name].write.parquet(str(tmp / file))
        if rejects is not None:
            rejects.write.parquet(str(tmp / "rejects.parquet"))
        if check is not None:
            spark = next(iter(tables.values())).sparkSession
            check({name: spark.read.parquet(str(tmp / file)) for name, file in FILES.items()})
        tmp.rename(target)
    except BaseException:
        remove(tmp)
        raise
    return target


def open_set(spark: SparkSession, root: str | SharedPath) -> tuple[str, dict[str, DataFrame]]:
    """The run id that CURRENT names, and its tables at their own paths: a later pointer doesn't move them."""
    root = shared(spark, root)
    run = read_current(root)
    if run is None:
        raise NoCurrentSet(f"{root} has no current set")
    if not RUN_ID.fullmatch(run):
        raise DatasetError(f"CURRENT holds no run id: {run}")
    where = set_path(root, run)
    if not where.is_dir():
        raise NoCurrentSet(f"set {run} is not there")
    tables = {}
    for name, file in FILES.items():
        if not (where / file).exists():
            raise IncompleteSet(f"set {run} lacks {file}")
        tables[name] = spark.read.parquet(str((where / file).resolve()))
        if KEYS[name] not in tables[name].columns:
            raise IncompleteSet(f"{file} of set {run} lacks {KEYS[name]}")
    return run, tables
