"""From projected files to a published set."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from sparkledger.operators import star, validate
from sparkledger.operators.integrity import check_integrity, messages
from sparkledger.sources import published
from sparkledger.sources.files import SharedPath, remove, shared
from sparkledger.sources.projected import load_projected


class IntegrityError(RuntimeError):
    """The tables contradict each other; nothing was written."""


@dataclass(frozen=True)
class Materialized:
    """What a run made: counts of rows, where the set is, and whether CURRENT points to it."""

    run_id: str
    path: SharedPath
    rows_in: int
    invalid: int
    collision: int
    collapsed: int
    valid: int
    published: bool


def _sound(tables: dict[str, DataFrame]) -> None:
    if faults := messages(check_integrity(tables)):
        raise IntegrityError("; ".join(faults))


def materialize(spark: SparkSession, files: Sequence[str | Path], root: str | SharedPath, allow_rejects: bool = False, run_id: str | None = None) -> Materialized:
    """Load, validate, reduce, check and publish.

    Rows that fail validation are kept as rejects of the set; unless
    ``allow_rejects``, the set is then written but CURRENT stays where it was.
    Assessed rows are written once under ``root``/staging and shared by all
    tables; they go when the set is written and stay for inspection if it fails.
    """
    run = run_id or published.new_run_id()
    root = shared(spark, root)
    staging = root / "staging" / run
    validate.assess(load_projected(spark, files)).write.parquet(str(staging))
    assessed = spark.read.parquet(str(staging))
    try:
        n = validate.counts(assessed).first().asDict()
        rejected = n["invalid"] + n["collision"]
        path = published.write_set(root, run, star.build(validate.valid(assessed)), validate.rejects(assessed) if rejected else None, _sound)
        flip = allow_rejects or not rejected
        if flip:
            published.write_current(root, run)
    except BaseException as e:
        e.add_note(f"the staged rows are kept in {staging}")
        raise
    remove(staging)
    return Materialized(run, path, **n, published=flip)
