"""The N first items of every group by sorted runs and a loser-tree merge.

Each input partition is a run: sorted by group and order, and cut to the first
N of every group while it is read, seeking over the rest. The cut runs are
stored by bucket, group by group, and a loser tree merges a group's runs until
N items are out; all its runs then stand at the next group.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LoserTree:
    """Merges sorted runs given as cursors; ``head(i)`` is a key or None at the end."""

    def __init__(self, heads: list) -> None:
        self.heads = heads
        self.n = max(1, len(heads))
        self.losers = [-1] * self.n
        self.winner = -1
        for i in range(len(heads)):
            self._climb(i, building=True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _climb(self, i: int, building: bool = False) -> None:
        node = (i + self.n) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = i
                return
            if other >= 0 and self._before(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.winner = i

    def replace(self, head: object) -> None:
        """Put the next head of the winner's run and find the new winner."""
        self.heads[self.winner] = head
        self._climb(self.winner)


def merge_runs(runs: list[list[tuple]], n: int) -> Iterator[tuple[int, int, int]]:
    """(run, position, place) of the first ``n`` of every group over sorted runs.

    A run is a list of (group, key...) tuples in ascending order. The place
    counts from 1. Equal keys come from the earlier run first.
    """
    at = [0] * len(runs)
    tree = LoserTree([r[0] if r else None for r in runs])
    group, out = None, 0
    while runs and tree.heads[tree.winner] is not None:
        i = tree.winner
        head = tree.heads[i]
        if head[0] != group:
            group, out = head[0], 0
        if out < n:
            out += 1
            yield i, at[i], out
            at[i] += 1
        else:
            at[i] = bisect_right(runs[i], group, at[i], key=lambda x: x[0])
        tree.replace(runs[i][at[i]] if at[i] < len(runs[i]) else None)


def _starts(groups: np.ndarray) -> np.ndarray:
    """For each place, where its stretch of equal groups starts."""
    new = np.r_[True, groups[1:] != groups[:-1]]
    return np.maximum.accumulate(np.where(new, np.arange(len(groups)), 0))


def top_n(df: DataFrame, group: Column, orders: Sequence[tuple[str, Column, bool]], n: int, carried: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """The first ``n`` rows of every group: group, the orders, carried columns, place.

    ``orders`` are (name, expression, descending) of dates, integers or text;
    text compares in binary order, nulls come last either way. Rows equal in
    every order come in the order of input partitions, then of rows, so give
    enough orders for a total order where the choice matters. A null group is a
    group of its own; an empty input gives no rows; ``n`` must be positive.

    Memory: the merge streams; a task holds a batch and one group's cut runs, at
    most ``n`` rows per input partition, however many rows the group has.
    """
    if n < 1:
        raise ValueError("n must be positive")
    cols = [group.alias("group"), *[c.alias(name) for name, c, _ in orders], *[c.alias(name) for name, c in carried]]
    rows = df.select(*cols)
    sorts = [F.col("group").asc_nulls_first(), *[F.col(f"`{name}`").desc_nulls_last() if desc else F.col(f"`{name}`").asc_nulls_last() for name, _, desc in orders]]
    down = [desc for _, _, desc in orders]
    run_schema = T.StructType([*rows.schema.fields, T.StructField("_run", T.IntegerType())])

    def cut_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last, seen = TaskContext.get().partitionId(), object(), 0
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column(0).dictionary_encode(null_encoding="encode")
            codes, names = np.asarray(coded.indices), coded.dictionary.to_pylist()
            place = np.arange(len(codes)) - _starts(codes)
            if names[codes[0]] == last:
                other = np.flatnonzero(codes != codes[0])
                place[: other[0] if len(other) else len(codes)] += seen
            last, seen = names[codes[-1]], int(place[-1]) + 1
            kept = b.filter(pa.array(place < n))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.full(kept.num_rows, run, dtype=np.int32))], names=[*kept.schema.names, "_run"])

    runs = rows.sortWithinPartitions(*sorts).mapInArrow(cut_run, run_schema)
    stored = runs.repartition("group").sortWithinPartitions(sorts[0], "_run", *sorts[1:])
    out_schema = T.StructType([*rows.schema.fields, T.StructField("place", T.LongType())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []  # the last group so far may go on
        for b in _then_none(batches):
            if b is not None:
                if not b.num_rows:
                    continue
                left.append(b)
                if left[0].column(0)[0].as_py() == b.column(0)[-1].as_py():
                    continue
            if not left:
                continue
            whole = pa.Table.from_batches(left).combine_chunks()
            codes = np.asarray(whole.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices)
            begin = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            done = len(codes) if b is None else int(begin[-1])
            left = [] if b is None else whole.slice(done).to_batches()
            if done:
                yield from _merged(whole.slice(0, done), begin[begin < done], down, n)

    return stored.mapInArrow(merge, out_schema)


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _merged(whole: pa.Table, begin: np.ndarray, down: Sequence[bool], n: int) -> Iterator[pa.RecordBatch]:
    """The first ``n`` of every group of rows sorted by group, run and order; a group that is one run is in order already."""
    run = np.asarray(whole.column("_run"))
    end = np.r_[begin[1:], len(run)]
    size = end - begin
    place = np.arange(len(run)) - np.repeat(begin, size)
    several = run[begin] != run[end - 1]
    alone = np.flatnonzero(~np.repeat(several, size) & (place < n))
    picked, places = [alone], [place[alone] + 1]
    rows = np.flatnonzero(np.repeat(several, size))
    if len(rows):
        part = whole.take(pa.array(rows))
        keys = [[(v is None, _Down(v) if desc and v is not None else v) for v in _comparable(part.column(i))] for i, desc in enumerate(down, 1)]
        tuples = list(zip(np.repeat(np.flatnonzero(several), size[several]).tolist(), *keys, strict=True))
        lo = 0
        for g in np.flatnonzero(several):
            own = run[begin[g] : end[g]]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            last = np.r_[first[1:], len(own)]
            for r, at, no in merge_runs([tuples[lo + x : lo + y] for x, y in zip(first, last, strict=True)], n):
                picked.append(begin[g : g + 1] + first[r] + at)
                places.append(np.array([no]))
            lo += len(own)
    out = whole.drop_columns(["_run"]).take(pa.array(np.concatenate(picked)))
    yield from out.append_column("place", pa.array(np.concatenate(places).astype(np.int64))).combine_chunks().to_batches()


class _Down:
    """Reverses the order of the value it holds."""

    __slots__ = ("v",)

    def __init__(self, v: object) -> None:
        self.v = v

    def __lt__(self, other: _Down) -> bool:
        return other.v < self.v

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Down) and self.v == other.v

    __hash__ = None


def _comparable(column: pa.ChunkedArray) -> list:
    """Values that compare as Spark orders them: days as numbers, text as bytes."""
    if pa.types.is_date(column.type):
        column = column.cast(pa.int32())
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return column.to_pylist()
