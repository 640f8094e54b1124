"""Filling containers of a fixed capacity with items of varying length.

Items are interchangeable if they have the same size, so an instance is a count
per size: never more entries than the capacity, however many items there are.
On that table Martello-Toth dominance fixes small sets that provably belong
together in some optimal packing and shrinks the instance; best-fit decreasing
packs the remainder. The plan, patterns with multiplicities, is then dealt back
to the items by their number within their size.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkledger.operators.skew import number_within_key

Pattern = tuple[tuple[int, int], ...]


def _largest(sizes: list[int], limit: int, below: int) -> int:
    """Index of the largest size at most ``limit`` among the first ``below``, or -1."""
    return bisect_right(sizes, limit, 0, below) - 1


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Fix dominating sets of up to three items; ``counts`` keeps what is left.

    For the largest item j with room r beside it, a set of others fits if its
    sum is at most r, and {j} + F dominates every {j} + G if the items of G can
    be divided among those of F without exceeding them. Fixed are: j alone if
    nothing fits; j with k, the largest that fits, if k fills r exactly or no
    two others fit; j with (k, b), b the largest that fits beside k, if no
    three others fit and b is at least the smaller of every pair that fits. An
    item without a dominating set is passed over, and looked at again after the
    instance has shrunk. Equal sizes are treated together.
    """
    fixed: list[tuple[Pattern, int]] = []
    shrunk = True
    while shrunk:
        shrunk = False
        sizes = sorted(counts)
        for j in sizes[::-1]:
            while counts.get(j, 0):
                found = _dominating(counts, sizes, j, capacity - j)
                if found is None:
                    break
                need: dict[int, int] = {}
                for s in (j, *found):
                    need[s] = need.get(s, 0) + 1
                times = min(counts[s] // m for s, m in need.items())
                # a set that stays dominating only while its sizes last is fixed once
                times = times if len(found) < 2 else 1
                fixed.append((tuple(sorted(need.items(), reverse=True)), times))
                for s, m in need.items():
                    counts[s] -= m * times
                    if not counts[s]:
                        del counts[s]
                        sizes.pop(bisect_left(sizes, s))
                shrunk = True
    return fixed


def _dominating(counts: dict[int, int], sizes: list[int], j: int, room: int) -> tuple[int, ...] | None:
    free = lambda s, used: counts[s] - used.count(s)
    used = [j]

    def largest(limit: int, taken: list[int]) -> int | None:
        at = _largest(sizes, limit, len(sizes))
        while at >= 0 and free(sizes[at], taken) <= 0:
            at -= 1
        return sizes[at] if at >= 0 else None

    def smallest(n: int) -> int | None:
        """Sum of the n smallest others, None if there are fewer."""
        total, left = 0, n
        for s in sizes:
            take = min(left, free(s, used))
            total, left = total + take * s, left - take
            if not left:
                return total
        return None

    k = largest(room, used)
    if k is None:
        return ()
    two = smallest(2)
    if k == room or two is None or two > room:
        return (k,)
    three = smallest(3)
    b = largest(room - k, [j, k])
    if b is not None and (three is None or three > room):
        # the greatest smaller part of a pair that fits: at most half the room
        y = largest(room // 2, used)
        while y is not None and b < y:
            x = largest(room - y, [j, y])
            if x is not None and x >= y:
                return None
            y = largest(y - 1, used)
        return (k, b)
    return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over counts, equal containers kept as one entry.

    The fullest container that has room takes the item; one that took an item
    of a size is the fullest for the next of that size, so it is filled on.
    """
    groups: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if times:
            if room not in groups:
                rooms.insert(bisect_left(rooms, room), room)
                groups[room] = []
            groups[room].append((pattern, times))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                whole, rest = divmod(left, each)
                put(capacity - each * size, ((size, each),), whole)
                if rest:
                    put(capacity - rest * size, ((size, rest),), 1)
                break
            room = rooms[at]
            pattern, times = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = room // size
            whole = min(times, left // each)
            put(room - each * size, (*pattern, (size, each)), whole)
            left -= whole * each
            if whole < times and left:
                put(room - left * size, (*pattern, (size, left)), 1)
                put(room, pattern, times - whole - 1)
                left = 0
            elif whole < times:
                put(room, pattern, times - whole)
    return [entry for entries in groups.values() for entry in entries]


def plan_packing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], int]:
    """Patterns with multiplicities, and how many containers dominance fixed."""
    left = {s: n for s, n in counts.items() if n}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("sizes must lie between 1 and the capacity")
    fixed = reduce_dominated(left, capacity)
    return [*fixed, *best_fit(left, capacity)], sum(n for _, n in fixed)


def pack(items: DataFrame, item: Column, size: Column, capacity: int, carried: dict[str, Column] | None = None) -> DataFrame:
    """Assign every item to a container: one row per piece of an item.

    Columns: item, the carried columns, piece (from 0), piece_offset (units of
    the item before it), piece_size, container (from 1). An item larger than
    the capacity is cut into full pieces and a rest; no other is cut. An item
    of size 0 or null has one piece of size 0 and rides in container 1. Items
    may repeat, each row is packed. Empty input gives no rows.

    ``items`` must give the same rows again when it runs again (checkpoint it
    if it is not a plain scan). To the driver comes a count per size, at most
    ``capacity`` entries; the plan goes out as one row per size and pattern.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    carried = carried or {}
    spark = items.sparkSession
    n = F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long")
    full = F.floor(F.greatest(n - 1, F.lit(0)) / capacity).cast("int")
    pieces = items.select(item.alias("item"), *[c.alias(k) for k, c in carried.items()], n.alias("_n"), F.explode(F.sequence(F.lit(0), full)).alias("piece"))
    pieces = pieces.select("item", *carried, "piece", (F.col("piece").cast("long") * capacity).alias("piece_offset"), F.least(F.col("_n") - F.col("piece").cast("long") * capacity, F.lit(capacity)).cast("int").alias("piece_size"))
    counts = {r[0]: r[1] for r in pieces.groupBy("piece_size").count().collect() if r[0]}
    plan, _ = plan_packing(counts, capacity)
    rows, first = [], 1
    dealt: dict[int, int] = {}
    for pattern, times in plan:
        per_size: dict[int, int] = {}
        for s, m in pattern:
            per_size[s] = per_size.get(s, 0) + m
        for s, m in per_size.items():
            rows.append((s, dealt.get(s, 0), m, first))
            dealt[s] = dealt.get(s, 0) + m * times
        first += times
    slots = spark.createDataFrame(rows, "size int, dealt long, per_container int, first_container long") if rows else spark.createDataFrame([], "size int, dealt long, per_container int, first_container long")
    # patterns of a size, in the order in which its items are dealt; at most a few times the capacity in all
    by_size = slots.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("dealt", "per_container", "first_container"))).alias("deals")).withColumnRenamed("size", "piece_size")
    numbered, _ = number_within_key(pieces, F.col("piece_size"), {"item": F.col("item"), **{k: F.col(k) for k in carried}, "piece": F.col("piece"), "piece_offset": F.col("piece_offset")}, chunk_rows=0)
    numbered = numbered.withColumnRenamed("key", "piece_size").join(F.broadcast(by_size), "piece_size", "left")
    deal = F.element_at(F.filter("deals", lambda x: x["dealt"] <= F.col("key_no")), -1)
    container = deal["first_container"] + F.floor((F.col("key_no") - deal["dealt"]) / deal["per_container"])
    return numbered.select("item", *carried, "piece", "piece_offset", "piece_size", F.coalesce(container, F.lit(1)).cast("long").alias("container"))


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, item: str, text: str, vocabulary: str, pattern: str) -> DataFrame:
    """item and n_tokens of whole texts in tokens of a public byte-level vocabulary; null text has 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(vocabulary, pattern)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(sizes, dtype=np.int64))], names=["item", "n_tokens"])

    kind = docs.schema[item].dataType.simpleString()
    return docs.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text")).mapInArrow(count, f"item {kind}, n_tokens long")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers by fill, a check of how little space stays unused: fill, n_containers."""
    fills = packed.groupBy("container").agg(F.sum("piece_size").alias("fill"))
    w = Window.partitionBy()
    return fills.groupBy("fill").agg(F.count("*").alias("n_containers")).withColumn("share_unused", 1 - F.sum(F.col("fill") * F.col("n_containers")).over(w) / (F.sum("n_containers").over(w) * capacity))
