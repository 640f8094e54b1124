"""Per-key results where a handful of keys hold most of the rows.

Exact offset chunking: keys are counted per input partition, prefix sums of
those counts number every row within its key without moving it, and a heavy
key's rows are processed as chunks of equal size whose states are merged in
order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkledger.sources.session import cut, slots

#: Offsets broadcast at most, two longs and a key each; beyond, a join by partition and key.
MAX_BROADCAST_OFFSETS = 200_000


def _number(batches: Iterator[pa.RecordBatch], heavy_only: bool = False) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the row's number within its key in this partition, from 0.

    With ``heavy_only`` only rows with an _offset are numbered, and only their
    keys remembered.
    """
    part = TaskContext.get().partitionId()
    seen: dict[object, int] = {}
    for b in batches:
        if heavy_only:
            heavy = pc.is_valid(b.column("_offset"))
            no = np.zeros(b.num_rows, dtype=np.int64)
            no[heavy.to_numpy(zero_copy_only=False)] = _next(b.column(0).filter(heavy), seen)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(no)], names=[*b.schema.names, "_no"])
            continue
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, dtype=np.int32)), pa.array(_next(b.column(0), seen))], names=[*b.schema.names, "_part", "_no"])


def _next(column: pa.Array, seen: dict[object, int]) -> np.ndarray:
    """The number of each row within its key, from what was seen on."""
    if len(column):
        coded = pc.dictionary_encode(column, null_encoding="encode")
        codes = np.asarray(coded.indices)
        order = np.argsort(codes, kind="stable")
        size = np.bincount(codes, minlength=len(coded.dictionary))
        first = np.cumsum(size) - size
        keys = coded.dictionary.to_pylist()
        base = np.array([seen.get(k, 0) for k in keys], dtype=np.int64)
        no = np.empty(len(codes), dtype=np.int64)
        no[order] = np.arange(len(codes)) - first[codes[order]] + base[codes[order]]
        seen.update((k, int(n + m)) for k, n, m in zip(keys, base, size, strict=True))
        return no
    return np.zeros(0, dtype=np.int64)


def number_within_key(df: DataFrame, key: Column, columns: dict[str, Column], chunk_rows: int | None = None) -> tuple[DataFrame, int]:
    """Rows numbered within their key, and the number of all rows.

    The rows have key, the columns, key_no from 0 and chunk. Numbers within a
    key are distinct and without gaps, in the order of input partitions and of
    rows within them. A key of at most ``chunk_rows`` rows is one chunk, and
    its rows need no offsets: key_no is then null. ``chunk_rows`` defaults to a
    quarter of a task slot's share of all rows; 0 numbers every row.

    ``df`` must give the same rows in the same partitions when it runs again
    (a scan, or a checkpoint). Null is a key like any other. No row moves: one
    shuffle carries a count per key and partition, and the offsets of heavy
    keys, of which there are at most rows / chunk_rows, come back to the rows.
    """
    rows = df.select(key.alias("key"), *[c.alias(n) for n, c in columns.items()])
    all_rows = df.count()
    if chunk_rows is None:
        chunk_rows = max(1, -(-all_rows // (4 * slots(df.sparkSession))))
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_no", T.LongType())])
    counts = rows.groupBy("key", F.spark_partition_id().alias("_part")).agg(F.count("*").alias("n"))
    by_key = Window.partitionBy("key")
    offsets = counts.select(
        F.col("key").alias("_key"),
        F.col("_part").alias("_p"),
        (F.sum("n").over(by_key.orderBy("_part")) - F.col("n")).alias("_offset"),
        F.sum("n").over(by_key).alias("_total"),
    )
    offsets = cut(offsets.where(F.col("_total") > chunk_rows).drop("_total"))
    match = F.col("key").eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p"))
    if offsets.count() <= MAX_BROADCAST_OFFSETS:
        # the offsets come to the rows where they lie, so that only heavy keys are numbered and remembered
        met = rows.withColumn("_part", F.spark_partition_id()).join(F.broadcast(offsets), match, "left").drop("_key", "_p", "_part")
        numbered = met.mapInArrow(lambda batches: _number(batches, heavy_only=True), T.StructType([*met.schema.fields, T.StructField("_no", T.LongType())]))
    else:
        numbered = rows.mapInArrow(_number, schema).join(offsets, match, "left")
    no = F.col("_offset") + F.col("_no")
    chunk = F.coalesce(F.floor(no / max(1, chunk_rows)), F.lit(0)).cast("long")
    return numbered.select("key", *columns, no.alias("key_no"), chunk.alias("chunk")), all_rows


def chunked_totals(df: DataFrame, key: Column, amount: Column, day: Column, heavy_percent: int = 3) -> DataFrame:
    """Rows, amount sum and latest day of every non-null key, with heavy keys marked.

    Columns: key, n_rows, n_chunks, amount_sum (decimal(38,2), null if no row
    has an amount), latest (null if no row has a day), heavy. A key is heavy if
    it holds at least ``heavy_percent`` in 100 of all rows, those of a null key
    included. No key is ever processed in one piece: chunks of equal size are
    reduced first, then their states are merged in the order of the chunks.
    Repeated rows count as often as they stand; an empty input gives no row.
    """
    rows, all_rows = number_within_key(df, key, {"amount": amount, "day": day})
    states = rows.groupBy("key", "chunk").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(38,2)")).alias("s"), F.max("day").alias("d"))
    # a key has at most one chunk more than all its rows fill: a bounded list, merged from the first chunk to the last
    ordered = states.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "n", "s", "d"))).alias("chunks"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("decimal(38,2)").alias("s"), F.lit(None).cast("date").alias("d"))
    plus = lambda a, b: F.coalesce(a + b, a, b).cast("decimal(38,2)")
    last = F.aggregate("chunks", start, lambda a, c: F.struct((a["n"] + c["n"]).alias("n"), plus(a["s"], c["s"].cast("decimal(38,2)")).alias("s"), F.greatest(a["d"], c["d"]).alias("d")))
    merged = ordered.select("key", F.size("chunks").cast("long").alias("n_chunks"), last.alias("x")).select("key", F.col("x.n").alias("n_rows"), "n_chunks", F.col("x.s").alias("amount_sum"), F.col("x.d").alias("latest"))
    return merged.where("key is not null").withColumn("heavy", F.col("n_rows") * 100 >= F.lit(heavy_percent * all_rows))
