"""The most similar vectors of every vector, by cross-polytope hashing.

Unit vectors are turned by fast Hadamard pseudo-rotations and assigned to the
nearest signed axis; a table joins the axes of two rotations into a bucket, and
multiprobing enters a vector also into the buckets that it nearly fell into.
Within a bucket cosines are exact, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkledger.operators.rejects import salted
from sparkledger.sources.session import cut

#: Vectors to a bucket that the number of buckets aims at.
LOAD = 8
#: Entries of a bucket that one task compares at once; a larger bucket is compared tile by tile, with nothing left out.
TILE = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x


def signs(seed: int, tables: int, hashes: int, dim: int) -> np.ndarray:
    """Random signs of the three diagonal matrices of each rotation."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], dtype=np.float32), size=(tables, hashes, 3, dim))


def shape(n: int, dim: int) -> tuple[int, int]:
    """How many rotations a table joins, and how many coordinates of the last one count, for about LOAD of ``n`` vectors to a bucket."""
    axes = 2 << (dim - 1).bit_length()
    hashes, room = 1, max(2.0, n / LOAD)
    while room > axes:
        hashes, room = hashes + 1, room / axes
    return hashes, min(axes // 2, 1 << max(0, round(np.log2(room)) - 1))


def buckets(x: np.ndarray, turns: np.ndarray, probes: int, last: int | None = None) -> np.ndarray:
    """Bucket numbers, (tables, rows, probes): the nearest axes first, then the likeliest others.

    Another bucket differs in one of the axes. Its penalty is how much farther
    that axis is than the nearest. Of the last rotation only the first ``last``
    coordinates have axes.
    """
    tables, hashes, _, dim = turns.shape
    width = 1 << (dim - 1).bit_length()
    padded = np.zeros((len(x), width), dtype=np.float32)
    padded[:, :dim] = x
    rows = np.arange(len(x))
    out = np.empty((tables, len(x), probes), dtype=np.int64)
    last = last or width
    depth = min(probes, 2 * width)
    for t in range(tables):
        axes, far = [], []
        for h in range(hashes):
            y = padded
            for s in turns[t, h]:
                y = hadamard(y * np.pad(s, (0, width - dim), constant_values=1.0))
            both = np.concatenate((y, -y), axis=1) if h < hashes - 1 else np.pad(np.concatenate((y[:, :last], -y[:, :last]), axis=1), ((0, 0), (0, 2 * (width - last))), constant_values=-np.inf)
            top = np.argpartition(-both, depth - 1, axis=1)[:, :depth]
            size = np.take_along_axis(both, top, axis=1)
            order = np.argsort(-size, axis=1, kind="stable")
            axes.append(np.take_along_axis(top, order, axis=1))
            size = np.take_along_axis(size, order, axis=1)
            far.append((size[:, :1] - np.maximum(size, -1e30)) / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-30))
        code = lambda picks: sum(a[rows, p] * (2 * width) ** i for i, (a, p) in enumerate(zip(axes, picks, strict=True)))
        zero = np.zeros(len(x), dtype=np.int64)
        out[t, :, 0] = code([zero] * hashes)
        others = np.concatenate([f[:, 1:] for f in far], axis=1)
        best = np.argsort(others, axis=1, kind="stable")[:, : probes - 1]
        for p in range(best.shape[1]):
            which, rank = best[:, p] // (depth - 1), best[:, p] % (depth - 1) + 1
            out[t, :, p + 1] = code([np.where(which == h, rank, 0) for h in range(hashes)])
        for p in range(best.shape[1] + 1, probes):
            out[t, :, p] = out[t, :, 0]
    return out


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(qid: np.ndarray, q: np.ndarray, tid: np.ndarray, t: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query row its k best target rows: (query id, target id, cosine rounded to 6 digits)."""
    sims = np.round(q @ t.T, 6)
    i, j = np.nonzero(sims >= least)
    keep = qid[i] != tid[j]
    i, j = i[keep], j[keep]
    cosine, target = sims[i, j], tid[j]
    order = np.lexsort((target, -cosine, i))
    i, cosine, target = i[order], cosine[order], target[order]
    first = np.r_[True, i[1:] != i[:-1]][: len(i)]
    place = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
    ok = place < k
    return qid[i[ok]], target[ok], cosine[ok]


def _compare(entries: DataFrame, dim: int, k: int, least: float) -> DataFrame:
    """The best neighbours of each vector within each bucket and tile: q, t, cosine.

    ``entries`` have bucket, tile, side, cid, vec. Vectors of side 0 meet those
    of side 1, those of side 2 meet each other.
    """

    def group(side: np.ndarray, cid: np.ndarray, vec: np.ndarray) -> list[tuple]:
        x = _unit(vec)
        if side[0] == 2:
            return [_best(cid, x, cid, x, k, least)]
        a, b = side == 0, side == 1
        return [_best(cid[a], x[a], cid[b], x[b], k, least), _best(cid[b], x[b], cid[a], x[a], k, least)]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        for b in _then_none(batches):
            if b is not None:
                if not b.num_rows:
                    continue
                kept.append((np.asarray(b.column(0)), np.asarray(b.column(1)), np.asarray(b.column(2)), np.asarray(b.column(3)), _vectors(b.column(4), dim)))
                if kept[0][0][0] == kept[-1][0][-1] and kept[0][1][0] == kept[-1][1][-1]:
                    continue  # one group so far
            if not kept:
                continue
            bucket, tile, side, cid, vec = (np.concatenate(c) for c in zip(*kept, strict=True))
            new = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (tile[1:] != tile[:-1])])
            ends = np.r_[new[1:], len(bucket)]
            last = len(new) if b is None else len(new) - 1
            out = [x for lo, hi in zip(new[:last], ends[:last], strict=True) if hi - lo > 1 for x in group(side[lo:hi], cid[lo:hi], vec[lo:hi])]
            kept = [] if b is None else [(bucket[new[-1] :], tile[new[-1] :], side[new[-1] :], cid[new[-1] :], vec[new[-1] :])]
            out = [x for x in out if len(x[0])]
            if out:
                q, t, c = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(t), pa.array(c)], names=["q", "t", "cosine"])

    rows = entries.select("bucket", "tile", "side", "cid", "vec").repartition("bucket", "tile").sortWithinPartitions("bucket", "tile")
    return rows.mapInArrow(merge, "q long, t long, cosine double")


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _tiled(entries: DataFrame, crowded: DataFrame) -> DataFrame:
    """Entries of crowded buckets, once for each pair of tiles that must meet."""
    both = entries.join(crowded, "bucket").withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("tiles")))
    pairs = both.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles").cast("long") - 1)))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    return pairs.select("bucket", (lo * F.col("tiles") + hi).alias("tile"), side.alias("side"), "cid", "vec")


def nearest(df: DataFrame, id: Column, vec: Column, k: int = 5, least: float = 0.9, dim: int = 64, tables: int | None = None, probes: int = 3, seed: int = 20) -> DataFrame:
    """The ``k`` most similar others of every vector: id, place (from 1), other, cosine.

    Cosines are in double precision rounded to 6 digits; pairs under ``least``
    never count; equal cosines go to the smaller id. Vectors that are null, not
    ``dim`` long, all zero or hold null or non-finite values take no part, nor
    do null ids. An id that stands with several vectors keeps one of them, the
    same in every run.

    A table joins as many rotations as the number of vectors asks for, so that
    buckets stay small and the work grows with the vectors; the number of tables
    grows with the rotations.

    Approximate: a neighbour is found if in any table the two share a bucket,
    by their nearest axes or probes. Within buckets nothing is left out, however
    many vectors they hold: a crowded bucket is compared in pairs of tiles.
    Equal vectors (by 128 bits of hash) are one class. Only classes are hashed,
    with the k + 1 smallest ids of each, which are all that can be among
    anyone's best; members take their neighbours from their class. So copies,
    however many, cost no comparison.
    """
    k1 = k + 1
    v = F.col("vec")
    sound = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = df.select(id.cast("long").alias("id"), vec.cast("array<float>").alias("vec")).where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))
    usable = usable.select("id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), F.reverse("vec")).alias("h2"))
    ids = cut(usable.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("id", "h.h1", "h.h2"))
    of_class = Window.partitionBy("h1", "h2").orderBy("id")
    few = ids.withColumn("r", F.row_number().over(of_class)).where(F.col("r") <= k1).groupBy("h1", "h2").agg(F.min("id").alias("cid"), F.array_sort(F.collect_list("id")).alias("ids"))
    classes = usable.withColumnRenamed("id", "cid").join(few, ["cid", "h1", "h2"]).dropDuplicates(["cid"])
    hashes, last = shape(ids.count(), dim)
    tables = tables or 2 * hashes
    turns = signs(seed, tables, hashes, dim)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                b = whole.slice(start, 4096)
                codes = buckets(_unit(_vectors(b.column("vec"), dim)).astype(np.float32), turns, probes, last)
                number = (codes * tables + np.arange(tables)[:, None, None]).transpose(1, 0, 2).reshape(b.num_rows, -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * number.shape[1]), pa.array(number.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "buckets"])

    coded = cut(classes.select("cid", "h1", "h2", "ids", "vec").mapInArrow(enter, "cid long, h1 long, h2 long, ids array<long>, vec array<float>, buckets array<long>"))
    sizes = coded.select(F.explode(F.array_distinct("buckets")).alias("bucket")).groupBy("bucket").count()
    crowded = cut(sizes.where(F.col("count") > TILE).select("bucket", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")))
    entries = coded.select(F.explode(F.array_distinct("buckets")).alias("bucket"), "cid", "vec")
    if crowded.isEmpty():
        found = _compare(entries.select("*", F.lit(0).cast("long").alias("tile"), F.lit(2).alias("side")), dim, k1, least)
    else:
        quiet = entries.join(crowded, "bucket", "left_anti").select("*", F.lit(0).cast("long").alias("tile"), F.lit(2).alias("side"))
        found = _compare(quiet.unionByName(_tiled(entries, crowded)), dim, k1, least)
    by_query = Window.partitionBy("q").orderBy(F.col("cosine").desc(), "t")
    best = found.groupBy("q", "t").agg(F.max("cosine").alias("cosine")).withColumn("r", F.row_number().over(by_query)).where(F.col("r") <= k1)
    # the ids behind the classes: the own class among them, then the neighbours
    theirs = best.join(coded.select(F.col("cid").alias("t"), "ids"), "t").select(F.col("q").alias("cid"), F.struct((-F.col("cosine")).alias("s"), F.col("ids").alias("ids")).alias("x"))
    own = coded.where(F.size("ids") > 1).select("cid", F.struct(F.lit(-1.0).alias("s"), F.col("ids").alias("ids")).alias("x"))
    flat = F.flatten(F.transform("xs", lambda x: F.transform(x["ids"], lambda i: F.struct(x["s"].alias("s"), i.alias("i")))))
    lists = theirs.unionByName(own).groupBy("cid").agg(F.collect_list("x").alias("xs")).select("cid", F.slice(F.array_sort(flat), 1, k1).alias("near"))
    lists = lists.join(coded.select("cid", "h1", "h2"), "cid").drop("cid")
    per = salted(ids, lists, ["h1", "h2"], F.col("id"), "inner")
    others = F.slice(F.filter("near", lambda x: x["i"] != F.col("id")), 1, k)
    return per.select("id", F.posexplode(others).alias("p", "x")).select("id", (F.col("p") + 1).alias("place"), F.col("x.i").alias("other"), (-F.col("x.s")).alias("cosine"))
