"""Held-out passages that leaked into a corpus.

Word n-grams of the test items are the seeds. One pass over the corpus counts
in how many documents each seed stands and keeps, for every document, the
stretches in which seeds of one item lie close together. Of every window of an
item its rarest seed is kept; a stretch without any rare seed is dropped unless
its words could reach the share of the item that is asked for. What remains is scored by Smith-Waterman alignment of words, so edited copies score
too, and measured for its longest run of equal words.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkledger.sources.session import cut

#: Words of test items that go out to the tasks at once; a larger set is worked through in blocks of items.
BLOCK_WORDS = 1_000_000

_COMMENT = re.compile(r"<!--|-->")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|small|big|sub|sup|span|font|tt|code|nowiki)\b[^<>]*>", re.IGNORECASE)
_SIGNS = re.compile(r"''+|\[\[|\]\]")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿￹-￻]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits, without markup and invisible signs.

    HTML entities are decoded; comment marks and tags go, their contents stay;
    signs that can stand inside a word (quotes of emphasis, link brackets,
    inline tags, invisible characters) leave no gap, all others part words.
    """
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", _COMMENT.sub(" ", text)))
    text = _SIGNS.sub("", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    return _WORD.findall(text.lower())


@dataclass
class Items:
    """Test items as word numbers, and where each seed stands in them."""

    n: int
    vocabulary: dict[str, int]
    ids: list
    texts: list[np.ndarray]
    seeds: np.ndarray  # sorted hashes
    first: np.ndarray  # for seed k, its places are first[k] : first[k + 1]
    item: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple], n: int) -> Items:
        vocabulary: dict[str, int] = {}
        texts = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(t)], dtype=np.int64) for _, t in rows]
        found = [(hashes(t, n), i) for i, t in enumerate(texts)]
        h = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
        item = np.concatenate([np.full(len(x), i) for x, i in found]) if found else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(x)) for x, _ in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        seeds, first = np.unique(h[order], return_index=True)
        return cls(n, vocabulary, [r[0] for r in rows], texts, seeds, np.r_[first, len(h)], item[order], place[order])

    def lookup(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the document at which a seed stands, and which seed."""
        h = hashes(doc, self.n)
        if not len(h) or not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        run = np.r_[0, np.cumsum(doc > 0)]
        known = np.flatnonzero(run[self.n :] - run[: -self.n] == self.n)
        at = np.minimum(np.searchsorted(self.seeds, h[known]), len(self.seeds) - 1)
        ok = self.seeds[at] == h[known]
        return known[ok], at[ok]


def hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n-gram of word numbers."""
    m = len(ids) - n + 1
    if m < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    x = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = (h ^ x[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def align(a: np.ndarray, b: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int]:
    """Smith-Waterman score of two word sequences, and their longest run of equal words; 0 equals nothing."""
    best = longest = 0
    above = np.zeros(len(b) + 1, dtype=np.int64)
    runs = np.zeros(len(b) + 1, dtype=np.int64)
    slope = np.arange(len(b) + 1) * -gap
    for x in a:
        equal = (b == x) & (x > 0)
        runs[1:] = np.where(equal, runs[:-1] + 1, 0)
        row = np.zeros_like(above)
        row[1:] = np.maximum(np.maximum(above[:-1] + np.where(equal, match, mismatch), above[1:] + gap), 0)
        above = np.maximum.accumulate(row + slope) - slope
        best, longest = max(best, int(above.max())), max(longest, int(runs.max()))
    return best, longest


def in_common(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two sequences have in common, repeated ones as often as in both: no alignment has more equal words."""
    known, inverse = np.unique(a, return_inverse=True)
    at = np.minimum(np.searchsorted(known, b), len(known) - 1)
    return int(np.minimum(np.bincount(inverse, minlength=len(known)), np.bincount(at[known[at] == b], minlength=len(known))).sum())


def _stretches(items: Items, at: np.ndarray, seed: np.ndarray, least: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """(item, from, to, seeds) where at least ``least`` seeds of an item lie within its length."""
    size = items.first[seed + 1] - items.first[seed]
    where = np.repeat(at, size)
    what = np.repeat(seed, size)
    base = np.repeat(items.first[seed] - np.r_[0, np.cumsum(size)[:-1]], size)
    item = items.item[base + np.arange(len(where))]
    many = np.bincount(item, minlength=len(items.texts)) >= least
    keep = many[item]
    if not keep.any():
        return
    where, what, item = where[keep], what[keep], item[keep]
    order = np.lexsort((where, item))
    where, what, item = where[order], what[order], item[order]
    length = np.array([len(t) for t in items.texts])[item]
    close = np.zeros(len(where), dtype=bool)
    k = least - 1
    dense = (item[k:] == item[: len(item) - k]) & (where[k:] - where[: len(where) - k] <= length[: len(where) - k])
    for shift in range(least):
        close[shift : shift + len(dense)] |= dense
    found = [(int(i), int(p), int(s)) for i, p, s in zip(item[close], where[close], what[close], strict=True)]
    for i, group in groupby(found, key=lambda x: x[0]):
        reach = len(items.texts[i])
        stretch: list[tuple[int, int, int]] = []
        for hit in [*group, None]:
            if stretch and (hit is None or hit[1] - stretch[-1][1] > reach):
                yield i, max(0, stretch[0][1] - reach), stretch[-1][1] + items.n + reach, sorted({s for _, _, s in stretch})
                stretch = []
            if hit:
                stretch.append(hit)


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 5, window: int = 13, least: int = 6, share: float | None = 0.5) -> DataFrame:
    """Documents with passages of test items: doc_id, item_id, score, share, longest_run.

    ``score`` is the best Smith-Waterman alignment (2 for an equal word, -1 for
    another or a gap), ``share`` that of the item's own best score, and
    ``longest_run`` the most consecutive words in common. Every document that
    holds ``window`` consecutive words of an item is found (window must be at
    least n + least - 1); below that, every copy is found that keeps at least
    ``least`` seeds of ``n`` words within the item's length and reaches the
    asked ``share``. Without one, or below it, stretches that hold no rare seed
    are passed over. Nulls and texts without words hold nothing; repeated rows are one
    result; an item shorter than ``n`` words is never found.

    The corpus is read once. Test items are worked through in blocks of at most
    BLOCK_WORDS words, the only thing that goes to every task; the counts of
    their seeds come to the driver, and nothing about other documents does.
    """
    if window < n + least - 1:
        raise ValueError("the window must hold the seeds that are asked for")
    spark = docs.sparkSession
    blocks: list[list[tuple]] = [[]]
    size = 0
    for r in items.where(F.col(item_id).isNotNull()).select(item_id, item_text).orderBy(item_id).toLocalIterator():
        size += len(r[1] or "") // 2
        if size > BLOCK_WORDS and blocks[-1]:
            blocks.append([])
            size = len(r[1] or "") // 2
        blocks[-1].append((r[0], r[1]))
    id_type, doc_type = items.schema[item_id].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()
    corpus = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    out = [_block(corpus, Items.of(block, n), doc_type, id_type, window, least, share) for block in blocks if block]
    if not out:
        return spark.createDataFrame([], f"doc_id {doc_type}, item_id {id_type}, score int, share double, longest_run int")
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole


def _block(corpus: DataFrame, items: Items, doc_type: str, id_type: str, window: int, least: int, share: float | None) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(items.seeds), dtype=np.int64)
        get = items.vocabulary.get
        for b in batches:
            rows = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([get(w, 0) for w in words(t)], dtype=np.int64)
                at, seed = items.lookup(ids)
                if not len(at):
                    continue
                df[np.unique(seed)] += 1
                if len(at) >= least:
                    rows += [(doc, i, seeds, ids[lo:hi].tolist()) for i, lo, hi, seeds in _stretches(items, at, seed, least)]
            if rows:
                yield _record(rows, b.schema.types[0])
        seen = np.flatnonzero(df)
        if len(seen):
            yield _record([(None, -1, [int(s)], [int(df[s])]) for s in seen], b.schema.types[0])

    found = cut(corpus.mapInArrow(scan, f"doc_id {doc_type}, item int, seeds array<int>, words array<int>"))
    counts = found.where("item = -1").groupBy(F.col("seeds")[0].alias("seed")).agg(F.sum(F.col("words")[0].cast("long")).alias("n")).collect()
    df = np.zeros(len(items.seeds), dtype=np.int64)
    for r in counts:
        df[r["seed"]] = r["n"]
    rare, fewest = _rare_seeds(items, df, window)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, i, seeds, ids in zip(*[c.to_pylist() for c in b.columns], strict=True):
                doc_words = np.array(ids, dtype=np.int64)
                # a run of a whole window holds its rarest seed and as many seeds as any window has
                whole = len(seeds) >= fewest[i] and not rare.isdisjoint(seeds)
                if whole or (share is not None and in_common(items.texts[i], doc_words) >= share * len(items.texts[i])):
                    s, run = align(items.texts[i], doc_words)
                    rows.append((doc, items.ids[i], s, s / max(1, 2 * len(items.texts[i])), run))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.types[0]), pa.array(cols[1], pa.infer_type(items.ids)), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.int32())], names=["doc_id", "item_id", "score", "share", "longest_run"])

    scored = found.where("item >= 0").mapInArrow(score, f"doc_id {doc_type}, item_id {id_type}, score int, share double, longest_run int")
    return scored.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("share").alias("share"), F.max("longest_run").alias("longest_run"))


def _record(rows: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
    a, b, c, d = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, doc_type), pa.array(b, pa.int32()), pa.array(c, pa.list_(pa.int32())), pa.array(d, pa.list_(pa.int32()))], names=["doc_id", "item", "seeds", "words"])


def _rare_seeds(items: Items, df: np.ndarray, window: int) -> tuple[set[int], list[int]]:
    """Of every window of every item, the seed that stands in the fewest documents; of every item, the fewest different seeds of a window."""
    rare: set[int] = set()
    fewest = []
    for t in items.texts:
        seed = np.searchsorted(items.seeds, hashes(t, items.n))
        width = min(window - items.n + 1, len(seed))
        parts = [seed[lo : lo + width] for lo in range(len(seed) - width + 1)] if len(seed) else []
        rare.update(int(part[np.argmin(df[part])]) for part in parts)
        fewest.append(min((len(np.unique(part)) for part in parts), default=0))
    return rare, fewest
