"""Text documents of awards, their vectors, and exact top-k search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkledger.functions.text import collapse_space, fold_key
from sparkledger.sources.session import cut

TEXT_BUDGET = 1800
TXN_HEADER = "Transaction work descriptions:"
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def transaction_texts(transactions: DataFrame) -> DataFrame:
    """award_id and texts: its distinct transaction descriptions, newest first.

    Texts that differ in case alone are one; the newest spelling stays, of one
    day that of the least transaction.
    """
    t = transactions.select("award_id", collapse_space("transaction_description").alias("d"), "action_date", "transaction_id").where("d is not null and award_id is not null")
    newest = F.struct(-F.coalesce(F.unix_date("action_date"), F.lit(-(2**31) + 1)).cast("long"), F.col("transaction_id"))
    one = t.groupBy("award_id", fold_key("d").alias("k")).agg(F.min(F.struct(newest.alias("o"), F.col("d"))).alias("x"))
    return one.groupBy("award_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"]).alias("texts"))


def projection(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per award what its document is made of, all of it white-space collapsed: names and codes once per row of their tables, before the joins."""
    a = tables["award_record"].select("award_id", "base_description", "recipient_id", "awarding_agency_id", "awarding_sub_agency_id", "naics_id", "psc_id")

    def add(df: DataFrame, source: str, key: str, fk: str, **columns: str) -> DataFrame:
        return df.join(tables[source].select(F.col(key).alias(fk), *[collapse_space(c).alias(n) for n, c in columns.items()]), fk, "left")

    a = add(a, "ref_recipients", "uei", "recipient_id", recipient_name="name")
    a = add(a, "ref_agencies", "agency_id", "awarding_agency_id", agency_name="name")
    a = add(a, "ref_agencies", "agency_id", "awarding_sub_agency_id", sub_agency_name="name")
    a = add(a, "ref_classifications", "classification_id", "psc_id", psc_code="code", psc_description="description")
    a = add(a, "ref_classifications", "classification_id", "naics_id", naics_code="code", naics_description="description")
    texts = ("base_description", "psc_code", "psc_description", "naics_code", "naics_description", "recipient_name", "agency_name", "sub_agency_name")
    a = a.select("award_id", *[collapse_space(c).alias(c) if c == "base_description" else F.col(c) for c in texts])
    return a.join(transaction_texts(tables["transaction_fact"]), "award_id", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))


def documents(tables: Mapping[str, DataFrame], budget: int = TEXT_BUDGET) -> DataFrame:
    """award_id, document_id and text of every award that says what work it is.

    Description, codes with their descriptions, transaction texts and labels, a
    line each, cut at ``budget`` characters. The transaction lines need room for
    their header and a character of the first; without it they are left out.
    """
    if budget < 0:
        raise ValueError("the budget must not be negative")
    p = projection(tables)
    work = F.col("base_description").isNotNull() | F.col("psc_description").isNotNull() | F.col("naics_description").isNotNull() | (F.size("texts") > 0)
    said = lambda label, *cs: F.concat(F.lit(label), F.concat_ws("; ", *cs))
    both = lambda kind: F.when(F.col(f"{kind}_code").isNotNull() & F.col(f"{kind}_description").isNotNull(), said(f"{kind.upper()}: ", f"{kind}_code", f"{kind}_description"))
    one = lambda label, c: F.when(F.col(c).isNotNull(), said(label, c))
    lines = lambda *cs: F.filter(F.array(*cs), lambda x: x.isNotNull())
    head = lines(one("Award description: ", "base_description"), both("psc"), both("naics"))
    labels = lines(one("Recipient: ", "recipient_name"), one("Awarding agency: ", "agency_name"), one("Awarding sub-agency: ", "sub_agency_name"))
    base = F.length(F.array_join(head, "\n")) + F.when(F.size(head) > 0, 1).otherwise(0)
    fits = (F.size("texts") > 0) & (base + len(TXN_HEADER) + 1 < budget)
    acts = F.when(fits, F.concat(F.array(F.lit(TXN_HEADER)), F.transform("texts", lambda d: F.concat(F.lit("- "), d)))).otherwise(F.array().cast("array<string>"))
    cut = F.regexp_replace(F.substring(F.array_join(F.concat(head, acts, labels), "\n"), 1, budget), r"\n\z", "")
    return p.where(work).select("award_id", F.concat(F.lit("award:"), F.col("award_id")).alias("document_id"), cut.alias("text"))


Embedder = Callable[[Sequence[str]], np.ndarray]


def hashed_embedder(dim: int = 384) -> Embedder:
    """Word hashes with signs, a model that needs no file: texts that share words are near."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
            if not out[i].any():
                out[i, 0] = 1.0
        return out

    return embed


def embed(docs: DataFrame, embedder: Embedder, dim: int, text: str = "text") -> DataFrame:
    """Documents with a vector of length 1 each; a vector of wrong shape, not finite or zero fails."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.asarray(embedder(s.tolist()), dtype=np.float32)
            if x.shape != (len(s), dim):
                raise ValueError(f"vectors of shape {x.shape}, not {(len(s), dim)}")
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            if not np.isfinite(x).all() or (norm < 1e-8).any():
                raise ValueError("a vector is zero or not finite")
            yield pd.Series(list(x / norm))

    return docs.withColumn("embedding", vectors(text))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(vectors: DataFrame, query: Sequence[float], k: int, id_column: str = "award_id", vector: str = "embedding", min_score: float | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """The k vectors of the highest dot product with the query, ties by id: id, score.

    Exact: one scan of ids and vectors, of which each partition keeps k rows.
    ``candidates`` (with the id column) restrict the search; those without a
    vector are silently absent. Scores below ``min_score`` are dropped first.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    q = [float(x) for x in query]
    if not all(np.isfinite(q)) or not any(q):
        raise ValueError("the query vector is zero or not finite")
    rows = vectors.select(id_column, vector)
    if candidates is not None:
        rows = rows.join(candidates.select(id_column).distinct(), id_column, "left_semi")
    scored = rows.select(id_column, dot(F.col(vector), F.array(*[F.lit(x) for x in q])).alias("score")).where("score is not null")
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return scored.orderBy(F.desc("score"), F.asc(id_column)).limit(k)


def index_faults(index: DataFrame, dim: int) -> DataFrame:
    """One row of counts that must all be zero for a sound index, and how many documents it has."""
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    return index.agg(
        F.count("*").alias("n_documents"),
        (F.count("*") - F.count_distinct("award_id")).alias("n_repeated"),
        F.count_if(F.col("award_id").isNull() | F.col("text").isNull() | F.col("embedding").isNull()).alias("n_null"),
        F.count_if(F.size("embedding") != dim).alias("n_wrong_length"),
        F.count_if(F.abs(norm - 1) > 1e-3).alias("n_not_unit"),
    )


def misnumbered(index: DataFrame, key: str = "award_id") -> DataFrame:
    """Rows whose row_index isn't their number from 0 in the order of the key."""
    return row_numbers(index.select(F.col(key), F.col("row_index").alias("_stated")), key).where(~F.col("_stated").eqNullSafe(F.col("row_index").cast("long")))


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "award_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """The k vectors of the highest dot product with every query: query_id, id, score; ties by id.

    Queries (the same columns; null vectors ask nothing) come in blocks of
    ``block``, a bounded broadcast each. A pass over the vectors compares one
    block and keeps k rows per query and batch; the best of these are merged per
    query. A query finds itself if it is among the vectors.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark, kind = vectors.sparkSession, vectors.schema[id_column].dataType.simpleString()
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("vec")).where("id is not null and vec is not null")

    def passed(ids: list, asked: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, asked))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked = shared.value
            for b in batches:
                own = b.column(0)
                order = np.argsort(np.asarray(own.to_pylist(), dtype=object if pa.types.is_string(own.type) else None), kind="stable")
                scores = asked @ np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1)[order].T
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                q = np.repeat(np.arange(len(ids)), best.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids, own.type).take(pa.array(q)), own.take(pa.array(order[best.ravel()])), pa.array(scores[q, best.ravel()])], names=["query_id", "id", "score"])

        return rows.mapInArrow(compare, f"query_id {kind}, id {kind}, score double")

    parts, ids, asked = [], [], []
    for r in queries.select(id_column, vector).where(F.col(vector).isNotNull() & F.col(id_column).isNotNull()).toLocalIterator():
        ids.append(r[0])
        asked.append(r[1])
        if len(ids) == block:
            parts.append(passed(ids, np.array(asked, dtype=np.float64)))
            ids, asked = [], []
    if ids:
        parts.append(passed(ids, np.array(asked, dtype=np.float64)))
    if not parts:
        return spark.createDataFrame([], f"query_id {kind}, id {kind}, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return reduce(DataFrame.unionByName, parts).withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def row_numbers(docs: DataFrame, key: str = "award_id") -> DataFrame:
    """Documents numbered from 0 by key without one task that sorts them all.

    Range partitions are numbered within themselves, then shifted by the rows before them.
    """
    parts = cut(docs.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").count()
    before = sizes.withColumn("_before", F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return parts.join(before.select("_part", "_before"), "_part").withColumn("row_index", within + F.coalesce("_before", F.lit(0))).drop("_part", "_before")
