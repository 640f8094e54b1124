"""Validation and deduplication of staged transactions.

One pass: values are normalised, each row is assessed, and two windows over
the transaction key tell collisions and copies apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkledger.functions.text import blank_as_null, to_date, to_money
from sparkledger.sources.columns import DATES, MONEY, PROJECTED, REQUIRED

KEY = REQUIRED[0]
LOAD = ("_source_path", "_input_index", "_load_seq")


def normalised(raw: DataFrame) -> DataFrame:
    return raw.select(*[blank_as_null(c).alias(c) for c in PROJECTED], *LOAD)


def reject_reason() -> Column:
    """All reasons of a row joined by '; ', null for a sound row."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing_required:{c}")) for c in REQUIRED]
    bad = [F.when(F.col(c).isNotNull() & f(c).isNull(), F.lit(f"malformed:{c}")) for cs, f in ((DATES, to_date), (MONEY, to_money)) for c in cs]
    return F.nullif(F.concat_ws("; ", *missing, *bad), F.lit(""))


def content_hash() -> Column:
    """SHA-256 over the normalised text of all projected columns: 10 and 10.00 differ."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("")) for c in PROJECTED]), 256)


def assess(raw: DataFrame) -> DataFrame:
    """Normalised rows with reject_reason, content hash, collision and copy number.

    Rows are partitioned by transaction key once. The windows need no frame over
    the whole key beyond a minimum, a maximum and a running number. Rows with a
    reason stand by themselves, so those that lack a key gather nowhere.
    """
    rows = normalised(raw).withColumn("reject_reason", reject_reason()).withColumn("_content_hash", content_hash())
    sound = F.col("reject_reason").isNull()
    of_key = Window.partitionBy(F.when(sound, F.col(KEY)), F.when(~sound, F.xxhash64(*LOAD)))
    collides = F.min("_content_hash").over(of_key) != F.max("_content_hash").over(of_key)
    return rows.withColumn("_collides", F.col("reject_reason").isNull() & collides).withColumn("_copy", F.row_number().over(of_key.orderBy("_load_seq")))


def rejects(assessed: DataFrame) -> DataFrame:
    """Rows that are not loaded, with the reason; a key with different contents loses all its rows."""
    reason = F.when(F.col("_collides"), F.lit("identity_collision")).otherwise(F.col("reject_reason"))
    return assessed.withColumn("reject_reason", reason).where("reject_reason is not null").select(*LOAD, "reject_reason", *PROJECTED)


def valid(assessed: DataFrame) -> DataFrame:
    """The first row of every sound key, typed."""
    kept = assessed.where(F.col("reject_reason").isNull() & ~F.col("_collides") & (F.col("_copy") == 1))
    as_type = lambda c: to_date(c) if c in DATES else to_money(c) if c in MONEY else F.col(c)
    return kept.select(*[as_type(c).alias(c) for c in PROJECTED], "_content_hash", *LOAD)


def counts(assessed: DataFrame) -> DataFrame:
    """One row: rows_in = invalid + collision + collapsed + valid."""
    sound = F.col("reject_reason").isNull() & ~F.col("_collides")
    return assessed.agg(
        F.count("*").alias("rows_in"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("invalid"),
        F.count_if(F.col("_collides")).alias("collision"),
        F.count_if(sound & (F.col("_copy") > 1)).alias("collapsed"),
        F.count_if(sound & (F.col("_copy") == 1)).alias("valid"),
    )


def once(staged: DataFrame) -> DataFrame:
    """One row per transaction key of already typed rows, the first one loaded."""
    w = Window.partitionBy(KEY).orderBy("_load_seq")
    return staged.withColumn("_copy", F.row_number().over(w)).where("_copy = 1").drop("_copy")
