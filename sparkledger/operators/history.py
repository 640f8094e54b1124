"""Histories of changing attributes, built from periodic snapshots.

Each attribute keeps its own event-sourced change log with its own intervals.
The logs are combined by splitting at the union of their boundary dates and
coalescing neighbours that hold the same state.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkledger.functions.text import col

#: The pseudo attribute whose first event is the entity's first day.
SEEN = "\x00seen"


def change_log(df: DataFrame, entity: Column, day: Column, order: Column, attributes: Mapping[str, Column]) -> DataFrame:
    """Per-attribute change log: entity, attribute, value, valid_from, valid_to.

    ``attributes`` maps a name to an expression that is null where a row says
    nothing. The last saying of a day counts, by ``order``; equal orders go to
    the greater value. An interval ends where the attribute's next begins; the
    last is open (null).

    Rows without entity or day have no place in time and take no part. An
    attribute never said has no interval. An empty input gives an empty log.
    Other columns, whatever their names, are not read.

    The first shuffle carries one row per entity and day, combined before it;
    what follows is partitioned by entity alone, so a hot entity costs its
    number of days, not its number of rows.
    """
    said = [F.struct(order.alias("o"), c.cast("string").alias("v")) for c in attributes.values()]
    daily = (
        df.select(entity.cast("string").alias("entity"), day.cast("date").alias("day"), *[F.when(c.isNotNull(), s).alias(f"a{i}") for i, (c, s) in enumerate(zip(attributes.values(), said, strict=True))])
        .where("entity is not null and day is not null")
        .groupBy("entity", "day")
        .agg(F.lit(SEEN).alias("seen"), *[F.max(f"a{i}")["v"].alias(f"v{i}") for i in range(len(attributes))])
        .repartition("entity")
    )
    events = daily.select(
        "entity", "day",
        F.inline(F.array(F.struct(F.lit(SEEN).alias("attribute"), F.col("seen").alias("value")), *[F.struct(F.lit(n).alias("attribute"), F.col(f"v{i}").alias("value")) for i, n in enumerate(attributes)])),
    ).where("value is not null")
    w = Window.partitionBy("entity", "attribute").orderBy("day")
    changes = events.withColumn("before", F.lag("value").over(w)).where("before is null or before <> value")
    return changes.select("entity", "attribute", "value", F.col("day").alias("valid_from"), F.lead("day").over(w).alias("valid_to"))


def combine_logs(log: DataFrame, names: list[str]) -> DataFrame:
    """Versions of whole entities: entity, the named attributes, valid_from, valid_to.

    A version starts at every boundary date of any attribute at which the state
    differs from the one before; valid_to is null for the last.
    """
    at = Window.partitionBy("entity").orderBy("valid_from")
    split = log.groupBy("entity", "valid_from").agg(*[F.max(F.when(F.col("attribute") == n, F.col("value"))).alias(f"s{i}") for i, n in enumerate(names)])
    # within an attribute's log the intervals leave no gap, so the latest start is the one that holds
    state = split.select("entity", "valid_from", *[F.last(f"s{i}", ignorenulls=True).over(at).alias(f"s{i}") for i in range(len(names))])
    same = F.row_number().over(at) > 1
    for i in range(len(names)):
        same &= F.col(f"s{i}").eqNullSafe(F.lag(f"s{i}").over(at))
    kept = state.withColumn("same", same).where("not same")
    return kept.select("entity", *[F.col(f"s{i}").alias(n) for i, n in enumerate(names)], "valid_from", F.lead("valid_from").over(at).alias("valid_to"))


def attribute_history(df: DataFrame, entity: str, day: str, order: str, attributes: Mapping[str, Column]) -> DataFrame:
    """``change_log`` and ``combine_logs`` in one: every version of every entity."""
    return combine_logs(change_log(df, col(entity), col(day), col(order), attributes), list(attributes))
