"""Primary and foreign key checks of a star schema, as one union of aggregates."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkledger.operators.star import KEYS

# Which column of the awards points to which table.
AWARD_LINKS = {
    "recipient_id": "ref_recipients", "awarding_agency_id": "ref_agencies", "awarding_sub_agency_id": "ref_agencies", "funding_agency_id": "ref_agencies",
    "funding_sub_agency_id": "ref_agencies", "awarding_office_id": "ref_offices", "funding_office_id": "ref_offices", "parent_idv_id": "ref_idvs",
    "naics_id": "ref_classifications", "psc_id": "ref_classifications", "recipient_location_id": "ref_locations", "place_of_performance_id": "ref_locations",
}
LINKS = (("transaction_fact", "award_id", "award_record"), *[("award_record", c, t) for c, t in AWARD_LINKS.items()], ("award_record", "projection_transaction_id", "transaction_fact"), ("award_record", "snapshot_transaction_id", "transaction_fact"))


def check_integrity(tables: Mapping[str, DataFrame]) -> DataFrame:
    """check_name and n_bad of every check that finds something.

    Keys must be unique (pk:) and not null (pk_null:); a link that is not null
    must lead to a row (fk:, counted in rows of the pointing table). All links
    of a table are read in one scan and counted per value before the one join,
    so a hot value costs one row. Tables that are absent are not checked, nor
    links to them.
    """
    parts = []
    for name, key in KEYS.items():
        if name in tables:
            n, distinct, nulls = F.count("*"), F.count_distinct(key), F.count_if(F.col(key).isNull())
            counted = tables[name].agg((n - distinct).alias("dup"), nulls.alias("null"))
            parts.append(counted.select(F.inline(F.array(F.struct(F.lit(f"pk:{name}.{key}").alias("check_name"), F.col("dup").alias("n_bad")), F.struct(F.lit(f"pk_null:{name}.{key}").alias("check_name"), F.col("null").alias("n_bad"))))))
    used, targets = [], set()
    for name in dict.fromkeys(n for n, _, _ in LINKS if n in tables):
        links = [(c, target) for n, c, target in LINKS if n == name and target in tables]
        if links:
            targets |= {t for _, t in links}
            each = tables[name].select(F.inline(F.array(*[F.struct(F.lit(f"fk:{name}.{c}").alias("check_name"), F.lit(t).alias("target"), F.col(c).alias("k")) for c, t in links])))
            used.append(each.where("k is not null").groupBy("check_name", "target", "k").agg(F.count("*").alias("n")))
    if used:
        there = reduce(DataFrame.unionByName, [tables[t].select(F.lit(t).alias("target"), F.col(KEYS[t]).alias("k")) for t in sorted(targets)])
        lost = reduce(DataFrame.unionByName, used).join(there, ["target", "k"], "left_anti")
        parts.append(lost.groupBy("check_name").agg(F.sum("n").alias("n_bad")))
    return reduce(DataFrame.unionByName, parts).where("n_bad > 0")


def messages(found: DataFrame) -> list[str]:
    """check=count lines, sorted; at most one per check."""
    return sorted(f"{r['check_name']}={r['n_bad']}" for r in found.collect())
