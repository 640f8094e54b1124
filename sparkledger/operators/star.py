"""The star schema: transactions, awards and six reference tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkledger.functions.keys import PERFORMANCE_PLACE, RECIPIENT_PLACE, agency_id, classification_id, granularity, idv_id, location_id, office_id, place

AWARD, TXN, DAY = "contract_award_unique_key", "contract_transaction_unique_key", "action_date"
ACTIVITY = ("federal_action_obligation", "modification_number", "transaction_number", "action_type_code", "action_type", "transaction_description")
MONEY = {"observed_total_obligation": "total_dollars_obligated", "observed_current_value": "current_total_value_of_award", "observed_potential_value": "potential_total_value_of_award"}


def transactions(valid: DataFrame) -> DataFrame:
    return valid.select(F.col(TXN).alias("transaction_id"), F.col(AWARD).alias("award_id"), DAY, *ACTIVITY)


def latest_descriptors(observations: DataFrame, entity: str, identity: Sequence[str], descriptors: Sequence[str]) -> DataFrame:
    """One row per entity; each descriptor from the latest observation that has one.

    Observations carry _day, _txn and _rank. The latest day wins, then the least
    transaction, then the least rank, then the least value. One aggregate, map-side combined.
    """
    order = lambda d: F.struct(-F.unix_date("_day"), F.col("_txn"), F.col("_rank"), F.col(d))
    return observations.where(F.col(entity).isNotNull()).groupBy(entity).agg(
        *[F.max(c).alias(c) for c in identity],
        *[F.min_by(d, F.when(F.col(d).isNotNull(), order(d))).alias(d) for d in descriptors],
    )


def _observe(valid: DataFrame, branches: Sequence[dict[str, Column]]) -> DataFrame:
    """All branches of one scan: a row per branch, in the order given as _rank."""
    rows = [F.struct(*[c.alias(n) for n, c in b.items()], F.lit(i).alias("_rank")) for i, b in enumerate(branches)]
    return valid.select(F.col(DAY).alias("_day"), F.col(TXN).alias("_txn"), F.inline(F.array(*rows)))


def agencies(valid: DataFrame) -> DataFrame:
    branches = [
        {"agency_id": agency_id(tier, f"{role}_{part}_code"), "tier": F.lit(tier), "code": F.col(f"{role}_{part}_code"), "name": F.col(f"{role}_{part}_name")}
        for role in ("awarding", "funding")
        for tier, part in (("toptier", "agency"), ("subtier", "sub_agency"))
    ]
    return latest_descriptors(_observe(valid, branches), "agency_id", ("tier", "code"), ("name",))


def offices(valid: DataFrame) -> DataFrame:
    branches = [
        {"office_id": office_id(f"{r}_sub_agency_code", f"{r}_office_code"), "sub_agency_code": F.col(f"{r}_sub_agency_code"), "office_code": F.col(f"{r}_office_code"), "name": F.col(f"{r}_office_name")}
        for r in ("awarding", "funding")
    ]
    return latest_descriptors(_observe(valid, branches), "office_id", ("sub_agency_code", "office_code"), ("name",))


def recipients(valid: DataFrame) -> DataFrame:
    """Recipients, and a stub without name for every parent that is no recipient itself."""
    seen = latest_descriptors(_observe(valid, [{"uei": F.col("recipient_uei"), "name": F.col("recipient_name"), "parent_uei": F.col("recipient_parent_uei")}]), "uei", (), ("name", "parent_uei"))
    null = F.lit(None).cast("string")
    stubs = seen.select(F.col("parent_uei").alias("uei")).where("uei is not null").distinct().join(seen.select("uei"), "uei", "left_anti")
    return seen.unionByName(stubs.select("uei", null.alias("name"), null.alias("parent_uei")))


def classifications(valid: DataFrame) -> DataFrame:
    branches = [
        {"classification_id": classification_id(kind, code), "kind": F.lit(kind), "code": F.col(code), "description": F.col(text)}
        for kind, code, text in (("NAICS", "naics_code", "naics_description"), ("PSC", "product_or_service_code", "product_or_service_code_description"))
    ]
    return latest_descriptors(_observe(valid, branches), "classification_id", ("kind", "code"), ("description",))


def idvs(valid: DataFrame) -> DataFrame:
    piid, agency = "parent_award_id_piid", "parent_award_agency_id"
    branch = {"idv_id": idv_id(piid, agency), "piid": F.col(piid), "award_key_agency_id": F.col(agency), "hydration_status": F.lit("stub"), "type_code": F.col("parent_award_type_code"), "type_label": F.col("parent_award_type")}
    return latest_descriptors(_observe(valid, [branch]), "idv_id", ("piid", "award_key_agency_id", "hydration_status"), ("type_code", "type_label"))


def locations(valid: DataFrame) -> DataFrame:
    names = {"country": "country_code", "state": "state_code", "county": "county_fips", "city": "city_name", "zip": "zip_code"}
    rows = [F.struct(location_id(p).alias("location_id"), *[F.nullif(c, F.lit("")).alias(names[n]) for n, c in place(p).items()], granularity(p).alias("granularity")) for p in (RECIPIENT_PLACE, PERFORMANCE_PLACE)]
    return valid.select(F.inline(F.array(*rows))).where("location_id is not null").distinct()


def _topology() -> dict[str, Column]:
    return {
        "piid": F.col("award_id_piid"),
        "award_type_code": F.col("award_type_code"),
        "recipient_id": F.col("recipient_uei"),
        **{f"{r}_agency_id": agency_id("toptier", f"{r}_agency_code") for r in ("awarding", "funding")},
        **{f"{r}_sub_agency_id": agency_id("subtier", f"{r}_sub_agency_code") for r in ("awarding", "funding")},
        **{f"{r}_office_id": office_id(f"{r}_sub_agency_code", f"{r}_office_code") for r in ("awarding", "funding")},
        "parent_idv_id": idv_id("parent_award_id_piid", "parent_award_agency_id"),
        "naics_id": classification_id("NAICS", "naics_code"),
        "psc_id": classification_id("PSC", "product_or_service_code"),
        "recipient_location_id": location_id(RECIPIENT_PLACE),
        "place_of_performance_id": location_id(PERFORMANCE_PLACE),
        "base_description": F.col("prime_award_base_transaction_description"),
        "usaspending_permalink": F.col("usaspending_permalink"),
        "pop_start": F.col("period_of_performance_start_date"),
        "pop_end": F.col("period_of_performance_current_end_date"),
        "projection_transaction_id": F.col(TXN),
    }


def awards(valid: DataFrame) -> DataFrame:
    """One row per award from one aggregate by award.

    What the award is comes from its latest transaction, ties to the least id.
    Its money comes from the eligible transactions (number 0 or none) of the
    latest day that has one: the triple counts if they all agree and it is whole.
    The triples of each day are gathered in an aggregate by award and day first,
    so that a hot award is combined before it moves.
    """
    eligible = F.col("transaction_number").isNull() | (F.col("transaction_number") == "0")
    triple = F.struct(*[F.col(c).alias(n) for n, c in MONEY.items()])
    daily = valid.groupBy(F.col(AWARD).alias("award_id"), F.col(DAY).alias("day")).agg(
        F.min(F.struct(F.col(TXN).alias("k"), F.struct(*[c.alias(n) for n, c in _topology().items()]).alias("t"))).alias("top"),
        F.min(F.when(eligible, F.col(TXN))).alias("txn"),
        F.min(F.when(eligible, triple)).alias("lo"),
        F.max(F.when(eligible, triple)).alias("hi"),
    )
    eligible_day = F.when(F.col("txn").isNotNull(), F.col("day"))
    one = daily.groupBy("award_id").agg(F.max_by("top.t", "day").alias("t"), F.max_by(F.struct("txn", "lo", "hi"), eligible_day).alias("m"))
    money = [F.col(f"m.lo.{n}") for n in MONEY]
    some, whole = F.coalesce(*money).isNotNull(), money[0].isNotNull() & money[1].isNotNull() & money[2].isNotNull()
    agree = F.col("m.txn").isNotNull() & F.col("m.lo").eqNullSafe(F.col("m.hi"))
    status = F.when(~agree, F.lit("requires_enrichment")).when(~some, F.lit("not_observed")).when(whole, F.lit("defensible")).otherwise(F.lit("requires_enrichment"))
    out = one.select("award_id", "t.*", *[F.when(agree & whole, c).alias(n) for n, c in zip(MONEY, money, strict=True)], status.alias("snapshot_status"), F.col("m.txn").alias("_txn"))
    source = F.when(F.col("snapshot_status") == "requires_enrichment", F.lit("none")).otherwise(F.lit("transaction"))
    return out.select("*", source.alias("snapshot_source"), F.when(F.col("snapshot_status") == "defensible", F.col("_txn")).alias("snapshot_transaction_id"), F.lit(None).cast("date").alias("date_signed")).drop("_txn")


TABLES = {"transaction_fact": transactions, "award_record": awards, "ref_agencies": agencies, "ref_offices": offices, "ref_recipients": recipients, "ref_classifications": classifications, "ref_idvs": idvs, "ref_locations": locations}
KEYS = {"transaction_fact": "transaction_id", "award_record": "award_id", "ref_agencies": "agency_id", "ref_offices": "office_id", "ref_recipients": "uei", "ref_classifications": "classification_id", "ref_idvs": "idv_id", "ref_locations": "location_id"}


def build(valid: DataFrame) -> dict[str, DataFrame]:
    """All eight tables, lazily, from valid transactions (one row per transaction)."""
    return {name: f(valid) for name, f in TABLES.items()}
