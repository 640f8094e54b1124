"""Identities of agencies, offices, vehicles, classifications and places."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkledger.functions.text import col

PLACE_PARTS = ("country", "state", "county", "city", "zip")
# The projected columns that hold the parts of a place, by role.
RECIPIENT_PLACE = {"country": "recipient_country_code", "state": "recipient_state_code", "county": "prime_award_transaction_recipient_county_fips_code", "city": "recipient_city_name", "zip": "recipient_zip_4_code"}
PERFORMANCE_PLACE = {"country": "primary_place_of_performance_country_code", "state": "primary_place_of_performance_state_code", "county": "prime_award_transaction_place_of_performance_county_fips_code", "city": "primary_place_of_performance_city_name", "zip": "primary_place_of_performance_zip_4"}


def agency_id(tier: str, code: Column | str) -> Column:
    return F.concat(F.lit(f"{tier}:"), col(code))


def office_id(sub_agency: Column | str, office: Column | str) -> Column:
    """Null if either part is missing."""
    return F.concat(col(sub_agency), F.lit(":"), col(office))


def idv_id(piid: Column | str, award_key_agency: Column | str) -> Column:
    return F.concat(F.lit("CONT_IDV_"), col(piid), F.lit("_"), col(award_key_agency))


def classification_id(kind: str, code: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}:"), col(code))


def place(parts: Mapping[str, str]) -> dict[str, Column]:
    """The parts of a place as text, empty where missing, the city in lower case."""
    return {p: F.coalesce(F.lower(col(parts[p])) if p == "city" else col(parts[p]), F.lit("")) for p in PLACE_PARTS}


def location_id(parts: Mapping[str, str]) -> Column:
    """SHA-256 of the five parts joined by a unit separator, null for a place without any part."""
    own = list(place(parts).values())
    return F.when(F.concat(*own) != "", F.sha2(F.concat_ws("\x1f", *own), 256))


def granularity(parts: Mapping[str, str]) -> Column:
    """Which parts a place has, outermost first, joined by slashes."""
    return F.concat_ws("/", *[F.when(c != "", F.lit(p)) for p, c in place(parts).items()])
