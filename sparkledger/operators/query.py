"""Selections of awards, activity in a date window, related entities and cards."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame]

#: Ids up to which a filter is a literal list; longer lists become a relation that is joined.
MAX_LITERALS = 300

# Filter name and the columns of the awards that it looks at.
FILTERS = {
    "award_ids": "award_id", "recipient_ids": "recipient_id", "awarding_agency_ids": "awarding_agency_id", "awarding_sub_agency_ids": "awarding_sub_agency_id",
    "awarding_office_ids": "awarding_office_id", "funding_agency_ids": "funding_agency_id", "funding_sub_agency_ids": "funding_sub_agency_id",
    "funding_office_ids": "funding_office_id", "parent_idv_ids": "parent_idv_id", "naics_ids": "naics_id", "psc_ids": "psc_id",
}
PLACE_COLUMNS = {"recipient": "recipient_location_id", "place_of_performance": "place_of_performance_id"}
PLACE_FIELDS = ("country_code", "state_code", "county_fips", "city_name", "zip_code")
ENTITY_KINDS = ("recipient", "agency", "office", "idv", "location", "classification")
ROLES = ("awarding", "funding", "recipient", "place_of_performance")


@dataclass(frozen=True)
class PlaceFilter:
    """Awards whose place in ``role`` is among the ids (a collection, or a relation with location_id) and has the given parts."""

    role: str
    location_ids: Collection[str] | DataFrame | None = None
    country_code: str | None = None
    state_code: str | None = None
    county_fips: str | None = None
    city_name: str | None = None
    zip_code: str | None = None

    def parts(self) -> dict[str, str]:
        given = {f: (getattr(self, f) or "").strip() for f in PLACE_FIELDS}
        return {f: v.lower() if f == "city_name" else v for f, v in given.items() if v}


def _among(awards: DataFrame, column: str, ids: Collection[str] | DataFrame) -> DataFrame:
    """An empty collection leaves nothing; a relation is joined, never collected."""
    if isinstance(ids, DataFrame):
        return awards.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")
    ids = sorted(set(ids))
    if not ids:
        return awards.where("false")
    if len(ids) <= MAX_LITERALS:
        return awards.where(F.col(column).isin(ids))
    relation = awards.sparkSession.createDataFrame([(i,) for i in ids], f"{column} string")
    return awards.join(relation, column, "left_semi")


def resolve(tables: Tables, place: PlaceFilter | None = None, **ids: Collection[str] | None) -> DataFrame:
    """award_id of the awards that pass every filter.

    A filter that is None doesn't constrain; an empty one leaves nothing. Parts
    of a place match exactly after trimming, the city in any case.
    """
    awards = tables["award_record"]
    for name, values in ids.items():
        if name not in FILTERS:
            raise ValueError(f"no filter named {name}")
        if values is not None:
            awards = _among(awards, FILTERS[name], values)
    if place is not None:
        if place.role not in PLACE_COLUMNS:
            raise ValueError(f"no place has the role {place.role}")
        parts = place.parts()
        if place.location_ids is None and not parts:
            raise ValueError("a place filter needs ids or a part")
        column = PLACE_COLUMNS[place.role]
        if place.location_ids is not None:
            awards = _among(awards, column, place.location_ids)
        if parts:
            where = tables["ref_locations"]
            for f, v in parts.items():
                where = where.where(F.col(f) == v)
            awards = awards.join(where.select(F.col("location_id").alias(column)), column, "left_semi")
    return awards.select("award_id").distinct()


def select_ids(tables: Tables, ids: Collection[str]) -> DataFrame:
    """A selection of the ids given, known or not; unknown ones drop out where it is joined."""
    return tables["award_record"].sparkSession.createDataFrame([(i,) for i in sorted(set(ids))], "award_id string")


def _window(tables: Tables, selection: DataFrame, start: date, end: date) -> DataFrame:
    if start > end:
        raise ValueError("the window ends before it starts")
    acts = tables["transaction_fact"].where(F.col("action_date").between(F.lit(start), F.lit(end)))
    # one row per award before the join: a hot award is combined where it lies
    per_award = acts.groupBy("award_id").agg(F.sum(F.col("federal_action_obligation").cast("decimal(38,2)")).alias("total"), F.count("*").alias("n"))
    return per_award.join(selection, "award_id", "left_semi")


def _limited(df: DataFrame, order: Sequence[Column], limit: int | None) -> DataFrame:
    if limit is not None and limit < 0:
        raise ValueError("the limit must not be negative")
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def activity_by_award(tables: Tables, selection: DataFrame, start: date, end: date, limit: int | None = None) -> DataFrame:
    """Obligations of each selected award in the window, highest first, ties by id.

    Transactions without an amount count but add nothing; an award with none
    that has one is left out.
    """
    totals = _window(tables, selection, start, end).where("total is not null")
    rows = totals.join(tables["award_record"].select("award_id", "piid", "recipient_id", "usaspending_permalink"), "award_id")
    rows = rows.select("award_id", "piid", "recipient_id", "usaspending_permalink", F.col("total").alias("total_obligation"), F.col("n").alias("transaction_count"))
    return _limited(rows, (F.desc("total_obligation"), F.asc("award_id")), limit)


def activity_by_recipient(tables: Tables, selection: DataFrame, start: date, end: date, limit: int | None = None) -> DataFrame:
    """The same per recipient; awards without one are left out."""
    awards = tables["award_record"].select("award_id", "recipient_id").where("recipient_id is not null")
    totals = _window(tables, selection, start, end).join(awards, "award_id").groupBy("recipient_id").agg(F.sum("total").cast("decimal(38,2)").alias("total_obligation"), F.sum("n").alias("transaction_count"))
    named = totals.where("total_obligation is not null").join(tables["ref_recipients"].select(F.col("uei").alias("recipient_id"), F.col("name").alias("recipient_name")), "recipient_id", "left")
    return _limited(named, (F.desc("total_obligation"), F.asc("recipient_id")), limit)


# The twelve links that lead from an award to another entity: kind, role, tier, column.
EDGES = (
    ("recipient", None, None, "recipient_id"), ("agency", "awarding", "toptier", "awarding_agency_id"), ("agency", "awarding", "subtier", "awarding_sub_agency_id"),
    ("agency", "funding", "toptier", "funding_agency_id"), ("agency", "funding", "subtier", "funding_sub_agency_id"), ("office", "awarding", None, "awarding_office_id"),
    ("office", "funding", None, "funding_office_id"), ("idv", None, None, "parent_idv_id"), ("location", "recipient", None, "recipient_location_id"),
    ("location", "place_of_performance", None, "place_of_performance_id"), ("classification", None, None, "naics_id"), ("classification", None, None, "psc_id"),
)


def entities(tables: Tables, kinds: Collection[str] = ENTITY_KINDS) -> DataFrame:
    """Every entity of the given kinds that an award can lead to: entity_kind, entity_id, label and details."""
    null = F.lit(None).cast("string")

    def rows(kind: str, source: str, key: str, label: Column, **details: Column) -> DataFrame:
        all_details = {"code": null, "description": null, "idv_agency_id": null, **dict.fromkeys([*PLACE_FIELDS, "granularity"], null), **details}
        return tables[source].select(F.lit(kind).alias("entity_kind"), F.col(key).alias("entity_id"), label.alias("label"), *[c.alias(n) for n, c in all_details.items()])

    every = {
        "recipient": lambda: rows("recipient", "ref_recipients", "uei", F.col("name")),
        "agency": lambda: rows("agency", "ref_agencies", "agency_id", F.col("name")),
        "office": lambda: rows("office", "ref_offices", "office_id", F.col("name")),
        "idv": lambda: rows("idv", "ref_idvs", "idv_id", F.col("piid"), idv_agency_id=F.col("award_key_agency_id")),
        "location": lambda: rows("location", "ref_locations", "location_id", null, **{f: F.col(f) for f in (*PLACE_FIELDS, "granularity")}),
        "classification": lambda: rows("classification", "ref_classifications", "classification_id", F.coalesce("description", "code"), code=F.col("code"), description=F.col("description")),
    }
    own = [make() for kind, make in every.items() if kind in kinds] or [every["recipient"]().where("false")]
    out = own[0]
    for o in own[1:]:
        out = out.unionByName(o)
    return out


def traverse(tables: Tables, selection: DataFrame, include: Collection[str] | None = None) -> DataFrame:
    """Entities one hop from the selected awards, once per kind, role and id.

    ``include`` limits the kinds: None is all, empty none. The tier of an agency
    is that of the link. Ordered by kind, role, tier and id, in their own orders.
    """
    kinds = ENTITY_KINDS if include is None else tuple(include)
    if unknown := set(kinds) - set(ENTITY_KINDS):
        raise ValueError(f"no such kind of entity: {sorted(unknown)}")
    edges = [F.struct(F.lit(k).alias("entity_kind"), F.lit(r).cast("string").alias("role"), F.lit(t).cast("string").alias("agency_tier"), F.col(c).alias("entity_id")) for k, r, t, c in EDGES if k in kinds]
    if not edges:
        edges = [F.struct(*[F.lit(None).cast("string").alias(n) for n in ("entity_kind", "role", "agency_tier", "entity_id")])]
    hops = tables["award_record"].join(selection, "award_id", "left_semi").select(F.inline(F.array(*edges))).where("entity_id is not null")
    hops = hops.groupBy("entity_kind", "role", "entity_id").agg(F.max("agency_tier").alias("agency_tier"))
    found = hops.join(entities(tables, kinds), ["entity_kind", "entity_id"])
    place = lambda names, c: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c))
    order = (place(ENTITY_KINDS, "entity_kind"), F.coalesce(place(ROLES, "role"), F.lit(0)), F.coalesce(place(("toptier", "subtier"), "agency_tier"), F.lit(0)), F.col("entity_id"))
    return found.orderBy(*order)


def cards(tables: Tables, award_ids: DataFrame) -> DataFrame:
    """What is cited of an award: identity, names, classes and place of performance."""
    a = tables["award_record"].join(award_ids.select("award_id").distinct(), "award_id", "left_semi")

    def add(df: DataFrame, source: str, key: str, fk: str, **columns: str) -> DataFrame:
        return df.join(tables[source].select(F.col(key).alias(fk), *[F.col(c).alias(n) for n, c in columns.items()]), fk, "left")

    a = add(a, "ref_recipients", "uei", "recipient_id", recipient_name="name")
    a = add(a, "ref_agencies", "agency_id", "awarding_agency_id", awarding_agency_name="name")
    a = add(a, "ref_agencies", "agency_id", "awarding_sub_agency_id", awarding_sub_agency_name="name")
    a = add(a, "ref_offices", "office_id", "awarding_office_id", awarding_office_name="name")
    a = add(a, "ref_classifications", "classification_id", "naics_id", naics_code="code", naics_description="description")
    a = add(a, "ref_classifications", "classification_id", "psc_id", psc_code="code", psc_description="description")
    a = add(a, "ref_locations", "location_id", "place_of_performance_id", **{f"pop_{f}": f for f in (*PLACE_FIELDS, "granularity")})
    return a.select(
        "award_id", "piid", "award_type_code", "recipient_id", "recipient_name", "base_description", "awarding_agency_id", "awarding_agency_name", "awarding_sub_agency_id",
        "awarding_sub_agency_name", "awarding_office_id", "awarding_office_name", "naics_id", "naics_code", "naics_description", "psc_id", "psc_code", "psc_description",
        "place_of_performance_id", *[f"pop_{f}" for f in (*PLACE_FIELDS, "granularity")], "usaspending_permalink",
    )


def first_ids(selection: DataFrame, n: int) -> DataFrame:
    return selection.orderBy("award_id").limit(n)


def overlay_money(awards: DataFrame, details: DataFrame) -> DataFrame:
    """Awards with the money of fetched details where the own money is not settled.

    ``details`` have award_id, total_obligation, current_value, potential_value,
    date_signed as text. Only awards that require enrichment take money; with
    all three amounts they are defensible, else they still require it.
    """
    amounts = {"observed_total_obligation": "total_obligation", "observed_current_value": "current_value", "observed_potential_value": "potential_value"}
    d = details.select("award_id", *[F.trim(c).try_cast("decimal(20,2)").alias(f"_{c}") for c in amounts.values()], F.substring(F.trim("date_signed"), 1, 10).try_cast("date").alias("_signed"), F.lit(True).alias("_known"))
    joined = awards.join(d, "award_id", "left")
    takes = F.col("_known") & (F.col("snapshot_status") == "requires_enrichment")
    whole = F.col("_total_obligation").isNotNull() & F.col("_current_value").isNotNull() & F.col("_potential_value").isNotNull()
    new = {
        **{c: F.when(takes, F.col(f"_{s}")).otherwise(F.col(c)) for c, s in amounts.items()},
        "snapshot_status": F.when(takes & whole, F.lit("defensible")).otherwise(F.col("snapshot_status")),
        "snapshot_source": F.when(takes, F.lit("award_detail")).otherwise(F.col("snapshot_source")),
        "date_signed": F.coalesce("_signed", "date_signed"),
    }
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in awards.columns])


def overlay_idvs(idvs: DataFrame, details: DataFrame) -> DataFrame:
    """Vehicles with type code and label of fetched details where these have them."""
    d = details.select("idv_id", F.nullif(F.trim("type_code"), F.lit("")).alias("_code"), F.nullif(F.trim("type_label"), F.lit("")).alias("_label"), F.lit(True).alias("_known"))
    new = {"type_code": F.coalesce("_code", "type_code"), "type_label": F.coalesce("_label", "type_label"), "hydration_status": F.when(F.col("_known"), F.lit("hydrated")).otherwise(F.col("hydration_status"))}
    return idvs.join(d, "idv_id", "left").select(*[new.get(c, F.col(c)).alias(c) for c in idvs.columns])
