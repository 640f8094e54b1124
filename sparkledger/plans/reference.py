"""Queries over the project's own operators, with independent SQL twins.

The SQL takes the long way (ranked rows and joins) where the operators use one
aggregate, so that the two check each other.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkledger.functions import keys
from sparkledger.functions.text import blank_as_null, collapse_space, fold_key, non_blank, to_date, to_money
from sparkledger.operators import query as q
from sparkledger.operators import semantic, star, validate
from sparkledger.operators.integrity import check_integrity
from sparkledger.plans.registry import Registry
from sparkledger.sources.columns import DATES, MONEY, PROJECTED, REQUIRED
from sparkledger.sources.tables import table

R = Registry()

# --- scalar expressions ---


@R.add("f01_blank_trim", "select _load_seq, nullif(trim(recipient_name), '') as recipient_name, nullif(trim(action_date), '') as action_date from staging_raw")
def f01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "staging_raw").select("_load_seq", *[blank_as_null(c).alias(c) for c in ("recipient_name", "action_date")])


@R.add("f02_money_cast", "select _load_seq, " + ", ".join(f"try_cast(nullif(trim({c}), '') as decimal(20,2)) as {c}" for c in MONEY) + " from staging_raw")
def f02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "staging_raw").select("_load_seq", *[to_money(c).alias(c) for c in MONEY])


DATE_SQL = "case when regexp_full_match(nullif(trim({c}), ''), '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}([T ]\\d{{2}}:\\d{{2}}:\\d{{2}})?') then try_cast(nullif(trim({c}), '') as date) end"


@R.add("f03_date_cast", "select _load_seq, " + ", ".join(f"{DATE_SQL.format(c=c)} as {c}" for c in DATES) + " from staging_raw")
def f03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "staging_raw").select("_load_seq", *[to_date(c).alias(c) for c in DATES])


def _assess_sql() -> str:
    norm = ", ".join(f"nullif(trim({c}), '') as {c}" for c in PROJECTED)
    reasons = [f"case when {c} is null then 'missing_required:{c}' end" for c in REQUIRED]
    reasons += [f"case when {c} is not null and {DATE_SQL.format(c=c)} is null then 'malformed:{c}' end" for c in DATES]
    reasons += [f"case when {c} is not null and try_cast({c} as decimal(20,2)) is null then 'malformed:{c}' end" for c in MONEY]
    content = ", ".join(f"coalesce({c}, '')" for c in PROJECTED)
    return f"""with norm as (select {norm}, _source_path, _input_index, _load_seq from staging_raw),
assessed as (select *, nullif(concat_ws('; ', {", ".join(reasons)}), '') as reject_reason, sha256(concat_ws(chr(31), {content})) as content_hash from norm),
collided as (select contract_transaction_unique_key as k from assessed where reject_reason is null group by 1 having count(distinct content_hash) > 1),
sound as (select * from assessed where reject_reason is null and contract_transaction_unique_key not in (select k from collided)),
firsts as (select * from sound qualify row_number() over (partition by contract_transaction_unique_key order by _load_seq) = 1)
"""


ASSESS = _assess_sql()


@R.add("f04_reject_reason", ASSESS + "select _load_seq, reject_reason from assessed")
def f04(spark: SparkSession, d: str) -> DataFrame:
    return validate.normalised(table(spark, d, "staging_raw")).select("_load_seq", validate.reject_reason().alias("reject_reason"))


@R.add("f05_content_hash", ASSESS + "select _load_seq, content_hash from assessed")
def f05(spark: SparkSession, d: str) -> DataFrame:
    return validate.normalised(table(spark, d, "staging_raw")).select("_load_seq", validate.content_hash().alias("content_hash"))


def _place_sql(role: str, p: dict[str, str]) -> dict[str, str]:
    part = {k: f"coalesce({'lower(' + c + ')' if k == 'city' else c}, '')" for k, c in p.items()}
    joined = ", ".join(part[k] for k in keys.PLACE_PARTS)
    some = " or ".join(f"{part[k]} <> ''" for k in keys.PLACE_PARTS)
    names = {"country": "country_code", "state": "state_code", "county": "county_fips", "city": "city_name", "zip": "zip_code"}
    return {
        "id": f"case when {some} then sha256(concat_ws(chr(31), {joined})) end",
        "granularity": "concat_ws('/', " + ", ".join(f"case when {part[k]} <> '' then '{k}' end" for k in keys.PLACE_PARTS) + ")",
        "parts": ", ".join(f"nullif({part[k]}, '') as {names[k]}" for k in keys.PLACE_PARTS),
        "some": some,
    }


RECIPIENT, PERFORMANCE = _place_sql("recipient", keys.RECIPIENT_PLACE), _place_sql("performance", keys.PERFORMANCE_PLACE)


@R.add("f06_entity_ids", """select _load_seq, 'toptier:' || awarding_agency_code as agency_id, awarding_sub_agency_code || ':' || awarding_office_code as office_id,
  'CONT_IDV_' || parent_award_id_piid || '_' || parent_award_agency_id as idv_id, 'NAICS:' || naics_code as naics_id from staging_valid""")
def f06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "staging_valid").select("_load_seq", keys.agency_id("toptier", "awarding_agency_code").alias("agency_id"), keys.office_id("awarding_sub_agency_code", "awarding_office_code").alias("office_id"), keys.idv_id("parent_award_id_piid", "parent_award_agency_id").alias("idv_id"), keys.classification_id("NAICS", "naics_code").alias("naics_id"))


@R.add("f07_location_id_granularity", f"select _load_seq, {RECIPIENT['id']} as location_id, {RECIPIENT['granularity']} as granularity from staging_valid")
def f07(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "staging_valid").select("_load_seq", keys.location_id(keys.RECIPIENT_PLACE).alias("location_id"), keys.granularity(keys.RECIPIENT_PLACE).alias("granularity"))


@R.add("f08_collapse_space", "select doc_id, nullif(trim(regexp_replace(text, '[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{0b}]+', ' ', 'g'), ' '), '') as text from documents")
def f08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", collapse_space("text").alias("text"))


# --- validation ---


@R.add("v01_collisions", ASSESS + "select _load_seq, contract_transaction_unique_key from assessed where reject_reason is null and contract_transaction_unique_key in (select k from collided)")
def v01(spark: SparkSession, d: str) -> DataFrame:
    return validate.assess(table(spark, d, "staging_raw")).where("_collides").select("_load_seq", "contract_transaction_unique_key")


@R.add("v02_dedupe_keep_first", ASSESS + "select contract_transaction_unique_key, _load_seq, content_hash from firsts")
def v02(spark: SparkSession, d: str) -> DataFrame:
    return validate.valid(validate.assess(table(spark, d, "staging_raw"))).select("contract_transaction_unique_key", "_load_seq", F.col("_content_hash").alias("content_hash"))


@R.add("v03_validate_counts", ASSESS + """select (select count(*) from assessed) as rows_in, (select count(*) from assessed where reject_reason is not null) as invalid,
  (select count(*) from assessed where reject_reason is null and contract_transaction_unique_key in (select k from collided)) as collision,
  (select count(*) from sound) - (select count(*) from firsts) as collapsed, (select count(*) from firsts) as valid""")
def v03(spark: SparkSession, d: str) -> DataFrame:
    return validate.counts(validate.assess(table(spark, d, "staging_raw")))


@R.add("v04_rejects", ASSESS + f"""select _source_path, _input_index, _load_seq, case when reject_reason is null then 'identity_collision' else reject_reason end as reject_reason, {", ".join(PROJECTED)}
from assessed where reject_reason is not null or contract_transaction_unique_key in (select k from collided)""")
def v04(spark: SparkSession, d: str) -> DataFrame:
    return validate.rejects(validate.assess(table(spark, d, "staging_raw")))


# --- star schema, from staging_valid with one row per transaction ---


def _valid(spark: SparkSession, d: str) -> DataFrame:
    return validate.once(table(spark, d, "staging_valid"))


ONCE = "with v as (select *, action_date as _day, contract_transaction_unique_key as _txn from staging_valid qualify row_number() over (partition by contract_transaction_unique_key order by _load_seq) = 1)"


def _ref_sql(branches: str, key: str, identity: tuple[str, ...], descriptors: tuple[str, ...]) -> str:
    """Ids with their identity, left joined with each descriptor's own latest row."""
    parts = [f"{ONCE}, obs as ({branches}), ids as (select {key}, {''.join(f'max({c}) as {c}, ' for c in identity)}1 as one from obs where {key} is not null group by {key})"]
    for x in descriptors:
        parts.append(f"d_{x} as (select {key}, {x} from obs where {key} is not null and {x} is not null qualify row_number() over (partition by {key} order by _day desc, _txn, _rank, {x}) = 1)")
    joins = "".join(f" left join d_{x} using ({key})" for x in descriptors)
    return ", ".join(parts) + f" select {key}, {', '.join([*identity, *descriptors])} from ids{joins}"


AGENCY_SQL = " union all ".join(
    f"select '{t}:' || {r}_{p}_code as agency_id, '{t}' as tier, {r}_{p}_code as code, {r}_{p}_name as name, _day, _txn, {i} as _rank from v"
    for i, (r, t, p) in enumerate((r, t, p) for r in ("awarding", "funding") for t, p in (("toptier", "agency"), ("subtier", "sub_agency")))
)
OFFICE_SQL = " union all ".join(f"select {r}_sub_agency_code || ':' || {r}_office_code as office_id, {r}_sub_agency_code as sub_agency_code, {r}_office_code as office_code, {r}_office_name as name, _day, _txn, {i} as _rank from v" for i, r in enumerate(("awarding", "funding")))
RECIPIENT_SQL = "select recipient_uei as uei, recipient_name as name, recipient_parent_uei as parent_uei, _day, _txn, 0 as _rank from v"
CLASS_SQL = " union all ".join(f"select '{k}:' || {c} as classification_id, '{k}' as kind, {c} as code, {t} as description, _day, _txn, {i} as _rank from v" for i, (k, c, t) in enumerate((("NAICS", "naics_code", "naics_description"), ("PSC", "product_or_service_code", "product_or_service_code_description"))))
IDV_SQL = "select 'CONT_IDV_' || parent_award_id_piid || '_' || parent_award_agency_id as idv_id, parent_award_id_piid as piid, parent_award_agency_id as award_key_agency_id, 'stub' as hydration_status, parent_award_type_code as type_code, parent_award_type as type_label, _day, _txn, 0 as _rank from v"
SEEN_SQL = _ref_sql(RECIPIENT_SQL, "uei", (), ("name", "parent_uei"))
REF_SQL = {
    "m02_ref_agencies": _ref_sql(AGENCY_SQL, "agency_id", ("tier", "code"), ("name",)),
    "m03_ref_offices": _ref_sql(OFFICE_SQL, "office_id", ("sub_agency_code", "office_code"), ("name",)),
    "m04_ref_recipients_stubs": f"with seen as ({SEEN_SQL}) select * from seen union all select distinct parent_uei, null, null from seen where parent_uei is not null and parent_uei not in (select uei from seen)",
    "m05_ref_classifications": _ref_sql(CLASS_SQL, "classification_id", ("kind", "code"), ("description",)),
    "m06_ref_idvs": _ref_sql(IDV_SQL, "idv_id", ("piid", "award_key_agency_id", "hydration_status"), ("type_code", "type_label")),
    "m07_ref_locations": ONCE + " " + " union ".join(f"select {p['id']} as location_id, {p['parts']}, {p['granularity']} as granularity from v where {p['some']}" for p in (RECIPIENT, PERFORMANCE)),
    "m01_transaction_fact": ONCE + f" select contract_transaction_unique_key as transaction_id, contract_award_unique_key as award_id, action_date, {', '.join(star.ACTIVITY)} from v",
}
for _name, _table in (("m01_transaction_fact", "transaction_fact"), ("m02_ref_agencies", "ref_agencies"), ("m03_ref_offices", "ref_offices"), ("m04_ref_recipients_stubs", "ref_recipients"), ("m05_ref_classifications", "ref_classifications"), ("m06_ref_idvs", "ref_idvs"), ("m07_ref_locations", "ref_locations")):
    R.add(_name, REF_SQL[_name])(lambda spark, d, t=_table: star.TABLES[t](_valid(spark, d)))

AWARD_SQL = f"""{ONCE}, topology as (select * from v qualify row_number() over (partition by contract_award_unique_key order by action_date desc, contract_transaction_unique_key) = 1),
eligible as (select * from v where transaction_number is null or transaction_number = '0'),
latest as (select contract_award_unique_key as a, max(action_date) as day from eligible group by 1),
money as (select e.contract_award_unique_key as a, min(contract_transaction_unique_key) as txn, any_value(total_dollars_obligated) as t, any_value(current_total_value_of_award) as c, any_value(potential_total_value_of_award) as p,
  count(distinct concat_ws('|', coalesce(total_dollars_obligated::varchar, ''), coalesce(current_total_value_of_award::varchar, ''), coalesce(potential_total_value_of_award::varchar, ''))) as n
  from eligible e join latest l on e.contract_award_unique_key = l.a and e.action_date = l.day group by 1),
status as (select x.*, m.txn, m.t, m.c, m.p, case when m.a is null or m.n > 1 then 'requires_enrichment' when m.t is null and m.c is null and m.p is null then 'not_observed'
  when m.t is null or m.c is null or m.p is null then 'requires_enrichment' else 'defensible' end as s from topology x left join money m on m.a = x.contract_award_unique_key)
select contract_award_unique_key as award_id, award_id_piid as piid, award_type_code, recipient_uei as recipient_id, 'toptier:' || awarding_agency_code as awarding_agency_id, 'subtier:' || awarding_sub_agency_code as awarding_sub_agency_id,
  awarding_sub_agency_code || ':' || awarding_office_code as awarding_office_id, 'toptier:' || funding_agency_code as funding_agency_id, 'subtier:' || funding_sub_agency_code as funding_sub_agency_id,
  funding_sub_agency_code || ':' || funding_office_code as funding_office_id, 'CONT_IDV_' || parent_award_id_piid || '_' || parent_award_agency_id as parent_idv_id, 'NAICS:' || naics_code as naics_id,
  'PSC:' || product_or_service_code as psc_id, {RECIPIENT['id']} as recipient_location_id, {PERFORMANCE['id']} as place_of_performance_id, prime_award_base_transaction_description as base_description, usaspending_permalink,
  period_of_performance_start_date as pop_start, period_of_performance_current_end_date as pop_end, contract_transaction_unique_key as projection_transaction_id,
  case when s = 'defensible' then t end as observed_total_obligation, case when s = 'defensible' then c end as observed_current_value, case when s = 'defensible' then p end as observed_potential_value,
  s as snapshot_status, case when s = 'requires_enrichment' then 'none' else 'transaction' end as snapshot_source, case when s = 'defensible' then txn end as snapshot_transaction_id, cast(null as date) as date_signed
from status"""


@R.add("m10_award_record", AWARD_SQL)
def m10(spark: SparkSession, d: str) -> DataFrame:
    return star.awards(_valid(spark, d))


@R.add("m08_award_topology", f"select award_id, projection_transaction_id, recipient_id, awarding_office_id from ({AWARD_SQL})")
def m08(spark: SparkSession, d: str) -> DataFrame:
    return star.awards(_valid(spark, d)).select("award_id", "projection_transaction_id", "recipient_id", "awarding_office_id")


@R.add("m09_award_snapshot", f"select snapshot_status, snapshot_source, count(*) as n_awards, cast(sum(observed_total_obligation) as decimal(38,2)) as total from ({AWARD_SQL}) group by all")
def m09(spark: SparkSession, d: str) -> DataFrame:
    return star.awards(_valid(spark, d)).groupBy("snapshot_status", "snapshot_source").agg(F.count("*").alias("n_awards"), F.sum("observed_total_obligation").cast("decimal(38,2)").alias("total"))


# --- integrity ---


@R.add("c01_integrity_clean", "select '' as check_name, cast(0 as bigint) as n_bad where false")
def c01(spark: SparkSession, d: str) -> DataFrame:
    """What the build of one set of transactions makes is sound: no rows."""
    return check_integrity(star.build(_valid(spark, d)))


@R.add("c02_integrity_broken", """
select * from (
  select 'pk:transaction_fact.transaction_id' as check_name, count(*) - count(distinct transaction_id) as n_bad from transaction_fact
  union all select 'pk_null:transaction_fact.transaction_id', count(*) filter (where transaction_id is null) from transaction_fact
  union all select 'pk:award_record.award_id', count(*) - count(distinct award_id) from award_record
  union all select 'pk_null:award_record.award_id', count(*) filter (where award_id is null) from award_record
  union all select 'pk:ref_classifications.classification_id', count(*) - count(distinct classification_id) from ref_classifications
  union all select 'pk_null:ref_classifications.classification_id', count(*) filter (where classification_id is null) from ref_classifications
  union all select 'pk:ref_recipients.uei', count(*) - count(distinct uei) from ref_recipients
  union all select 'pk_null:ref_recipients.uei', count(*) filter (where uei is null) from ref_recipients
  union all select 'fk:transaction_fact.award_id', count(*) from transaction_fact t where award_id is not null and not exists (select 1 from award_record a where a.award_id = t.award_id)
  union all select 'fk:award_record.recipient_id', count(*) from award_record a where recipient_id is not null and not exists (select 1 from ref_recipients r where r.uei = a.recipient_id)
  union all select 'fk:award_record.naics_id', count(*) from award_record a where naics_id is not null and not exists (select 1 from ref_classifications c where c.classification_id = a.naics_id)
  union all select 'fk:award_record.psc_id', count(*) from award_record a where psc_id is not null and not exists (select 1 from ref_classifications c where c.classification_id = a.psc_id)
  union all select 'fk:award_record.projection_transaction_id', count(*) from award_record a where projection_transaction_id is not null and not exists (select 1 from transaction_fact t where t.transaction_id = a.projection_transaction_id)
  union all select 'fk:award_record.snapshot_transaction_id', count(*) from award_record a where snapshot_transaction_id is not null and not exists (select 1 from transaction_fact t where t.transaction_id = a.snapshot_transaction_id)
) where n_bad > 0""")
def c02(spark: SparkSession, d: str) -> DataFrame:
    """The delivered tables, whose reference table of recipients is a log of snapshots and not unique."""
    return check_integrity({n: table(spark, d, n) for n in ("transaction_fact", "award_record", "ref_classifications", "ref_recipients")})


# --- queries on the delivered facts, with the current state of the reference tables ---


def dataset(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Facts as delivered; each reference entity with its latest non-blank values; places and vehicles from staging."""

    def now(source: str, key: str, **fields: str) -> DataFrame:
        at = F.struct("observed_on", "row_id")
        return table(spark, d, source).groupBy(key).agg(*[F.max_by(non_blank(c), F.when(non_blank(c).isNotNull(), at)).alias(n) for n, c in fields.items()])

    staged = table(spark, d, "staging_valid")
    return {
        "transaction_fact": table(spark, d, "transaction_fact"),
        "award_record": table(spark, d, "award_record"),
        "ref_recipients": now("ref_recipients", "uei", name="name", parent_uei="parent_uei"),
        "ref_agencies": now("ref_agencies", "agency_id", name="name"),
        "ref_offices": now("ref_offices", "office_id", name="name"),
        "ref_classifications": table(spark, d, "ref_classifications"),
        "ref_idvs": star.idvs(staged),
        "ref_locations": star.locations(staged),
    }


def _now_sql(name: str, key: str, *fields: str) -> str:
    b = "nullif(case when upper(trim({c}, ' ')) in ('N/A', 'UNKNOWN', 'NOT AVAILABLE', '-') then null else trim({c}, ' ') end, '')"
    cols = ", ".join(f"max_by({b.format(c=c)}, struct_pack(a := observed_on, b := row_id)) filter (where {b.format(c=c)} is not null) as {c}" for c in fields)
    return f"(select {key}, {cols} from {name} group by {key})"


STAGED = "select *, action_date as _day, contract_transaction_unique_key as _txn from staging_valid"
RECIPIENTS, AGENCIES, OFFICES = _now_sql("ref_recipients", "uei", "name", "parent_uei"), _now_sql("ref_agencies", "agency_id", "name"), _now_sql("ref_offices", "office_id", "name")
LOCATIONS = "(" + REF_SQL["m07_ref_locations"].replace(ONCE, f"with v as ({STAGED})") + ")"
IDVS = "(" + REF_SQL["m06_ref_idvs"].replace(ONCE, f"with v as ({STAGED})") + ")"

FROM, TO = date(2023, 1, 1), date(2024, 12, 31)
AGENCY_IDS = ["toptier:901", "toptier:931", "toptier:971"]
NAICS_LIKE = "substr(naics_id, 1, 9) = 'NAICS:814'"


@R.add("q01_resolve_all", "select distinct award_id from award_record")
def q01(spark: SparkSession, d: str) -> DataFrame:
    return q.resolve(dataset(spark, d))


@R.add("q02_resolve_ids", f"select distinct award_id from award_record where awarding_agency_id in ({', '.join(repr(x) for x in AGENCY_IDS)})")
def q02(spark: SparkSession, d: str) -> DataFrame:
    return q.resolve(dataset(spark, d), awarding_agency_ids=AGENCY_IDS)


@R.add("q03_resolve_and", f"select distinct award_id from award_record where awarding_agency_id in ({', '.join(repr(x) for x in AGENCY_IDS)}) and recipient_id in ('U000BPUKF361', 'VUNM2TQULCSY') and funding_agency_id in ('toptier:931', 'toptier:961')")
def q03(spark: SparkSession, d: str) -> DataFrame:
    return q.resolve(dataset(spark, d), awarding_agency_ids=AGENCY_IDS, recipient_ids=["U000BPUKF361", "VUNM2TQULCSY"], funding_agency_ids=["toptier:931", "toptier:961"])


@R.add("q04_resolve_empty", "select award_id from award_record where false")
def q04(spark: SparkSession, d: str) -> DataFrame:
    return q.resolve(dataset(spark, d), psc_ids=[])


@R.add("q05_location_ids", f"select distinct award_id from award_record where recipient_location_id in (select location_id from {LOCATIONS} where state_code = 'VA')")
def q05(spark: SparkSession, d: str) -> DataFrame:
    t = dataset(spark, d)
    return q.resolve(t, q.PlaceFilter("recipient", location_ids=t["ref_locations"].where("state_code = 'VA'").select("location_id")))


@R.add("q06_location_struct", f"select distinct award_id from award_record where place_of_performance_id in (select location_id from {LOCATIONS} where country_code = 'USA' and state_code = 'NV')")
def q06(spark: SparkSession, d: str) -> DataFrame:
    return q.resolve(dataset(spark, d), q.PlaceFilter("place_of_performance", country_code=" USA ", state_code="NV"))


@R.add("q07_location_city", f"select distinct award_id from award_record where recipient_location_id in (select location_id from {LOCATIONS} where city_name = 'padosofuta')")
def q07(spark: SparkSession, d: str) -> DataFrame:
    return q.resolve(dataset(spark, d), q.PlaceFilter("recipient", city_name=" PADOSOFUTA "))


@R.add("q08_select_explicit_unknown", "select unnest(['CONT_AWD_W1018C00000_A000_-NONE-_-NONE-', 'NO_SUCH_AWARD']) as award_id")
def q08(spark: SparkSession, d: str) -> DataFrame:
    return q.select_ids(dataset(spark, d), ["NO_SUCH_AWARD", "CONT_AWD_W1018C00000_A000_-NONE-_-NONE-", "NO_SUCH_AWARD"])


def _by_award_sql(where: str = "true", tail: str = "") -> str:
    return f"""select a.award_id, a.piid, a.recipient_id, a.usaspending_permalink, cast(sum(t.federal_action_obligation) as decimal(38,2)) as total_obligation, count(*) as transaction_count
from transaction_fact t join (select distinct award_id from award_record where {where}) s on s.award_id = t.award_id join award_record a on a.award_id = t.award_id
where t.action_date between date '{FROM}' and date '{TO}' group by 1, 2, 3, 4 having sum(t.federal_action_obligation) is not null{tail}"""


@R.add("q10_activity_by_award", _by_award_sql())
def q10(spark: SparkSession, d: str) -> DataFrame:
    t = dataset(spark, d)
    return q.activity_by_award(t, q.resolve(t), FROM, TO)


@R.add("q11_activity_by_recipient", f"""select a.recipient_id, r.name as recipient_name, cast(sum(t.federal_action_obligation) as decimal(38,2)) as total_obligation, count(*) as transaction_count
from transaction_fact t join award_record a on a.award_id = t.award_id left join {RECIPIENTS} r on r.uei = a.recipient_id
where t.action_date between date '{FROM}' and date '{TO}' and a.recipient_id is not null group by 1, 2 having sum(t.federal_action_obligation) is not null""")
def q11(spark: SparkSession, d: str) -> DataFrame:
    t = dataset(spark, d)
    return q.activity_by_recipient(t, q.resolve(t), FROM, TO)


@R.add("q12_activity_topk", _by_award_sql(tail=" order by total_obligation desc, award_id limit 25"))
def q12(spark: SparkSession, d: str) -> DataFrame:
    t = dataset(spark, d)
    return q.activity_by_award(t, q.resolve(t), FROM, TO, limit=25)


@R.add("q13_null_totals", f"select count(*) as n_awards from (select award_id from transaction_fact where action_date between date '{FROM}' and date '{TO}' group by 1 having sum(federal_action_obligation) is null and award_id in (select award_id from award_record))")
def q13(spark: SparkSession, d: str) -> DataFrame:
    """Awards with activity in the window but without any amount, which the rankings leave out."""
    t = dataset(spark, d)
    every = q._window(t, q.resolve(t), FROM, TO)
    return every.agg(F.count_if(F.col("total").isNull()).alias("n_awards"))


SELECTED = f"select award_id from award_record where awarding_agency_id in ({', '.join(repr(x) for x in AGENCY_IDS)})"
ENTITY_SQL = {
    "recipient": f"select 'recipient' as entity_kind, uei as entity_id, name as label, null as code, null as description, null as idv_agency_id, null as country_code, null as state_code, null as county_fips, null as city_name, null as zip_code, null as granularity from {RECIPIENTS}",
    "agency": f"select 'agency', agency_id, name, null, null, null, null, null, null, null, null, null from {AGENCIES}",
    "office": f"select 'office', office_id, name, null, null, null, null, null, null, null, null, null from {OFFICES}",
    "idv": f"select 'idv', idv_id, piid, null, null, award_key_agency_id, null, null, null, null, null, null from {IDVS}",
    "location": f"select 'location', location_id, null, null, null, null, country_code, state_code, county_fips, city_name, zip_code, granularity from {LOCATIONS}",
    "classification": "select 'classification', classification_id, coalesce(description, code), code, description, null, null, null, null, null, null, null from ref_classifications",
}


def _traverse_sql(kinds: tuple[str, ...], selected: str = SELECTED) -> str:
    lit = lambda x: f"'{x}'" if x else "cast(null as varchar)"
    hops = " union all ".join(f"select '{k}' as entity_kind, {lit(r)} as role, {lit(t)} as agency_tier, {c} as entity_id from award_record where award_id in ({selected}) and {c} is not null" for k, r, t, c in q.EDGES if k in kinds)
    return f"with hops as (select distinct * from ({hops})), entities as ({' union all '.join(ENTITY_SQL.values())}) select h.role, h.agency_tier, e.* from hops h join entities e on e.entity_kind = h.entity_kind and e.entity_id = h.entity_id"


for _i, _kinds in enumerate([*[(k,) for k in q.ENTITY_KINDS], q.ENTITY_KINDS]):
    _label = _kinds[0] if len(_kinds) == 1 else "all"

    def _traverse(spark: SparkSession, d: str, kinds: tuple[str, ...] = _kinds) -> DataFrame:
        t = dataset(spark, d)
        return q.traverse(t, q.resolve(t, awarding_agency_ids=AGENCY_IDS), kinds)

    R.add(f"q2{_i}_traverse_{_label}", _traverse_sql(_kinds))(_traverse)

    def _traverse_every(spark: SparkSession, d: str, kinds: tuple[str, ...] = _kinds) -> DataFrame:
        """From the whole selection."""
        t = dataset(spark, d)
        return q.traverse(t, q.resolve(t), kinds)

    R.add(f"q4{_i}_traverse_every_{_label}", _traverse_sql(_kinds, "select award_id from award_record"))(_traverse_every)

CARDS_SQL = f"""select a.award_id, a.piid, a.award_type_code, a.recipient_id, r.name as recipient_name, a.base_description, a.awarding_agency_id, g.name as awarding_agency_name, a.awarding_sub_agency_id, s.name as awarding_sub_agency_name,
  a.awarding_office_id, o.name as awarding_office_name, a.naics_id, n.code as naics_code, n.description as naics_description, a.psc_id, p.code as psc_code, p.description as psc_description, a.place_of_performance_id,
  l.country_code as pop_country_code, l.state_code as pop_state_code, l.county_fips as pop_county_fips, l.city_name as pop_city_name, l.zip_code as pop_zip_code, l.granularity as pop_granularity, a.usaspending_permalink
from award_record a left join {RECIPIENTS} r on r.uei = a.recipient_id left join {AGENCIES} g on g.agency_id = a.awarding_agency_id left join {AGENCIES} s on s.agency_id = a.awarding_sub_agency_id
  left join {OFFICES} o on o.office_id = a.awarding_office_id left join ref_classifications n on n.classification_id = a.naics_id left join ref_classifications p on p.classification_id = a.psc_id left join {LOCATIONS} l on l.location_id = a.place_of_performance_id"""


@R.add("q30_award_cards", CARDS_SQL)
def q30(spark: SparkSession, d: str) -> DataFrame:
    t = dataset(spark, d)
    return q.cards(t, q.resolve(t))


@R.add("q31_first_cards", f"select * from ({CARDS_SQL}) where award_id in ({SELECTED} order by award_id limit 10)")
def q31(spark: SparkSession, d: str) -> DataFrame:
    t = dataset(spark, d)
    return q.cards(t, q.first_ids(q.resolve(t, awarding_agency_ids=AGENCY_IDS), 10))


# --- documents and search ---

SPACE = "nullif(trim(regexp_replace({c}, '\\s+', ' ', 'g'), ' '), '')"
TEXTS_SQL = f"""texts as (
  select award_id, list(d order by action_date desc nulls last, transaction_id) as texts from (
    select award_id, {SPACE.format(c="transaction_description")} as d, action_date, transaction_id from transaction_fact where award_id is not null
    qualify row_number() over (partition by award_id, lower(upper(d)) order by action_date desc nulls last, transaction_id, d) = 1) where d is not null group by award_id)"""
PROJECTION_SQL = f"""{TEXTS_SQL}, parts as (
  select a.award_id, {SPACE.format(c="a.base_description")} as base_description, {SPACE.format(c="p.code")} as psc_code, {SPACE.format(c="p.description")} as psc_description, {SPACE.format(c="n.code")} as naics_code, {SPACE.format(c="n.description")} as naics_description,
    {SPACE.format(c="r.name")} as recipient_name, {SPACE.format(c="g.name")} as agency_name, {SPACE.format(c="s.name")} as sub_agency_name, coalesce(texts, []) as texts
  from award_record a left join {RECIPIENTS} r on r.uei = a.recipient_id left join {AGENCIES} g on g.agency_id = a.awarding_agency_id left join {AGENCIES} s on s.agency_id = a.awarding_sub_agency_id
    left join ref_classifications n on n.classification_id = a.naics_id left join ref_classifications p on p.classification_id = a.psc_id left join texts t on t.award_id = a.award_id)"""


@R.add("s01_doc_projection", f"with {PROJECTION_SQL} select * exclude (texts), len(texts) as n_texts from parts")
def s01(spark: SparkSession, d: str) -> DataFrame:
    return semantic.projection(dataset(spark, d)).withColumn("n_texts", F.size("texts").cast("long")).drop("texts")


DOCUMENT_SQL = f"""with {PROJECTION_SQL}, sized as (
  select *, list_filter([case when base_description is not null then 'Award description: ' || base_description end, case when psc_code is not null and psc_description is not null then 'PSC: ' || psc_code || '; ' || psc_description end,
    case when naics_code is not null and naics_description is not null then 'NAICS: ' || naics_code || '; ' || naics_description end], lambda x: x is not null) as head,
    list_filter(['Recipient: ' || recipient_name, 'Awarding agency: ' || agency_name, 'Awarding sub-agency: ' || sub_agency_name], lambda x: x is not null) as labels
  from parts where base_description is not null or psc_description is not null or naics_description is not null or len(texts) > 0
), whole as (
  select award_id, array_to_string(head || (case when len(texts) > 0 and length(array_to_string(head, chr(10))) + (case when len(head) > 0 then 1 else 0 end) + 31 < 1800
    then ['Transaction work descriptions:'] || list_transform(texts, lambda x: '- ' || x) else [] end) || labels, chr(10)) as text from sized)
select award_id, 'award:' || award_id as document_id, regexp_replace(substring(text, 1, 1800), '\\n$', '') as text from whole"""


@R.add("s02_doc_text", DOCUMENT_SQL)
def s02(spark: SparkSession, d: str) -> DataFrame:
    return semantic.documents(dataset(spark, d))


@R.add("s03_txn_text_dedupe", f"with {TEXTS_SQL} select award_id, array_to_string(texts, chr(10)) as texts from texts")
def s03(spark: SparkSession, d: str) -> DataFrame:
    return semantic.transaction_texts(table(spark, d, "transaction_fact")).select("award_id", F.array_join("texts", "\n").alias("texts"))


@R.add("s04_fold_key", "select doc_id, lower(upper(page_title)) as key from documents")
def s04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fold_key("page_title").alias("key"))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


def _top_sql(k: int, where: str = "true") -> str:
    return f"""select vec_id, round(score, 6) as score from (select e.vec_id, list_dot_product(e.embedding::double[], x.embedding::double[]) as score from embeddings e, (select embedding from embeddings where vec_id = 0) x where {where})
order by score desc, vec_id limit {k}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.round("score", 6).alias("score"))


@R.add("s10_topk_cosine", _top_sql(50))
def s10(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(semantic.top_k(table(spark, d, "embeddings"), _query_vector(spark, d), 50, "vec_id"))


@R.add("s11_topk_min_score", _top_sql(50, "list_dot_product(e.embedding::double[], x.embedding::double[]) >= 0.1"))
def s11(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(semantic.top_k(table(spark, d, "embeddings"), _query_vector(spark, d), 50, "vec_id", min_score=0.1))


@R.add("s12_topk_candidates", _top_sql(50, "e.label = 3"))
def s12(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return _rounded(semantic.top_k(e, _query_vector(spark, d), 50, "vec_id", candidates=e.where("label = 3")))


@R.add("s16_topk_every", """
with x as (select vec_id, embedding::double[] as v from embeddings)
select q.vec_id as query_id, x.vec_id as id, round(list_dot_product(q.v, x.v), 6) as score from x q join x on q.vec_id % 50 = 0
qualify row_number() over (partition by q.vec_id order by list_dot_product(q.v, x.v) desc, x.vec_id) <= 10""")
def s16(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 50, asked of all vectors."""
    e = table(spark, d, "embeddings")
    return semantic.top_k_each(e, e.where("vec_id % 50 = 0"), 10, "vec_id").select("query_id", "id", F.round("score", 6).alias("score"))


@R.add("s13_index_validation", "select count(*) as n_documents, count(*) - count(distinct vec_id) as n_repeated, count(*) filter (where embedding is null) as n_null, count(*) filter (where len(embedding) <> 64) as n_wrong_length, count(*) filter (where abs(sqrt(list_dot_product(embedding::double[], embedding::double[])) - 1) > 1e-3) as n_not_unit from embeddings")
def s13(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("award_id"), F.lit("").alias("text"), "embedding")
    return semantic.index_faults(e, 64)


@R.add("s14_row_index", "select vec_id, row_number() over (order by vec_id) - 1 as row_index from embeddings")
def s14(spark: SparkSession, d: str) -> DataFrame:
    return semantic.row_numbers(table(spark, d, "embeddings").select("vec_id"), "vec_id").select("vec_id", F.col("row_index").cast("long").alias("row_index"))


@R.add("s15_embedded_search")
def s15(spark: SparkSession, d: str) -> DataFrame:
    """Documents of awards, embedded by word hashes, searched by a sentence."""
    docs = semantic.embed(semantic.documents(dataset(spark, d)), semantic.hashed_embedder(), 384)
    words = semantic.hashed_embedder()(["repair of hangar doors at the northern depot"])[0]
    return semantic.top_k(docs, (words / float((words**2).sum()) ** 0.5).tolist(), 50).select("award_id", F.round("score", 6).alias("score"))


# --- overlay of fetched details ---

DETAILS_SQL = """details as (select award_id, case when length(piid) % 2 = 0 then cast(observed_total_obligation + 1 as varchar) else '1500.50' end as total_obligation,
  case when substr(piid, -1) in ('0', '1', '2', '3') then null else '250.00' end as current_value, '99.999' as potential_value, '2024-02-03T00:00:00' as date_signed from award_record where substr(piid, -1) not in ('A', 'B'))"""


def _details(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "award_record").where("substr(piid, -1) not in ('A', 'B')")
    return a.select(
        "award_id",
        F.when(F.length("piid") % 2 == 0, (F.col("observed_total_obligation") + 1).cast("string")).otherwise(F.lit("1500.50")).alias("total_obligation"),
        F.when(~F.col("piid").substr(-1, 1).isin("0", "1", "2", "3"), F.lit("250.00")).alias("current_value"),
        F.lit("99.999").alias("potential_value"),
        F.lit("2024-02-03T00:00:00").alias("date_signed"),
    )


@R.add("e01_overlay_money", f"""with {DETAILS_SQL}, typed as (select award_id, cast(total_obligation as decimal(20,2)) as t, cast(current_value as decimal(20,2)) as c, cast(potential_value as decimal(20,2)) as p, cast(substr(date_signed, 1, 10) as date) as signed from details)
select a.* exclude (observed_total_obligation, observed_current_value, observed_potential_value, snapshot_status, snapshot_source, date_signed),
  case when takes then t else observed_total_obligation end as observed_total_obligation, case when takes then c else observed_current_value end as observed_current_value, case when takes then p else observed_potential_value end as observed_potential_value,
  case when takes and t is not null and c is not null and p is not null then 'defensible' else snapshot_status end as snapshot_status, case when takes then 'award_detail' else snapshot_source end as snapshot_source, coalesce(signed, date_signed) as date_signed
from (select a.*, d.* exclude (award_id), d.award_id is not null and a.snapshot_status = 'requires_enrichment' as takes from award_record a left join typed d on d.award_id = a.award_id) a""".replace("select a.* exclude (observed", "select a.* exclude (t, c, p, signed, takes, observed"))
def e01(spark: SparkSession, d: str) -> DataFrame:
    return q.overlay_money(table(spark, d, "award_record"), _details(spark, d))


@R.add("e02_overlay_idv", f"""with idvs as (select * from {IDVS}) select idv_id, piid, award_key_agency_id, case when substr(piid, -1) in ('1', '2') then 'hydrated' else hydration_status end as hydration_status,
  case when substr(piid, -1) = '1' then 'X' else type_code end as type_code, case when substr(piid, -1) = '2' then 'GWAC' else type_label end as type_label from idvs""")
def e02(spark: SparkSession, d: str) -> DataFrame:
    own = star.idvs(table(spark, d, "staging_valid"))
    last = F.col("piid").substr(-1, 1)
    return q.overlay_idvs(own, own.where(last.isin("1", "2")).select("idv_id", F.when(last == "1", F.lit("X")).otherwise(F.lit(" ")).alias("type_code"), F.when(last == "2", F.lit("GWAC")).alias("type_label")))


# --- compositions ---


@R.add("x01_resolve_then_aggregate", _by_award_sql(f"award_id in ({SELECTED})"))
def x01(spark: SparkSession, d: str) -> DataFrame:
    t = dataset(spark, d)
    return q.activity_by_award(t, q.resolve(t, awarding_agency_ids=AGENCY_IDS), FROM, TO)


@R.add("x02_traverse_then_resolve", f"select distinct award_id from award_record where funding_office_id in (select funding_office_id from award_record where award_id in ({SELECTED}) and funding_office_id in (select office_id from ref_offices))")
def x02(spark: SparkSession, d: str) -> DataFrame:
    """Awards whose funding office is one hop from the selection; the hop stays a relation."""
    t = dataset(spark, d)
    offices = q.traverse(t, q.resolve(t, awarding_agency_ids=AGENCY_IDS), ["office"]).where("role = 'funding'")
    return t["award_record"].join(offices.select(F.col("entity_id").alias("funding_office_id")), "funding_office_id", "left_semi").select("award_id").distinct()


@R.add("x03_search_then_aggregate")
def x03(spark: SparkSession, d: str) -> DataFrame:
    t = dataset(spark, d)
    return q.activity_by_award(t, s15(spark, d).select("award_id"), FROM, TO)
