"""Queries p1, p2 and p7: the general data-preparation problems."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkledger.functions.text import col, non_blank
from sparkledger.operators.history import attribute_history
from sparkledger.operators.rejects import CHECKED, load_lines, load_table
from sparkledger.operators.skew import chunked_totals
from sparkledger.plans.registry import Registry
from sparkledger.sources.columns import DATES, MONEY, PROJECTED, REQUIRED
from sparkledger.sources.tables import table

R = Registry()

BLANK_SQL = "case when trim({c}, ' ') = '' or upper(trim({c}, ' ')) in ('N/A', 'UNKNOWN', 'NOT AVAILABLE', '-') then null else trim({c}, ' ') end"

HISTORY_SQL = f"""
with said as (
  select 'recipient' as entity_kind, uei as entity_id, row_id, observed_on, {BLANK_SQL.format(c="name")} as name, {BLANK_SQL.format(c="parent_uei")} as parent_uei
  from ref_recipients where uei is not null and observed_on is not null
  union all
  select 'office', office_id, row_id, observed_on, {BLANK_SQL.format(c="name")}, null from ref_offices where office_id is not null and observed_on is not null
), state as (
  select entity_kind, entity_id, observed_on, row_id,
    last_value(name ignore nulls) over w as name, last_value(parent_uei ignore nulls) over w as parent_uei
  from said window w as (partition by entity_kind, entity_id order by observed_on, row_id rows between unbounded preceding and current row)
), daily as (
  select * from state qualify row_number() over (partition by entity_kind, entity_id, observed_on order by row_id desc) = 1
), marked as (
  select *, row_number() over d = 1 or name is distinct from lag(name) over d or parent_uei is distinct from lag(parent_uei) over d as starts
  from daily window d as (partition by entity_kind, entity_id order by observed_on)
), versions as (
  select entity_kind, entity_id, name, parent_uei, observed_on as valid_from,
    coalesce(lead(observed_on) over (partition by entity_kind, entity_id order by observed_on), date '9999-12-31') as valid_to
  from marked where starts
)
"""


def history(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "ref_recipients")
    people = attribute_history(people, "uei", "observed_on", "row_id", {"name": non_blank("name"), "parent_uei": non_blank("parent_uei")})
    offices = attribute_history(table(spark, d, "ref_offices"), "office_id", "observed_on", "row_id", {"name": non_blank("name")})
    both = people.withColumn("entity_kind", F.lit("recipient")).unionByName(offices.withColumn("entity_kind", F.lit("office")).withColumn("parent_uei", F.lit(None).cast("string")))
    return both.select("entity_kind", F.col("entity").alias("entity_id"), "name", "parent_uei", "valid_from", F.coalesce("valid_to", F.lit("9999-12-31").cast("date")).alias("valid_to"))


@R.add("p1_history", HISTORY_SQL + "select entity_kind, entity_id, name, parent_uei, cast(valid_from as varchar) as valid_from, cast(valid_to as varchar) as valid_to from versions")
def p1_history(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d).withColumns({c: F.col(c).cast("string") for c in ("valid_from", "valid_to")})


@R.add("p1_found", HISTORY_SQL + "select distinct entity_kind, entity_id, cast(valid_from as varchar) as valid_from, cast(valid_to as varchar) as valid_to from versions")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d).select("entity_kind", "entity_id", F.col("valid_from").cast("string"), F.col("valid_to").cast("string"))


def _checks_sql() -> str:
    t = lambda c: f"coalesce(trim({c}, ' '), '')"
    rows = [f"case when {t(c)} = '' then 'missing_required:{c}' end" for c in REQUIRED]
    rows += [f"case when {t(c)} <> '' and not (regexp_full_match({t(c)}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and {t(c)} not like '0000%' and try_cast({t(c)} as date) is not null) then 'malformed:{c}' end" for c in DATES]
    rows += [f"case when {t(c)} <> '' and not regexp_full_match({t(c)}, '[+-]?[0-9]{{1,18}}([.][0-9]+)?') then 'malformed:{c}' end" for c in MONEY]
    return "list_filter([" + ", ".join(rows) + "], lambda x: x is not null)"


RAW_SQL = f"""
with raw_checked as (
  select *, {_checks_sql()} as reasons, trim(contract_transaction_unique_key, ' ') as k,
    concat_ws(chr(31), {", ".join(f"coalesce(trim({c}, ' '), '')" for c in PROJECTED)}) as content
  from staging_raw
), raw_collided as (select k from raw_checked where len(reasons) = 0 group by k having count(distinct content) > 1)
"""


# A record is put behind a comma, so that each field, empty ones too, is a match of its own.
FIELD_SQL = """("(?:[^"]|"")*"|[^",]*)"""
UNQUOTED_SQL = """lambda x: case when x like '"%' then replace(x[2:len(x) - 1], '""', '"') else x end"""
LINES_SQL = f"""
with numbered as (select *, coalesce(_source_path, '') as file, coalesce(record_text, '') as t, _load_seq = min(_load_seq) over (partition by coalesce(_source_path, '')) as is_header from staging_lines),
split as (
  select *, regexp_full_match(',' || t, '(,{FIELD_SQL})+') as quoted, list_transform(regexp_extract_all(',' || t, ',{FIELD_SQL}', 1), {UNQUOTED_SQL}) as own from numbered
), header as (select file, list_transform(own, lambda x: trim(x, ' ')) as names from split where is_header),
records as (
  select s.*, len(own) = len(names) as fits, {{columns}}
  from split s join header using (file) where not is_header
), judged as (
  select *, case when not quoted then ['broken_quoting'] when not fits then ['column_count'] else {{reasons}} end as reasons from records
)
"""


def _lines_sql(columns: Sequence[str]) -> str:
    return LINES_SQL.format(columns=", ".join(f"own[list_position(names, '{c}')] as {c}" for c in columns), reasons=_checks_sql())


RAW_REJECTS_SQL = RAW_SQL + """
select _load_seq as load_seq, unnest(reasons) as reason from raw_checked where len(reasons) > 0
union all select _load_seq, 'identity_collision' from raw_checked where len(reasons) = 0 and k in (select k from raw_collided)"""


P2_SQL = f"""
select 'staging_raw' as input_table, load_seq, reason from ({RAW_REJECTS_SQL})
union select 'staging_lines', load_seq, reason from ({_lines_sql(CHECKED)} select _load_seq as load_seq, unnest(reasons) as reason from judged)"""


@R.add("p2_found", P2_SQL)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    _, raw = load_table(table(spark, d, "staging_raw"))
    _, lines = load_lines(table(spark, d, "staging_lines"))
    return raw.select(F.lit("staging_raw").alias("input_table"), "load_seq", "reason").unionByName(lines.select(F.lit("staging_lines").alias("input_table"), "load_seq", "reason")).distinct()


@R.add("p2_raw_rejects", RAW_REJECTS_SQL)
def p2_raw_rejects(spark: SparkSession, d: str) -> DataFrame:
    return load_table(table(spark, d, "staging_raw"))[1]


def _typed_sql(c: str) -> str:
    t = f"nullif(trim({c}, ' '), '')"
    return f"cast({t} as date) as {c}" if c in DATES else f"cast({t} as decimal(20,2)) as {c}" if c in MONEY else f"{t} as {c}"


@R.add("p2_raw_loaded", RAW_SQL + f"""select {", ".join(map(_typed_sql, PROJECTED))}, _source_path, _input_index, _load_seq
from raw_checked where len(reasons) = 0 and k not in (select k from raw_collided)""")
def p2_raw_loaded(spark: SparkSession, d: str) -> DataFrame:
    return load_table(table(spark, d, "staging_raw"))[0]


@R.add("p2_lines_loaded", f"""{_lines_sql(PROJECTED)} select {", ".join(map(_typed_sql, PROJECTED))}, _source_path, _input_index, _load_seq from judged where len(reasons) = 0""")
def p2_lines_loaded(spark: SparkSession, d: str) -> DataFrame:
    return load_lines(table(spark, d, "staging_lines"))[0]


def _per_key_sql(name: str, key: str, amount: str, day: str) -> str:
    return f"""select '{name}' as table_name, '{key}' as column_name, {key} as key_value, count(*) as n_rows,
  cast(sum({amount}) as decimal(38,2)) as amount_sum, max({day}) as latest, count(*) * 100 >= 3 * (select count(*) from {name}) as heavy
from {name} where {key} is not null group by {key}"""


PER_KEY = (("transaction_fact", "award_id", "federal_action_obligation", "action_date"), ("award_record", "recipient_id", "observed_total_obligation", "date_signed"))
PER_KEY_SQL = " union all ".join(_per_key_sql(*x) for x in PER_KEY)


def per_key(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        chunked_totals(table(spark, d, name), col(key), col(amount), col(day)).select(F.lit(name).alias("table_name"), F.lit(key).alias("column_name"), F.col("key").alias("key_value"), "n_rows", "amount_sum", "latest", "heavy")
        for name, key, amount, day in PER_KEY
    ]
    return parts[0].unionByName(parts[1])


@R.add("p7_per_key", PER_KEY_SQL)
def p7_per_key(spark: SparkSession, d: str) -> DataFrame:
    return per_key(spark, d)


@R.add("p7_found", f"select table_name, column_name, key_value from ({PER_KEY_SQL}) where heavy")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return per_key(spark, d).where("heavy").select("table_name", "column_name", "key_value")
