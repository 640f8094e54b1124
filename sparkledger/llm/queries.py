"""Queries p3 to p6 and p8 to p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkledger.functions.text import non_blank
from sparkledger.llm.leaks import leaked
from sparkledger.llm.names import resolve_names
from sparkledger.llm.neighbours import nearest
from sparkledger.llm.packing import fill_report, pack, token_counts
from sparkledger.llm.survivors import survivors
from sparkledger.llm.topn import top_n
from sparkledger.llm.toxic import fit_tables, score_documents
from sparkledger.plans.registry import Registry
from sparkledger.sources.session import cut
from sparkledger.sources.tables import table

R = Registry()

TRUST = ("award_detail", "transaction", "none")

BLANK_SQL = "case when trim({c}, ' ') = '' or upper(trim({c}, ' ')) in ('N/A', 'UNKNOWN', 'NOT AVAILABLE', '-') then null else trim({c}, ' ') end"
SURVIVOR_SQL = f"""
with said as (
  select 'recipient' as entity_kind, uei as entity_id, row_id, observed_on, source, {BLANK_SQL.format(c="name")} as name, {BLANK_SQL.format(c="parent_uei")} as parent_uei from ref_recipients where uei is not null
  union all select 'agency', agency_id, row_id, observed_on, source, {BLANK_SQL.format(c="name")}, null from ref_agencies where agency_id is not null
), ranked as (
  select *, row_number() over (partition by entity_kind, entity_id order by (name is null)::int, (case source when 'award_detail' then 0 when 'transaction' then 1 else 2 end), observed_on desc nulls last, row_id) as rn,
    row_number() over (partition by entity_kind, entity_id order by (parent_uei is null)::int, (case source when 'award_detail' then 0 when 'transaction' then 1 else 2 end), observed_on desc nulls last, row_id) as rp
  from said
)
select entity_kind, entity_id, coalesce(max(case when rn = 1 and name is not null then row_id end), 0) as name_row_id,
  coalesce(max(case when rp = 1 and parent_uei is not null then row_id end), 0) as parent_row_id
from ranked group by entity_kind, entity_id having count(*) >= 2"""


def _survivors(spark: SparkSession, d: str, trust: tuple[str, ...] | None = TRUST) -> tuple[DataFrame, DataFrame]:
    people, _ = survivors(table(spark, d, "ref_recipients"), F.col("uei"), F.col("row_id"), F.col("source"), F.col("observed_on"), {"name": non_blank("name"), "parent_uei": non_blank("parent_uei")}, trust)
    offices, _ = survivors(table(spark, d, "ref_agencies"), F.col("agency_id"), F.col("row_id"), F.col("source"), F.col("observed_on"), {"name": non_blank("name")}, trust)
    return people, offices


@R.add("p5_found", SURVIVOR_SQL)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    people, agencies = _survivors(spark, d)
    a = people.select(F.lit("recipient").alias("entity_kind"), "n_rows", F.col("entity").alias("entity_id"), F.col("name_row_id"), F.col("parent_uei_row_id").alias("parent_row_id"))
    b = agencies.select(F.lit("agency").alias("entity_kind"), "n_rows", F.col("entity").alias("entity_id"), F.col("name_row_id"), F.lit(0).cast("long").alias("parent_row_id"))
    return a.unionByName(b).where("n_rows >= 2").drop("n_rows")


@R.add("p5_records")
def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """Whole surviving records with the posterior of each value and all values judged true, sources ranked by the model."""
    people, agencies = _survivors(spark, d, trust=None)
    none = {"parent_uei": F.lit(None).cast("string"), "parent_uei_row_id": F.lit(0).cast("long"), "parent_uei_truth": F.lit(None).cast("double"), "parent_uei_values": F.array().cast("array<string>")}
    both = people.withColumn("entity_kind", F.lit("recipient")).unionByName(agencies.withColumns(none).withColumn("entity_kind", F.lit("agency")))
    return both.withColumnRenamed("entity", "entity_id")


@R.add("p6_found", """
with once as (
  select contract_transaction_unique_key as t, contract_award_unique_key as a, action_date as d from staging_valid where contract_transaction_unique_key is not null
  qualify row_number() over (partition by contract_transaction_unique_key order by _load_seq desc) = 1
)
select a as contract_award_unique_key, t as contract_transaction_unique_key, row_number() over (partition by a order by d desc nulls last, t) as place_no
from once where a is not null qualify place_no <= 3""")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "staging_valid").where("contract_transaction_unique_key is not null")
    once = rows.groupBy("contract_transaction_unique_key").agg(F.max(F.struct("_load_seq", "contract_award_unique_key", "action_date")).alias("r"))
    top = top_n(once.where("r.contract_award_unique_key is not null"), F.col("r.contract_award_unique_key"), [("day", F.col("r.action_date"), True), ("contract_transaction_unique_key", F.col("contract_transaction_unique_key"), False)], 3)
    return top.select(F.col("group").alias("contract_award_unique_key"), "contract_transaction_unique_key", F.col("place").alias("place_no"))


#: Capacity of a container in tokens.
CAPACITY = 4096


def _packed(spark: SparkSession, d: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Documents packed by the tokens of a vocabulary file and its pattern; without them by those of the public tokenizers at hand."""
    if vocabulary is None or pattern is None:
        import public_tokenizers as public

        vocabulary, pattern = vocabulary or public.path("byte_bpe_50k.tiktoken"), pattern or public.PATTERN
    docs = token_counts(table(spark, d, "documents"), "doc_id", "text", vocabulary, pattern)
    return pack(cut(docs), F.col("item"), F.col("n_tokens"), CAPACITY)


@R.add("p8_containers")
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).withColumnRenamed("item", "doc_id")


@R.add("p8_fill")
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(_packed(spark, d), CAPACITY)


def _leaked(spark: SparkSession, d: str, share: float | None) -> DataFrame:
    # shorter seeds, and fewer of them, find copies of which a fifth of the words is edited
    kind = {} if share is None else {"n": 4, "least": 4}
    return leaked(table(spark, d, "documents"), table(spark, d, "eval_items"), share=share, **kind)


@R.add("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d, None).where("longest_run >= 13").select("doc_id", "item_id")


@R.add("p9_scores")
def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Edited copies too: alignments that reach half of the item's best score, where four seeds of four words lie within its length."""
    return _leaked(spark, d, 0.5).where("share >= 0.5 or longest_run >= 13")


NEAREST_SQL = """
with unit as (
  select doc_id, v, sqrt(list_dot_product(v, v)) as n from (select doc_id, vec::double[] as v from doc_vectors where len(vec) = 64) where list_dot_product(v, v) > 0
), pairs as (
  select a.doc_id as a, b.doc_id as b, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) as s from unit a join unit b on a.doc_id <> b.doc_id
), best as (select *, row_number() over (partition by a order by s desc, b) as place from pairs where s >= 0.9 qualify place <= 5)"""


@R.add("p4_found", f"{NEAREST_SQL} select distinct least(a, b) as doc_id_a, greatest(a, b) as doc_id_b from best")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = nearest(table(spark, d, "doc_vectors"), F.col("doc_id"), F.col("vec"))
    return near.select(F.least("id", "other").alias("doc_id_a"), F.greatest("id", "other").alias("doc_id_b")).distinct()


@R.add("p4_neighbours", f"{NEAREST_SQL} select a as doc_id, place, b as neighbour_id, s as cosine, award_id as neighbour_award_id from best join (select doc_id as b, award_id from doc_vectors) using (b)")
def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every document, with the award that the neighbour stands for."""
    vectors = table(spark, d, "doc_vectors")
    near = nearest(vectors, F.col("doc_id"), F.col("vec")).withColumnsRenamed({"id": "doc_id", "other": "neighbour_id"})
    return near.join(vectors.select(F.col("doc_id").alias("neighbour_id"), F.col("award_id").alias("neighbour_award_id")), "neighbour_id", "left")


@R.add("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    who = cut(resolve_names(table(spark, d, "ref_recipients"), F.col("uei"), non_blank("name")))
    other = who.select(F.col("id").alias("uei_b"), "entity")
    return who.join(other, "entity").where("id < uei_b").select(F.col("id").alias("uei_a"), "uei_b").distinct()


@R.add("p3_entities")
def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every uei with the entity that its names stand for, and how many uei values that entity has."""
    who = cut(resolve_names(table(spark, d, "ref_recipients"), F.col("uei"), non_blank("name")))
    return who.join(who.groupBy("entity").agg(F.count("*").alias("n_ueis")), "entity").withColumnRenamed("id", "uei")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return score_documents(docs, fit_tables(docs, table(spark, d, "doc_labels")), carried=("source",))


@R.add("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("toxic").select("doc_id")


@R.add("p10_scores")
def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


@R.add("p10_rates")
def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, abusive documents and their share, per source (a null source is one of its own)."""
    return _scored(spark, d).groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("toxic").alias("n_toxic"), F.avg(F.col("toxic").cast("int")).alias("rate"))
