"""One surviving record per duplicate group, field by field.

A latent two-sided quality model says which claimed values are true: each
source has a sensitivity (how often it states a true value) and a specificity
(how often it keeps from stating a false one), inferred by expectation
maximisation over all claims. The value of the greatest posterior survives, and
every value judged true is retained. A stated order of trust enters as a prior:
it admits only parameters under which a source outweighs all those below it
together.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkledger.sources.session import cut

#: Patterns of claims that the driver iterates over by itself; with more, each round is a job over the table of patterns, with the same result.
MAX_PATTERNS = 10_000


@dataclass(frozen=True)
class Quality:
    """What the model found: the prior log odds that a claimed value is true, and per source what a statement of a value and silence about it add."""

    prior: float
    stated: tuple[float, ...]
    silent: tuple[float, ...]
    rounds: int

    @property
    def sensitivity(self) -> tuple[float, ...]:
        return tuple(float((1 - np.exp(t)) / (1 - np.exp(t - s))) for s, t in zip(self.stated, self.silent, strict=True))

    @property
    def specificity(self) -> tuple[float, ...]:
        return tuple(float((1 - np.exp(-s)) / (1 - np.exp(t - s))) for s, t in zip(self.stated, self.silent, strict=True))


@dataclass(frozen=True)
class Sums:
    """Expected counts of one round: per source the true values that it states and covers, the false ones it doesn't state and covers; all true ones, all."""

    true_stated: np.ndarray
    true_covered: np.ndarray
    false_unstated: np.ndarray
    false_covered: np.ndarray
    true: float
    all: float


def maximised(s: Sums, trust: Sequence[int] | None, rounds: int) -> Quality:
    """The parameters that the sums of a round make most likely.

    Beta(8,2) and Beta(9,1) pseudo counts keep a source that covers little near
    a fair guess and rule out that true and false swap roles. ``trust`` lists
    the sources, most trusted first: from the last on, log odds that don't
    outweigh twice those below are raised until they do.
    """
    sens = (s.true_stated + 8) / (s.true_covered + 10)
    spec = (s.false_unstated + 9) / (s.false_covered + 10)
    if trust is not None:  # a trusted source's word is never evidence against a value
        spec = np.maximum(spec, 1 - sens + 1e-3)
    sens, spec = np.clip(sens, 1e-6, 1 - 1e-6), np.clip(spec, 1e-6, 1 - 1e-6)
    stated, silent = np.log(sens) - np.log(1 - spec), np.log(1 - sens) - np.log(spec)
    below = 0.0
    for i in reversed(trust or ()):
        weight = stated[i] - silent[i]
        if weight < 2 * below:
            stated[i], silent[i] = stated[i] * 2 * below / weight, silent[i] * 2 * below / weight
        below += stated[i] - silent[i]
    prior = (s.true + 1) / (s.all + 2)
    return Quality(float(np.log(prior) - np.log(1 - prior)), tuple(map(float, stated)), tuple(map(float, silent)), rounds)


def start(sources: int, trust: Sequence[int] | None = None) -> Quality:
    """The parameters before anything is seen."""
    return maximised(Sums(*np.zeros((4, sources)), 0.0, 0.0), trust, 0)


def moved(a: Quality, b: Quality) -> float:
    x, y = (np.r_[q.prior, q.stated, q.silent] for q in (a, b))
    return float((np.abs(x - y) / np.maximum(1, np.abs(x))).max(initial=0))


def truth(said: np.ndarray, covers: np.ndarray, q: Quality, group: np.ndarray | None = None) -> np.ndarray:
    """Posterior that each value is true; ``said`` and ``covers`` are (values, sources).

    Values of one ``group`` exclude each other: at most one of them is true.
    Groups are numbered from 0 in order; without them every value is by itself.
    """
    odds = q.prior + (said * np.array(q.stated)).sum(1) + ((covers & ~said) * np.array(q.silent)).sum(1)
    group = np.arange(len(odds)) if group is None else group
    top = np.zeros(int(group.max(initial=-1)) + 1)
    np.maximum.at(top, group, odds)
    each = np.exp(odds - top[group])
    return each / (np.exp(-top) + np.bincount(group, each, len(top)))[group]


def fit_quality(said: np.ndarray, covers: np.ndarray, weight: np.ndarray, trust: Sequence[int] | None = None, group: np.ndarray | None = None, max_rounds: int = 300, tolerance: float = 1e-6) -> Quality:
    """EM over claimed values.

    ``said``: the source states this value; ``covers``: the source says anything
    about this field of this entity. A source that does not cover a field is no
    evidence. Weights count how often a value of the kind stands; see ``truth``
    for groups.
    """
    q = start(said.shape[1], trust)
    for rounds in range(1, max_rounds + 1):
        p = truth(said, covers, q, group)
        t, f = (weight * p)[:, None], (weight * (1 - p))[:, None]
        new = maximised(Sums((t * said).sum(0), (t * covers).sum(0), (f * (covers & ~said)).sum(0), (f * covers).sum(0), float((weight * p).sum()), float(weight.sum())), trust, rounds)
        done = moved(q, new) < tolerance
        q = new
        if done:
            break
    return q


def log_odds(said: Column, covers: Column, sources: Sequence[str], q: Quality) -> Column:
    """Posterior log odds that a value is true which the sources of ``said`` state, of those of ``covers``."""
    if not sources:
        return F.lit(q.prior)
    stated, silent = (F.map_from_arrays(F.array(*map(F.lit, sources)), F.array(*map(F.lit, x))) for x in (q.stated, q.silent))
    return F.aggregate(covers, F.lit(q.prior), lambda acc, s: acc + F.when(F.array_contains(said, s), F.element_at(stated, s)).otherwise(F.element_at(silent, s)))


def posteriors(odds: Column, alone: Column) -> Column:
    """Of an array of log odds the posteriors: values exclude each other, or each is by itself if ``alone``."""
    top = F.greatest(F.lit(0.0), F.coalesce(F.array_max(odds), F.lit(0.0)))
    total = F.aggregate(odds, F.exp(-top), lambda acc, o: acc + F.exp(o - top))
    bound = lambda o: F.greatest(F.lit(-500.0), F.least(F.lit(500.0), o))
    return F.transform(odds, lambda o: F.when(alone, 1 / (1 + F.exp(-bound(o)))).otherwise(F.exp(o - top) / total))


def _fit_over(patterns: DataFrame, sources: Sequence[str], trust: Sequence[int] | None, max_rounds: int = 300, tolerance: float = 1e-6) -> Quality:
    """The same EM where the patterns are too many for the driver: sums per source come back."""
    q = start(len(sources), trust)
    at = {s: i for i, s in enumerate(sources)}
    for rounds in range(1, max_rounds + 1):
        odds = F.transform("saids", lambda x: log_odds(x, F.col("covers"), sources, q))  # noqa: B023
        each = patterns.select("covers", "n", F.explode(F.arrays_zip(F.col("saids").alias("said"), posteriors(odds, F.col("alone")).alias("p"))).alias("x")).select("covers", "n", "x.*")
        judged = each.withColumn("t", F.col("n") * F.col("p")).withColumn("f", F.col("n") * (1 - F.col("p")))
        own = F.array_contains("said", F.col("s"))
        sums = judged.select("said", "t", "f", F.explode("covers").alias("s")).groupBy("s").agg(F.sum(F.when(own, F.col("t")).otherwise(0.0)), F.sum("t"), F.sum(F.when(own, 0.0).otherwise(F.col("f"))), F.sum("f"))
        per = np.zeros((4, len(sources)))
        for s, *x in sums.collect():
            per[:, at[s]] = x
        t, n = judged.agg(F.sum("t"), F.sum("n")).first()
        new = maximised(Sums(*per, float(t), float(n)), trust, rounds)
        done = moved(q, new) < tolerance
        q = new
        if done:
            break
    return q


def survivors(df: DataFrame, entity: Column, row_id: Column, source: Column, day: Column, fields: Mapping[str, Column], trust: Sequence[str] | None = None, several: Collection[str] = ()) -> tuple[DataFrame, Quality]:
    """The surviving record of every entity, and the fitted quality model.

    ``fields`` map names to expressions that are null where a row says nothing.
    Columns: entity, n_rows, and for each field f: f (the surviving value),
    f_row_id (where it stems from, 0 if the field has no value), f_truth (its
    posterior) and f_values (every value judged true, best first).

    What a source claims of a field is its latest value that isn't null; an
    earlier one is superseded and no claim. Of rows of one day the first by
    row_id counts, or all of them for a field in ``several``, of which several
    values may be true; of other fields at most one is. The claimed value
    of the greatest posterior survives, ties by the latest day, then the
    smallest row_id, with the row of the weightiest source that claims it.
    ``trust`` lists sources, most trusted first (others follow by name): under
    that prior a source outweighs all those below it together. Without it the
    claims alone say how good a source is. Null sources count as one source
    named ''. A null day is earlier than any day. Rows without entity take no
    part; repeated rows change nothing but n_rows; an empty table gives no
    record and the prior model.

    Claims are combined before they move: what is shuffled is one row per
    entity, field, value and source. The model's parameters, two numbers per
    source, are on the driver.
    """
    rows = df.select(entity.alias("entity"), row_id.cast("long").alias("row_id"), F.coalesce(source, F.lit("")).alias("source"), day.cast("date").alias("day"), F.array(*[F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in fields.items()]).alias("said")).where("entity is not null")
    days = -F.coalesce(F.unix_date("day"), F.lit(-(2**31) + 1)).cast("long")
    claims = rows.select("entity", "row_id", "source", days.alias("age"), F.inline("said")).groupBy("entity", "field", "source", "value").agg(F.min(F.struct("age", "row_id")).alias("best"), F.count("*").alias("n")).repartition("entity")
    one = F.struct(F.col("best.age").alias("age"), F.col("best.row_id").alias("row_id"), F.col("value").alias("value"))
    stated = F.when(F.col("value").isNotNull(), one)
    per_source = claims.groupBy("entity", "field", "source").agg(F.min(stated).alias("first"), F.sum("n").alias("n"), *([F.collect_list(F.when(F.col("field").isin(*several), stated)).alias("every")] if several else []))
    of_day = F.filter("every", lambda x: x["age"] == F.col("first.age")) if several else None
    held = F.when(F.col("field").isin(*several), of_day).otherwise(F.array("first")) if several else F.array("first")
    groups = per_source.withColumn("held", F.when(F.col("first").isNotNull(), held).otherwise(F.array().cast("array<struct<age:bigint,row_id:bigint,value:string>>")))
    groups = groups.groupBy("entity", "field").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set(F.when(F.col("first").isNotNull(), F.col("source")))).alias("covers"), F.flatten(F.collect_list(F.transform("held", lambda x: F.struct(x["value"].alias("value"), F.col("source").alias("source"), x["age"].alias("age"), x["row_id"].alias("row_id"))))).alias("by"))
    of_value = lambda v: F.filter("by", lambda x: x["value"] == v)
    values = F.transform(F.array_distinct(F.transform("by", lambda x: x["value"])), lambda v: F.struct(v.alias("value"), F.array_sort(F.transform(of_value(v), lambda x: x["source"])).alias("said"), of_value(v).alias("by")))
    groups = cut(groups.select("entity", "field", "n", "covers", values.alias("values")))
    sources = sorted(r[0] for r in groups.select(F.explode("covers")).distinct().collect())
    order = None if trust is None else [sources.index(s) for s in (*(t for t in trust if t in sources), *(s for s in sources if s not in trust))]
    alone = F.col("field").isin(*several) if several else F.lit(False)
    patterns = cut(groups.where(F.size("values") > 0).select(F.array_sort("values.said").alias("saids"), "covers", alone.alias("alone")).groupBy("saids", "covers", "alone").agg(F.count("*").alias("n")))
    few = patterns.limit(MAX_PATTERNS + 1).collect()
    if len(few) > MAX_PATTERNS:
        quality = _fit_over(patterns, sources, order)
    else:
        each = [(said, r["covers"], r["n"], (i, k if r["alone"] else 0)) for i, r in enumerate(few) for k, said in enumerate(r["saids"])]
        grid = lambda k: np.array([[s in x[k] for s in sources] for x in each], dtype=bool).reshape(len(each), len(sources))
        number = {g: i for i, g in enumerate(dict.fromkeys(x[3] for x in each))}
        quality = fit_quality(grid(0), grid(1), np.array([x[2] for x in each], dtype=float), order, np.array([number[x[3]] for x in each], dtype=np.int64))
    weight = {s: a - b for s, a, b in zip(sources, quality.stated, quality.silent, strict=True)}
    weigh = F.map_from_arrays(F.array(*map(F.lit, weight)), F.array(*map(F.lit, weight.values()))) if weight else F.lit(None).cast("map<string,double>")

    def scored(v: Column) -> Column:
        odds = log_odds(v["said"], F.col("covers"), sources, quality)
        row = F.array_min(F.transform(v["by"], lambda b: F.struct((-F.element_at(weigh, b["source"])).alias("weight"), b["age"].alias("age"), b["row_id"].alias("row_id"))))
        return F.struct((-odds).alias("odds"), row["age"].alias("age"), row["row_id"].alias("row_id"), v["value"].alias("value"))

    ranked = groups.select("entity", "field", "n", F.array_sort(F.transform("values", scored)).alias("v"))
    ranked = ranked.withColumn("p", posteriors(F.transform("v", lambda x: -x["odds"]), alone))
    first = F.get("v", F.lit(0))
    true_ones = F.transform(F.filter("v", lambda x, i: F.get("p", i) >= 0.5), lambda x: x["value"])
    out = ranked.groupBy("entity").agg(
        F.max("n").alias("n_rows"),
        *[
            F.max(F.when(F.col("field") == n, F.struct(first["value"].alias("value"), F.coalesce(first["row_id"], F.lit(0)).alias("row_id"), F.get("p", F.lit(0)).alias("truth"), true_ones.alias("values")))).alias(f"_{i}")
            for i, n in enumerate(fields)
        ],
    )
    picked = [F.col(f"_{i}.{part}").alias(name) for i, n in enumerate(fields) for part, name in (("value", n), ("row_id", f"{n}_row_id"), ("truth", f"{n}_truth"), ("values", f"{n}_values"))]
    return out.select("entity", "n_rows", *picked), quality
