"""Loading records of which some are damaged.

Strict load plus anti-join: every record keeps its offset, only conforming
records are loaded, their offsets are subtracted from the raw ones, and what
remains is diagnosed. A record is thus either loaded or diagnosed, never both
or neither.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from sparkledger.functions.text import col, is_date, is_money, trimmed
from sparkledger.sources.columns import DATES, MONEY, PROJECTED, REQUIRED

#: Copies of a small keyed side, so that a key's rows on the large side are spread over as many tasks.
SALTS = 16


def salted(large: DataFrame, small: DataFrame, keys: Sequence[str], spread: Column, how: str) -> DataFrame:
    """Join ``large`` with ``small`` (unique by ``keys``) without gathering a hot key.

    ``spread`` is any column of ``large`` that varies within a key. Nothing is
    broadcast by force; a small side that proves small is by adaptive planning.
    """
    left = large.withColumn("_salt", F.pmod(F.hash(spread), F.lit(SALTS)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def value_reasons() -> list[tuple[str, Column]]:
    """What can be wrong with a record's values, each with the test for it."""
    missing = [(f"missing_required:{c}", trimmed(c).isNull()) for c in REQUIRED]
    dates = [(f"malformed:{c}", trimmed(c).isNotNull() & ~is_date(trimmed(c))) for c in DATES]
    money = [(f"malformed:{c}", trimmed(c).isNotNull() & ~is_money(trimmed(c))) for c in MONEY]
    return [*missing, *dates, *money]


CHECKED = tuple(dict.fromkeys([*REQUIRED, *DATES, *MONEY]))


def _reasons() -> Column:
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in value_reasons()]), lambda x: x.isNotNull())


def _sound() -> Column:
    ok = F.lit(True)
    for _, bad in value_reasons():
        ok &= ~bad
    return ok


def typed(df: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Conforming text as typed columns: 3 dates, 4 decimal(20,2), the rest trimmed text."""
    as_type = {**dict.fromkeys(DATES, "date"), **dict.fromkeys(MONEY, "decimal(20,2)")}
    return df.select(*[trimmed(c).try_cast(as_type.get(c, "string")).alias(c) for c in PROJECTED], *carried)


def load_table(raw: DataFrame, offset: str = "_load_seq", carried: Sequence[str] = ("_source_path", "_input_index", "_load_seq")) -> tuple[DataFrame, DataFrame]:
    """Split a table of text columns into loaded rows and (load_seq, reason).

    ``offset`` must be unique. Values are trimmed of spaces; null and empty are
    the same. A row lacking a required field or holding a malformed date or
    amount is not loaded, nor is any row of a transaction key that stands, among
    the rows that are sound so far, with two different contents. Repeated rows
    of one content are all loaded. Extra columns are ignored; an empty table
    gives two empty results.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(trimmed(c), F.lit("")) for c in PROJECTED])
    # two independent 64-bit hashes, compared within one key only; longs keep the aggregate hash-based
    strict = raw.where(_sound()).select(offset, trimmed(REQUIRED[0]).alias("_key"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), F.reverse(text)).alias("h2"))
    contents = strict.groupBy("_key").agg(*[f(h).alias(f"{n}{h}") for h in ("h1", "h2") for n, f in (("lo", F.min), ("hi", F.max))])
    collided = contents.where("loh1 <> hih1 or loh2 <> hih2").select("_key")
    loaded = salted(strict, collided, ["_key"], F.col(offset), "left_anti").select(offset)
    checked = raw.select(offset, *[c for c in CHECKED if c != offset])
    rest = checked.join(loaded, offset, "left_anti").select(offset, _reasons().alias("reasons"))
    rest = rest.select(col(offset).alias("load_seq"), F.explode(F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("identity_collision")))).alias("reason"))
    return typed(raw.join(loaded, offset, "left_semi"), carried), rest


# A field of a record: enclosed in quotes with inner quotes doubled, or without any quote; then a comma or the end.
_FIELD = re.compile(r'(?:"((?:[^"]++|"")*+)"|([^",]*+))(,|\Z)')


def split_record(text: str) -> list[str] | None:
    """The fields of a record by RFC 4180, unquoted, or None if its quoting is broken."""
    if '"' not in text:
        return text.split(",")
    out, at = [], 0
    while True:
        m = _FIELD.match(text, at)
        if m is None:
            return None
        out.append(m[2] if m[1] is None else m[1].replace('""', '"'))
        if not m[3]:
            return out
        at = m.end()


@lru_cache(maxsize=10_000)
def _header(text: str, wanted: tuple[str, ...]) -> tuple[int, tuple[int, ...]]:
    """Number of columns that a header names, and where each wanted one stands (-1 if it doesn't); a damaged header names what stands between its commas."""
    names = [n.strip(" ") for n in split_record(text) or text.split(",")]
    return len(names), tuple(names.index(c) if c in names else -1 for c in wanted)


def _parsed(records: DataFrame, wanted: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Each record (_text, _header_text) split once: carried columns, _quoted, _fits, and the wanted fields where both hold."""
    fields = [records.schema[c] for c in carried]
    wanted = tuple(wanted)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            quoted, fits, rows = [], [], []
            for text, head in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                width, places = _header(head, wanted)
                own = split_record(text)
                quoted.append(own is not None)
                fits.append(own is not None and len(own) == width)
                rows.append([own[i] if i >= 0 else None for i in places] if fits[-1] else [None] * len(wanted))
            values = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * len(wanted)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(quoted, pa.bool_()), pa.array(fits, pa.bool_()), *values], names=[*b.schema.names[:-2], "_quoted", "_fits", *wanted])

    schema = StructType([*fields, StructField("_quoted", BooleanType()), StructField("_fits", BooleanType()), *(StructField(c, StringType()) for c in wanted)])
    return records.select(*carried, "_text", "_header_text").mapInArrow(split, schema)


def load_lines(lines: DataFrame, path: str = "_source_path", offset: str = "_load_seq", text: str = "record_text", carried: Sequence[str] = ("_source_path", "_input_index", "_load_seq")) -> tuple[DataFrame, DataFrame]:
    """Split delivered records into loaded rows and (load_seq, reason).

    The record of the least ``offset`` of each file names its columns, in any
    order; columns beyond the projected ones are ignored and a projected one
    that a file lacks is null. A record is loaded if it is well quoted, has as
    many fields as its header and sound values. A null record is an empty one:
    one empty field. A file's header is never a record, even if damaged. A null
    path is a file of its own.

    Records are split by a scanner, once for the strict load; what its offsets
    leave of the raw ones, the remainder alone, is split again and diagnosed.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    raw = lines.select(*dict.fromkeys([*carried, path, offset]), F.coalesce(path, F.lit("")).alias("_file"), t.alias("_text"))
    # longs keep the aggregate hash-based; the few header texts are fetched by their offsets
    first = raw.groupBy("_file").agg(F.min(offset).alias("_header_at"))
    header = first.join(raw.select(F.col(offset).alias("_header_at"), F.col("_text").alias("_header_text")), "_header_at")
    records = salted(raw, header, ["_file"], F.col(offset), "inner").where(F.col(offset) != F.col("_header_at"))
    strict = _parsed(records, CHECKED, [offset]).where(F.col("_quoted") & F.col("_fits") & _sound()).select(offset)
    rest = _parsed(records.join(strict, offset, "left_anti"), CHECKED, [offset])
    reason = F.when(~F.col("_quoted"), F.array(F.lit("broken_quoting"))).when(~F.col("_fits"), F.array(F.lit("column_count"))).otherwise(_reasons())
    loaded = _parsed(records, PROJECTED, list(dict.fromkeys(carried))).where(F.col("_quoted") & F.col("_fits") & _sound())
    return typed(loaded, carried), rest.select(col(offset).alias("load_seq"), F.explode(reason).alias("reason"))
