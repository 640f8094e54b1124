"""Projected transaction files: header contract and all-text scan."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkledger.sources.columns import PROJECTED


def header(path: str | Path) -> list[str]:
    """The first record of a file; an empty file is an error. A byte order mark is no part of it."""
    with open(path, encoding="utf-8-sig", newline="") as f:
        first = next(csv.reader(f), None)
    if not first:
        raise ValueError(f"{path} has no header")
    return first


def require_columns(path: str | Path, names: Sequence[str]) -> None:
    """No name twice, every projected one present; others are ignored."""
    if repeated := sorted({n for n in names if list(names).count(n) > 1}):
        raise ValueError(f"{path}: columns stand twice: {', '.join(repeated)}")
    if lost := [c for c in PROJECTED if c not in names]:
        raise ValueError(f"{path}: columns are missing: {', '.join(lost)}")


def load_projected(spark: SparkSession, paths: Sequence[str | Path]) -> DataFrame:
    """All records of the files as text, with _source_path, _input_index and _load_seq.

    _load_seq grows with the file, then with the place in it; it is unique and
    has gaps. Files of one header are read together, each once and whole by one
    task, so the plan grows with the number of headers, not of files.
    """
    if not paths:
        raise ValueError("no file to load")
    by_header: dict[tuple[str, ...], list[Path]] = {}
    known = []
    for i, p in enumerate(map(Path, paths)):
        if not p.is_file():
            raise FileNotFoundError(p)
        names = header(p)
        require_columns(p, names)
        by_header.setdefault(tuple(names), []).append(p)
        # a file's name as Spark escapes it
        known.append((spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file:{p.resolve()}").toUri().toString(), str(p), i))
    if len({uri for uri, _, _ in known}) < len(paths):
        raise ValueError("a file stands twice")
    files = F.broadcast(spark.createDataFrame(known, "_uri string, _source_path string, _input_index int"))  # a short row a file
    parts = []
    for names, own in by_header.items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        rows = spark.read.schema(schema).csv([str(p.resolve()) for p in own], header=True, multiLine=True, escape='"', encoding="utf-8", enforceSchema=True)
        at = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
        parts.append(rows.select(*[F.col(f"`{c}`") for c in PROJECTED], at.alias("_uri"), F.monotonically_increasing_id().alias("_place")))
    index = F.coalesce("_input_index", F.raise_error(F.concat(F.lit("a record of an unknown file: "), F.col("_uri"))).cast("int"))
    seq = F.col("_input_index").cast("long") * F.lit(1 << 52) + F.col("_place")
    return reduce(DataFrame.unionByName, parts).join(files, "_uri", "left").select(*PROJECTED, "_source_path", index.alias("_input_index"), seq.alias("_load_seq"))


def stream_projected(spark: SparkSession, folder: str, names: Sequence[str] = PROJECTED, files_per_trigger: int = 16) -> DataFrame:
    """Files that arrive in a folder as an unbounded table of text with _source_path."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).csv(folder, header=True, multiLine=True, escape='"')
    return rows.select(*[F.col(f"`{c}`") for c in PROJECTED], F.col("_metadata.file_path").alias("_source_path"))
