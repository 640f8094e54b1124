"""Files that keep arriving: each batch is validated and appended.

An addition beside the batch load. Rows are judged one by one with the same
rules; what needs all rows of a key, copies and collisions, is left to the
batch build over what has been appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkledger.functions.text import blank_as_null
from sparkledger.operators.validate import reject_reason
from sparkledger.sources.columns import PROJECTED
from sparkledger.sources.projected import stream_projected


def assess_arrivals(rows: DataFrame) -> DataFrame:
    return rows.select(*[blank_as_null(c).alias(c) for c in PROJECTED], "_source_path").withColumn("reject_reason", reject_reason())


def append_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived, sound rows and rejects in partitions of their own, then stop.

    Exactly once: the checkpoint knows the files that were read, the sink the
    batches that were written.
    """
    rows = assess_arrivals(stream_projected(spark, folder)).withColumn("sound", F.col("reject_reason").isNull())
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("sound").trigger(availableNow=True).start()
