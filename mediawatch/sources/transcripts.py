"""Reading and appending the chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("channel_id", T.IntegerType()),
        T.StructField("channel_name", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("text", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("duration_sec", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table, written by day; a filter on `date` prunes whole folders."""
    return spark.read.parquet(path)


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Append rows to their day's folder. Status and index are views over this table."""
    chunks.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").parquet(path)


def between_days(rows: DataFrame, first: Column, last: Column, ts: str = "ts") -> DataFrame:
    """Rows whose instant lies in the days first .. last; of a table written by day only their folders are read."""
    out = rows.filter((F.col(ts) >= first) & (F.col(ts) < F.date_add(last, 1)))
    return out.filter(F.col("date").between(F.to_date(first), F.to_date(last))) if "date" in rows.columns else out


def scan_chunks(
    chunks: DataFrame,
    after_id: int | None = None,
    since: str | None = None,
    until: str | None = None,
    channel_ids: list[int] | None = None,
) -> DataFrame:
    """Chunks after an id cursor, in [since, until) and on the given channels; all predicates push down."""
    out = chunks
    dated = "date" in chunks.columns
    if after_id is not None:
        out = out.filter(F.col("id") > after_id)
    if since is not None:
        out = out.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
        out = out.filter(F.col("date") >= F.to_date(F.lit(since))) if dated else out
    if until is not None:
        out = out.filter(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
        out = out.filter(F.col("date") <= F.to_date(F.lit(until))) if dated else out
    if channel_ids is not None:
        out = out.filter(F.col("channel_id").isin(channel_ids))
    return out
