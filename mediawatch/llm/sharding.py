"""Weighted shards by rendezvous hashing, with gapless places inside every shard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediawatch.llm.common import hidden

SHARDS = 24
#: Parts a shard is numbered in; a part is one window, so it bounds what a task sorts.
PARTS = 1024
#: Copies of one row that one array of places may hold.
RUN = 65_536


def distance(key: Column, shard: int, weight: float) -> Column:
    """Exponential draw of a key for a shard, with the weight as its rate; the least draw wins the key."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(shard), key.cast("string")), 11)
    unit = (draw.cast("double") + F.lit(0.5)) / F.lit(float(2**53))
    return F.negative(F.log(unit)) / F.lit(float(weight))


def nearest(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key, ties to the lower number; a shard of weight 0 gets none."""
    drawn = [
        F.struct(distance(key, i, w).alias("d"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0
    ]
    if not drawn:
        raise ValueError("no shard has a positive weight")
    return (drawn[0] if len(drawn) == 1 else F.least(*drawn)).getField("shard")


def assign(df: DataFrame, key: str, weights: Sequence[float], to: str = "shard") -> DataFrame:
    """Every row with its shard (int), without a shuffle; only the key and the weights decide.

    Each shard draws for the key on its own, so one more shard takes rows from the others and moves
    none between them, and a changed weight moves rows only to or from its shard. Equal keys share a
    shard; null keys are one key. A column already called `to` is replaced.
    """
    return df.withColumn(to, nearest(F.col(f"`{key}`"), weights))


def placed(rows: DataFrame, shard: str, order: list[str], copies: str, parts: int = PARTS) -> DataFrame:
    """One row per copy with `slot`, its place in the shard from 0 without gaps.

    `rows` holds each distinct row once with its number of copies. Every shard is numbered in parts by
    hash; the parts' totals (shards x parts rows, whatever the input) give each part its start.
    """
    part, start, before, block = (hidden(rows, n) for n in ("part", "start", "before", "block"))
    cut = rows.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    total = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(shard, part)
        .agg(F.sum(copies).alias(start))
        .withColumn(start, F.coalesce(F.sum(start).over(total), F.lit(0)))
    )
    inside = Window.partitionBy(shard, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = (
        cut.withColumn(before, F.coalesce(F.sum(copies).over(inside), F.lit(0)))
        .join(F.broadcast(starts), [shard, part])
        .withColumn(before, F.col(before) + F.col(start))
    )
    blocks = first.withColumn(
        block, F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"({copies} - 1) div {RUN}")))
    )
    width = F.least(F.lit(RUN).cast("bigint"), F.col(copies) - F.col(block) * RUN)
    return blocks.select(
        *rows.columns,
        F.explode(
            F.sequence(F.col(before) + F.col(block) * RUN, F.col(before) + F.col(block) * RUN + width - 1)
        ).alias("slot"),
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, parts: int = PARTS) -> DataFrame:
    """Manifest of the documents over equal shards under the key law: one row per input row.

    Columns: doc_id, size (UTF-8 bytes of the text + 8), text_crc32 (of the UTF-8 bytes, unsigned), law,
    shard, slot, grown_shard (the shard when there is one more). A null text has no bytes (size 8, crc 0);
    a null doc_id is a key of its own; repeated rows get places of their own; an empty table gives no
    rows; further columns are ignored. Identical rows are counted before the first shuffle, so a row
    that fills a third of the table is one row there.
    """
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
    )
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    grown = [1.0] * (shards + 1)
    dealt = assign(assign(counted, "doc_id", grown[:-1]), "doc_id", grown, "grown_shard")
    return placed(dealt, "shard", ["doc_id", "size", "text_crc32"], "copies", parts).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
