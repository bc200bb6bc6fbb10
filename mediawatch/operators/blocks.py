"""Half-hour transcript blocks as text and subtitle files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediawatch.functions import text as T
from mediawatch.functions.timefn import block_end, block_start, seconds_between, shift_seconds, srt_time
from mediawatch.operators import guide
from mediawatch.scale import place_of, stored


def _stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")


def block_rows(chunks: DataFrame) -> DataFrame:
    """Speech chunks with their event-time block, place in it and end."""
    w = Window.partitionBy("channel_id", "block").orderBy("ts", "id")
    return (
        chunks.filter(T.is_speech(F.col("text")))
        .withColumn("block", block_start(F.col("ts")))
        .withColumn("idx", F.row_number().over(w))
        .withColumn("end_ts", shift_seconds(F.col("ts"), F.coalesce("duration_sec", F.lit(0.0))))
    )


def srt_rows(chunks: DataFrame) -> DataFrame:
    """Subtitle entries: number in the block and times relative to its start."""

    def rel(t: str) -> Column:
        return srt_time(seconds_between(F.col(t), F.col("block")) * 1000)

    return block_rows(chunks).select(
        "channel_id", "channel_name", "block", "idx", rel("ts").alias("start_tc"), rel("end_ts").alias("end_tc"), "text"
    )


def _file_base() -> Column:
    return F.concat(F.format_string("canal_%02d_", "channel_id"), T.safe_name(F.col("channel_name")))


def _folder(block: Column) -> Column:
    return F.concat(F.date_format(block, "yyyy-MM-dd_HH-mm"), F.date_format(block_end(block), "_HH-mm"))


def text_lines(chunks: DataFrame, programmes: DataFrame) -> DataFrame:
    """Lines of the readable block files: a header with the programme on air when the block opens
    (its first chunk), then one line per chunk."""
    rows = block_rows(chunks)
    opened = guide.with_programme(rows.filter("idx = 1"), programmes)
    header = F.array(
        F.concat(F.lit("# [EPG] "), F.when(F.col("programme") != "", F.col("programme")).otherwise("sin datos")),
        F.concat(F.lit("# Bloque: "), _plain(F.col("block")), F.lit(" → "), _plain(block_end(F.col("block")))),
        F.lit("# Formato: [start → end] texto"),
    )
    keys = [_folder(F.col("block")).alias("window"), _file_base().alias("channel"), "block", "channel_id"]
    heads = opened.select(*keys, F.posexplode(header).alias("_p", "line")).select(
        "window", "channel", "block", "channel_id", (F.col("_p") - 3).alias("pos"), "line"
    )
    line = F.concat(
        F.lit("["), _stamp(F.col("ts")), F.lit(" → "), F.date_format("end_ts", "HH:mm:ss.SSS"), F.lit("] "), F.col("text")
    )
    return heads.unionByName(rows.select(*keys, F.col("idx").alias("pos"), line.alias("line")))


def _plain(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def srt_lines(chunks: DataFrame) -> DataFrame:
    """Subtitle entries as file text, one row per entry."""
    entry = F.concat(
        F.col("idx").cast("string"), F.lit("\n"), F.col("start_tc"), F.lit(" --> "), F.col("end_tc"), F.lit("\n"), F.col("text"), F.lit("\n")
    )
    return srt_rows(chunks).select(
        _folder(F.col("block")).alias("window"), _file_base().alias("channel"), F.col("idx").alias("pos"), entry.alias("line")
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """One folder per (window, channel), its lines in order. The windows of the lines are replaced, with all their
    channels; other windows stay as they are."""
    spark = lines.sparkSession
    rows = stored(lines.select("window", "channel", "pos", "line"), "block-lines")
    parts = {(r["window"], r["channel"]) for r in rows.select("window", "channel").distinct().collect()}  # files, not lines
    (
        rows.repartition("window", "channel")
        .sortWithinPartitions("window", "channel", "pos")
        .select("window", "channel", "line")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("window", "channel")
        .text(path)
    )
    for window in {w for w, _ in parts}:
        system, place = place_of(f"{path}/window={window}/channel=*", spark)
        for found in system.globStatus(place) or []:
            name = found.getPath().getName().removeprefix("channel=")
            if (window, name) not in parts:
                system.delete(found.getPath(), True)
