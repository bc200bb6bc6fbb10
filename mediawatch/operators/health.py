"""Channel health, live status and transcription quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediawatch.functions import text as T
from mediawatch.functions.timefn import (
    age_seconds,
    fluency_pct,
    freshness_band,
    heartbeat_band,
    seconds,
    shift_seconds,
    stability_pct,
)
from mediawatch.operators.ordered import HOUR, time_bucket
from mediawatch.scale import shipped, stored
from mediawatch.sources.transcripts import between_days

MIN_OK_CHUNKS = 20
ALIVE_SECONDS = 300
ZOMBIE_SECONDS = 180


def on_day(rows: DataFrame, day: Column, ts: str = "ts") -> DataFrame:
    """Rows of one calendar day, as a range that reaches the scan (and its folder, if the table has one a day)."""
    return between_days(rows, day, day, ts)


def failure_counts(failures: DataFrame, day: Column) -> DataFrame:
    return on_day(failures, day).groupBy("channel_id", "channel_name", "reason").agg(
        F.count(F.lit(1)).alias("n")
    )


def failures_by_channel(failures: DataFrame, day: Column) -> DataFrame:
    """Per channel: total and its reasons, the most frequent first."""
    ranked = F.array_sort(
        F.collect_list(F.struct((-F.col("n")).alias("_neg"), "reason", "n"))
    )
    return (
        failure_counts(failures, day)
        .groupBy("channel_id", "channel_name")
        .agg(F.sum("n").alias("n_failures"), ranked.alias("_r"))
        .withColumn("reasons", F.transform("_r", lambda r: F.struct(r["reason"].alias("reason"), r["n"].alias("n"))))
        .drop("_r")
    )


def daily_chunks(chunks: DataFrame, day: Column) -> DataFrame:
    return on_day(chunks, day).groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def integrity_class(n: Column, min_ok: int = MIN_OK_CHUNKS) -> Column:
    return F.when(n >= min_ok, F.lit("ok")).when(n > 0, F.lit("low")).otherwise(F.lit("none"))


def channel_integrity(
    roster: DataFrame, chunks: DataFrame, status: DataFrame, day: Column, min_ok: int = MIN_OK_CHUNKS
) -> DataFrame:
    """Every roster channel with its day's chunks, span, class and last status."""
    state = status.select("channel_id", "restart_count", "error_count", "last_error")
    return (
        roster.join(daily_chunks(chunks, day), "channel_id", "left")
        .join(state, "channel_id", "left")
        .na.fill(0, ["n_chunks"])
        .withColumn("integrity", integrity_class(F.col("n_chunks"), min_ok))
    )


def integrity_totals(integrity: DataFrame) -> DataFrame:
    return integrity.agg(
        *[F.count_if(F.col("integrity") == k).alias(f"n_{k}") for k in ("ok", "low", "none")]
    )


def probable_causes(by_channel: DataFrame, integrity: DataFrame, reachability: DataFrame | None = None) -> DataFrame:
    """Ordered cause lines: unreachable hosts, failing channels, silent channels; one default line if none.

    reachability (optional): host, reachable.
    """
    top = F.array_join(
        F.transform(F.slice("reasons", 1, 2), lambda r: F.substring(r["reason"], 1, 60)), ", "
    )
    failing = by_channel.select(
        F.lit(2).alias("part"),
        (-F.col("n_failures")).alias("pos"),
        F.col("channel_id").cast("bigint").alias("tie"),
        F.format_string("Channel %02d (%s): %d failures - %s", "channel_id", "channel_name", "n_failures", top).alias("cause"),
    )
    silent = integrity.filter("integrity = 'none'").select(
        F.lit(3).alias("part"),
        F.col("channel_id").cast("bigint").alias("pos"),
        F.lit(0).cast("bigint").alias("tie"),
        F.format_string("Channel %02d (%s): no transcript all day", "channel_id", "name").alias("cause"),
    )
    lines = failing.unionByName(silent)
    if reachability is not None:
        lines = lines.unionByName(
            reachability.filter(~F.col("reachable")).select(
                F.lit(1).alias("part"),
                F.lit(0).cast("bigint").alias("pos"),
                F.lit(0).cast("bigint").alias("tie"),
                F.concat(F.lit("Host "), "host", F.lit(" unreachable")).alias("cause"),
            )
        )
    default = (
        lines.agg(F.count(F.lit(1)).alias("n"))
        .filter("n = 0")
        .select(
            F.lit(9).alias("part"),
            F.lit(0).cast("bigint").alias("pos"),
            F.lit(0).cast("bigint").alias("tie"),
            F.lit("No probable cause found").alias("cause"),
        )
    )
    return lines.unionByName(default).orderBy("part", "pos", "tie", "cause")


def warning_count(logs: DataFrame, day: str) -> DataFrame:
    """Log lines of the day that carry a warning."""
    return logs.filter(F.col("value").rlike(rf"^{day}.*WARNING")).agg(F.count(F.lit(1)).alias("warnings"))


def health_report(
    roster: DataFrame,
    chunks: DataFrame,
    failures: DataFrame,
    status: DataFrame,
    day: Column,
    min_ok: int = MIN_OK_CHUNKS,
    reachability: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The daily report's parts as DataFrames."""
    by_channel = failures_by_channel(failures, day)
    integrity = channel_integrity(roster, chunks, status, day, min_ok)
    return {
        "failures": by_channel.orderBy(F.col("n_failures").desc(), "channel_id"),
        "channels": integrity.orderBy("channel_id"),
        "totals": integrity_totals(integrity),
        "causes": probable_causes(by_channel, integrity, reachability),
    }


def newest_instants(chunks: DataFrame) -> DataFrame:
    """(channel_id, id, ts, top_ts): the highest id of each channel, its instant, and the channel's last instant."""
    return chunks.groupBy("channel_id").agg(F.max(F.struct("id", "ts")).alias("_n"), F.max("ts").alias("top_ts")).select(
        "channel_id", "_n.id", "_n.ts", "top_ts"
    )


def newer_instants(stored_rows: DataFrame, more: DataFrame) -> DataFrame:
    """`newest_instants` of two tables, from theirs; the same rows again change nothing."""
    return stored_rows.unionByName(more).groupBy("channel_id").agg(
        F.max(F.struct("id", "ts")).alias("_n"), F.max("top_ts").alias("top_ts")
    ).select("channel_id", "_n.id", "_n.ts", "top_ts")


def latest_per_channel(chunks: DataFrame, newest: DataFrame | None = None) -> DataFrame:
    """The newest chunk (highest id) of each channel.

    newest: the table of `newest_instants` that a live job keeps (`alerts.read_newest`); without it they are found on
    narrow columns of all days. Then only the days that hold them are read with their text.
    """
    marks = stored((newest_instants(chunks) if newest is None else newest).select("channel_id", "id", "ts"), "newest-chunks")
    return recent_days(chunks, marks).join(shipped(marks), ["channel_id", "id", "ts"]).groupBy("channel_id").agg(
        F.max(F.struct(*[c for c in chunks.columns if c != "channel_id"])).alias("_r")
    ).select("channel_id", "_r.*")


def recent_days(chunks: DataFrame, marks: DataFrame, back: int = 0) -> DataFrame:
    """The chunks from the day of the earliest mark on, or `back` seconds before it."""
    first = marks.agg(F.min("ts")).first()[0]
    if first is None:
        return chunks
    since = F.lit(first).cast("timestamp_ntz") - seconds(back)
    own = chunks.filter(F.col("ts") >= since)
    return own.filter(F.col("date") >= F.to_date(since)) if "date" in chunks.columns else own


def latest_with_status(chunks: DataFrame, status: DataFrame, limit: int = 20, newest: DataFrame | None = None) -> DataFrame:
    """Newest chunk of each channel with its status, the first 20 channels."""
    last = latest_per_channel(chunks, newest).select("channel_id", "channel_name", "ts", "text", "confidence")
    return last.join(status.select("channel_id", "status", "total_segments"), "channel_id").orderBy("channel_id").limit(limit)


def alive_channels(status: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Channels whose heartbeat is at most five minutes old."""
    alive = status.filter(F.col("heartbeat") >= now - seconds(ALIVE_SECONDS))
    return alive.orderBy("channel_id").limit(limit) if limit else alive


def live_snapshot(
    chunks: DataFrame, status: DataFrame, now: Column, window: int = 30, newest: DataFrame | None = None
) -> DataFrame:
    """Per live channel: speech of the last `window` seconds before its newest chunk, and how it flows.

    Without speech in the window the last chunk by id is shown. The newest instants come from the table that a live job
    keeps (`newest`), or else from narrow columns of all days; texts are read only of the days from the earliest on.
    """
    live = alive_channels(status, now)
    if newest is None:
        newest = newest_instants(chunks.select("channel_id", "id", "ts").join(live.select("channel_id"), "channel_id", "left_semi"))
    tops = stored(
        newest.join(live.select("channel_id"), "channel_id", "left_semi").select(
            "channel_id", F.col("top_ts").alias("_top"), F.col("ts").alias("_last_ts")
        ),
        "newest-instants",
    )
    marks = tops.select(F.least(F.col("_top"), F.col("_last_ts")).alias("ts"))
    own = recent_days(chunks, marks, window).join(shipped(tops), "channel_id")
    anchor = own.groupBy("channel_id").agg(
        F.max("_top").alias("_top"), F.max_by(F.struct("text", "confidence"), "id").alias("_last")
    )
    speech = T.is_speech(F.col("text"))
    recent = (
        own.filter(F.col("ts") >= F.col("_top") - seconds(window))
        .groupBy("channel_id")
        .agg(
            F.array_sort(F.collect_list(F.when(speech, F.struct("id", "text")))).alias("_said"),
            F.avg(F.when(speech, F.col("confidence"))).alias("_conf"),
            F.count(F.lit(1)).alias("n_chunks"),
            F.max_by("ts", "id").alias("last_ts"),
        )
    )
    said = F.array_join("_said.text", " ")
    last_speech = T.is_speech(F.col("_last.text"))
    fallback = F.when(last_speech, F.col("_last.text")).otherwise(F.lit(T.SILENCE))
    spoke = F.size("_said") > 0
    last_conf = F.when(last_speech & (F.col("_last.confidence") > 0), F.col("_last.confidence"))
    return (
        live.join(anchor, "channel_id", "left")
        .join(recent, "channel_id", "left")
        .select(
            "channel_id",
            "channel_name",
            F.coalesce("last_ts", "last_seen").alias("last_ts"),
            F.coalesce(F.when(spoke, said), fallback).alias("text"),
            F.coalesce(F.when(spoke, F.col("_conf")).otherwise(last_conf), F.lit(0.0)).alias("confidence"),
            F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
            fluency_pct(F.coalesce("n_chunks", F.lit(0)), window).alias("fluency"),
            "status",
            "total_segments",
            "heartbeat",
            "error_count",
        )
    )


def status_snapshot(status: DataFrame, now: Column) -> DataFrame:
    """Heartbeat age, bands, and zombies: processes alive without a recent heartbeat."""
    age = F.when(F.col("heartbeat").isNotNull(), age_seconds(now, F.col("heartbeat")))
    return status.withColumn("age", age).select(
        "channel_id",
        "status",
        "age",
        freshness_band(F.coalesce("age", F.lit(9999))).alias("freshness"),
        heartbeat_band(F.coalesce("age", F.lit(9999))).alias("heartbeat_state"),
        (F.col("age").isNotNull() & (F.col("age") > ZOMBIE_SECONDS) & (F.col("status") == "running")).alias("zombie"),
    )


def status_today(status: DataFrame, chunks: DataFrame, today: Column) -> DataFrame:
    """Status list with the number of chunks since the start of the day."""
    own = chunks.filter(F.col("ts") >= today)
    own = own.filter(F.col("date") >= F.to_date(today)) if "date" in chunks.columns else own
    n = own.groupBy("channel_id").agg(F.count(F.lit(1)).alias("segments_today"))
    return status.join(n, "channel_id", "left").na.fill(0, ["segments_today"])


def latest_status(events: DataFrame, key: str = "channel_id", at: str = "updated_at") -> DataFrame:
    """Last-value table over an append-only event table."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("_r")).select(key, "_r.*")


def stability(failures: DataFrame, roster: DataFrame, hours: Column) -> DataFrame:
    """Restarts per hour of each channel and the stability it amounts to."""
    n = failures.groupBy("channel_id").agg(F.count(F.lit(1)).alias("restarts"))
    rate = F.col("restarts") / F.greatest(hours, F.lit(1 / 60))
    return (
        roster.join(n, "channel_id", "left")
        .na.fill(0, ["restarts"])
        .withColumn("restarts_per_hour", rate)
        .withColumn("stability", stability_pct(F.col("restarts_per_hour")))
    )


def language_drift(chunks: DataFrame, window: str = "1 hour") -> DataFrame:
    """Share of English function words per channel and time window."""
    return (
        chunks.filter(T.is_speech(F.col("text")))
        .groupBy("channel_id", F.window("ts", window).alias("w"))
        .agg(F.sum(T.english_hits(F.col("text"))).alias("n_english"), F.sum(F.size(T.words(F.col("text")))).alias("n_words"))
        .select(
            "channel_id",
            F.col("w.start").alias("window_start"),
            "n_english",
            "n_words",
            (F.col("n_english") / F.greatest("n_words", F.lit(1))).alias("drift"),
        )
    )


def throughput(jobs: DataFrame) -> DataFrame:
    """Chunks and real-time factor per channel. jobs: channel_id, audio_sec, infer_sec."""
    return jobs.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.when(F.sum("infer_sec") > 0, F.sum("audio_sec") / F.sum("infer_sec")).otherwise(0.0).alias("rtfx"),
    )


def unplanned_failures(failures: DataFrame, in_pause: Column) -> DataFrame:
    """Failures outside the planned nightly pause."""
    return failures.filter(~in_pause)


def caption_spans(blocks: DataFrame) -> DataFrame:
    """Caption rows with a start that never precedes the end of the channel's previous caption.

    blocks: channel_id, end_ts, duration_sec, plus a tie-breaking `seq`.
    """
    own = blocks.withColumn("_b", time_bucket(F.col("end_ts"), HOUR))
    inside = Window.partitionBy("channel_id", "_b").orderBy("end_ts", "seq")
    across = Window.partitionBy("channel_id").orderBy("_b")
    edges = own.groupBy("channel_id", "_b").agg(F.max("end_ts").alias("_last")).select(
        "channel_id", "_b", F.lag("_last").over(across).alias("_before")
    )
    raw = shift_seconds(F.col("end_ts"), -F.col("duration_sec"))
    return (
        own.withColumn("_prev", F.lag("end_ts").over(inside))
        .join(edges, ["channel_id", "_b"])
        .withColumn("_prev", F.coalesce("_prev", "_before"))
        .withColumn("start_ts", F.least(F.greatest(raw, F.coalesce("_prev", raw)), F.col("end_ts")))
        .drop("_prev", "_before", "_b")
    )


def committed_segments(segments: DataFrame, hop_seconds: int = 120, tolerance: float = 0.01) -> DataFrame:
    """Segments of overlapping passes kept once: by the pass in whose new region they start."""
    new_from = F.col("hop") * hop_seconds
    keep = (F.trim("text") != "") & ((F.col("hop") == 0) | (F.col("start_s") >= new_from - F.lit(tolerance)))
    return segments.filter(keep)
