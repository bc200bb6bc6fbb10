"""Recorded-segment catalogue: names, blocks of a day, clips and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediawatch.functions import text as T
from mediawatch.functions.timefn import epoch_seconds, seconds, seconds_between
from mediawatch.operators import guide, ordered
from mediawatch.scale import stored

# How recorded files and channel folders are named.
SEGMENT_NAME = r"_(\d{4}-\d{2}-\d{2})_(\d{2})-(\d{2})\.(ts|mp4|mkv)$"
FOLDER_NAME = r"(?:^|/)canal_(\d+)_([^/]+)/[^/]+$"

CLIP_SIDE = 10
CLIP_STEPS = 4
UNDATED = "9999-12-31 00:00:00"


def parse_segments(files: DataFrame) -> DataFrame:
    """Files with folder, channel number and safe name, start minute and extension from the path.

    A name without a date keeps a NULL start.
    """
    path = F.col("path")

    def part(i: int) -> Column:
        return F.regexp_extract(path, SEGMENT_NAME, i)

    stamp = F.concat_ws(" ", part(1), F.concat_ws(":", part(2), part(3), F.lit("00")))
    num = F.regexp_extract(path, FOLDER_NAME, 1)
    return files.select(
        "*",
        F.regexp_extract(path, r"^(.*)/[^/]+$", 1).alias("folder"),
        F.when(num != "", num.cast("int")).alias("channel_id"),
        F.regexp_extract(path, FOLDER_NAME, 2).alias("safe_channel"),
        F.when(F.regexp_like(path, F.lit(SEGMENT_NAME)), stamp.try_cast("timestamp_ntz")).alias("start_ts"),
        F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1).alias("ext"),
    )


def _preference() -> Column:
    """Finalised mp4 first, then ts, then mkv."""
    return F.when(F.col("ext") == "mp4", 0).when(F.col("ext") == "ts", 1).otherwise(2)


def preferred_files(segments: DataFrame) -> DataFrame:
    """One file per (channel, start): the finalised one if there is any."""
    rest = [c for c in segments.columns if c not in ("channel_id", "start_ts")]
    return (
        segments.filter(F.col("start_ts").isNotNull())
        .groupBy("channel_id", "start_ts")
        .agg(F.min_by(F.struct(*rest), F.struct(_preference(), F.col("path"))).alias("_r"))
        .select("channel_id", "start_ts", "_r.*")
    )


def channel_names(segments: DataFrame, roster: DataFrame) -> DataFrame:
    """Exact channel name from the roster, else the folder's with spaces for underscores."""
    named = segments.join(roster.select("channel_id", F.col("name").alias("_name")), "channel_id", "left")
    own = F.trim(F.replace("safe_channel", F.lit("_"), F.lit(" ")))
    return named.withColumn("channel_name", F.coalesce("_name", own)).drop("_name")


def day_blocks(segments: DataFrame, roster: DataFrame, programmes: DataFrame, day: Column | None = None) -> DataFrame:
    """Recorded blocks (of one day) with the programme on air when each starts."""
    if day is not None:
        segments = segments.filter((F.col("start_ts") >= day) & (F.col("start_ts") < F.date_add(day, 1)))
    blocks = channel_names(preferred_files(segments), roster)
    return guide.with_programme(blocks, programmes, ts="start_ts", out="title")


def recording_dates(segments: DataFrame) -> DataFrame:
    """Days with a recording per channel, newest first."""
    dated = segments.filter(F.col("start_ts").isNotNull())
    return dated.select("channel_id", F.to_date("start_ts").alias("day")).distinct().orderBy("channel_id", F.col("day").desc())


def _order() -> Column:
    """Order of files that start in the same minute, as listed: ts, mp4, mkv."""
    return F.when(F.col("ext") == "ts", 0).when(F.col("ext") == "mp4", 1).otherwise(2)


def _covers(start: Column, duration: Column, moment: Column) -> Column:
    """A known duration must reach past the moment; an unknown one (NULL or 0) is taken on trust."""
    return (F.coalesce(duration, F.lit(0.0)) == 0) | (seconds_between(moment, start) < duration)


def segment_at(moments: DataFrame, segments: DataFrame, ts: str = "ts") -> DataFrame:
    """Moments that some recording shows, with its path and the offset in seconds.

    Only the last segment started by then counts, even if an earlier longer one still runs.
    moments carry safe_channel.
    """
    listed = segments.filter(F.col("start_ts").isNotNull()).withColumn("_order", _order())
    found = ordered.asof_last(
        moments, listed, ["safe_channel"], ts, "start_ts", ["_order", "path", "duration_sec"], out="_seg"
    )
    shown = F.col("_seg").isNotNull() & _covers(F.col("_seg.at"), F.col("_seg.duration_sec"), F.col(ts))
    return found.filter(shown).select(
        *moments.columns,
        F.col("_seg.path").alias("path"),
        seconds_between(F.col(ts), F.col("_seg.at")).cast("double").alias("offset_sec"),
    )


def clip_plan(
    moments: DataFrame,
    segments: DataFrame,
    moment_id: str,
    ts: str = "ts",
    before: int = CLIP_SIDE,
    after: int = CLIP_SIDE,
    steps: int | None = None,
) -> DataFrame:
    """(moment_id, piece, path, offset_sec, length_sec) whose pieces in order make the clip.

    A cursor walks from the window's start: take the segment on at the cursor up to its end or the
    window's, else jump to the next start inside the window; with `steps` so many at most, jumps included.
    Candidates are the segment on at the window's start and the few that start inside it.
    """
    listed = segments.filter(F.col("start_ts").isNotNull()).withColumn("_order", _order())
    spots = moments.select(
        moment_id, "safe_channel", (F.col(ts) - seconds(before)).alias("_lo"), (F.col(ts) + seconds(after)).alias("_hi")
    )
    opening = ordered.asof_last(
        spots, listed, ["safe_channel"], "_lo", "start_ts", ["_order", "path", "duration_sec"], out="_open"
    )
    minute = F.floor(epoch_seconds(F.col("start_ts")) / 60).cast("bigint")
    starts = listed.select("safe_channel", "start_ts", "_order", "path", "duration_sec", minute.alias("_m"))
    wanted = spots.withColumn(
        "_m",
        F.explode(
            F.sequence(
                F.floor(epoch_seconds(F.col("_lo")) / 60).cast("bigint"),
                F.floor(epoch_seconds(F.col("_hi")) / 60).cast("bigint"),
            )
        ),
    )
    seg = F.struct(F.col("start_ts").alias("at"), "_order", "path", "duration_sec")
    inside = (
        wanted.join(starts, ["safe_channel", "_m"])
        .filter((F.col("start_ts") > F.col("_lo")) & (F.col("start_ts") < F.col("_hi")))
        .groupBy(moment_id)
        .agg(F.collect_list(seg).alias("_in"))
    )
    everything = F.array_sort(
        F.concat(
            F.when(F.col("_open").isNotNull(), F.array("_open")).otherwise(F.filter(F.array("_open"), lambda s: F.lit(False))),
            F.coalesce("_in", F.filter(F.array("_open"), lambda s: F.lit(False))),
        )
    )

    def rel(t: Column) -> Column:
        return seconds_between(t, F.col("_lo")).cast("double")

    window = float(before + after)
    piece_type = "array<struct<path:string,offset_sec:double,length_sec:double>>"
    start = F.struct(F.lit(0.0).alias("cur"), F.array().cast(piece_type).alias("pieces"))

    def step(acc: Column, _: Column) -> Column:
        cur = acc["cur"]
        begun = F.filter("_segs", lambda s: rel(s["at"]) <= cur)
        following = F.array_min(F.transform(F.filter("_segs", lambda s: rel(s["at"]) > cur), lambda s: rel(s["at"])))
        last = F.try_element_at(begun, F.lit(-1))
        dur = F.coalesce(last["duration_sec"], F.lit(0.0))
        on = last.isNotNull() & ((dur == 0) | (cur - rel(last["at"]) < dur))
        end = F.when(dur == 0, F.lit(window)).otherwise(F.least(F.lit(window), rel(last["at"]) + dur))
        piece = F.struct(
            last["path"].alias("path"),
            F.greatest(cur - rel(last["at"]), F.lit(0.0)).alias("offset_sec"),
            (end - cur).alias("length_sec"),
        )
        taken = F.struct(end.alias("cur"), F.concat(acc["pieces"], F.array(piece)).alias("pieces"))
        jumped = F.struct(F.coalesce(following, F.lit(window)).alias("cur"), acc["pieces"].alias("pieces"))
        return F.when(cur >= window, acc).when(on, taken).otherwise(jumped)

    turns = F.lit(steps) if steps is not None else 2 * F.size("_segs") + 2  # each segment is taken and jumped to once at most
    plan = F.aggregate(F.sequence(F.lit(1), turns), start, step)["pieces"]
    return (
        opening.join(inside, moment_id, "left")
        .withColumn("_segs", everything)
        .select(moment_id, F.posexplode(plan).alias("piece", "_p"))
        .select(moment_id, "piece", "_p.*")
    )


def locate_matches(enriched: DataFrame, segments: DataFrame) -> DataFrame:
    """Where each match (by its exact time) is in the recordings."""
    moments = enriched.select(
        "match_id", T.safe_name(F.col("channel_name")).alias("safe_channel"), F.col("precise_ts").alias("ts")
    )
    return segment_at(stored(moments, "moments"), segments)


def clip_plans(enriched: DataFrame, segments: DataFrame, steps: int | None = None) -> DataFrame:
    """Clip pieces of each match, ten seconds either side of its exact time."""
    moments = enriched.select(
        "match_id", T.safe_name(F.col("channel_name")).alias("safe_channel"), F.col("precise_ts").alias("ts")
    )
    return clip_plan(stored(moments, "moments"), segments, "match_id", steps=steps)


def retention_plan(segments: DataFrame, free_bytes: int, target_bytes: int) -> DataFrame:
    """Files to delete, oldest name first and undated ones last, until enough space is free.

    The running total is summed by day, minute and a 256-way shard of the path, so no task sees
    more than one of those levels.
    """
    start = F.coalesce("start_ts", F.lit(UNDATED).cast("timestamp_ntz"))
    placed = segments.select(
        "path", "length", start.alias("_start"), F.to_date(start).alias("_day"), F.substring(F.md5("path"), 1, 2).alias("_shard")
    )
    summed = ordered.running_total(placed, "length", ["_day", "_start", "_shard"], ["path"], "freed_before")
    return summed.filter(F.lit(free_bytes) + F.col("freed_before") < target_bytes).select("path", "length", "freed_before")


def aged_files(segments: DataFrame, now: Column, days: int = 2) -> DataFrame:
    """Unfinalised ts files last modified more than `days` whole days ago."""
    age = F.floor(seconds_between(now, F.col("modified")) / 86400)
    return segments.filter((F.col("ext") == "ts") & (age > days))


def finalize_plan(segments: DataFrame) -> DataFrame:
    """Source files ready to be finalised: all but the newest of each channel folder, still open."""
    sources = segments.filter(F.col("ext").isin("ts", "mkv") & F.col("channel_id").isNotNull())
    newest = sources.groupBy("folder").agg(F.max_by("path", F.struct("modified", "path")).alias("_open"))
    return sources.join(newest, "folder").filter(F.col("path") != F.col("_open")).drop("_open").withColumn(
        "target", F.regexp_replace("path", r"\.[A-Za-z0-9]+$", ".mp4")
    )
