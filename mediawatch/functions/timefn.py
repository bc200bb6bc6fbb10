"""Time arithmetic, banding and classification as Column expressions (TIMESTAMP_NTZ in, NTZ out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Channel id ranges of each medium.
RADIO_MIN = 27
YOUTUBE_MIN = 52
NEWS_CHANNEL = 9001

CHUNK_SECONDS = 30
BLOCK_MINUTES = 30


def seconds(n: int | float) -> Column:
    return F.make_dt_interval(secs=F.lit(float(n)).cast("decimal(18,6)"))


def shift_seconds(ts: Column, secs: Column) -> Column:
    return ts + F.make_dt_interval(secs=secs.cast("decimal(18,6)"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Exact difference in seconds as DECIMAL, free of any time zone."""
    return (later - earlier).cast("interval second").cast("decimal(20,6)")


def epoch_seconds(ts: Column) -> Column:
    return seconds_between(ts, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def floor_second(ts: Column) -> Column:
    return ts - F.make_dt_interval(secs=(F.extract(F.lit("SECOND"), ts) % 1).cast("decimal(18,6)"))


def floor_minutes(ts: Column, minutes: int) -> Column:
    """Start of the ts's block of `minutes` within its hour."""
    return ts - F.make_dt_interval(
        mins=F.minute(ts) % minutes, secs=F.extract(F.lit("SECOND"), ts).cast("decimal(18,6)")
    )


def floor_hour(ts: Column) -> Column:
    return floor_minutes(ts, 60)


def block_start(ts: Column) -> Column:
    return floor_minutes(ts, BLOCK_MINUTES)


def block_end(ts: Column) -> Column:
    return block_start(ts) + F.make_dt_interval(mins=F.lit(BLOCK_MINUTES))


def hour_bucket(ts: Column) -> Column:
    """Whole hours since 1970, the equi key that range joins share."""
    return F.floor(epoch_seconds(ts) / 3600).cast("bigint")


def srt_time(ms: Column) -> Column:
    """Milliseconds to HH:MM:SS,mmm; negatives are zero."""
    t = F.greatest(ms.cast("bigint"), F.lit(0))
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        F.floor(t / 3600000),
        F.floor(t / 60000) % 60,
        F.floor(t / 1000) % 60,
        t % 1000,
    )


_TIMECODE = r"^\s*(\d+):(\d+):(\d+),(\d+)\s*$"


def timecode_ms(c: Column) -> Column:
    """HH:MM:SS,mmm to milliseconds, NULL when malformed."""

    def part(i: int) -> Column:
        return F.regexp_extract(c, _TIMECODE, i).cast("bigint")

    value = ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)
    return F.when(F.regexp_like(c, F.lit(_TIMECODE)), value)


def caption_duration(line: Column) -> Column:
    """Seconds covered by 'start --> end'; malformed lines and negative spans are zero."""
    sides = F.split(line, " --> ", 2)
    span = (timecode_ms(F.get(sides, F.lit(1))) - timecode_ms(F.get(sides, F.lit(0)))) / 1000.0
    return F.coalesce(F.greatest(span, F.lit(0.0)), F.lit(0.0))


def caption_end_ms(line: Column) -> Column:
    """End of 'start --> end' in milliseconds; null if malformed."""
    return timecode_ms(F.get(F.split(line, " --> ", 2), F.lit(1)))


def precise_timestamp(ts: Column, idx: Column, total: Column) -> Column:
    """Estimated instant of word `idx` of `total` inside a 30 s chunk, to the whole second."""
    offset = (idx + F.lit(0.5)) / total * CHUNK_SECONDS
    return F.when(
        idx.isNotNull() & (total > 0), floor_second(shift_seconds(ts, offset))
    ).otherwise(ts)


def parse_guide_ts(c: Column, tz: str = "UTC") -> Column:
    """'yyyyMMddHHmmss +zzzz' to local naive time; without an offset the digits are local already."""
    text = F.trim(c)
    instant = F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss Z"))
    local = F.convert_timezone(F.current_timezone(), F.lit(tz), instant.cast("timestamp_ntz"))
    digits = F.substring(text, 1, 14)
    d = [F.substring(digits, p, n).cast("int") for p, n in ((1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2))]
    naive = F.try_make_timestamp_ntz(*d[:5], d[5].cast("decimal(16,6)"))
    return F.coalesce(local, F.when(F.regexp_like(digits, F.lit(r"^\d{14}$")), naive))


# Named time ranges of a question, in hours; any other name means all time.
RANGE_HOURS = {"1h": 1, "6h": 6, "24h": 24, "7d": 168, "30d": 720}


def range_cutoff(name: Column, now: Column) -> Column:
    """Earliest instant of a named range, NULL for all time; whole seconds."""
    hours = F.create_map(*[x for k, v in RANGE_HOURS.items() for x in (F.lit(k), F.lit(v))])
    return floor_second(now - F.make_dt_interval(hours=F.element_at(hours, name)))


def media_type(channel_id: Column) -> Column:
    return (
        F.when(channel_id == NEWS_CHANNEL, F.lit("news"))
        .when(channel_id >= YOUTUBE_MIN, F.lit("youtube"))
        .when(channel_id >= RADIO_MIN, F.lit("radio"))
        .otherwise(F.lit("tv"))
    )


def age_seconds(now: Column, ts: Column) -> Column:
    """Whole seconds since ts; 9999 when it is unknown."""
    return F.coalesce(seconds_between(now, ts).cast("bigint"), F.lit(9999).cast("bigint"))


def freshness_band(age: Column) -> Column:
    return F.when(age < 60, F.lit("fresh")).when(age < 300, F.lit("late")).otherwise(F.lit("old"))


def heartbeat_band(age: Column) -> Column:
    return F.when(age <= 60, F.lit("ok")).when(age <= 180, F.lit("slow")).otherwise(F.lit("zombie"))


def confidence_band(c: Column) -> Column:
    return (
        F.when(c.isNull(), F.lit("none"))
        .when(c >= 0.7, F.lit("high"))
        .when(c >= 0.4, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def in_pause_window(ts: Column, start_minute: int = 0, end_minute: int = 330) -> Column:
    """Minute of day inside [start, end); a window may cross midnight."""
    at = F.hour(ts) * 60 + F.minute(ts)
    if start_minute <= end_minute:
        return (at >= start_minute) & (at < end_minute)
    return (at >= start_minute) | (at < end_minute)


def stability_pct(restarts_per_hour: Column) -> Column:
    capped = F.least(restarts_per_hour, F.lit(6.0))
    return F.when(restarts_per_hour == 0, F.lit(100)).otherwise(
        F.greatest(F.lit(0), F.lit(100) - F.floor(capped / 6 * 100)).cast("int")
    )


def fluency_pct(chunks: Column, window_seconds: int = 30) -> Column:
    return F.least(chunks / F.lit(window_seconds / CHUNK_SECONDS), F.lit(1.0))


def progress_pct(done: Column, total: Column, initialised: Column | None = None) -> Column:
    """Backfill percentage (half to even); with nothing to scan, 100 once initialised, else 0."""
    empty = F.when(initialised, 100).otherwise(0) if initialised is not None else F.lit(0)
    pct = F.bround(F.coalesce(done, F.lit(0)) / total * 100).cast("int")
    return F.when(F.coalesce(total, F.lit(0)) > 0, pct).otherwise(empty)


def inclusive_until(date_to: Column) -> Column:
    """Exclusive upper bound of an inclusive last day."""
    return F.date_add(date_to, 1)
