"""Programme-guide joins. Every range join has (channel, hour) as its equi key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediawatch.functions.timefn import floor_second, hour_bucket, seconds, seconds_between
from mediawatch.operators.matching import keyword_hits

#: Titles of a display list.
TITLES_SHOWN = 200


def _by_hour(programmes: DataFrame) -> DataFrame:
    """Programmes repeated for each hour they touch."""
    last = F.col("stop_ts") - seconds(0.000001)
    return programmes.filter("stop_ts > start_ts").withColumn(
        "_h", F.explode(F.sequence(hour_bucket(F.col("start_ts")), hour_bucket(last)))
    )


def with_programme(
    rows: DataFrame,
    programmes: DataFrame,
    ts: str = "ts",
    channel: str = "channel_name",
    out: str = "programme",
) -> DataFrame:
    """Title on air at each row's instant: start <= t < stop, the latest start wins, '' if none.

    The guide is folded to one array per (channel, hour) first, so the join keeps the row count and
    needs no aggregation afterwards.
    """
    slot = F.struct("start_ts", "stop_ts", F.coalesce("title", F.lit("")).alias("title"))
    packed = (
        _by_hour(programmes)
        .groupBy(F.col("channel_name").alias("_c"), "_h")
        .agg(F.array_sort(F.collect_set(slot)).alias("_slots"))
    )
    t = F.col(ts)
    on_air = F.filter("_slots", lambda p: (p["start_ts"] <= t) & (p["stop_ts"] > t))
    joined = rows.withColumn("_rh", hour_bucket(t)).join(
        packed, (F.col(channel) == F.col("_c")) & (F.col("_rh") == F.col("_h")), "left"
    )
    title = F.coalesce(F.try_element_at(on_air, F.lit(-1))["title"], F.lit(""))
    return joined.withColumn(out, title).drop("_rh", "_c", "_h", "_slots")


def _covers(rows: DataFrame, programmes: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    left = rows.withColumn("_rh", hour_bucket(F.col("ts")))
    right = _by_hour(programmes).select(
        F.col("channel_name").alias("_c"), "_h", "start_ts", "stop_ts", F.col("title").alias("_title")
    )
    cond = (
        (F.col("channel_name") == F.col("_c"))
        & (F.col("_rh") == F.col("_h"))
        & (F.col("start_ts") <= F.col("ts"))
        & (F.col("stop_ts") > F.col("ts"))
    )
    return left, right, cond


def programme_titles(matches: DataFrame, programmes: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct titles on air during the matches, alphabetical; all, or the first `limit` for a display list."""
    left, right, cond = _covers(matches.select("channel_name", "ts"), programmes)
    titles = left.join(right, cond).select(F.col("_title").alias("title")).distinct().orderBy("title")
    return titles.limit(limit) if limit is not None else titles


def during_programmes(matches: DataFrame, programmes: DataFrame, titles: list[str]) -> DataFrame:
    """Matches that fall inside any programme with one of the titles."""
    left, right, cond = _covers(matches, programmes.filter(F.col("title").isin(titles)))
    return left.join(right, cond, "left_semi").drop("_rh")


def coverage(programmes: DataFrame) -> DataFrame:
    return programmes.groupBy("channel_name").agg(
        F.count(F.lit(1)).alias("total"),
        F.min("start_ts").alias("first_start"),
        F.max("stop_ts").alias("last_stop"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
    )


def first_source_wins(programmes: DataFrame, latest: bool = False) -> DataFrame:
    """One row per (channel, start): the lowest-ranked source, or the highest with `latest`."""
    pick = F.max_by if latest else F.min_by
    row = F.struct("stop_ts", "title", "source")
    return (
        programmes.groupBy("channel_name", "start_ts")
        .agg(pick(row, "source_rank").alias("_r"))
        .select("channel_name", "start_ts", "_r.*")
    )


def missing_coverage(wanted: DataFrame, programmes: DataFrame) -> DataFrame:
    """Wanted channel names the guide does not cover."""
    return wanted.select("channel_name").distinct().join(
        programmes.select("channel_name").distinct(), "channel_name", "left_anti"
    )


def map_guide_channels(guide: DataFrame, wanted: DataFrame) -> DataFrame:
    """Guide channel id to internal name.

    guide: guide_id, file_pos, haystack (id and display names); wanted: wanted_pos, name, fragments.
    Each wanted name takes the first guide channel in file order containing any of its fragments; a
    guide channel taken twice goes to the later wanted name. Both tables are station lists.
    """
    names = wanted.select("wanted_pos", "name", F.explode("fragments").alias("norm_kw"))
    first = (
        _holding(guide.select("guide_id", "file_pos", F.lower("haystack").alias("_text")), names)
        .groupBy("wanted_pos", "name")
        .agg(F.min_by("guide_id", "file_pos").alias("guide_id"))
    )
    return first.groupBy("guide_id").agg(F.max_by("name", "wanted_pos").alias("name"))


def _holding(rows: DataFrame, fragments: DataFrame) -> DataFrame:
    """Rows beside the fragments (column norm_kw) that their `_text` holds; an empty fragment is held by none."""
    asked = fragments.filter("norm_kw <> ''")
    return keyword_hits(rows, "_text", asked.select("norm_kw", F.lit(False).alias("whole_word"), F.lit(False).alias("phonetic"))).join(asked, "norm_kw")


def map_live_channels(channels: DataFrame, fragments: DataFrame) -> DataFrame:
    """Live-guide channel to internal name: the first fragment, in map order, found in its name."""
    asked = fragments.select("frag_pos", "name", F.col("fragment").alias("norm_kw"))
    return (
        _holding(channels.select("uuid", F.lower("live_name").alias("_text")), asked)
        .groupBy("uuid")
        .agg(F.min_by("name", "frag_pos").alias("name"))
    )


def refresh_due(sources: DataFrame, now: Column) -> DataFrame:
    """Sources whose last fetch is missing, unreadable or at least `hours` old.

    sources: source, last_fetch STRING 'yyyy-MM-dd HH:mm:ss', hours.
    """
    last = F.expr("try_cast(last_fetch AS timestamp_ntz)")
    due = last.isNull() | (seconds_between(now, last) / 3600 >= F.col("hours"))
    return sources.filter(due)


def fetch_mark(now: Column, ok: Column, hours: Column) -> Column:
    """Instant to record after a fetch: now, or after a failure one that falls due in 30 minutes."""
    back = (hours - F.lit(0.5)) * 3600
    return floor_second(F.when(ok, now).otherwise(now - F.make_dt_interval(secs=back.cast("decimal(18,6)"))))
