"""Search lifecycle: what is due, what expires, what must be rescanned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediawatch.functions.timefn import NEWS_CHANNEL, inclusive_until

NEWS_MINUTES = 30
DAILY_HOUR = 7

RESCAN_FIELDS = ["date_start", "date_end", "keywords", "phonetic", "whole_word", "media_types"]


def _has_address() -> Column:
    return F.coalesce(F.col("report_email"), F.lit("")) != ""


def expire(searches: DataFrame, today: Column) -> DataFrame:
    """Active searches past their last day become completed."""
    over = (F.col("status") == "active") & (F.col("date_end") < today)
    return searches.withColumn("status", F.when(over, F.lit("completed")).otherwise(F.col("status")))


def news_due(searches: DataFrame, now: Column) -> DataFrame:
    """Live searches that cover news and were not fetched in the last 30 minutes."""
    today = F.to_date(now)
    stale = F.col("news_last_fetch").isNull() | (
        F.col("news_last_fetch") <= now - F.make_dt_interval(mins=F.lit(NEWS_MINUTES))
    )
    return searches.filter(
        (F.col("status") == "active")
        & F.col("initialized")
        & (F.col("date_start") <= today)
        & (F.col("date_end") >= today)
        & F.array_contains("media_types", "news")
        & stale
    )


def news_query_manifest(searches: DataFrame) -> DataFrame:
    """One landed query per keyword, its upper date made exclusive."""
    return searches.select(
        "search_id",
        F.explode("keywords").alias("keyword"),
        F.col("date_start").alias("after_date"),
        inclusive_until(F.col("date_end")).alias("before_date"),
    )


def news_matches(searches: DataFrame, articles: DataFrame, found_at: Column) -> DataFrame:
    """Articles landed for a keyword become matches of its searches, with no text test or spacing."""
    kws = searches.select("search_id", F.posexplode("keywords").alias("kw_pos", "keyword"))
    return articles.join(kws, "keyword").select(
        F.xxhash64("search_id", "keyword", "link").alias("match_id"),
        "search_id",
        "kw_pos",
        "keyword",
        F.lit(NEWS_CHANNEL).alias("channel_id"),
        F.col("outlet").alias("channel_name"),
        F.col("published").alias("ts"),
        F.lit(None).cast("bigint").alias("chunk_id"),
        F.lit(None).cast("string").alias("prev_text"),
        F.col("title").alias("cur_text"),
        F.lit(None).cast("string").alias("next_text"),
        found_at.alias("found_at"),
        F.col("link").alias("source_url"),
    )


def daily_reports_due(searches: DataFrame, now: Column) -> DataFrame:
    today = F.to_date(now)
    return searches.filter(
        (F.hour(now) >= DAILY_HOUR)
        & (F.col("delivery_mode") == "daily")
        & _has_address()
        & (F.col("status") == "active")
        & (F.col("last_report").isNull() | (F.col("last_report") < today))
    )


def final_reports_due(searches: DataFrame, today: Column) -> DataFrame:
    return searches.filter(
        (F.col("delivery_mode") == "final")
        & _has_address()
        & F.col("status").isin("active", "completed")
        & (F.col("date_end") < today)
        & (F.col("last_report").isNull() | (F.col("last_report") < F.col("date_end")))
    )


def report_matches(searches: DataFrame, matches: DataFrame, now: Column) -> DataFrame:
    """Matches each due report carries: today's finds for daily reports, all for final ones."""
    today = F.to_date(now)
    daily = daily_reports_due(searches, now).select("search_id", F.lit("daily").alias("mode"))
    final = final_reports_due(searches, today).select("search_id", F.lit("final").alias("mode"))
    return matches.join(daily.unionByName(final), "search_id").filter(
        (F.col("mode") == "final") | (F.to_date("found_at") == today)
    )


def mark_reported(searches: DataFrame, now: Column) -> DataFrame:
    """Searches after their due reports went out: report day noted, final ones completed."""
    today = F.to_date(now)
    daily = daily_reports_due(searches, now).select("search_id", F.lit("daily").alias("_sent"))
    final = final_reports_due(searches, today).select("search_id", F.lit("final").alias("_sent"))
    out = searches.join(daily.unionByName(final), "search_id", "left")
    return (
        out.withColumn("last_report", F.when(F.col("_sent").isNotNull(), today).otherwise(F.col("last_report")))
        .withColumn("status", F.when(F.col("_sent") == "final", F.lit("completed")).otherwise(F.col("status")))
        .drop("_sent")
        .select(*searches.columns)
    )


def to_rescan(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids of edited searches whose matches must be rebuilt; spacing and delivery alone do not."""
    old = before.select("search_id", F.struct(*RESCAN_FIELDS).alias("_old"))
    new = after.select("search_id", F.struct(*RESCAN_FIELDS).alias("_new"))
    changed = reduce(
        lambda a, b: a | b, [~F.col(f"_old.{f}").eqNullSafe(F.col(f"_new.{f}")) for f in RESCAN_FIELDS]
    )
    return old.join(new, "search_id").filter(changed).select("search_id")


def without_rescanned(matches: DataFrame, stale_ids: DataFrame) -> DataFrame:
    """Matches left after those of rescanned searches are dropped."""
    return matches.join(stale_ids, "search_id", "left_anti")
