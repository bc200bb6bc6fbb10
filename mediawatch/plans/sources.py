"""Typing of landed playlists, guides, news and captions, on rows derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediawatch import fixtures as X
from mediawatch.functions.timefn import epoch_seconds
from mediawatch.operators.health import warning_count
from mediawatch.plans import oracle as O
from mediawatch.plans.registry import query
from mediawatch.sources import landed


@query(
    "playlist_catalogue",
    r"""SELECT host AS file, id::INT AS channel_id, CASE WHEN page_id % 5 = 0 THEN 'Canal_' || id ELSE trim(title) END AS name, url,
       CASE WHEN page_id % 3 = 0 THEN 'Origin: ' || host END AS headers FROM (
       SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
         row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]+)', 1) ORDER BY page_id) AS id FROM pages)""",
)
def playlist_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """One playlist per web host, a fifth of the entries unnamed, a third with a header."""
    entry = F.concat(
        F.when(F.col("page_id") % 5 != 0, F.concat(F.lit("#EXTINF:-1,"), "title", F.lit("\n"))).otherwise(""),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("#EXTHEADER:Origin: "), "outlet", F.lit("\n"))).otherwise(""),
        F.col("link"),
    )
    texts = X.articles(spark, sf).groupBy(F.col("outlet").alias("file")).agg(
        F.concat(
            F.lit("#EXTM3U\n"), F.array_join(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e"))))["e"], "\n")
        ).alias("text")
    )
    return landed.playlist_from(texts).select("file", "channel_id", "name", "url", "headers")


@query(
    "guide_scan",
    O.with_ctes(
        "SELECT channel_name AS guide_id, start_ts, stop_ts, title, 'guide' AS source FROM programmes WHERE title <> 'prog_5'"
    ),
)
def guide_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Guide rows as XML gives them; titles are tagged and spaced, one title's rows have no stop."""
    raw = X.programmes(spark, sf).select(
        F.col("channel_name").alias("guide_id"),
        F.concat(F.date_format("start_ts", "yyyyMMddHHmmss"), F.lit(" +0000")).alias("start"),
        F.when(F.col("title") != "prog_5", F.date_format("stop_ts", "yyyyMMddHHmmss")).otherwise("").alias("stop"),
        F.concat(F.lit("[M]  "), "title", F.lit(" ")).alias("title"),
    )
    return landed.programmes_from(raw)


@query(
    "guide_event_scan",
    O.with_ctes("SELECT channel_name AS uuid, start_ts, stop_ts, title || ' live' AS title, 'live' AS source FROM programmes WHERE title <> 'prog_5'"),
)
def guide_event_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Live-guide pages written as JSON and read back; one title's entries have a zero stop."""

    def unix(c: str) -> Column:
        return epoch_seconds(F.col(c)).cast("bigint")

    entry = F.struct(
        F.col("channel_name").alias("channelUuid"),
        unix("start_ts").alias("start"),
        F.when(F.col("title") == "prog_5", F.lit(0).cast("bigint")).otherwise(unix("stop_ts")).alias("stop"),
        F.concat("title", F.lit("   live")).alias("title"),
    )
    pages = X.programmes(spark, sf).groupBy("channel_name").agg(F.to_json(F.struct(F.collect_list(entry).alias("entries"))).alias("page"))
    parsed = pages.select(F.from_json("page", landed._EVENTS).alias("p")).select(F.explode("p.entries").alias("e"))
    return landed.guide_events_from(parsed.select(F.col("e.channelUuid").alias("uuid"), "e.start", "e.stop", "e.title"))


@query(
    "news_scan",
    O.with_ctes(
        """SELECT outlet AS file, ltrim(title) AS title, link, outlet, published FROM (
        SELECT *, row_number() OVER (PARTITION BY outlet ORDER BY page_id) AS rn FROM articles) WHERE rn <= 50 AND trim(title) <> ''"""
    ),
)
def news_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Articles as feed items with RFC 822 dates, one feed per outlet."""
    items = X.articles(spark, sf).select(
        F.col("outlet").alias("file"),
        F.col("page_id").alias("pos"),
        F.concat("title", F.lit(" - "), "outlet").alias("title"),
        "link",
        "outlet",
        F.date_format("published", "E, dd MMM yyyy HH:mm:ss 'GMT'").alias("published"),
    )
    return landed.news_from(items, limit=landed.NEWS_ITEMS)


@query(
    "caption_scan",
    O.with_ctes(
        r"""SELECT conv_id, turn, (turn + 5.5)::DOUBLE AS duration_sec, md5(body) AS text_md5 FROM (SELECT conv_id, turn,
        regexp_replace(array_to_string(list_filter(list_transform(lines, lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> ''), ' '), ' {2,}', ' ', 'g') AS body
        FROM caption_blocks) WHERE body <> ''"""
    ),
)
def caption_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as subtitle blocks."""
    blocks = X.caption_blocks(spark, sf).select(
        "conv_id", "turn", F.concat_ws("\n", F.lit("1"), "timecode", F.array_join("lines", "\n")).alias("block")
    )
    rows = landed.captions_from(blocks)
    return rows.select("conv_id", "turn", "duration_sec", F.md5("text").alias("text_md5"))


@query("roster_union", O.with_ctes("SELECT channel_id, name, kind FROM roster WHERE kind IN ('tv', 'radio')"))
def roster_union(spark: SparkSession, sf: str) -> DataFrame:
    roster = X.roster(spark, sf)
    return landed.full_roster(roster.filter("kind = 'tv'"), roster.filter("kind = 'radio'"))


@query(
    "warning_lines",
    """SELECT count(*) AS warnings FROM events WHERE event_type = 'error' AND ts::DATE = DATE '2024-01-02'""",
)
def warning_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as log lines, errors as warnings."""
    level = F.when(F.col("event_type") == "error", F.lit("WARNING")).otherwise(F.lit("INFO"))
    lines = spark.read.parquet(f"{sf}/events.parquet").select(
        F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), level, "props").alias("value")
    )
    return warning_count(lines, "2024-01-02")
