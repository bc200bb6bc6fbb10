"""Time functions, bands and classifications."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediawatch import fixtures as X
from mediawatch.functions import timefn as M
from mediawatch.operators import matching
from mediawatch.operators.lifecycle import news_query_manifest
from mediawatch.plans import oracle as O
from mediawatch.plans.registry import query

@query(
    "block_bounds",
    O.with_ctes(f"""SELECT id, {O.block_start('ts')} AS block_start,
        {O.block_start('ts')} + INTERVAL 30 MINUTE AS block_end FROM chunks"""),
)
def block_bounds(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    return X.chunks(spark, sf).select(
        "id", M.block_start(ts).alias("block_start"), M.block_end(ts).alias("block_end")
    )


@query(
    "media_type_counts",
    O.with_ctes(f"SELECT {O.media('channel_id')} AS medium, count(*) AS n FROM chunks GROUP BY 1"),
)
def media_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return X.chunks(spark, sf).groupBy(M.media_type(F.col("channel_id")).alias("medium")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "status_bands",
    O.with_ctes(
        f"""SELECT channel_id, age, CASE WHEN age < 60 THEN 'fresh' WHEN age < 300 THEN 'late' ELSE 'old' END AS freshness,
        CASE WHEN age <= 60 THEN 'ok' WHEN age <= 180 THEN 'slow' ELSE 'zombie' END AS heartbeat_state
        FROM (SELECT channel_id, trunc(epoch(TIMESTAMP '{X.NOW}') - epoch(heartbeat))::BIGINT AS age FROM channel_status)"""
    ),
)
def status_bands(spark: SparkSession, sf: str) -> DataFrame:
    age = M.age_seconds(X.now(), F.col("heartbeat"))
    return X.channel_status(spark, sf).select("channel_id", age.alias("age")).select(
        "channel_id",
        "age",
        M.freshness_band(F.col("age")).alias("freshness"),
        M.heartbeat_band(F.col("age")).alias("heartbeat_state"),
    )


@query(
    "confidence_bands",
    O.with_ctes(
        """SELECT CASE WHEN confidence IS NULL THEN 'none' WHEN confidence >= 0.7 THEN 'high'
        WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM chunks GROUP BY 1"""
    ),
)
def confidence_bands(spark: SparkSession, sf: str) -> DataFrame:
    return X.chunks(spark, sf).groupBy(M.confidence_band(F.col("confidence")).alias("band")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "caption_durations",
    O.with_ctes(
        r"""SELECT conv_id, turn, greatest(0.0, (ms(b) - ms(a)) / 1000.0)::DOUBLE AS seconds FROM (
        SELECT conv_id, turn, split_part(timecode, ' --> ', 1) AS a, split_part(timecode, ' --> ', 2) AS b FROM caption_blocks)"""
        .replace("ms(b)", "(epoch_ms(CAST('1970-01-01 ' || replace(b, ',', '.') AS TIMESTAMP)))")
        .replace("ms(a)", "(epoch_ms(CAST('1970-01-01 ' || replace(a, ',', '.') AS TIMESTAMP)))")
    ),
)
def caption_durations(spark: SparkSession, sf: str) -> DataFrame:
    return X.caption_blocks(spark, sf).select(
        "conv_id", "turn", M.caption_duration(F.col("timecode")).alias("seconds")
    )


@query(
    "guide_times",
    O.with_ctes(
        """SELECT channel_name, start_ts, start_ts - INTERVAL 6 HOUR AS mexico_ts, NULL::TIMESTAMP AS bad_ts FROM programmes"""
    ),
)
def guide_times(spark: SparkSession, sf: str) -> DataFrame:
    """Guide time strings written from programme starts and read back."""
    raw = F.concat(F.date_format("start_ts", "yyyyMMddHHmmss"), F.lit(" +0000"))
    return X.programmes(spark, sf).withColumn("raw", raw).select(
        "channel_name",
        M.parse_guide_ts(F.substring("raw", 1, 14)).alias("start_ts"),
        M.parse_guide_ts(F.col("raw"), "America/Mexico_City").alias("mexico_ts"),
        M.parse_guide_ts(F.substring("raw", 1, 9)).alias("bad_ts"),
    )


@query(
    "pause_window",
    """SELECT event_type, count(*) FILTER (m >= 0 AND m < 330) AS n_paused,
       count(*) FILTER (m >= 1380 OR m < 60) AS n_over_midnight FROM (
       SELECT event_type, hour(ts) * 60 + minute(ts) AS m FROM events) GROUP BY event_type""",
)
def pause_window(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(
        F.count_if(M.in_pause_window(F.col("ts"))).alias("n_paused"),
        F.count_if(M.in_pause_window(F.col("ts"), 1380, 60)).alias("n_over_midnight"),
    )


@query(
    "range_counts",
    O.with_ctes(
        f"""SELECT r.name AS range_name, count(c.id) AS n FROM
        (VALUES ('1h', 1), ('6h', 6), ('24h', 24), ('7d', 168), ('30d', 720), ('all', NULL)) r(name, hours)
        LEFT JOIN chunks c ON r.hours IS NULL OR c.ts >= TIMESTAMP '2024-01-03 12:00:00' - to_hours(r.hours)
        GROUP BY r.name"""
    ),
)
def range_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks inside each named time range, counted in one pass."""
    now = F.lit("2024-01-03 12:00:00").cast("timestamp_ntz")
    names = [*M.RANGE_HOURS, "all"]
    inside = {
        n: F.coalesce(F.col("ts") >= M.range_cutoff(F.lit(n), now), F.lit(True)) for n in names
    }
    counts = X.chunks(spark, sf).agg(*[F.count_if(c).alias(n) for n, c in inside.items()])
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return counts.selectExpr(f"stack({len(names)}, {pairs}) AS (range_name, n)")


@query(
    "backfill_progress",
    O.with_ctes(
        """SELECT search_id, n AS rows_total, m AS rows_done,
        CASE WHEN n > 0 THEN round_even(100.0 * m / n, 0)::INT ELSE CASE WHEN initialized THEN 100 ELSE 0 END END AS pct FROM (
        SELECT s.search_id, s.initialized, count(c.id) AS n, count(c.id) FILTER (c.ts < TIMESTAMP '2024-01-03') AS m FROM searches s LEFT JOIN chunks c
        ON c.ts >= s.date_start AND c.ts < s.date_end + INTERVAL 1 DAY GROUP BY s.search_id, s.initialized)"""
    ),
)
def backfill_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Progress of all searches after a backfill over the first two days, by what that run has read."""
    searches, chunks = X.searches(spark), X.chunks(spark, sf)
    _, done = matching.backfill_days(chunks, searches, date(2024, 1, 1), date(2024, 1, 2))
    counts = matching.backfill_progress(chunks, searches, done).join(searches.select("search_id", "initialized"), "search_id")
    pct = M.progress_pct(F.col("rows_done"), F.col("rows_total"), F.col("initialized"))
    return counts.select("search_id", "rows_total", "rows_done", pct.alias("pct"))


@query(
    "news_manifest",
    O.with_ctes(
        """SELECT k.search_id, k.keyword, k.date_start AS after_date, (k.date_end + INTERVAL 1 DAY)::DATE AS before_date,
        count(a.page_id) AS n_landed FROM kws k LEFT JOIN articles a
        ON a.published >= k.date_start AND a.published < k.date_end + INTERVAL 1 DAY
        GROUP BY ALL"""
    ),
)
def news_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """What to ask a news source for (one row per keyword, upper date made exclusive) and what has landed."""
    manifest = news_query_manifest(X.searches(spark))
    per_day = X.articles(spark, sf).groupBy(F.to_date("published").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days = manifest.withColumn(
        "day", F.explode(F.sequence("after_date", F.date_sub("before_date", 1)))
    )
    keys = ["search_id", "keyword", "after_date", "before_date"]
    return days.join(per_day, "day", "left").groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_landed")
    )
