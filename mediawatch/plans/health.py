"""Health report, live status and quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediawatch import fixtures as X
from mediawatch.functions.timefn import caption_duration, in_pause_window
from mediawatch.operators import health
from mediawatch.plans import oracle as O
from mediawatch.plans.registry import query

DAY = "2024-01-02"
LIVE_NOW = "2024-01-30 12:00:00"


def _day():
    return F.lit(DAY).cast("date")


def _live_now():
    return F.lit(LIVE_NOW).cast("timestamp_ntz")


_BY_REASON = f"SELECT channel_id, channel_name, reason, count(*) AS n FROM failures WHERE ts::DATE = DATE '{DAY}' GROUP BY ALL"


@query(
    "failure_summary",
    O.with_ctes(
        """SELECT channel_id, channel_name, sum(n)::BIGINT AS n_failures, string_agg(reason || ':' || n, ',' ORDER BY n DESC, reason) AS reasons,
        sum(sum(n)) OVER ()::BIGINT AS total FROM by_reason GROUP BY 1, 2""",
        {"by_reason": _BY_REASON},
    ),
)
def failure_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = health.failures_by_channel(X.failures(spark, sf), _day())
    text = F.array_join(F.transform("reasons", lambda r: F.concat(r["reason"], F.lit(":"), r["n"].cast("string"))), ",")
    total = rows.agg(F.sum("n_failures").alias("t"))
    return rows.select("channel_id", "channel_name", "n_failures", text.alias("reasons"), total.scalar().alias("total"))


_INTEGRITY = f"""SELECT r.channel_id, r.name, r.kind, count(c.id) AS n_chunks, min(c.ts) AS first_ts, max(c.ts) AS last_ts,
    CASE WHEN count(c.id) >= 8 THEN 'ok' WHEN count(c.id) > 0 THEN 'low' ELSE 'none' END AS integrity,
    s.restart_count, s.error_count, s.last_error
    FROM roster r LEFT JOIN chunks c ON c.channel_id = r.channel_id AND c.ts::DATE = DATE '{DAY}'
    LEFT JOIN channel_status s ON s.channel_id = r.channel_id GROUP BY ALL"""


@query("channel_integrity", O.with_ctes("SELECT * FROM integrity", {"integrity": _INTEGRITY}))
def channel_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return health.channel_integrity(
        X.roster(spark, sf), X.chunks(spark, sf), X.channel_status(spark, sf), _day(), min_ok=8
    ).select(
        "channel_id", "name", "kind", "n_chunks", "first_ts", "last_ts", "integrity", "restart_count", "error_count", "last_error"
    )


@query(
    "integrity_totals",
    O.with_ctes(
        """SELECT count(*) FILTER (integrity = 'ok') AS n_ok, count(*) FILTER (integrity = 'low') AS n_low,
        count(*) FILTER (integrity = 'none') AS n_none FROM integrity""",
        {"integrity": _INTEGRITY},
    ),
)
def integrity_totals(spark: SparkSession, sf: str) -> DataFrame:
    return health.integrity_totals(channel_integrity(spark, sf))


@query(
    "probable_causes",
    O.with_ctes(
        """SELECT printf('Channel %02d (%s): %d failures - %s', channel_id, channel_name, sum(n)::BIGINT,
          array_to_string(list(reason ORDER BY n DESC, reason)[1:2], ', ')) AS cause FROM by_reason GROUP BY channel_id, channel_name
        UNION ALL SELECT printf('Channel %02d (%s): no transcript all day', channel_id, name) FROM integrity WHERE integrity = 'none'""",
        {"by_reason": _BY_REASON, "integrity": _INTEGRITY},
    ),
)
def probable_causes(spark: SparkSession, sf: str) -> DataFrame:
    report = health.health_report(
        X.roster(spark, sf), X.chunks(spark, sf), X.failures(spark, sf), X.channel_status(spark, sf), _day(), min_ok=8
    )
    return report["causes"].select("cause")


@query(
    "daily_chunks",
    O.with_ctes(
        f"SELECT channel_id, count(*) AS n_chunks, min(ts) AS first_ts, max(ts) AS last_ts FROM chunks WHERE ts::DATE = DATE '{DAY}' GROUP BY 1"
    ),
)
def daily_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return health.daily_chunks(X.chunks(spark, sf), _day())


@query(
    "latest_per_channel",
    O.with_ctes(
        """SELECT channel_id, id, ts, md5(text) AS text_md5 FROM chunks WHERE id IN (SELECT max(id) FROM chunks GROUP BY channel_id)"""
    ),
)
def latest_per_channel(spark: SparkSession, sf: str) -> DataFrame:
    rows = health.latest_per_channel(X.chunks(spark, sf).select("channel_id", "id", "ts", "text"))
    return rows.select("channel_id", "id", "ts", F.md5("text").alias("text_md5"))


@query(
    "latest_with_status",
    O.with_ctes(
        """SELECT c.channel_id, c.ts, c.confidence, s.status, s.total_segments FROM chunks c JOIN channel_status s
        ON s.channel_id = c.channel_id WHERE c.id IN (SELECT max(id) FROM chunks GROUP BY channel_id) ORDER BY c.channel_id LIMIT 20"""
    ),
)
def latest_with_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = health.latest_with_status(X.chunks(spark, sf), X.channel_status(spark, sf))
    return rows.select("channel_id", "ts", "confidence", "status", "total_segments")


@query(
    "alive_channels",
    O.with_ctes(
        f"SELECT channel_id, heartbeat FROM channel_status WHERE heartbeat >= TIMESTAMP '{LIVE_NOW}' - INTERVAL 5 MINUTE ORDER BY channel_id LIMIT 20"
    ),
)
def alive_channels(spark: SparkSession, sf: str) -> DataFrame:
    return health.alive_channels(X.channel_status(spark, sf), _live_now(), limit=20).select("channel_id", "heartbeat")


@query(
    "live_snapshot",
    O.with_ctes(
        f"""SELECT s.channel_id, coalesce(r.last_ts, s.last_seen) AS last_ts,
        md5(CASE WHEN r.said IS NOT NULL THEN r.said WHEN l.text NOT IN ('', '[~]') THEN l.text ELSE '[~]' END) AS text_md5,
        round(coalesce(CASE WHEN r.said IS NOT NULL THEN r.conf WHEN l.text NOT IN ('', '[~]') AND l.confidence > 0 THEN l.confidence END, 0.0), 6) AS confidence,
        coalesce(r.n, 0) AS n_chunks, least(coalesce(r.n, 0) / 2.0, 1.0)::DOUBLE AS fluency
        FROM channel_status s
        LEFT JOIN (SELECT c.channel_id, max_by(c.ts, c.id) AS last_ts, count(*) AS n,
          string_agg(CASE WHEN c.text NOT IN ('', '[~]') THEN c.text END, ' ' ORDER BY c.id) AS said,
          avg(CASE WHEN c.text NOT IN ('', '[~]') THEN c.confidence END) AS conf
          FROM chunks c JOIN (SELECT channel_id, max(ts) AS top FROM chunks GROUP BY 1) a ON a.channel_id = c.channel_id
          AND c.ts >= a.top - INTERVAL 60 SECOND GROUP BY 1) r ON r.channel_id = s.channel_id
        LEFT JOIN (SELECT * FROM chunks WHERE id IN (SELECT max(id) FROM chunks GROUP BY channel_id)) l ON l.channel_id = s.channel_id
        WHERE s.heartbeat >= TIMESTAMP '{LIVE_NOW}' - INTERVAL 5 MINUTE"""
    ),
)
def live_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    rows = health.live_snapshot(X.chunks(spark, sf), X.channel_status(spark, sf), _live_now(), window=60)
    return rows.select(
        "channel_id", "last_ts", F.md5("text").alias("text_md5"), F.round("confidence", 6).alias("confidence"), "n_chunks", "fluency"
    )


@query(
    "status_snapshot",
    O.with_ctes(
        f"""SELECT channel_id, status, age, CASE WHEN age < 60 THEN 'fresh' WHEN age < 300 THEN 'late' ELSE 'old' END AS freshness,
        CASE WHEN age <= 60 THEN 'ok' WHEN age <= 180 THEN 'slow' ELSE 'zombie' END AS heartbeat_state,
        age > 180 AND status = 'running' AS zombie FROM (
        SELECT channel_id, status, trunc(epoch(TIMESTAMP '{X.NOW}') - epoch(heartbeat))::BIGINT AS age FROM channel_status)"""
    ),
)
def status_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return health.status_snapshot(X.channel_status(spark, sf), X.now())


@query(
    "status_today",
    O.with_ctes(
        f"""SELECT s.channel_id, s.total_segments, count(c.id) AS segments_today FROM channel_status s
        LEFT JOIN chunks c ON c.channel_id = s.channel_id AND c.ts >= DATE '{DAY}' GROUP BY 1, 2"""
    ),
)
def status_today(spark: SparkSession, sf: str) -> DataFrame:
    rows = health.status_today(X.channel_status(spark, sf), X.chunks(spark, sf), _day())
    return rows.select("channel_id", "total_segments", "segments_today")


@query(
    "latest_status",
    """SELECT channel_id, event_type, updated_at FROM (SELECT (user_id % 60 + 1)::INT AS channel_id, event_type, ts AS updated_at,
       row_number() OVER (PARTITION BY user_id % 60 ORDER BY ts DESC, event_type DESC) AS rn FROM events) WHERE rn = 1""",
)
def latest_status(spark: SparkSession, sf: str) -> DataFrame:
    events = X.channel_events(spark, sf).select("channel_id", "updated_at", "event_type")
    return health.latest_status(events).select("channel_id", "event_type", "updated_at")


@query(
    "stability",
    O.with_ctes(
        """SELECT channel_id, restarts, round(rate, 6) AS restarts_per_hour,
        CASE WHEN rate = 0 THEN 100 ELSE greatest(0, 100 - floor(least(rate, 6.0) / 6 * 100)::INT) END::INT AS stability FROM (
        SELECT r.channel_id, count(f.id) AS restarts, count(f.id) / 24.0::DOUBLE AS rate FROM roster r
        LEFT JOIN failures f ON f.channel_id = r.channel_id GROUP BY 1)"""
    ),
)
def stability(spark: SparkSession, sf: str) -> DataFrame:
    rows = health.stability(X.failures(spark, sf), X.roster(spark, sf).select("channel_id"), F.lit(24.0))
    return rows.select("channel_id", "restarts", F.round("restarts_per_hour", 6).alias("restarts_per_hour"), "stability")


@query(
    "unplanned_failures",
    O.with_ctes(
        "SELECT channel_id, count(*) AS n FROM failures WHERE NOT (hour(ts) * 60 + minute(ts) >= 0 AND hour(ts) * 60 + minute(ts) < 330) GROUP BY 1"
    ),
)
def unplanned_failures(spark: SparkSession, sf: str) -> DataFrame:
    rows = health.unplanned_failures(X.failures(spark, sf), in_pause_window(F.col("ts")))
    return rows.groupBy("channel_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "language_drift",
    O.with_ctes(
        f"""SELECT channel_id, date_trunc('hour', ts) AS window_start, sum({O.english('text')})::BIGINT AS n_english,
        sum(len({O.word_list('text')}))::BIGINT AS n_words,
        round(sum({O.english('text')})::DOUBLE / greatest(sum(len({O.word_list('text')})), 1), 6) AS drift FROM chunks
        WHERE text NOT IN ('', '[~]') GROUP BY 1, 2"""
    ),
)
def language_drift(spark: SparkSession, sf: str) -> DataFrame:
    rows = health.language_drift(X.chunks(spark, sf))
    return rows.select("channel_id", "window_start", "n_english", "n_words", F.round("drift", 6).alias("drift"))


@query(
    "throughput",
    """SELECT (user_id % 60 + 1)::INT AS channel_id, count(*) AS n_chunks, round(sum(30.0) / sum(value / 10.0), 6)::DOUBLE AS rtfx FROM events GROUP BY 1""",
)
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    """Events stand for recogniser jobs of 30 s of audio each."""
    jobs = spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "cast(user_id % 60 + 1 AS int) AS channel_id", "30.0D AS audio_sec", "value / 10 AS infer_sec"
    )
    return health.throughput(jobs).select("channel_id", "n_chunks", F.round("rtfx", 6).alias("rtfx"))


@query(
    "caption_clamp",
    O.with_ctes(
        """SELECT channel_id, conv_id, turn, end_ts, least(greatest(raw, coalesce(prev, raw)), end_ts) AS start_ts FROM (
        SELECT *, lag(end_ts) OVER (PARTITION BY channel_id ORDER BY end_ts, conv_id * 100 + turn) AS prev,
          end_ts - to_milliseconds((turn + 5) * 1000 + 500) AS raw FROM caption_blocks)"""
    ),
)
def caption_clamp(spark: SparkSession, sf: str) -> DataFrame:
    blocks = X.caption_blocks(spark, sf).select(
        "channel_id", "conv_id", "turn", "end_ts",
        (F.col("conv_id") * 100 + F.col("turn")).alias("seq"),
        caption_duration(F.col("timecode")).alias("duration_sec"),
    )
    return health.caption_spans(blocks).select("channel_id", "conv_id", "turn", "end_ts", "start_ts")


@query(
    "hop_commit",
    O.with_ctes(
        """SELECT file_id, hop, start_s, end_s, md5(text) AS text_md5 FROM asr_segments
        WHERE trim(text) <> '' AND (hop = 0 OR start_s >= hop * 120 - 0.01)"""
    ),
)
def hop_commit(spark: SparkSession, sf: str) -> DataFrame:
    rows = health.committed_segments(X.asr_segments(spark, sf))
    return rows.select("file_id", "hop", "start_s", "end_s", F.md5("text").alias("text_md5"))
