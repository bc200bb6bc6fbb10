"""Recorded-segment and block-export queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediawatch import fixtures as X
from mediawatch.operators import blocks, detail, recordings
from mediawatch.plans import oracle as O
from mediawatch.plans.matching import _LOCATED
from mediawatch.plans.registry import query


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return recordings.parse_segments(X.recordings(spark, sf))


_SEGS = r"""SELECT path, length, modified, duration_sec, regexp_extract(path, '^(.*)/[^/]+$', 1) AS folder,
    regexp_extract(path, 'canal_([0-9]+)_', 1)::INT AS channel_id, regexp_extract(path, 'canal_[0-9]+_([^/]+)/', 1) AS safe_channel,
    strptime(regexp_extract(path, '_([0-9-]{10}_[0-9]{2}-[0-9]{2})\.', 1), '%Y-%m-%d_%H-%M') AS start_ts,
    regexp_extract(path, '\.([a-z0-9]+)$', 1) AS ext FROM recordings"""
_LISTED = "SELECT *, CASE ext WHEN 'ts' THEN 0 WHEN 'mp4' THEN 1 ELSE 2 END AS o FROM segs"
_BEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_id, start_ts
    ORDER BY CASE ext WHEN 'mp4' THEN 0 WHEN 'ts' THEN 1 ELSE 2 END, path) AS rn FROM segs) WHERE rn = 1"""


@query("segment_catalogue", O.with_ctes("SELECT path, folder, channel_id, safe_channel, start_ts, ext, length FROM segs", {"segs": _SEGS}))
def segment_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return segments(spark, sf).select("path", "folder", "channel_id", "safe_channel", "start_ts", "ext", "length")


@query("recording_dates", O.with_ctes("SELECT DISTINCT channel_id, start_ts::DATE AS day FROM segs", {"segs": _SEGS}))
def recording_dates(spark: SparkSession, sf: str) -> DataFrame:
    return recordings.recording_dates(segments(spark, sf))


@query(
    "day_blocks",
    O.with_ctes(
        """SELECT b.channel_id, b.path, b.start_ts, coalesce(max_by(p.title, p.start_ts), '') AS title FROM best b
        LEFT JOIN programmes p ON p.channel_name = b.safe_channel AND p.start_ts <= b.start_ts AND p.stop_ts > b.start_ts GROUP BY 1, 2, 3""",
        {"segs": _SEGS, "best": _BEST},
    ),
)
def day_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = recordings.day_blocks(segments(spark, sf), X.roster(spark, sf), X.programmes(spark, sf))
    return rows.select("channel_id", "path", "start_ts", "title")


_MOMENTS = "SELECT match_id, channel_name AS safe_channel, precise_ts AS ts FROM enriched"
_ASOF = """SELECT m.match_id, m.safe_channel, m.ts, max(s) AS s FROM moments m JOIN (SELECT safe_channel, {'at': start_ts, 'o': o, 'path': path, 'dur': coalesce(duration_sec, 0)} AS s,
    start_ts FROM listed) l ON l.safe_channel = m.safe_channel AND l.start_ts <= m.ts GROUP BY 1, 2, 3"""


@query(
    "segment_at",
    O.with_ctes(
        """SELECT match_id, ts, s.path AS path, (epoch_us(ts) - epoch_us(s.at)) / 1000000.0::DOUBLE AS offset_sec FROM found_seg
        WHERE s.dur = 0 OR epoch_us(ts) - epoch_us(s.at) < s.dur * 1000000""",
        {**_LOCATED, "segs": _SEGS, "listed": _LISTED, "moments": _MOMENTS, "found_seg": _ASOF},
    ),
)
def segment_at(spark: SparkSession, sf: str) -> DataFrame:
    """Where each match's exact time is in the recordings."""
    enriched = detail.enrich(X.matches(spark, sf), X.searches(spark))
    return recordings.locate_matches(enriched, segments(spark, sf)).select("match_id", "ts", "path", "offset_sec")


_EVENT_MOMENTS = """SELECT event_id AS match_id, 'ch' || lpad((user_id % 60 + 1)::VARCHAR, 2, '0') AS safe_channel, ts,
    ts - INTERVAL 10 SECOND AS lo, ts + INTERVAL 10 SECOND AS hi FROM events"""
_OPEN = """SELECT m.match_id, max(l.s) AS s FROM moments m JOIN (SELECT safe_channel, start_ts, {'at': start_ts, 'o': o, 'path': path, 'dur': coalesce(duration_sec, 0)} AS s FROM listed) l
    ON l.safe_channel = m.safe_channel AND l.start_ts <= m.lo GROUP BY 1"""
_CANDS = """SELECT match_id, s FROM opened UNION ALL SELECT m.match_id, {'at': l.start_ts, 'o': l.o, 'path': l.path, 'dur': coalesce(l.duration_sec, 0)}
    FROM moments m JOIN listed l ON l.safe_channel = m.safe_channel AND l.start_ts > m.lo AND l.start_ts < m.hi"""
_WALK = """SELECT match_id, 1 AS step, lo AS cur, NULL::VARCHAR AS path, NULL::DOUBLE AS off, NULL::DOUBLE AS len FROM moments
    UNION ALL
    SELECT match_id, step + 1, CASE WHEN on_air THEN stop_at ELSE coalesce(nxt, hi) END, CASE WHEN on_air THEN last_s.path END,
      CASE WHEN on_air THEN (epoch_us(cur) - epoch_us(last_s.at)) / 1000000.0 END, CASE WHEN on_air THEN (epoch_us(stop_at) - epoch_us(cur)) / 1000000.0 END
    FROM (SELECT *, last_s IS NOT NULL AND (last_s.dur = 0 OR epoch_us(cur) - epoch_us(last_s.at) < last_s.dur * 1000000) AS on_air,
        CASE WHEN last_s.dur = 0 THEN hi ELSE least(hi, last_s.at + to_seconds(last_s.dur::INT)) END AS stop_at
      FROM (SELECT w.match_id, w.step, w.cur, m.hi, max(CASE WHEN c.s.at <= w.cur THEN c.s END) AS last_s, min(CASE WHEN c.s.at > w.cur THEN c.s.at END) AS nxt
        FROM steps w JOIN moments m ON m.match_id = w.match_id LEFT JOIN cands c ON c.match_id = w.match_id
        WHERE w.step <= 4 AND w.cur < m.hi GROUP BY w.match_id, w.step, w.cur, m.hi))"""


@query(
    "clip_plan",
    O.with_ctes(
        """SELECT match_id, (row_number() OVER (PARTITION BY match_id ORDER BY step) - 1)::INT AS piece, path, round(off, 6)::DOUBLE AS offset_sec, round(len, 6)::DOUBLE AS length_sec
        FROM steps WHERE path IS NOT NULL""",
        {"segs": _SEGS, "listed": _LISTED, "moments": _EVENT_MOMENTS, "opened": _OPEN, "cands": _CANDS, "steps": _WALK},
        ("steps",),
    ),
)
def clip_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Clips around every event, from the recordings of its channel."""
    moments = spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "event_id AS match_id", "concat('ch', lpad(cast(user_id % 60 + 1 AS string), 2, '0')) AS safe_channel", "ts"
    )
    rows = recordings.clip_plan(moments, segments(spark, sf), "match_id", steps=recordings.CLIP_STEPS)
    return rows.select(
        "match_id", "piece", "path", F.round("offset_sec", 6).alias("offset_sec"), F.round("length_sec", 6).alias("length_sec")
    )


_MATCH_MOMENTS = """SELECT match_id, channel_name AS safe_channel, precise_ts AS ts, precise_ts - INTERVAL 10 SECOND AS lo,
    precise_ts + INTERVAL 10 SECOND AS hi FROM enriched"""


@query(
    "match_clips",
    O.with_ctes(
        """SELECT match_id, (row_number() OVER (PARTITION BY match_id ORDER BY step) - 1)::INT AS piece, path, round(off, 6)::DOUBLE AS offset_sec, round(len, 6)::DOUBLE AS length_sec
        FROM steps WHERE path IS NOT NULL""",
        {**_LOCATED, "segs": _SEGS, "listed": _LISTED, "moments": _MATCH_MOMENTS, "opened": _OPEN, "cands": _CANDS, "steps": _WALK},
        ("steps",),
    ),
)
def match_clips(spark: SparkSession, sf: str) -> DataFrame:
    """Clips around the exact time of every match."""
    enriched = detail.enrich(X.matches(spark, sf), X.searches(spark))
    rows = recordings.clip_plans(enriched, segments(spark, sf), recordings.CLIP_STEPS)
    return rows.select(
        "match_id", "piece", "path", F.round("offset_sec", 6).alias("offset_sec"), F.round("length_sec", 6).alias("length_sec")
    )


@query(
    "retention_plan",
    O.with_ctes(
        """SELECT path, length, freed_before::BIGINT AS freed_before FROM (SELECT path, length, coalesce(sum(length) OVER (ORDER BY start_ts, substr(md5(path), 1, 2), path
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed_before FROM segs) WHERE 1000000000 + freed_before < 9000000000""",
        {"segs": _SEGS},
    ),
)
def retention_plan(spark: SparkSession, sf: str) -> DataFrame:
    rows = recordings.retention_plan(segments(spark, sf), 1_000_000_000, 9_000_000_000)
    return rows.select("path", "length", F.col("freed_before").cast("bigint").alias("freed_before"))


@query(
    "aged_files",
    O.with_ctes(
        "SELECT path, modified FROM segs WHERE ext = 'ts' AND floor((epoch_us(TIMESTAMP '2024-01-15') - epoch_us(modified)) / 86400000000.0) > 2",
        {"segs": _SEGS},
    ),
)
def aged_files(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit("2024-01-15").cast("timestamp_ntz")
    return recordings.aged_files(segments(spark, sf), now).select("path", "modified")


@query(
    "finalize_plan",
    O.with_ctes(
        r"""SELECT path, regexp_replace(path, '\.[a-z0-9]+$', '.mp4') AS target FROM (SELECT path, row_number() OVER (PARTITION BY folder ORDER BY modified DESC, path DESC) AS rn
        FROM segs WHERE ext IN ('ts', 'mkv')) WHERE rn > 1""",
        {"segs": _SEGS},
    ),
)
def finalize_plan(spark: SparkSession, sf: str) -> DataFrame:
    return recordings.finalize_plan(segments(spark, sf)).select("path", "target")


@query(
    "srt_rows",
    O.with_ctes(
        """SELECT channel_id, block, idx::INT AS idx, '00:' || strftime(TIMESTAMP '2000-01-01' + (ts - block), '%M:%S,%g') AS start_tc,
        '00:' || strftime(TIMESTAMP '2000-01-01' + (ts + INTERVAL 30 SECOND - block), '%M:%S,%g') AS end_tc, md5(text) AS text_md5 FROM (
        SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) AS block, row_number() OVER (PARTITION BY channel_id, time_bucket(INTERVAL 30 MINUTE, ts) ORDER BY ts, id) AS idx
        FROM chunks WHERE text NOT IN ('', '[~]'))"""
    ),
)
def srt_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = blocks.srt_rows(X.chunks(spark, sf))
    return rows.select("channel_id", "block", "idx", "start_tc", "end_tc", F.md5("text").alias("text_md5"))


@query(
    "block_text_lines",
    O.with_ctes(
        """SELECT channel_id, block, count(*) + 3 AS n_lines, max(CASE WHEN idx = 1 THEN '# [EPG] ' || coalesce((SELECT p.title FROM programmes p
          WHERE p.channel_name = b.channel_name AND p.start_ts <= b.ts AND p.stop_ts > b.ts ORDER BY p.start_ts DESC LIMIT 1), 'sin datos') END) AS header FROM (
        SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) AS block, row_number() OVER (PARTITION BY channel_id, time_bucket(INTERVAL 30 MINUTE, ts) ORDER BY ts, id) AS idx
        FROM chunks WHERE text NOT IN ('', '[~]')) b GROUP BY 1, 2"""
    ),
)
def block_text_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = blocks.text_lines(X.chunks(spark, sf), X.programmes(spark, sf))
    return lines.groupBy("channel_id", "block").agg(
        F.count(F.lit(1)).alias("n_lines"), F.max(F.when(F.col("pos") == -3, F.col("line"))).alias("header")
    )
