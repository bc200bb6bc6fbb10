"""Adapters that present the driver's generic tables as transcripts, searches, programmes and so on.

Every rule is plain SQL that Spark and DuckDB both understand (see plans/oracle.py for the other side).
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediawatch.operators import matching, retrieval
from mediawatch.scale import own_folder, stored
from mediawatch.sources.text_index import append_index, read_index

TODAY = "2024-01-10"
NOW = "2024-01-10 08:00:00"


def today() -> Column:
    return F.lit(TODAY).cast("date")


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


# search_id, user_id, name, keywords, phonetic, whole_word, date_end, mode, email, chat, media, dedup
SEARCHES = [
    (1, 1, "Common words", ["that", "onre"], 0, 0, "2024-12-31", "final", "a@example.com", 0, ["tv", "radio"], 1),
    (2, 1, "Endings [tv]", ["ción"], 0, 0, "2024-12-31", "final", "", 0, ["tv"], 1),
    (3, 2, "Whole word", ["que"], 0, 1, "2024-12-31", "daily", "b@example.com", 0, ["tv", "radio"], 1),
    (4, 2, "Phrase", ["the of"], 0, 0, "2024-12-31", "final", "", 1, ["tv", "radio"], 0),
    (5, 2, "Sounds", ["baca", "sion"], 1, 0, "2024-12-31", "final", "", 0, ["tv", "radio"], 1),
    (6, 3, "Radio only", ["eaux"], 0, 0, "2024-12-31", "immediate", "c@example.com", 1, ["radio"], 1),
    (7, 3, "All media", ["ander", "schl"], 0, 0, "2024-12-31", "daily", "c@example.com", 0, ["tv", "radio", "youtube"], 1),
    (8, 3, "Expiring", ["license"], 0, 0, "2024-01-01", "final", "c@example.com", 0, ["tv", "radio"], 1),
]
USERS = [(1, "Ana", "admin", "100"), (2, "Beto", "user", ""), (3, "Caro", "user", "300")]
QUESTIONS = [
    (1, "¿Qué pasa con that y onre?", "all", "", 15),
    (2, "onre eaux ander", "all", "ch3", 5),
    (3, "que es la cion", "all", "", 3),
    (4, "Los schl y las license", "all", "", 30),
    (5, "estaba donde the", "all", "", 10),
    (6, "el la los de", "all", "", 10),
    (7, "ander", "30d", "", 1),
    (8, "eaux", "all", "ch1", 40),
    (9, "tion nicht über aulich", "all", "", 12),
    (10, "baca", "7d", "", 15),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: 60 channels, bursts of eight 30 s chunks, whole texts.

    About three in a hundred are followed after 15 s by a silent chunk, a row of its own with a negative id.
    The driver's small table is one file of one row group, so one task would read it; a chunk table in use has a folder
    a day. Such a table's rows are therefore dealt out here, by id.
    """
    documents = _dealt_out(_table(spark, sf_dir, "documents"), sf_dir)

    def dealt(rows: DataFrame, chunk_id: str, later: str, text: str, seconds: str) -> DataFrame:
        return rows.selectExpr(
            f"{chunk_id} AS id",
            "cast(doc_id % 60 + 1 AS int) AS channel_id",
            "concat('ch', lpad(cast(doc_id % 60 + 1 AS string), 2, '0')) AS channel_name",
            f"""timestamp_ntz'2024-01-01 00:00:00'
                 + make_dt_interval(cast(doc_id div 60 div 8 AS int), cast((doc_id % 60 + 1) % 24 AS int), 0,
                     cast((doc_id div 60) % 8 * 30 + (doc_id div 60) % 4 * 0.25 + {later} AS decimal(18,6))) AS ts""",
            f"{text} AS text",
            "CASE WHEN (doc_id div 60) % 3 = 0 THEN ((doc_id div 60) % 10) / 10.0D END AS confidence",
            f"{seconds} AS duration_sec",
            "CASE WHEN (doc_id div 60) % 5 = 0 THEN 'cc' ELSE 'asr' END AS source",
        )

    spoken = dealt(documents, "doc_id", "0", "text", "30.0D")
    pauses = _table(spark, sf_dir, "documents").filter("doc_id % 97 = 5 OR doc_id % 101 = 7 OR doc_id % 103 = 9")
    silence = "CASE WHEN doc_id % 97 = 5 THEN '' WHEN doc_id % 101 = 7 THEN '[~]' END"
    return spoken.unionByName(dealt(pauses, "-1 - doc_id", "15", silence, "15.0D"))


_EVEN: dict[tuple[str, str], int] = {}


def _dealt_out(documents: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as they lie if no task would read more than twice its share, else dealt by id over as many tasks."""
    context = documents.sparkSession.sparkContext
    key = (context.applicationId, sf_dir)
    if key not in _EVEN:
        read = documents.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
        whole = read.agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
        tasks = max(context.defaultParallelism, documents.rdd.getNumPartitions())
        _EVEN[key] = tasks if (whole["most"] or 0) * context.defaultParallelism > 2 * (whole["n"] or 0) else 0
    return documents.repartition(_EVEN[key], "doc_id") if _EVEN[key] else documents


def searches(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    def row(r: tuple) -> str:
        kws = ", ".join(f"'{k}'" for k in r[3])
        media = ", ".join(f"'{m}'" for m in r[10])
        return (
            f"({r[0]}, {r[1]}, '{r[2]}', array({kws}), {bool(r[4])}, {bool(r[5])}, date'2024-01-01', "
            f"date'{r[6]}', 'active', '{r[7]}', '{r[8]}', cast(null AS date), true, "
            f"timestamp_ntz'2024-01-01 {r[0]:02d}:00:00', {bool(r[9])}, array({media}), "
            f"cast(null AS timestamp_ntz), {bool(r[11])})"
        )

    return spark.sql(
        f"""SELECT * FROM VALUES {', '.join(row(r) for r in SEARCHES)}
        AS t(search_id, user_id, name, keywords, phonetic, whole_word, date_start, date_end, status,
             delivery_mode, report_email, last_report, initialized, created_at, notify_chat, media_types,
             news_last_fetch, dedup_channel)"""
    )


def users(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    values = ", ".join(f"({i}, '{n}', '{r}', '{c}')" for i, n, r, c in USERS)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(user_id, name, role, chat_id)")


def questions(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    values = ", ".join(f"({i}, '{q}', '{r}', '{c}', {n})" for i, q, r, c, n in QUESTIONS)
    return spark.sql(
        f"SELECT * FROM VALUES {values} AS t(question_id, question, range, channel, top_n)"
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_chunks(chunks(spark, sf_dir), searches(spark))


def _build_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("ts") + F.make_dt_interval(secs=F.lit(60))
    rows = matching.backfill(chunks(spark, sf_dir), searches(spark), found)
    numbered = (F.col("search_id") * 10 + F.col("kw_pos")).cast("bigint") * 1_000_000_000
    return rows.withColumn("match_id", numbered + F.col("chunk_id"))


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def _stored(name: str, build, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived table as a user would keep it: built once per session, read by later queries."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = stored(build(spark, sf_dir), name)
    return _STORED[key]


matches = partial(_stored, "matches", _build_matches)


_INDEXES: dict[tuple[str, str], retrieval.TextIndex] = {}


def text_index(spark: SparkSession, sf_dir: str) -> retrieval.TextIndex:
    """The stored index of all chunks, appended in two segments: nights and mornings, then the rest of the days."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        path, rows, early = own_folder(spark, "text-index"), chunks(spark, sf_dir), F.hour("ts") < 12
        append_index(rows.filter(early), path)
        append_index(rows.filter(~early), path)
        _INDEXES[key] = read_index(spark, path)
    return _INDEXES[key]


def programmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hour slots of every channel day, odd slots overlapping the next, every 11th missing."""
    days = chunks(spark, sf_dir).select("channel_id", "channel_name", F.to_date("ts").alias("day")).distinct()
    return (
        days.selectExpr("*", "explode(sequence(0, 47)) AS slot")
        .filter("slot % 11 <> 10")
        .selectExpr(
            "channel_name",
            "cast(day AS timestamp_ntz) + make_dt_interval(0, 0, slot * 30, 0) AS start_ts",
            "cast(day AS timestamp_ntz) + make_dt_interval(0, 0, slot * 30 + CASE WHEN slot % 2 = 1 THEN 45 ELSE 30 END, 0) AS stop_ts",
            "concat('prog_', cast((slot * 7 + channel_id) % 13 AS string)) AS title",
            "CASE WHEN slot % 2 = 0 THEN 'guide_a' ELSE 'guide_b' END AS source",
        )
    )


def programme_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guide as two ranked sources that both list the channels' programmes."""
    base = programmes(spark, sf_dir)
    first = base.withColumn("source_rank", F.lit(1))
    second = base.selectExpr(
        "channel_name", "start_ts", "stop_ts", "concat(title, '_alt') AS title",
        "'guide_c' AS source", "2 AS source_rank",
    )
    return first.unionByName(second)


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _table(spark, sf_dir, "events")
        .filter("event_type = 'error'")
        .selectExpr(
            "event_id AS id",
            "cast(user_id % 60 + 1 AS int) AS channel_id",
            "concat('ch', lpad(cast(user_id % 60 + 1 AS string), 2, '0')) AS channel_name",
            "ts",
            "concat('r', cast(cast(regexp_extract(props, '([0-9]+)', 1) AS int) % 4 AS string)) AS reason",
            "'restart' AS action",
        )
    )


def channel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr(
        "cast(user_id % 60 + 1 AS int) AS channel_id",
        "concat('ch', lpad(cast(user_id % 60 + 1 AS string), 2, '0')) AS channel_name",
        "ts AS updated_at",
        "event_type",
        "event_id",
    )


def channel_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channel_events(spark, sf_dir).groupBy("channel_id").agg(
        F.max("channel_name").alias("channel_name"),
        F.lit("running").alias("status"),
        F.max("updated_at").alias("last_seen"),
        F.max("updated_at").alias("heartbeat"),
        F.count(F.lit(1)).alias("total_segments"),
        F.count_if(F.col("event_type") == "error").alias("error_count"),
        F.count_if(F.col("event_type") == "signup").alias("restart_count"),
        F.max(F.when(F.col("event_type") == "error", F.concat(F.lit("event "), F.col("event_id")))).alias("last_error"),
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels seen in the chunks plus three that never produced one."""
    seen = chunks(spark, sf_dir).select("channel_id", "channel_name").distinct()
    silent = spark.sql(
        "SELECT cast(id AS int) AS channel_id, concat('ch', id) AS channel_name FROM range(61, 64)"
    )
    kind = "CASE WHEN channel_id >= 52 THEN 'youtube' WHEN channel_id >= 27 THEN 'radio' ELSE 'tv' END"
    return seen.unionByName(silent).selectExpr("channel_id", "channel_name AS name", f"{kind} AS kind")


def caption_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _table(spark, sf_dir, "conversations")
        .selectExpr(
            "cast(conv_id % 26 + 1 AS int) AS channel_id",
            "conv_id",
            "turn",
            "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(conv_id AS int), cast(turn * 7 AS decimal(18,6))) AS end_ts",
            "concat('00:00:00,000 --> 00:00:', lpad(cast(turn + 5 AS string), 2, '0'), ',500') AS timecode",
            "split(text, '\\n') AS lines",
        )
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "regexp_extract(html, '<title>(.*?)</title>', 1) AS title",
        "url AS link",
        "regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS outlet",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(page_id AS int), 0, 0) AS published",
    )


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as recorded files whose names carry channel and start minute."""
    return (
        _table(spark, sf_dir, "events")
        .selectExpr(
            """concat('canal_', lpad(cast(user_id % 60 + 1 AS string), 2, '0'), '_ch',
                 lpad(cast(user_id % 60 + 1 AS string), 2, '0'), '/x_',
                 date_format(ts, 'yyyy-MM-dd_HH-mm'),
                 CASE event_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.mp4' ELSE '.mkv' END) AS path""",
            "cast(value * 1e6 AS bigint) AS length",
            "ts AS modified",
            "CASE WHEN event_id % 9 <> 0 THEN 1800.0D END AS duration_sec",
        )
        .groupBy("path")
        .agg(
            F.max("length").alias("length"),
            F.max("modified").alias("modified"),
            F.max("duration_sec").alias("duration_sec"),
        )
    )


def asr_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as recogniser segments, each seen by its own hop and again by the next one."""
    return _table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS file_id",
        "explode(array(cast(turn * 37 div 120 AS int), cast(turn * 37 div 120 + 1 AS int))) AS hop",
        "cast(turn * 37 AS double) AS start_s",
        "cast(turn * 37 + 20 AS double) AS end_s",
        "text",
    )
