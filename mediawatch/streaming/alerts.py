"""Live jobs over the growing chunk table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mediawatch.functions import text as T
from mediawatch.functions.timefn import epoch_seconds, floor_second, seconds
from mediawatch.operators import health, matching, outbox
from mediawatch.scale import make_folder, stored, whole_folder
from mediawatch.sources import manifest
from mediawatch.sources.tables import read_or_empty, replace_days, same_days
from mediawatch.sources.transcripts import CHUNK_SCHEMA, between_days
from mediawatch.streaming import state


@dataclass
class WatchPaths:
    """Where the live job reads and writes. Searches and users are read anew for every batch."""

    chunks: str
    searches: str
    users: str
    matches: str
    outbox: str
    checkpoint: str
    #: Raw hits on their way from the matching to the alerting query; beside the matches by default.
    hits: str = ""
    #: Newest instants of every channel, kept by the matching query; beside the chunks by default.
    newest: str = ""

    def __post_init__(self) -> None:
        self.hits = self.hits or f"{self.matches}-hits"
        self.newest = self.newest or f"{self.chunks}-newest"


def stream_chunks(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """New chunk files as they land; the checkpoint is the cursor."""
    reader = spark.readStream.schema(CHUNK_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def not_held_back(hits: DataFrame, known: DataFrame, gap: int = matching.DEDUP_SECONDS) -> DataFrame:
    """Hits without a stored match of their key in [floor(second) - gap, hit].

    The equi key is the match key and the minute; a stored match reaches into the minute after its own.
    """
    minute = F.floor(epoch_seconds(F.col("ts")) / 60).cast("bigint")
    held = known.select(
        F.struct("search_id", "keyword", "channel_id").alias("_k"),
        F.col("ts").alias("_at"),
        F.explode(F.sequence(minute, minute + F.ceil(F.lit(gap / 60)).cast("bigint") + 1)).alias("_m"),
    )
    spaced = hits.withColumn("_hm", minute)
    same = (F.struct("search_id", "keyword", "channel_id") == F.col("_k")) & (F.col("_hm") == F.col("_m"))
    near = (F.col("_at") >= floor_second(F.col("ts")) - seconds(gap)) & (F.col("_at") <= F.col("ts"))
    return spaced.join(held, same & near & F.col("dedup_channel"), "left_anti").drop("_hm")


def process_batch(
    batch: DataFrame,
    searches: DataFrame,
    users: DataFrame,
    chunks: DataFrame,
    paths: WatchPaths,
    today: Column,
    found_at: Column | None = None,
    global_chat: str | None = None,
) -> DataFrame:
    """Match a batch, space it against the stored matches, write messages and matches; returns the new matches.

    For a batch outside the live job, which keeps its spacing as state.
    """
    live = matching.active_searches(searches, today)
    hits = stored(matching.match_chunks(batch, live, by_row_date=False), "batch-hits")
    if hits.isEmpty():
        return hits
    shape = hits.select("search_id", "keyword", "channel_id", "ts").withColumn("date", F.to_date("ts"))
    lo, hi = span_of(hits)
    recent = between(read_or_empty(batch.sparkSession, paths.matches, shape), lo - seconds(120), hi)
    kept = stored(matching.spaced_hits(not_held_back(hits, recent)), "batch-kept")
    return process_kept(kept, live, users, chunks, paths, found_at, global_chat)


def process_kept(
    kept: DataFrame, live: DataFrame, users: DataFrame, chunks: DataFrame, paths: WatchPaths,
    found_at: Column | None = None, global_chat: str | None = None,
) -> DataFrame:
    """Write messages and matches of stored, spaced hits; returns the new matches.

    Messages are written before matches and both are keyed, so a replayed batch adds nothing. Both are kept
    by day, and only the days of the batch are compared.
    """
    spark = kept.sparkSession
    lo, hi = span_of(kept)
    rows = matching.as_matches(matching.with_context(kept, nearby(chunks, kept, lo, hi)), found_at)
    dated = rows.withColumn("date", F.to_date("ts"))
    fresh = stored(
        matching.drop_known(dated, same_days(read_or_empty(spark, paths.matches, dated), kept)), "batch-fresh"
    )
    messages = outbox.alerts(fresh.drop("date"), live, users, global_chat).join(
        fresh.select("match_id", "date").dropDuplicates(["match_id"]), "match_id"
    )
    sent = same_days(read_or_empty(spark, paths.outbox, messages), kept).select("match_id", "channel")
    messages.join(sent, ["match_id", "channel"], "left_anti").write.mode("append").partitionBy("date").parquet(paths.outbox)
    fresh.write.mode("append").partitionBy("date").parquet(paths.matches)
    return fresh.drop("date")


def span_of(rows: DataFrame) -> tuple[Column, Column]:
    span = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    return tuple(F.lit(span[x]).cast("timestamp_ntz") for x in ("lo", "hi"))


def between(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """Rows in [first, last]; of a table written by day only their folders are read."""
    own = rows.filter((F.col("ts") >= first) & (F.col("ts") <= last))
    return own.filter(F.col("date").between(F.to_date(first), F.to_date(last))) if "date" in rows.columns else own


def nearby(chunks: DataFrame, hits: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """The chunks that hold the hits and their nearest neighbours.

    Reaches back a day, then ever further, until every channel with a hit has an earlier chunk or none is left; the
    instants alone are read for that. The next chunk after the last hit has not arrived as a rule, or is close by.
    """
    first = hits.groupBy("channel_id").agg(F.min("ts").alias("_first"))
    thin = chunks.select(*[c for c in ("channel_id", "ts", "date") if c in chunks.columns])
    days, last = 1, hi + seconds(3600)
    while True:
        since = lo - F.make_dt_interval(days=F.lit(days))
        seen = between(thin, since, hi).join(first, "channel_id").filter(F.col("ts") < F.col("_first")).select("channel_id").distinct()
        lacking = first.join(seen, "channel_id", "left_anti")
        older = thin.filter(F.col("ts") < since)
        older = older.filter(F.col("date") <= F.to_date(since)) if "date" in thin.columns else older
        if lacking.isEmpty() or older.join(lacking, "channel_id", "left_semi").isEmpty():
            return between(chunks, since, last)
        days *= 8


@dataclass
class Watch:
    """The queries of a live run: chunks to hits, hits to alerts."""

    matching: StreamingQuery
    alerting: StreamingQuery

    def awaitTermination(self, timeout: int | None = None) -> bool | None:  # noqa: N802  (as a query's)
        self.matching.awaitTermination(timeout)
        return self.alerting.awaitTermination(timeout)

    def stop(self) -> None:
        self.matching.stop()
        self.alerting.stop()


NEWEST = "channel_id int, id bigint, ts timestamp_ntz, top_ts timestamp_ntz"


def keep_newest(batch: DataFrame, path: str) -> None:
    """Carry the newest instants of the channels on to a batch; a replayed batch changes nothing."""
    spark = batch.sparkSession
    old = manifest.folders(spark, path)
    number = max([int(n.split("=")[1]) for n in old], default=0) + 1
    rows = health.newer_instants(read_newest(spark, path), health.newest_instants(batch))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/data/write={number}")  # a row a channel
    manifest.publish(spark, path, [f"write={number}"])
    manifest.vacuum(spark, path, ["data"], keep=3)


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    """The channels' newest instants that the live job keeps, for `health.live_snapshot` and `latest_per_channel`.

    Rebuilt, if lost, by `rebuild_newest`.
    """
    own = manifest.folders(spark, path)
    return spark.read.schema(NEWEST).parquet(f"{path}/data/{own[0]}") if own else spark.createDataFrame([], NEWEST)


def rebuild_newest(chunks: DataFrame, path: str) -> None:
    """Newest instants from all chunks (narrow columns), instead of what the table holds, which is not newer."""
    keep_newest(chunks, path)


def start_matching(
    spark: SparkSession, paths: WatchPaths, today: Callable[[], Column], trigger: dict, files_per_trigger: int | None = None,
    captions: bool = False,
) -> StreamingQuery:
    """Chunks to raw hits, one folder per batch; a folder that is whole is not written again by a replay.

    With `captions` a recognised chunk first waits for captions (`state.caption_first_stream`).
    """

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        folder = f"{paths.hits}/batch={number}"
        if whole_folder(session, folder):
            return
        live = matching.active_searches(session.read.parquet(paths.searches), today())
        hits = matching.match_chunks(batch, live, by_row_date=False).withColumn("landed", F.current_timestamp())
        keep_newest(batch, paths.newest)
        hits.select(*[f.split()[0] for f in state.HITS.split(", ")]).write.mode("overwrite").parquet(folder)

    chunks = stream_chunks(spark, paths.chunks, files_per_trigger)
    chosen = state.caption_first_stream(chunks) if captions else chunks
    writer = chosen.writeStream.foreachBatch(run).option("checkpointLocation", f"{paths.checkpoint}/matching")
    return writer.queryName(f"matching {paths.checkpoint}").trigger(**trigger).start()


def start_alerting(
    spark: SparkSession, paths: WatchPaths, today: Callable[[], Column], trigger: dict, found_at: Column | None = None,
    global_chat: str | None = None,
) -> StreamingQuery:
    """Raw hits to messages and matches; the minimum gap is state (`state.spaced_stream`)."""

    def run(batch: DataFrame, _: int) -> None:
        kept = stored(batch, "batch-kept")
        if kept.isEmpty():
            return
        session = batch.sparkSession
        live = matching.active_searches(session.read.parquet(paths.searches), today())
        process_kept(
            kept, live, session.read.parquet(paths.users), session.read.parquet(paths.chunks), paths, found_at, global_chat
        )

    make_folder(spark, paths.hits)
    # Folders are read as such: there may be none yet when the query starts.
    hits = spark.readStream.schema(state.HITS).option("recursiveFileLookup", True).parquet(paths.hits)
    writer = state.spaced_stream(hits).writeStream.foreachBatch(run).option("checkpointLocation", f"{paths.checkpoint}/alerting")
    return writer.queryName(f"alerting {paths.checkpoint}").trigger(**trigger).start()


def start_watch(
    spark: SparkSession,
    paths: WatchPaths,
    today: Callable[[], Column] = F.current_date,
    found_at: Column | None = None,
    once: bool = False,
    files_per_trigger: int | None = None,
    global_chat: str | None = None,
    captions: bool = False,
) -> Watch:
    """The live alert job: every five seconds, or over everything there is when `once`."""
    state.use_state_store(spark)
    trigger = {"availableNow": True} if once else {"processingTime": "5 seconds"}
    first = start_matching(spark, paths, today, trigger, files_per_trigger, captions)
    if once:
        first.awaitTermination()
    return Watch(first, start_alerting(spark, paths, today, trigger, found_at, global_chat))


def repair_context(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every match, with the neighbours that had not arrived when it was found.

    A match whose chunk is no longer stored, or that never had one, keeps the texts it has.
    """
    keys = matches.filter(F.col("chunk_id").isNotNull()).select("channel_id", "ts", F.col("chunk_id").alias("id")).distinct()
    texts = matching.with_context(keys, chunks).select(
        "channel_id", "ts", F.col("id").alias("chunk_id"), F.lit(True).alias("_found"),
        *[F.col(c).alias(f"_{c}") for c in ("prev_text", "cur_text", "next_text")],
    )
    both = matches.join(texts, ["channel_id", "ts", "chunk_id"], "left")
    fixed = {c: F.when(F.col("_found"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("prev_text", "cur_text", "next_text")}
    return both.withColumns(fixed).select(*matches.columns)


def repair_matches(spark: SparkSession, paths: WatchPaths, first: Column, last: Column) -> None:
    """Repair the stored matches of the days first .. last in place; their folders alone are read and written."""
    days = between_days(spark.read.parquet(paths.matches), first, last)
    lo, hi = F.to_timestamp_ntz(first.cast("date").cast("string")), F.to_timestamp_ntz(F.date_add(last, 1).cast("string"))
    chunks = nearby(spark.read.parquet(paths.chunks), days, lo, hi)
    fixed = stored(repair_context(days, chunks), "repaired-matches")
    replace_days(fixed, days.select("date").distinct(), paths.matches)


def suppress_captioned(batch: DataFrame, captions: DataFrame) -> DataFrame:
    """Caption-first over a batch: stored captions of the last minutes count as well as the batch's own."""
    own = batch.select("channel_id", "ts", "source").filter("source = 'cc'")
    past = captions.select("channel_id", "ts", F.lit("cc").alias("source"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in batch.schema.fields if f.name not in own.columns]
    known = past.join(own, ["channel_id", "ts"], "left_anti").select("*", *blank, F.lit(True).alias("_past"))
    both = batch.withColumn("_past", F.lit(False)).unionByName(known)
    return matching.caption_first(both).filter(~F.col("_past")).drop("_past")


def stream_blocks(chunks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Half-hour blocks of a chunk stream by event time; a late chunk goes to its own block.

    Blocks come out once, when the watermark has passed their end. A block holds 30 minutes of one channel.
    """
    said = F.array_sort(F.collect_list(F.struct("ts", "id", "text")))
    return (
        chunks.filter(T.is_speech(F.col("text")))
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", "30 minutes").alias("w"), "channel_id", "channel_name")
        .agg(said.alias("lines"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("block"),
            "channel_id",
            "channel_name",
            F.transform("lines", lambda r: F.concat(F.date_format(r["ts"], "HH:mm:ss.SSS"), F.lit(" "), r["text"])).alias("lines"),
        )
    )
