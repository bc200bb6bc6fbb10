"""State kept between the batches of a live job: kept instants per match key, captions per channel.

Both operators run on a landing clock: rows carry the instant they landed (`landed`, the batch's own time), so a row is
not too late for the watermark however old the event it tells of, and a replayed batch has the same clock. The watermark
stays behind by what the clock may be set back, or the files of one batch may be seen apart, without losing a row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mediawatch.functions.timefn import CHUNK_SECONDS, epoch_seconds
from mediawatch.operators.matching import CAPTION_GRACE_SECONDS, DEDUP_SECONDS, HIT_KEY

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HITS = (
    "search_id int, kw_pos int, keyword string, channel_id int, channel_name string, id bigint, ts timestamp_ntz, "
    "dedup_channel boolean, landed timestamp"
)
SECOND = 1_000_000
#: How far the watermark stays behind the landing clock.
BEHIND = "10 seconds"
HITS_BEHIND = "10 minutes"
#: Seconds after its last hit for which a key's state is kept.
KEPT_SECONDS = 86_400


def use_state_store(spark: SparkSession) -> None:
    """State lives in RocksDB, whose snapshots go to the query's checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class SpacedHits(StatefulProcessor):
    """Kept instants of one match key, in microseconds; only those that can still hold a hit back stay."""

    def __init__(self, gap: int, keep: int):
        self.gap, self.keep = gap * SECOND, keep * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = [r[0] for r in self.kept.get()] if self.kept.exists() else []
        landed = 0
        # Rows come in any order; within a batch the earliest, and of one instant the lowest id, is first.
        for pos, chunk, active, at in sorted((r["pos"], r["id"], r["dedup_channel"], r["landed_ms"]) for r in rows):
            landed = max(landed, at)
            reach = pos - pos % SECOND - self.gap if active else pos
            if not any(reach <= k <= pos for k in kept):
                kept.append(pos)
                yield Row(**dict(zip(("search_id", "kw_pos", "keyword", "channel_id", "channel_name"), key)), pos=pos, id=chunk)
        newest = max(kept)
        self.kept.put([(k,) for k in sorted(kept) if k >= newest - 60 * self.gap])
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(landed + self.keep)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.kept.clear()
        yield from ()

    def close(self) -> None:
        pass


def spaced_stream(hits: DataFrame, gap: int = DEDUP_SECONDS, keep: int = KEPT_SECONDS) -> DataFrame:
    """Hits of a stream (columns `HITS`) left after the minimum gap of their key: the key, id and ts.

    A hit is held back by a kept hit of its key in [floor(second) - gap, hit]. On hits that come in time order
    this is `ordered.keep_spaced`, however they are cut into batches; a hit that comes after a later one is judged
    by the kept hits before it. With the gap off (`dedup_channel`) one hit of every instant is left. State reaches
    back 60 gaps from a key's newest kept hit, and is dropped `keep` seconds after its last one landed.
    """
    scope = [*HIT_KEY, "channel_name"]
    placed = hits.withWatermark("landed", HITS_BEHIND).select(
        *scope, "id", "dedup_channel", "landed", (epoch_seconds(F.col("ts")) * SECOND).cast("bigint").alias("pos"),
        F.unix_millis("landed").alias("landed_ms"),
    )
    kept = placed.groupBy(*scope).transformWithState(
        SpacedHits(gap, keep),
        "search_id int, kw_pos int, keyword string, channel_id int, channel_name string, pos bigint, id bigint",
        "Append", "EventTime",
    )
    instant = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        secs=(F.col("pos") / F.lit(SECOND).cast("decimal(7,0)")).cast("decimal(18,6)")
    )
    return kept.select(*scope, "id", instant.alias("ts"))


class CaptionFirst(StatefulProcessor):
    """Captions of one channel, and its recognised chunks that a caption may still displace."""

    def __init__(self, grace: int, chunk: int, wait: int):
        self.grace, self.chunk, self.wait = grace * SECOND, chunk * SECOND, wait * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.captions = handle.getListState("captions", "at bigint")
        self.waiting = handle.getListState("waiting", "pos bigint, due bigint, row string")

    def _captioned(self, pos: int, captions: list[int]) -> bool:
        end = pos + self.chunk
        return any(end - self.grace < c <= end for c in captions)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        captions = [r[0] for r in self.captions.get()] if self.captions.exists() else []
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        for r in rows:
            if r["source"] == "asr":
                waiting.append((r["pos"], r["landed_ms"] + self.wait, r["row"]))
            else:
                if r["source"] == "cc":
                    captions.append(r["pos"])
                yield Row(channel_id=key[0], row=r["row"])
        waiting = [w for w in waiting if not self._captioned(w[0], captions)]
        self._keep(captions, waiting)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        captions = [r[0] for r in self.captions.get()] if self.captions.exists() else []
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        for pos, due, row in waiting:
            if due <= now:
                yield Row(channel_id=key[0], row=row)
        self._keep(captions, [w for w in waiting if w[1] > now])

    def _keep(self, captions: list[int], waiting: list[tuple]) -> None:
        # Captions of the last hour and of all chunks that still wait.
        oldest = min([w[0] for w in waiting], default=None)
        newest = max(captions, default=0)
        floor = newest - 3600 * SECOND if oldest is None else min(newest - 3600 * SECOND, oldest - self.grace)
        captions = sorted({c for c in captions if c >= floor})
        self.captions.put([(c,) for c in captions]) if captions else self.captions.clear()
        self.waiting.put(waiting) if waiting else self.waiting.clear()
        for at in {w[1] for w in waiting} - set(self.handle.listTimers()):
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def caption_first_stream(
    chunks: DataFrame, grace: int = CAPTION_GRACE_SECONDS, chunk: int = CHUNK_SECONDS, wait: int | None = None,
    landed: Column | None = None,
) -> DataFrame:
    """`matching.caption_first` over a stream of chunks: the chunks that no caption displaces.

    Captions, and chunks of other sources, pass at once. A recognised chunk waits for `wait` seconds (`grace`, if not
    given) after it landed, so a caption displaces it whichever of both lands first; captions that land later than
    that do not (it leaves up to `BEHIND` later still, with the next batch). A caption displaces the chunk if its instant lies in the `grace` seconds before the chunk's end.
    Rows land when their batch runs, unless `landed` says otherwise.
    """
    columns = list(chunks.columns)
    schema = chunks.schema
    timed = chunks.withColumn("landed", F.current_timestamp() if landed is None else landed).withWatermark("landed", BEHIND)
    whole = F.to_json(F.struct(*columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    placed = timed.select(
        "channel_id", "landed", "source", F.unix_millis("landed").alias("landed_ms"),
        (epoch_seconds(F.col("ts")) * SECOND).cast("bigint").alias("pos"), whole.alias("row"),
    )
    passed = placed.groupBy("channel_id").transformWithState(
        CaptionFirst(grace, chunk, grace if wait is None else wait), "channel_id int, row string", "Append", "EventTime"
    )
    read = F.from_json("row", schema, {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    return passed.select(read.alias("r")).select("r.*")
