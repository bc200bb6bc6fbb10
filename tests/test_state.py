"""State of the live job: any cut into batches, with a restart between them, equals the batch operator."""

import random
import re
from datetime import timedelta

import pytest
from helpers import T0, at, chunks, search, searches, users
from pyspark.sql import functions as F

from mediawatch.operators import matching, ordered
from mediawatch.streaming import alerts, state

KEY = ["search_id", "kw_pos", "keyword", "channel_id", "channel_name"]


def streamed(spark, tmp_path, batches, schema, operator):
    """Rows that the operator has let out after each batch; every batch is a new run from the checkpoint."""
    state.use_state_store(spark)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = operator(spark.readStream.schema(schema).parquet(source))
        run = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "ck"))
        run.trigger(availableNow=True).start().awaitTermination(120)
        yield spark.read.parquet(sink).collect()


def hits(rng, n):
    out = []
    for i in range(n):
        k = rng.randrange(4)
        out.append([1 + k // 2, k % 2, f"k{k}", 1, "ch01", 1000 + rng.randrange(10**6), at(round(rng.uniform(0, 1500), 3)), k != 3])
    for r in rng.sample(out, 12):  # the same instant of another chunk
        out.append([*r[:5], r[5] + 1, *r[6:]])
    return sorted(out, key=lambda r: r[6])


@pytest.mark.parametrize("seed", [1, 2])
def test_spacing_is_the_same_in_any_cut(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = hits(rng, 260)
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    while any(rows[c][6] == rows[c - 1][6] for c in cuts):  # the lowest id of one instant is known in its batch only
        cuts = sorted(rng.sample(range(1, len(rows)), 3))
    batches = [[(*r, T0 + timedelta(days=9, seconds=b)) for r in rows[i:j]] for b, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(rows)]))]
    *_, got = streamed(spark, tmp_path, batches, state.HITS, state.spaced_stream)
    whole = spark.createDataFrame([r for b in batches for r in b], state.HITS)
    want = ordered.keep_spaced(whole, KEY, "ts", "id", "dedup_channel", matching.DEDUP_SECONDS)
    cols = [*KEY, "ts", "id"]
    assert sorted(tuple(r[c] for c in cols) for r in got) == sorted(tuple(r) for r in want.select(*cols).collect())


def test_late_and_repeated_hits_and_expired_keys(spark, tmp_path):
    hit = lambda s, i, landed: (1, 0, "k", 1, "ch01", i, at(s), True, T0 + timedelta(days=9, seconds=landed))
    other = lambda landed: (2, 0, "x", 1, "ch01", 9, at(0), True, T0 + timedelta(days=9, seconds=landed))
    batches = [
        [hit(100, 1, 0)], [hit(20, 2, 1), hit(100, 1, 1)], [hit(130, 3, 2)], [other(5000)], [other(5001)], [hit(131, 4, 5002)],
    ]
    seen = [
        sorted(r["id"] for r in rows if r["search_id"] == 1)
        for rows in streamed(spark, tmp_path, batches, state.HITS, lambda s: state.spaced_stream(s, keep=60))
    ]
    # a late hit is judged by the hits before it; a repeated one adds nothing; 131 s comes after the key's state was dropped
    assert seen == [[1], [1, 2], [1, 2], [1, 2], [1, 2], [1, 2, 4]]


def test_captions_displace_whichever_lands_first(spark, tmp_path):
    rows = [  # id, channel, ts, source, landed
        (1, 1, 100, "asr", 0), (2, 1, 300, "asr", 0), (3, 2, 100, "asr", 0), (4, 1, 500, "cc", 0), (5, 1, 510, "asr", 40),
        (6, 1, 120, "cc", 40), (7, 1, 239, "cc", 40), (8, 1, 331, "cc", 40), (9, 3, 5, "rss", 40), (10, 2, 700, "asr", 60),
        (11, 2, 640, "cc", 149), (12, 2, 641, "cc", 149), (13, 9, 0, "rss", 400), (14, 9, 30, "rss", 401),
    ]  # 1: caption after the chunk; 5: before it; 10: just inside the wait and the window; 2: captions on both sides of its window
    schema = chunks(spark, []).schema
    made = [(i, c, f"ch{c:02d}", at(s + 0.25), f"text {i} ñ", 1e9 + landed, 30.0, source) for i, c, s, source, landed in rows]
    batches = [[r for r in made if r[5] == t] for t in sorted({r[5] for r in made})]
    op = lambda s: state.caption_first_stream(s, landed=F.timestamp_seconds("confidence"))
    *_, got = streamed(spark, tmp_path, batches, schema, op)
    want = matching.caption_first(spark.createDataFrame(made, schema)).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want} and len(got) == len(want)
    assert {r["id"] for r in got if r["source"] == "asr"} == {2, 3}


def test_a_caption_past_the_wait_comes_too_late(spark, tmp_path):
    schema = chunks(spark, []).schema
    row = lambda i, c, s, source, landed: (i, c, "ch", at(s), "t", 1e9 + landed, 30.0, source)
    batches = [[row(1, 1, 100, "asr", 0)], [row(2, 2, 0, "rss", 101)], [row(3, 1, 110, "cc", 102)]]
    op = lambda s: state.caption_first_stream(s, landed=F.timestamp_seconds("confidence"))
    seen = [sorted(r["id"] for r in rows) for rows in streamed(spark, tmp_path, batches, schema, op)]
    assert seen == [[], [1, 2], [1, 2, 3]]


def test_live_run_with_captions_alerts_once(spark, tmp_path):
    paths = alerts.WatchPaths(*[str(tmp_path / n) for n in ("chunks", "searches", "users", "matches", "outbox", "ckpt")])
    searches(spark, search(1)).write.parquet(paths.searches)
    users(spark).write.parquet(paths.users)
    for rows in ([(1, 1, 0, "sol", "cc"), (2, 1, 30, "sol"), (3, 2, 0, "nada")], [(4, 2, 300, "el sol", "cc")]):
        chunks(spark, rows).coalesce(1).write.mode("append").parquet(paths.chunks)
        alerts.start_watch(spark, paths, today=lambda: F.lit("2024-01-05").cast("date"), once=True, captions=True).awaitTermination(120)
    assert sorted(r["chunk_id"] for r in spark.read.parquet(paths.matches).collect()) == [1, 4]
    assert spark.read.parquet(paths.outbox).select("match_id").distinct().count() == 2


def test_live_status_reads_the_newest_days_only(spark, tmp_path):
    from helpers import chunks as made
    from mediawatch.operators import detail, health
    from mediawatch.sources.transcripts import append_chunks

    paths = alerts.WatchPaths(*[str(tmp_path / n) for n in ("chunks", "searches", "users", "matches", "outbox", "ckpt")])
    rows = [(60 * c + d, c, 86400 * d + 10 * c, f"dia {d}") for d in range(60) for c in (1, 2, 3)]
    late = [(9999, 1, 86400 * 57, "tarde, pero la ultima"), (9998, 2, 86400 * 59 + 25, "casi")]
    for part in (rows[:90], rows[90:], late, late):
        append_chunks(made(spark, part), paths.chunks)
        alerts.keep_newest(made(spark, part), paths.newest)
    table, newest = spark.read.parquet(paths.chunks), alerts.read_newest(spark, paths.newest)
    whole = health.newest_instants(table)
    assert sorted(map(tuple, newest.collect())) == sorted(map(tuple, whole.collect())) and newest.count() == 3
    status = spark.createDataFrame(
        [(c, f"ch0{c}", at(0), "running", 5, at(86400 * 60), 0) for c in (1, 2, 3)],
        "channel_id int, channel_name string, last_seen timestamp_ntz, status string, total_segments int, heartbeat timestamp_ntz, error_count int",
    )
    now = F.lit(at(86400 * 60)).cast("timestamp_ntz")
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    for got, want in (
        (health.live_snapshot(table, status, now, newest=newest), health.live_snapshot(table, status, now)),
        (health.latest_per_channel(table, newest), health.latest_per_channel(table)),
    ):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 3
        scans = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in x and "/chunks" in x]
        assert scans and all("date#" in x and ">= 2024-02-2" in x.split("PartitionFilters")[1] for x in scans), scans
    matches = spark.createDataFrame([(1, 1, at(86400 * 5 + 5)), (2, 2, at(86400 * 9 - 3))], "match_id bigint, channel_id int, ts timestamp_ntz")
    near = detail.nearby_text(matches, table)
    plan = near._jdf.queryExecution().executedPlan().toString()
    listed = [x.split("PartitionFilters: [")[1].split("]")[0] for x in plan.splitlines() if "PartitionFilters: [date#" in x]
    assert len(listed) == 1 and set(re.findall(r"2024-\d\d-\d\d", listed[0])) == {"2024-01-05", "2024-01-06", "2024-01-09", "2024-01-10"}
    plain = detail.nearby_text(matches, table.drop("date"))
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, plain.collect())) and {r["context"] for r in near.collect()} == {"dia 5", ""}
    dated = matches.withColumn("keyword", F.lit("k")).withColumn("date", F.to_date("ts"))
    dated.write.partitionBy("date").parquet(paths.matches)
    plan = detail.facet_filter(spark.read.parquet(paths.matches), date_from="2024-01-08", date_to="2024-01-09")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(date#" in plan and ">= 2024-01-08" in plan and "<= 2024-01-09" in plan.split("PartitionFilters")[1]
