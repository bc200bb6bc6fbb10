import gzip
import json
from datetime import datetime

from helpers import at, chunks, search, searches, users
from pyspark.sql import functions as F

from mediawatch.operators import detail, guide, matching
from mediawatch.operators.retrieval import TextQuery, index_tables, matching_chunks, ranked_search
from mediawatch.sources.text_index import append_index, read_index
from mediawatch.sources import landed, manifest, tables
from mediawatch.sources.transcripts import append_chunks, read_chunks, scan_chunks
from mediawatch.streaming import alerts


def test_playlists(spark, tmp_path):
    (tmp_path / "a.m3u").write_text(
        "#EXTM3U\n#EXTINF:-1,Uno\nhttp://u:p@h/1\nhttp://h/2\n\n#EXTINF:-1 tvg,Tres, HD\n#EXTHEADER:Origin: https://o\n#comment\nhttp://h/3\n"
    )
    rows = landed.read_playlists(spark, str(tmp_path / "*.m3u")).orderBy("channel_id").collect()
    assert [(r["channel_id"], r["name"], r["url"], r["headers"]) for r in rows] == [
        (1, "Uno", "http://h/1", None),
        (2, "Canal_2", "http://h/2", None),
        (3, "Tres, HD", "http://h/3", "Origin: https://o"),
    ]
    kept = landed.keep_channels(landed.read_playlists(spark, str(tmp_path / "*.m3u")), skip_ids=[1])
    assert sorted(r["channel_id"] for r in kept.collect()) == [2, 3]


def test_guide_xml_and_events(spark, tmp_path):
    xml = """<tv><channel id="c1"><display-name>Canal Uno</display-name></channel>
    <channel id="c2"><display-name>Otro</display-name></channel>
    <programme channel="c1" start="20240101100000 -0600" stop="20240101110000 -0600"><title>[M]  Las   noticias </title></programme>
    <programme channel="c1" start="bad" stop="20240101110000 -0600"><title>x</title></programme>
    <programme channel="c2" start="20240101100000 -0600" stop="20240101110000 -0600"><title>y</title></programme></tv>"""
    path = tmp_path / "g.xml.gz"
    path.write_bytes(gzip.compress(xml.encode()))
    wanted = spark.createDataFrame([(1, "Uno", ["canal uno"])], "wanted_pos int, name string, fragments array<string>")
    names = guide.map_guide_channels(landed.read_guide_channels(spark, str(path)), wanted)
    progs = landed.name_programmes(landed.read_guide_programmes(spark, str(path), "America/Mexico_City"), names, "guide_id")
    assert [tuple(r) for r in progs.collect()] == [("Uno", datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 11), "Las noticias", "guide")]
    page = {"entries": [{"channelUuid": "u", "start": 1704067200, "stop": 1704070800, "title": "a  b"}, {"channelUuid": "u", "start": 0, "stop": 5}]}
    (tmp_path / "p.json").write_text(json.dumps(page, indent=1))
    ev = landed.read_guide_events(spark, str(tmp_path / "p.json")).collect()
    assert [(r["uuid"], r["start_ts"], r["title"]) for r in ev] == [("u", datetime(2024, 1, 1), "a b")]


def test_programme_sink_keeps_the_first_source(spark, tmp_path):
    path = str(tmp_path / "epg")
    schema = "channel_name string, start_ts timestamp_ntz, stop_ts timestamp_ntz, title string, source string, source_rank int"
    tables.insert_programmes(spark.createDataFrame([("a", at(0), at(9), "A", "x", 1), ("a", at(0), at(9), "B", "y", 2)], schema), path)
    tables.insert_programmes(spark.createDataFrame([("a", at(0), at(9), "C", "z", 1), ("a", at(9), at(19), "D", "z", 1)], schema), path)
    assert sorted(r["title"] for r in spark.read.parquet(path).collect()) == ["A", "D"]


def test_news(spark, tmp_path):
    items = "".join(
        f"<item><title>T{i} - Paper</title><link>http://n/{i}</link><pubDate>Mon, 01 Jan 2024 10:{i:02d}:00 GMT</pubDate><source url='u'>Paper</source></item>"
        for i in range(55)
    )
    odd = "<item><title>No date</title><link>l</link></item><item><title>Bad</title><link>l</link><pubDate>yesterday</pubDate></item>"
    (tmp_path / "n.xml").write_text(f"<rss><channel><title>feed</title>{odd}{items}</channel></rss>")
    rows = landed.read_news(spark, str(tmp_path / "n.xml"), "America/Mexico_City", landed.NEWS_ITEMS).orderBy("published").collect()
    assert len(rows) == 48  # the first 50 items hold two unusable ones
    assert (rows[0]["title"], rows[0]["outlet"], rows[0]["published"]) == ("T0", "Paper", datetime(2024, 1, 1, 4, 0))


def test_captions_logs_and_files(spark, tmp_path):
    (tmp_path / "c.srt").write_text("1\n00:00:01,000 --> 00:00:03,500\n hola  a \n\ttodos\n\n2\nno time\nx\n\n3\n00:00:04,000 --> 00:00:05,000\n \n")
    rows = landed.read_caption_blocks(spark, str(tmp_path / "c.srt")).collect()
    assert [(r["text"], r["duration_sec"]) for r in rows] == [("hola a todos", 2.5)]
    lines = "1\r\n00:00:00,000 --> 00:00:02,000\r\nuno\r\n\r\n\r\n2\r\n00:00:02,000 --> 00:00:04,000\r\ndos\r\n"
    (tmp_path / "canal_07.srt").write_bytes(lines.encode())
    both = landed.read_caption_blocks(spark, str(tmp_path / "canal_07.srt"))
    assert [(r["block"], r["text"], r["end_ms"]) for r in both.orderBy("block").collect()] == [(0, "uno", 2000), (1, "dos", 4000)]
    owner = spark.createDataFrame([("canal_07", 7, "ch07")], "pattern string, channel_id int, channel_name string")
    live = landed.caption_rows(both, owner, F.lit(at(0)).cast("timestamp_ntz")).orderBy("end_ts").collect()
    assert [(r["channel_id"], r["end_ts"], r["text"]) for r in live] == [(7, at(2), "uno"), (7, at(4), "dos")]
    from mediawatch.operators.health import warning_count

    (tmp_path / "v.log").write_text("2024-01-01 10:00 WARNING x\n2024-01-01 INFO WARN\n2024-01-02 WARNING\n")
    assert warning_count(landed.read_log_lines(spark, str(tmp_path / "v.log")), "2024-01-01").first()[0] == 1
    folder = tmp_path / "video" / "canal_03_c3"
    folder.mkdir(parents=True)
    (folder / "x_2024-01-01_10-30.ts").write_bytes(b"123")
    (folder / "notes.txt").write_text("no")
    found = landed.read_recordings(spark, str(tmp_path / "video")).collect()
    assert [(r["length"], r["channel_id"], r["start_ts"]) for r in found] == [(3, 3, datetime(2024, 1, 1, 10, 30))]


def test_chunk_table_prunes_days(spark, tmp_path):
    path = str(tmp_path / "chunks")
    append_chunks(chunks(spark, [(1, 1, 0, "a"), (2, 1, 86400, "b"), (3, 2, 3 * 86400, "c")]), path)
    df = scan_chunks(read_chunks(spark, path), since="2024-01-02", until="2024-01-03", channel_ids=[1])
    assert [r["id"] for r in df.collect()] == [2]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert "channel_id" in plan.split("PushedFilters:")[1].split("]")[0]


def test_status_upsert_and_export(spark, tmp_path):
    path = str(tmp_path / "status")
    schema = "channel_id int, updated_at timestamp_ntz, status string"
    tables.upsert_latest(spark.createDataFrame([(1, at(5), "run"), (2, at(5), "run")], schema), path, "channel_id", "updated_at")
    tables.upsert_latest(spark.createDataFrame([(1, at(4), "old"), (2, at(9), "stop")], schema), path, "channel_id", "updated_at")
    assert {(r["channel_id"], r["status"]) for r in tables.read_versions(spark, path).collect()} == {(1, "run"), (2, "stop")}
    c = chunks(spark, [(1, 1, 0, 'dice "sol", hoy'), (2, 1, 10, "sigue")])
    s = searches(spark, search(name="N/1"))
    progs = spark.createDataFrame([("ch01", at(0), at(60), "P", "g")], "channel_name string, start_ts timestamp_ntz, stop_ts timestamp_ntz, title string, source string")
    rows = detail.export_rows(matching.backfill(c, s), s, progs, c)
    tables.write_report(rows, str(tmp_path / "report"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "report")).first()
    assert (back["sheet"], back["programme"], back["context"]) == ("N1", "P", 'dice "sol", hoy sigue')


def test_reports_of_equal_names_are_kept_apart(spark, tmp_path):
    c = chunks(spark, [(1, 1, 0, "sol"), (2, 1, 300, "luna")])
    s = searches(spark, search(1, name="Noticias"), search(2, name="Noticias", user_id=2, keywords=["luna"]))
    progs = spark.createDataFrame([], "channel_name string, start_ts timestamp_ntz, stop_ts timestamp_ntz, title string, source string")
    path = str(tmp_path / "r")
    tables.write_report(detail.export_rows(matching.backfill(c, s), s, progs, c), path, "parquet")
    for n, kw in ((1, "sol"), (2, "luna")):
        assert [r["keyword"] for r in spark.read.parquet(f"{path}/search={n}").collect()] == [kw]


def test_stored_reports_turn_stale(spark, tmp_path):
    from mediawatch.operators import similarity

    text = "uno dos tres cuatro cinco seis sol siete ocho nueve diez once doce trece"
    s = searches(spark, search(1, dedup_channel=False))
    first = matching.backfill(chunks(spark, [(i, 1, 3600 * i, text) for i in range(3)]), s)
    path = str(tmp_path / "rep")
    tables.write_similarity_report(similarity.similarity_report(first), first, F.lit(at(9)).cast("timestamp_ntz"), path)
    assert spark.read.parquet(f"{path}/clusters").first()["size"] == 3
    assert [r["stale"] for r in tables.read_similarity_reports(spark, first, path).collect()] == [False]
    assert [r["stale"] for r in tables.read_similarity_reports(spark, first.limit(2), path).collect()] == [True]
    assert similarity.to_generate(s, spark.read.parquet(f"{path}/reports")).count() == 0


def test_repair_keeps_matches_without_a_chunk(spark, tmp_path):
    rows = [(1, 1, 0, "uno"), (2, 1, 30, "sol"), (3, 1, 60, "fin"), (4, 2, 0, "sol")]
    paths = alerts.WatchPaths(*[str(tmp_path / n) for n in ("chunks", "searches", "users", "matches", "outbox", "ckpt")])
    early = matching.backfill(chunks(spark, rows[:2] + rows[3:]), searches(spark, search()))
    tables.insert_matches(early, paths.matches)
    append_chunks(chunks(spark, rows[:3]), paths.chunks)  # the chunk of channel 2 is gone
    alerts.repair_matches(spark, paths, F.lit("2024-01-01").cast("date"), F.lit("2024-01-01").cast("date"))
    got = {r["chunk_id"]: (r["prev_text"], r["cur_text"], r["next_text"]) for r in spark.read.parquet(paths.matches).collect()}
    assert got == {2: ("uno", "sol", "fin"), 4: (None, "sol", None)}


def test_live_context_reaches_back_as_far_as_needed(spark, tmp_path):
    rows = [(1, 1, 0, "antes"), (2, 1, 40 * 86400, "sol"), (3, 2, 40 * 86400, "sol")]
    paths = watch(spark, tmp_path, [rows[:1], rows[1:]], [search(1)])
    got = {r["chunk_id"]: r["prev_text"] for r in spark.read.parquet(paths.matches).collect()}
    assert got == {2: "antes", 3: None}


def watch(spark, tmp_path, batches, rows_searches, replay=None):
    paths = alerts.WatchPaths(*[str(tmp_path / n) for n in ("chunks", "searches", "users", "matches", "outbox", "ckpt")])
    searches(spark, *rows_searches).write.mode("overwrite").parquet(paths.searches)
    users(spark).write.mode("overwrite").parquet(paths.users)
    for rows in batches:
        chunks(spark, rows).coalesce(1).write.mode("append").parquet(paths.chunks)
        q = alerts.start_watch(
            spark, paths, today=lambda: F.lit("2024-01-05").cast("date"), once=True, global_chat="900"
        )
        q.awaitTermination(120)
    return paths


def test_stream_equals_batch_and_replay_adds_nothing(spark, tmp_path):
    rows = [(i, 1 + i % 2, 30 * (i // 2) + 0.25 * (i % 4), "hay sol hoy" if i % 3 else "[~]") for i in range(40)]
    s = [search(1), search(2, keywords=["hoy", "ay"], dedup_channel=False)]
    paths = watch(spark, tmp_path, [rows[:13], rows[13:14], rows[14:]], s)
    key = ["search_id", "keyword", "channel_id", "ts", "chunk_id"]
    stored = spark.read.parquet(paths.matches)
    want = matching.backfill(chunks(spark, rows), searches(spark, *s))
    assert {tuple(r) for r in stored.select(*key).collect()} == {tuple(r) for r in want.select(*key).collect()}
    sent = spark.read.parquet(paths.outbox)
    assert sent.count() == 2 * stored.count()
    # the same batch again: nothing new
    fresh = alerts.process_batch(
        chunks(spark, rows), searches(spark, *s), users(spark), spark.read.parquet(paths.chunks), paths,
        F.lit("2024-01-05").cast("date"), global_chat="900",
    )
    assert fresh.count() == 0
    assert spark.read.parquet(paths.matches).count() == want.count()
    assert spark.read.parquet(paths.outbox).count() == 2 * want.count()
    # late context is repaired to what the batch job finds
    cols = [*key, "prev_text", "cur_text", "next_text"]
    repaired = alerts.repair_context(stored, chunks(spark, rows)).select(*cols)
    assert {tuple(r) for r in repaired.collect()} == {tuple(r) for r in want.select(*cols).collect()}


def test_rescan_replaces_a_search(spark, tmp_path):
    path = str(tmp_path / "m")
    c = chunks(spark, [(1, 1, 0, "sol y luna"), (2, 1, 300, "luna")])
    tables.insert_matches(matching.backfill(c, searches(spark, search(1), search(2, keywords=["luna"]))), path)
    edited = searches(spark, search(1, keywords=["luna"]))
    tables.replace_searches_matches(matching.backfill(c, edited), edited.select("search_id"), path)
    got = sorted((r["search_id"], r["keyword"], r["chunk_id"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, "luna", 1), (1, "luna", 2), (2, "luna", 1), (2, "luna", 2)]


def test_caption_suppression_uses_stored_captions(spark):
    batch = chunks(spark, [(1, 1, 100, "asr"), (2, 2, 100, "asr"), (3, 2, 90, "cap", "cc")])
    stored = spark.createDataFrame([(1, at(60))], "channel_id int, ts timestamp_ntz")
    assert sorted(r["id"] for r in alerts.suppress_captioned(batch, stored).collect()) == [3]
    assert sorted(r["id"] for r in alerts.suppress_captioned(batch, stored.limit(0)).collect()) == [1, 3]


def test_block_stream_puts_late_chunks_in_their_block(spark, tmp_path):
    path = str(tmp_path / "in")
    for rows in ([(1, 1, 100, "a"), (2, 1, 1900, "b")], [(3, 1, 1700, "tarde"), (4, 1, 9000, "c")], [(5, 1, 9100, "d")]):
        chunks(spark, rows).coalesce(1).write.mode("append").parquet(path)
    q = (
        alerts.stream_blocks(alerts.stream_chunks(spark, path, 1))
        .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    got = {r["block"]: r["lines"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[at(0)] == ["00:01:40.000 a", "00:28:20.000 tarde"] and got[at(1800)] == ["00:31:40.000 b"]


def test_ranked_search_filters(spark):
    c = chunks(spark, [(1, 1, 0, "Música clásica"), (2, 1, 60, "musical rock"), (3, 2, 0, "rock clásico duro"), (4, 2, 5, "[~]")])

    index = index_tables(c)

    def ids(q, **kw):
        return [r["id"] for r in ranked_search(index, q, **kw).collect()]

    assert sorted(ids(TextQuery(any_of=["music*"]))) == [1, 2]
    assert ids(TextQuery(any_of=["musica"])) == [1]
    assert ids(TextQuery(all_of=["rock"], none_of=["musical"])) == [3]
    assert ids(TextQuery(phrase="rock clasico")) == [3]
    assert ids(TextQuery(any_of=["rock", "clas*"]), channel="CH01", limit=1) in ([1], [2])
    assert ids(TextQuery(any_of=["rock"]), since=F.lit(at(30)).cast("timestamp_ntz")) == [2]
    assert sorted(r["id"] for r in matching_chunks(index, TextQuery(none_of=["rock"])).collect()) == [1, 4]


def test_a_day_appended_to_the_index_adds_its_own_postings(spark, tmp_path):
    path = str(tmp_path / "index")
    append_index(chunks(spark, [(1, 1, 0, "sol y mar"), (2, 1, 60, "mar")]), path)
    before = {f for f in (tmp_path / "index").rglob("*.parquet")}
    append_index(chunks(spark, [(3, 1, 90000, "sol sol")]), path)
    added = [f for f in (tmp_path / "index").rglob("*.parquet") if f not in before]
    assert sum(spark.read.parquet(str(f)).count() for f in added if "postings" in str(f)) == 1
    index = read_index(spark, path)
    found = ranked_search(index, TextQuery(any_of=["sol"]))
    assert [r["id"] for r in found.collect()] == [3, 1]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan


def test_upsert_writes_touched_buckets_and_keeps_old_files_for_readers(spark, tmp_path):
    path, schema = str(tmp_path / "status"), "channel_id int, updated_at timestamp_ntz, status string"
    upsert = lambda rows: tables.upsert_latest(spark.createDataFrame(rows, schema), path, "channel_id", "updated_at")
    upsert([(i, at(1), "a") for i in range(200)])
    before = tables.read_versions(spark, path)
    upsert([(7, at(2), "b"), (500, at(0), "c"), (8, at(0), "older")])
    files = [str(f) for f in (tmp_path / "status" / "data" / "write=2").rglob("*.parquet")]
    assert 1 <= len({f.split("bucket=")[1].split("/")[0] for f in files}) <= 3
    assert {r["status"] for r in before.collect()} == {"a"} and before.count() == 200
    now = {r["channel_id"]: r["status"] for r in tables.read_versions(spark, path).collect()}
    assert len(now) == 201 and (now[7], now[500], now[8]) == ("b", "c", "a")
    upsert([(i, at(3), "d") for i in range(200)])  # touches every bucket
    assert manifest.vacuum(spark, path, ["data"], keep=2) == []
    assert manifest.vacuum(spark, path, ["data"]) == ["data/write=1", "data/write=2"]
    now = {r["channel_id"]: r["status"] for r in tables.read_versions(spark, path).collect()}
    assert len(now) == 201 and now[500] == "c" and {now[i] for i in range(200)} == {"d"}


def test_a_stored_report_loses_what_its_search_has_lost(spark, tmp_path):
    from mediawatch.operators import similarity

    first = "uno dos tres cuatro cinco seis sol siete ocho nueve diez once doce trece"
    other = "a b c d e f g h sol i j k l m n o p q r s t"
    s = searches(spark, search(1, dedup_channel=False), search(2, keywords=["nueve"], dedup_channel=False))
    rows = [(i, 1 + i, 3600 * i, first if i < 3 else other) for i in range(6)]  # each alone on its channel
    path, when = str(tmp_path / "rep"), F.lit(at(9)).cast("timestamp_ntz")
    matches = matching.backfill(chunks(spark, rows), s)
    tables.write_similarity_report(similarity.similarity_report(matches), matches, when, path)
    spots = lambda: sorted((r["search_id"], r["size"]) for r in spark.read.parquet(f"{path}/clusters").collect())
    assert spots() == [(1, 3), (1, 3), (2, 3)]
    fewer = matching.backfill(chunks(spark, [rows[0], rows[3]]), s.filter("search_id = 1"))
    tables.write_similarity_report(similarity.similarity_report(fewer), fewer, when, path)
    assert spots() == [(2, 3)]  # from two spots to none; the other search is left as it was
    assert {r["search_id"] for r in spark.read.parquet(f"{path}/members").collect()} == {2}
    exchanged = matching.backfill(chunks(spark, [rows[0], rows[4]]), s.filter("search_id = 1"))
    assert [r["stale"] for r in tables.read_similarity_reports(spark, exchanged, path).orderBy("search_id").collect()] == [True, True]
    tables.write_similarity_report(
        similarity.similarity_report(fewer.limit(0)), fewer.limit(0), when, path, s.filter("search_id = 1")
    )
    assert {r["search_id"]: r["match_count"] for r in spark.read.parquet(f"{path}/reports").collect()} == {1: 0, 2: 3}
    assert tables.read_or_empty(spark, f"{path}/unique", fewer).filter("search_id = 1").count() == 0


def test_block_export_replaces_its_own_windows(spark, tmp_path):
    from mediawatch.operators import blocks

    progs = spark.createDataFrame([], "channel_name string, start_ts timestamp_ntz, stop_ts timestamp_ntz, title string, source string")
    out = str(tmp_path / "txt")
    write = lambda rows: blocks.write_lines(blocks.text_lines(chunks(spark, rows), progs), out)
    write([(1, 1, 60, "uno"), (2, 2, 60, "dos"), (3, 1, 86400, "otro dia")])
    write([(4, 1, 90, "de nuevo"), (5, 1, 2 * 86400, "tercero")])
    kept = spark.read.text(out).filter("value not like '#%'").collect()
    assert sorted((r["window"][:10], r["value"].split("] ")[1]) for r in kept) == [
        ("2024-01-01", "de nuevo"), ("2024-01-02", "otro dia"), ("2024-01-03", "tercero")
    ]


def test_progress_is_what_a_run_has_read(spark):
    from datetime import date

    rows = [(d * 10 + i, 1, d * 86400 + 60 * i, "sol" if i else "[~]") for d in range(5) for i in range(4)]
    s = searches(spark, search(1, date_start=date(2024, 1, 1), date_end=date(2024, 1, 5)), search(2, date_start=date(2024, 1, 2), date_end=date(2024, 1, 2)))
    c = chunks(spark, rows)
    found, done = matching.backfill_days(c, s, date(2024, 1, 1), date(2024, 1, 2))
    got = {r["search_id"]: (r["rows_done"], r["rows_total"]) for r in matching.backfill_progress(c, s, done.unionByName(done)).collect()}
    assert got == {1: (8, 20), 2: (4, 4)}  # 40 % of the first
    assert {r["ts"].day for r in found.collect()} == {1, 2}
