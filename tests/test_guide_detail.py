import pytest
from datetime import date, datetime

from helpers import at, search, searches, users
from pyspark.sql import functions as F

from mediawatch.operators import detail, guide, health, lifecycle, outbox

PROG = "channel_name string, start_ts timestamp_ntz, stop_ts timestamp_ntz, title string, source string"
MATCH = (
    "match_id bigint, search_id int, kw_pos int, keyword string, channel_id int, channel_name string, ts timestamp_ntz, "
    "chunk_id bigint, prev_text string, cur_text string, next_text string, found_at timestamp_ntz, source_url string"
)


def match(i, s, sec, text="el sol", search_id=1, channel=1, keyword="sol"):
    return (i, search_id, 0, keyword, channel, f"ch{channel:02d}", at(sec), i, None, text, None, at(sec + 60), None)


def test_programme_bounds_overlap_and_long_programmes(spark):
    progs = spark.createDataFrame(
        [
            ("ch01", at(0), at(1800), "A", "g"),
            ("ch01", at(1800), at(3600), "B", "g"),
            ("ch01", at(2700), at(9000), "C", "g"),
            ("ch02", at(0), at(50 * 3600), "long", "g"),
            ("ch02", at(3600), at(3700), None, "g"),
        ],
        PROG,
    )
    asked = [("ch01", 0, "A"), ("ch01", 1799, "A"), ("ch01", 1800, "B"), ("ch01", 2700, "C"), ("ch01", 3600, "C"),
             ("ch01", 9000, ""), ("ch02", 49 * 3600, "long"), ("ch02", 3650, ""), ("ch03", 0, "")]
    rows = spark.createDataFrame([(c, at(s), want) for c, s, want in asked], "channel_name string, ts timestamp_ntz, want string")
    out = guide.with_programme(rows, progs)
    assert out.filter("programme <> want").count() == 0 and out.count() == len(asked)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    inside = guide.during_programmes(rows, progs, ["C"])
    assert inside.count() == 2
    assert "NestedLoop" not in inside._jdf.queryExecution().executedPlan().toString()


def test_channel_maps(spark):
    listed = spark.createDataFrame([("x1", 0, "x1 Canal Uno HD"), ("x2", 1, "x2 canal uno"), ("x3", 2, "x3 Dos")], "guide_id string, file_pos bigint, haystack string")
    wanted = spark.createDataFrame([(1, "Uno", ["canal uno"]), (2, "Again", ["hd"]), (3, "Dos", ["zz", "dos"])], "wanted_pos int, name string, fragments array<string>")
    assert {tuple(r) for r in guide.map_guide_channels(listed, wanted).collect()} == {("x1", "Again"), ("x3", "Dos")}
    live = spark.createDataFrame([("u", "Imagen ADN")], "uuid string, live_name string")
    frags = spark.createDataFrame([(1, "adn", "ADN 40"), (0, "imagen", "Imagen")], "frag_pos int, fragment string, name string")
    assert guide.map_live_channels(live, frags).first()["name"] == "Imagen"


def test_refresh_marks(spark):
    state = spark.createDataFrame([("a", "2024-01-10 00:00:00", 12.0), ("b", None, 12.0), ("c", "junk", 6.0), ("d", "2024-01-09 12:00:00", 12.0)], "source string, last_fetch string, hours double")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    assert sorted(r["source"] for r in guide.refresh_due(state, now).collect()) == ["b", "c", "d"]
    failed = spark.range(1).select(guide.fetch_mark(now, F.lit(False), F.lit(6.0)).alias("x")).first()["x"]
    assert failed == datetime(2024, 1, 9, 18, 30)


def test_heatmap_of_an_empty_search(spark):
    s = searches(spark, search(1, date_start=date(2024, 3, 1), date_end=date(2024, 3, 5)))
    none = spark.createDataFrame([], MATCH)
    cells = detail.heatmap(none, s, F.lit("2024-02-01").cast("date"))
    assert cells.count() == 24 and cells.agg(F.max("n")).first()[0] == 0
    assert detail.heatmap_rows(cells).first()["hours"] == [0] * 24


def test_page_is_resorted_by_exact_time(spark):
    # the earlier chunk says the word late, the later chunk says it early
    m = spark.createDataFrame([match(1, 1, 0, "a b c d e f g h i sol"), match(2, 1, 20, "sol b c d e f g h i j", channel=2)], MATCH)
    page = detail.match_page(m, searches(spark, search()), 1).collect()
    assert [r["match_id"] for r in page] == [1, 2]


def test_feed_and_scope(spark):
    m = spark.createDataFrame([match(i, 1, i) for i in range(1, 130)], MATCH)
    assert detail.match_feed(m, 1, after_id=10).count() == 100
    assert detail.match_feed(m, 1).first()["match_id"] == 129
    both = searches(spark, search(1), search(2, user_id=2))
    assert detail.owned_searches(both, 2, False).count() == 1 and detail.owned_searches(both, 2, True).count() == 2


def test_alerts_go_where_they_should(spark):
    m = spark.createDataFrame([match(1, 1, 0, "x" * 400 + " sol"), match(2, 1, 0, search_id=2), match(3, 1, 0, search_id=3)], MATCH)
    s = searches(spark, search(1), search(2, user_id=2, delivery_mode="final"), search(3, notify_chat=False, report_email=""))
    rows = {(r["match_id"], r["channel"]): r for r in outbox.alerts(m, s, users(spark), "900").collect()}
    assert set(rows) == {(1, "email"), (1, "chat"), (2, "chat")}
    assert rows[(1, "chat")]["recipient"] == "100" and rows[(2, "chat")]["recipient"] == "900"
    assert len(rows[(1, "chat")]["body"]) == 300 and len(rows[(1, "email")]["body"]) == 404
    assert outbox.alerts(m, s, users(spark), None).filter("match_id = 2").count() == 0
    assert '"event":"match"' in outbox.webhook_payloads(m, s).first()["payload"]
    assert outbox.phone_payloads(m, s).count() == 3


@pytest.mark.parametrize("apart", [3601, 0])
def test_chat_report_packs_greedily(spark, apart):
    # apart 0: a backfill gives all its matches one instant
    m = spark.createDataFrame([match(i, 1, i * apart, "sol " + "y" * (i % 90)) for i in range(400)], MATCH)
    m = m.withColumn("match_id", F.col("match_id") * F.lit(10**15) - F.lit(2 * 10**17))
    lines = [r["line"] for r in outbox.chat_lines(m).orderBy("found_at", "match_id").collect()]
    want, block = [], []
    for line in lines:
        if sum(len(x) + 1 for x in block) + len(line) + 1 > 3800:
            want.append("\n".join(block))
            block = []
        block.append(line)
    want.append("\n".join(block))
    got = [r["body"] for r in outbox.chat_report(m).orderBy("block").collect()]
    assert got == want and len(got) > 5


def test_lifecycle_rules(spark):
    today = F.lit("2024-01-10").cast("date")
    now = F.lit("2024-01-10 08:00:00").cast("timestamp_ntz")
    s = searches(
        spark,
        search(1, date_end=date(2024, 1, 9), delivery_mode="final"),
        search(2, delivery_mode="daily", last_report=date(2024, 1, 9)),
        search(3, delivery_mode="daily", last_report=date(2024, 1, 10)),
        search(4, media_types=["news"], news_last_fetch=datetime(2024, 1, 10, 7, 30)),
        search(5, media_types=["news"], news_last_fetch=datetime(2024, 1, 10, 7, 31)),
        search(6, date_end=date(2024, 1, 9), delivery_mode="final", status="completed", last_report=date(2024, 1, 10)),
    )

    def ids(df):
        return sorted(r["search_id"] for r in df.collect())

    assert ids(lifecycle.expire(s, today).filter("status = 'completed'")) == [1, 6]
    assert ids(lifecycle.news_due(s, now)) == [4]
    assert ids(lifecycle.daily_reports_due(s, now)) == [2]
    assert ids(lifecycle.daily_reports_due(s, F.lit("2024-01-10 06:59:00").cast("timestamp_ntz"))) == []
    assert ids(lifecycle.final_reports_due(s, today)) == [1]
    after = lifecycle.mark_reported(s, now)
    assert ids(after.filter("last_report = date'2024-01-10'")) == [1, 2, 3, 6]
    assert ids(after.filter("status = 'completed'")) == [1, 6]
    edited = searches(spark, search(1, keywords=["luna"]), search(2, dedup_channel=False), search(3, name="new"))
    before = searches(spark, search(1), search(2), search(3))
    assert ids(lifecycle.to_rescan(before, edited)) == [1]


def test_health_classes_and_causes(spark):
    assert [spark.range(1).select(health.integrity_class(F.lit(n)).alias("c")).first()["c"] for n in (0, 1, 19, 20)] == ["none", "low", "low", "ok"]
    roster = spark.createDataFrame([(1, "Uno"), (2, "Dos")], "channel_id int, name string")
    from helpers import chunks

    c = chunks(spark, [(1, 1, 0, "hola")])
    status = spark.createDataFrame([(1, 0, 0, "")], "channel_id int, restart_count int, error_count int, last_error string")
    fails = spark.createDataFrame([(1, "Uno", at(5), "r" * 80), (1, "Uno", at(6), "r" * 80), (1, "Uno", at(7), "b")], "channel_id int, channel_name string, ts timestamp_ntz, reason string")
    day = F.lit("2024-01-01").cast("date")
    hosts = spark.createDataFrame([("tv", False)], "host string, reachable boolean")
    causes = [r["cause"] for r in health.health_report(roster, c, fails, status, day, reachability=hosts)["causes"].collect()]
    assert causes[0] == "Host tv unreachable"
    assert causes[1] == "Channel 01 (Uno): 3 failures - " + "r" * 60 + ", b"
    assert causes[2] == "Channel 02 (Dos): no transcript all day"
    fine = health.health_report(roster.filter("channel_id = 1"), c, fails.limit(0), status, day)["causes"].collect()
    assert [r["cause"] for r in fine] == ["No probable cause found"]


def test_live_snapshot_falls_back_to_the_last_chunk(spark):
    from helpers import chunks

    c = chunks(spark, [(1, 1, 0, "viejo"), (2, 1, 100, "[~]"), (3, 2, 100, "uno"), (4, 2, 130, "dos")])
    status = spark.createDataFrame(
        [(i, f"ch{i}", "running", at(100), at(130), 9, 0) for i in (1, 2, 3)],
        "channel_id int, channel_name string, status string, last_seen timestamp_ntz, heartbeat timestamp_ntz, total_segments int, error_count int",
    )
    rows = {r["channel_id"]: r for r in health.live_snapshot(c, status, F.lit(at(200)).cast("timestamp_ntz")).collect()}
    assert rows[1]["text"] == "[~]" and rows[2]["text"] == "uno dos" and rows[3]["text"] == "[~]"
    assert rows[2]["n_chunks"] == 2 and rows[2]["fluency"] == 1.0 and rows[3]["last_ts"] == at(100)
