import math
import random
import re
from datetime import timedelta

import pytest
from helpers import T0, at, chunks, search, searches
from pyspark.sql import functions as F

from mediawatch.functions import text as T
from mediawatch.operators import detail, health, matching, ordered
from mediawatch.sources.transcripts import append_chunks
from mediawatch.streaming import alerts


def spaced(spark, seconds, key=None, gap=60):
    rows = [(key or 1, i, at(s), True) for i, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, "k int, id bigint, ts timestamp_ntz, on boolean")
    kept = ordered.keep_spaced(df, ["k"], "ts", "id", "on", gap).collect()
    return sorted((r["ts"] - T0).total_seconds() for r in kept)


def brute(seconds, gap=60):
    kept = []
    for s in sorted(set(seconds)):
        if not kept or kept[-1] < math.floor(s) - gap:
            kept.append(s)
    return kept


def test_greedy_spacing(spark):
    assert spaced(spark, [0, 30, 90, 100, 200]) == [0, 90, 200]
    assert spaced(spark, [0.5, 60.7]) == [0.5]
    assert spaced(spark, [0, 60]) == [0]
    assert spaced(spark, [0, 61]) == [0, 61]


@pytest.mark.parametrize("group", [64, 2])
def test_greedy_spacing_across_buckets_agrees_with_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(ordered, "GROUP", group)  # 2: buckets, pairs of them and pairs of pairs
    rng = random.Random(7)
    span = 3 * ordered.GAP_BUCKET
    edge = ordered.GAP_BUCKET
    cases = [
        [i * 30 + 0.25 * (i % 4) for i in range(span // 30)],  # a hit in every chunk, for 18 hours
        sorted(round(rng.uniform(edge - 400, edge + 400), 3) for _ in range(120)),
        sorted(round(rng.uniform(0, span), 3) for _ in range(900)),
        [edge - 61, edge - 60.5, edge - 0.001, edge, edge + 0.5, edge + 59.9, edge + 61, edge + 122],
        [k * edge + d for k in (0, 1, 2, 5, 6, 7, 8, 9, 10, 11) for d in (0.5, 30, 59, 61, edge - 40, edge - 1)],
    ]
    rows = [(k, i, at(s), True) for k, c in enumerate(cases) for i, s in enumerate(c)]
    df = spark.createDataFrame(rows, "k int, id bigint, ts timestamp_ntz, on boolean")
    got = {}
    for r in ordered.keep_spaced(df, ["k"], "ts", "id", "on").collect():
        got.setdefault(r["k"], []).append((r["ts"] - T0).total_seconds())
    for k, c in enumerate(cases):
        assert sorted(got[k]) == pytest.approx(brute(c)), k


def test_spacing_off_keeps_every_instant_once(spark):
    df = spark.createDataFrame(
        [(1, 5, at(0), False), (1, 2, at(0), False), (1, 3, at(10), False)], "k int, id bigint, ts timestamp_ntz, on boolean"
    )
    got = sorted((r["ts"], r["id"]) for r in ordered.keep_spaced(df, ["k"], "ts", "id", "on").collect())
    assert got == [(at(0), 2), (at(10), 3)]


def test_neighbours_across_days(spark):
    seconds = [0, 30, 86390, 86400, 5 * 86400]
    df = spark.createDataFrame([(1, at(s)) for s in seconds], "channel_id int, ts timestamp_ntz")
    got = {r["ts"]: (r["prev_ts"], r["next_ts"]) for r in ordered.neighbour_instants(df, ["channel_id"], "ts").collect()}
    times = [at(s) for s in seconds]
    for i, t in enumerate(times):
        assert got[t] == (times[i - 1] if i else None, times[i + 1] if i + 1 < len(times) else None)


def test_asof_carries_over_empty_days(spark):
    left = spark.createDataFrame([(1, at(s)) for s in (5, 10, 3 * 86400)], "k int, t timestamp_ntz")
    right = spark.createDataFrame([(1, at(10), "a"), (1, at(20), "b")], "k int, u timestamp_ntz, v string")
    got = {r["t"]: r["asof"] and r["asof"]["v"] for r in ordered.asof_last(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert got == {at(5): None, at(10): "a", at(3 * 86400): "b"}


def test_silent_neighbour_contributes_nothing(spark):
    c = chunks(spark, [(1, 1, 0, "antes"), (2, 1, 30, "[~]"), (3, 1, 60, "el sol"), (4, 1, 90, "luego")])
    row = matching.backfill(c, searches(spark, search())).first()
    assert (row["prev_text"], row["cur_text"], row["next_text"]) == (None, "el sol", "luego")


def test_media_dates_status_and_flags(spark):
    c = chunks(spark, [(1, 1, 0, "sol"), (2, 27, 0, "sol"), (3, 52, 0, "sol"), (4, 1, 86400, "Sol!"), (5, 1, 2 * 86400, None)])
    from datetime import date

    s = searches(
        spark,
        search(1, media_types=["radio"]),
        search(2, date_end=date(2024, 1, 1), media_types=["tv"]),
        search(3, keywords=["", "zol"], phonetic=True, media_types=["youtube"]),
    )
    got = {(r["search_id"], r["id"]) for r in matching.match_chunks(c, s).collect()}
    assert got == {(1, 2), (2, 1), (3, 3)}
    live = matching.active_searches(searches(spark, search(1), search(2, initialized=False), search(3, status="paused"), search(4, date_end=date(2024, 1, 2))), F.lit("2024-01-03").cast("date"))
    assert [r["search_id"] for r in live.collect()] == [1]


def test_insert_is_idempotent_and_nulls_never_collide(spark):
    rows = [(1, "a", 1, at(0)), (1, "a", 1, at(0)), (1, "a", None, at(0)), (1, "a", None, at(0))]
    df = spark.createDataFrame(rows, "search_id int, keyword string, channel_id int, ts timestamp_ntz")
    first = matching.drop_known(df, df.limit(0))
    assert first.count() == 3
    again = matching.drop_known(df, first)
    assert [r["channel_id"] for r in again.collect()] == [None, None]


def test_caption_first_boundary(spark):
    # the chunk at 100 s is complete at 130 s: captions after 40 s hold it back
    for cc, left in [(41, {2}), (40, {1, 2}), (130, {2}), (131, {1, 2})]:
        c = chunks(spark, [(1, 1, 100, "asr text"), (2, 1, cc, "caption", "cc")])
        assert {r["id"] for r in matching.caption_first(c).collect()} == left, cc


def test_enrich_centres_on_the_current_chunk(spark):
    c = chunks(spark, [(1, 1, 0, "sol sol"), (2, 1, 30, "uno dos sol cuatro"), (3, 1, 60, "fin")])
    m = matching.backfill(c, searches(spark, search())).filter("chunk_id = 2 or cur_text = 'uno dos sol cuatro'")
    assert m.count() == 0  # held back by the first chunk
    off = searches(spark, search(dedup_channel=False))
    row = detail.enrich(matching.backfill(c, off).filter("chunk_id = 2"), off, side=1).first()
    assert row["word_idx"] == 2
    assert row["precise_ts"] == at(30) + timedelta(seconds=int((2.5 / 4) * 30))
    assert row["centered_text"] == "… dos sol cuatro …"
    assert row["channel_kind"] == "tv"


def test_many_keywords_give_the_same_matches(spark, monkeypatch):
    c = chunks(spark, [(i, i % 20 + 1, 60 * i, f"palabra{i} comun sol, x") for i in range(50)])
    s = searches(spark, *[search(i, keywords=[f"palabra{i}", "sol", "x"]) for i in range(30)])
    whole = {tuple(r) for r in matching.match_chunks(c, s).collect()}
    assert {r[2] for r in whole} > {"palabra7", "sol", "x"}
    more = searches(spark, *[search(i, keywords=[f"palabra{i}", "sol", "x"]) for i in range(30)],
                    search(99, keywords=[f"zz{i}q" for i in range(100_000)]))
    assert whole == {tuple(r) for r in matching.match_chunks(c, more).collect()}
    monkeypatch.setattr(matching, "SHIPPED_ROWS", 5)  # beyond the bound texts are read again
    assert whole == {tuple(r) for r in matching.match_chunks(c, s).collect()}


@pytest.mark.parametrize("few,shipped", [(48, 500_000), (0, 500_000), (0, 0)])
def test_keywords_meet_texts_as_by_trying_all(spark, monkeypatch, few, shipped):
    monkeypatch.setattr(matching, "FEW", few)  # beyond it the texts' grams choose the keywords
    monkeypatch.setattr(matching, "SHIPPED_ROWS", shipped)
    words = ["sol", "so", "s", "ñu", "c++", "la casa", "ción", "a b", " s"]
    texts = ["sol so s", "el sol.", "c++ y c", "acción", "ñu", "la  casa la casa", "la", "", "xsolx a b", "😀 so"]
    c = chunks(spark, [(i, 1, 60 * i, t) for i, t in enumerate(texts)])
    for whole in (False, True):
        s = searches(spark, search(1, keywords=words, whole_word=whole, dedup_channel=False))
        rows = [(r["keyword"], r["id"]) for r in matching.match_chunks(c, s).collect()]
        got = set(rows)
        assert len(rows) == len(got)
        norm = lambda t: t.replace("ó", "o").replace("ñ", "n")
        edge = r"(?<!\w){}(?!\w)" if whole else "{}"
        want = {(w, i) for w in words for i, t in enumerate(texts) if t and re.search(edge.format(re.escape(norm(w))), norm(t))}
        assert got == want


def test_match_plan_reads_chunks_once_without_shuffle(spark, tmp_path):
    path = str(tmp_path / "chunks")
    chunks(spark, [(1, 1, 0, "sol")]).write.parquet(path)
    df = matching.match_chunks(spark.read.parquet(path), searches(spark, search()))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count(f"file:{path}"[:60]) == 1
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not moved


def test_reads_by_day_prune_folders(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)  # else the plan cuts a long path short
    path = str(tmp_path / "chunks")
    append_chunks(chunks(spark, [(i, 1, 86400 * i, "sol y luna") for i in range(5)]), path)
    table = spark.read.parquet(path)

    def folders(df):
        scans = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in x and "chunks" in x]
        assert scans and all("PartitionFilters: [isnotnull(date" in x for x in scans), scans

    day = F.lit("2024-01-02").cast("date")
    folders(health.daily_chunks(table, day))
    folders(matching.match_chunks(table, searches(spark, search())))
    folders(alerts.between(table, F.lit(at(0)).cast("timestamp_ntz"), F.lit(at(9)).cast("timestamp_ntz")))
    assert health.daily_chunks(table, day).first()["n_chunks"] == 1
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_context_of_silent_and_repeated_instants(spark):
    c = chunks(spark, [(1, 1, 0, "uno"), (2, 1, 30, "[~]"), (3, 1, 60, "sol"), (4, 1, 60, "otro"), (5, 1, 90, ""), (6, 2, 0, "sol"), (7, 1, 7200, "sol")])
    rows = matching.backfill(c, searches(spark, search(dedup_channel=False))).collect()
    got = {r["chunk_id"]: (r["prev_text"], r["cur_text"], r["next_text"]) for r in rows}
    assert got == {3: (None, "sol", None), 6: (None, "sol", None), 7: (None, "sol", None)}


def test_text_words_survive_extra_spaces(spark):
    df = spark.createDataFrame([("  a  b\n\tc ",)], "s string")
    assert df.select(T.words(F.col("s")).alias("w")).first()["w"] == ["a", "b", "c"]


def test_both_ways_of_looking_up_agree_on_sounds(spark, monkeypatch):
    c = chunks(spark, [(i, 1, 60 * i, t) for i, t in enumerate(["vaca y baca", "hola ola", "queso keso", "ll y yuvia lluvia", "nada"])])
    s = searches(spark, search(1, keywords=["baca", "ola", "keso", "yuvia", "h"], phonetic=True), search(2, keywords=["hola", "ll"]))
    one = sorted(tuple(r) for r in matching.match_chunks(c, s).collect())
    monkeypatch.setattr(matching, "FEW", 0)
    assert sorted(tuple(r) for r in matching.match_chunks(c, s).collect()) == one and len(one) == 6


def test_a_bitmap_too_small_only_lets_more_through(spark, monkeypatch):
    c = chunks(spark, [(i, 1, 60 * i, f"palabra{i} abc xyz") for i in range(30)])
    s = searches(spark, search(1, keywords=[f"palabra{i}" for i in range(0, 30, 2)] + [f"q{i}w" for i in range(90)], dedup_channel=False))
    monkeypatch.setattr(matching, "MOST_BITS", 6)
    got = {(r["keyword"], r["id"]) for r in matching.match_chunks(c, s).collect()}
    assert got == {(k, i) for i in range(30) for k in [f"palabra{j}" for j in range(0, 30, 2)] if k in f"palabra{i} abc"}


def test_the_hits_of_a_chunk_ask_for_its_texts_once(spark, monkeypatch):
    c = chunks(spark, [(i, 1, 30 * i, f"sol mar {i}") for i in range(4)])
    asked = {}

    def counted(df, name):
        out = stored(df, name)
        asked[name] = out.count()
        return out

    stored = matching.stored
    monkeypatch.setattr(matching, "stored", counted)
    off = searches(spark, search(1, ("sol", "mar"), dedup_channel=False), search(2, ("sol",), dedup_channel=False))
    rows = matching.backfill(c, off).collect()
    assert len(rows) == 12 and asked["asked-instants"] == 10  # four chunks, three neighbours before and three after
    for r in rows:
        i = r["chunk_id"]
        want = [f"sol mar {j}" if 0 <= j < 4 else None for j in (i - 1, i, i + 1)]
        assert [r["prev_text"], r["cur_text"], r["next_text"]] == want
