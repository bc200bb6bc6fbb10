import random
from datetime import datetime, timedelta

import pytest
from helpers import T0, at, chunks
from pyspark.sql import functions as F

from mediawatch.operators import blocks, recordings


def files(spark, rows):
    """rows: (folder, start minute or None, ext, duration, length)"""
    out = []
    for i, (folder, minute, ext, dur, length) in enumerate(rows):
        name = (T0 + timedelta(minutes=minute)).strftime("x_%Y-%m-%d_%H-%M") if minute is not None else f"odd{i}"
        out.append((f"{folder}/{name}.{ext}", length, at(60 * (minute or 0) + i), dur))
    df = spark.createDataFrame(out, "path string, length bigint, modified timestamp_ntz, duration_sec double")
    return recordings.parse_segments(df)


def test_names(spark):
    df = files(spark, [("out/canal_04_N_", 90, "ts", None, 1), ("other", None, "mkv", None, 1)])
    a, b = df.orderBy("path").collect()[::-1] if df.first()["path"].startswith("other") else df.collect()
    assert (a["folder"], a["channel_id"], a["safe_channel"], a["start_ts"], a["ext"]) == ("out/canal_04_N_", 4, "N_", datetime(2024, 1, 1, 1, 30), "ts")
    assert b["start_ts"] is None and b["channel_id"] is None


def py_at(segs, moment):
    last = None
    for s in segs:
        if s[0] <= moment:
            last = s
    if last is None or (last[2] and moment - last[0] >= last[2]):
        return None
    return last


def py_clip(segs, moment):
    cur, end, pieces = moment - 10, moment + 10, []
    for _ in range(4):
        if cur >= end:
            break
        on = py_at(segs, cur)
        if on is None:
            later = [s[0] for s in segs if s[0] > cur]
            if not later or later[0] >= end:
                break
            cur = later[0]
            continue
        stop = min(end, on[0] + on[2]) if on[2] else end
        pieces.append((on[1], cur - on[0], stop - cur))
        cur = stop
    return pieces


def test_segment_at_and_clips_agree_with_a_walk(spark):
    rng = random.Random(11)
    rows, segs = [], {}
    for ch in range(1, 7):
        minutes = sorted(rng.sample(range(0, 3000), 25) + [10, 11, 12])
        own = []
        for m in sorted(set(minutes)):
            dur = rng.choice([None, 55.0, 65.0, 60.0, 1800.0, 5.0])
            rows.append((f"canal_{ch:02d}_c{ch}", m, "ts", dur, 1))
            own.append((m * 60, f"canal_{ch:02d}_c{ch}/" + (T0 + timedelta(minutes=m)).strftime("x_%Y-%m-%d_%H-%M.ts"), dur or 0))
        segs[f"c{ch}"] = own
    moments = []
    for ch, own in segs.items():
        for s in own:
            for d in (-12, -10, -3, 0, 4, 52, 58, 61, 70):
                moments.append((len(moments), ch, s[0] + d))
    df = spark.createDataFrame([(i, c, at(t)) for i, c, t in moments], "id int, safe_channel string, ts timestamp_ntz")
    parsed = files(spark, rows).cache()
    seen = {r["id"]: (r["path"], r["offset_sec"]) for r in recordings.segment_at(df, parsed).collect()}
    plan = {}
    for r in recordings.clip_plan(df, parsed, "id").orderBy("id", "piece").collect():
        plan.setdefault(r["id"], []).append((r["path"], r["offset_sec"], r["length_sec"]))
    for i, ch, t in moments:
        on = py_at(segs[ch], t)
        assert seen.get(i) == ((on[1], float(t - on[0])) if on else None)
        assert plan.get(i, []) == [(p, pytest.approx(o), pytest.approx(n)) for p, o, n in py_clip(segs[ch], t)]


def test_retention_takes_the_oldest_and_undated_last(spark):
    df = files(spark, [("canal_01_a", None, "ts", None, 5), ("canal_01_a", 10, "ts", None, 3), ("canal_02_b", 5, "mp4", None, 4)])
    def plan(target):
        return [r["length"] for r in recordings.retention_plan(df, 0, target).orderBy("freed_before").collect()]
    assert plan(0) == [] and plan(4) == [4] and plan(5) == [4, 3] and plan(8) == [4, 3, 5]


def test_finalise_age_and_preference(spark):
    df = files(spark, [("canal_01_a", 0, "ts", None, 1), ("canal_01_a", 30, "mkv", None, 1), ("canal_01_a", 0, "mp4", None, 1), ("misc", 1, "ts", None, 1)])
    assert [r["path"] for r in recordings.finalize_plan(df).collect()] == ["canal_01_a/x_2024-01-01_00-00.ts"]
    assert sorted(r["ext"] for r in recordings.preferred_files(df.filter("channel_id = 1")).collect()) == ["mkv", "mp4"]
    now = F.lit("2024-01-04 00:00:10").cast("timestamp_ntz")
    assert recordings.aged_files(df, now, 2).count() == 1


def test_block_files(spark, tmp_path):
    progs = spark.createDataFrame([("ch01", at(0), at(3600), "Noticias", "g")], "channel_name string, start_ts timestamp_ntz, stop_ts timestamp_ntz, title string, source string")
    c = chunks(spark, [(1, 1, 60, "uno"), (2, 1, 30, "dos"), (3, 1, 1800, "tres"), (4, 1, 90, "[~]")])
    out = str(tmp_path / "txt")
    blocks.write_lines(blocks.text_lines(c, progs), out)
    text = spark.read.text(f"{out}/window=2024-01-01_00-00_00-30/channel=canal_01_ch01")
    lines = [r["value"] for r in text.collect()]
    assert lines[0] == "# [EPG] Noticias"
    assert lines[1] == "# Bloque: 2024-01-01 00:00:00 → 2024-01-01 00:30:00"
    assert lines[3:] == ["[2024-01-01 00:00:30.000 → 00:01:00.000] dos", "[2024-01-01 00:01:00.000 → 00:01:30.000] uno"]
    srt = [r["line"] for r in blocks.srt_lines(c).orderBy("window", "pos").collect()]
    assert srt[0] == "1\n00:00:30,000 --> 00:01:00,000\ndos\n"
    assert srt[2] == "1\n00:00:00,000 --> 00:00:30,000\ntres\n"
