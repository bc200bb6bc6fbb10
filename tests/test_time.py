from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mediawatch.functions import timefn as M


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def ts(s):
    return F.lit(s).cast("timestamp_ntz")


def test_precise_timestamp(spark):
    at = ts("2024-01-01 10:00:00.750")
    assert one(spark, M.precise_timestamp(ts("2024-01-01 10:00:00"), F.lit(0), F.lit(1))) == datetime(2024, 1, 1, 10, 0, 15)
    assert one(spark, M.precise_timestamp(at, F.lit(None).cast("int"), F.lit(5))) == datetime(2024, 1, 1, 10, 0, 0, 750000)


def test_srt_and_timecodes(spark):
    assert one(spark, M.srt_time(F.lit(-1))) == "00:00:00,000"
    assert one(spark, M.srt_time(F.lit(3723004))) == "01:02:03,004"
    for line, secs in [
        ("00:00:01,000 --> 00:00:03,500", 2.5),
        ("00:00:03,000 --> 00:00:01,000", 0.0),
        ("bad --> 00:00:01,000", 0.0),
        ("no arrow", 0.0),
    ]:
        assert one(spark, M.caption_duration(F.lit(line))) == secs


@pytest.mark.parametrize(
    "channel,kind", [(None, "tv"), (26, "tv"), (27, "radio"), (51, "radio"), (52, "youtube"), (9001, "news")]
)
def test_media_type(spark, channel, kind):
    assert one(spark, M.media_type(F.lit(channel).cast("int"))) == kind


def test_blocks_and_guide_times(spark):
    at = ts("2024-01-01 10:44:59.250")
    assert one(spark, M.block_start(at)) == datetime(2024, 1, 1, 10, 30)
    assert one(spark, M.block_end(at)) == datetime(2024, 1, 1, 11, 0)
    assert one(spark, M.parse_guide_ts(F.lit("20260418103001 -0600"), "America/Mexico_City")) == datetime(2026, 4, 18, 10, 30, 1)
    assert one(spark, M.parse_guide_ts(F.lit("20260418103001"))) == datetime(2026, 4, 18, 10, 30, 1)
    assert one(spark, M.parse_guide_ts(F.lit("soon"))) is None
    assert one(spark, M.parse_guide_ts(F.lit("20261399103001"))) is None


def test_bands_and_percentages(spark):
    assert [one(spark, M.heartbeat_band(F.lit(a))) for a in (60, 61, 180, 181)] == ["ok", "slow", "slow", "zombie"]
    assert [one(spark, M.freshness_band(F.lit(a))) for a in (59, 60, 300)] == ["fresh", "late", "old"]
    assert [one(spark, M.stability_pct(F.lit(r))) for r in (0.0, 1.5, 6.0, 9.0)] == [100, 75, 0, 0]
    assert one(spark, M.progress_pct(F.lit(1), F.lit(8), F.lit(True))) == 12  # half to even
    assert one(spark, M.progress_pct(F.lit(0), F.lit(0), F.lit(True))) == 100
    assert one(spark, M.progress_pct(F.lit(0), F.lit(0))) == 0
    assert one(spark, M.fluency_pct(F.lit(3))) == 1.0
    assert one(spark, M.in_pause_window(ts("2024-01-01 05:29:00"))) is True
    assert one(spark, M.in_pause_window(ts("2024-01-01 05:30:00"))) is False
    assert one(spark, M.in_pause_window(ts("2024-01-01 23:30:00"), 1380, 60)) is True
    assert one(spark, M.range_cutoff(F.lit("7d"), ts("2024-01-10 08:00:00.5"))) == datetime(2024, 1, 3, 8, 0)
    assert one(spark, M.range_cutoff(F.lit("all"), ts("2024-01-10 08:00:00"))) is None
