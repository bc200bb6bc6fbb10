"""The driver contract, and a few registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import compare

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not mounted")


def test_flagship_has_rows_and_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["match_id", "search_id", "keyword"]


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    "name",
    ["keyword_matches", "match_dedup", "match_enriched", "programme_at", "export_rows", "chat_report_blocks",
     "channel_integrity", "caption_first", "spot_components", "question_hits", "clip_plan", "retention_plan"],
)
def test_agrees_with_sql(spark, name):
    ok, note = compare.compare(spark, compare.duck(SF), SF, name)
    assert ok, note
    assert "types(" not in note, note
