"""The numbered queries that SQL can express, and the contract of the others' results."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not mounted")


@pytest.mark.parametrize("name", ["op1_line_templates", "op4_decontamination", "op7_threshold_topk"])
def test_agrees_with_sql(spark, name):
    ok, note = compare.compare(spark, compare.duck(SF), SF, name)
    assert ok, note
    assert "types(" not in note, note


def test_every_numbered_query_is_registered():
    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
