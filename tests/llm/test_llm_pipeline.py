"""The pipeline against plain versions of its stages on the smallest tables."""

import re
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline as P
from mediawatch.llm import near_copies, packing

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not mounted")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(P.stored(stage(spark, out[-1], SF), name))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "packing"]
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns


def test_language_stage_keeps_what_has_letters(steps):
    before, after = rows(steps[0]), rows(steps[1])
    assert set(after) == {i for i, r in before.items() if r["text"] and re.search(r"[^\W\d_]", r["text"])}


def test_line_stage_drops_templates_of_many_documents(steps):
    before, after = rows(steps[1]), rows(steps[2])
    assert set(before) == set(after)
    held = {}
    for i, r in before.items():
        for line in set(r["text"].split("\n")):
            held.setdefault(line, set()).add(i)
    dropped = 0
    for i, r in before.items():
        kept = Counter(after[i]["text"].split("\n"))
        gone = Counter(r["text"].split("\n")) - kept
        for line in gone:
            dropped += 1
            # without digits and with every token in five documents, a line is its own template
            assert not line.strip() or min(held[line]) != i or re.search("[0-9]", line)
    assert dropped and any(len(ids) >= 5 for ids in held.values())
    for line, ids in held.items():
        if len(ids) >= 5 and line.strip():
            assert all(line not in after[i]["text"].split("\n") for i in ids - {min(ids)}), line


def test_near_copy_stage_keeps_the_lowest_of_each_group(steps):
    before = [(i, set(near_copies.shingle_set(r["text"]).tolist())) for i, r in sorted(rows(steps[2]).items())]
    group = {i: i for i, _ in before}
    for a, x in before:
        for b, y in before:
            if b < a and 5 * len(x & y) >= 4 * len(x | y) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    assert set(rows(steps[3])) == set(group.values()) and len(set(group.values())) < len(group)


def test_decontamination_stage_drops_documents_with_an_item(spark, steps):
    def shingles(text):
        w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    items = [shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = rows(steps[3])
    bad = {i for i, r in before.items() if any(5 * len(s & shingles(r["text"])) >= 4 * len(s) for s in items if s)}
    assert bad and set(rows(steps[4])) == set(before) - bad


def test_packing_stage_places_every_token(steps):
    before, got = rows(steps[4]), steps[5].collect()
    encode = packing.Encoder()
    sizes = {i: len(encode(r["text"] or "")) + 1 for i, r in before.items()}
    assert Counter({i: n for i, n in sizes.items()}) == sum((Counter({r["doc_id"]: r["length"]}) for r in got), Counter())
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        ends = [0]
        for offset, length in sorted(own):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 1024
    assert len(places) <= 1.02 * sum(sizes.values()) / 1024 + 2


def test_run_equals_the_stages(spark, steps):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert {tuple(r) for r in P.run(spark, SF).select(*key).collect()} == {tuple(r) for r in steps[5].select(*key).collect()}
