"""Spots kept from day to day equal one run over all matches."""

import random

import pytest
from helpers import at, chunks, search, searches

from mediawatch.operators import matching, similarity
from mediawatch.sources import spots


def campaign(draw, n):
    """Texts alone on their channels: some ads with small changes, some that share an ad's end with another's start, and noise."""
    word = lambda: f"w{draw.randrange(4000)}"
    ads = [[word() for _ in range(40)] for _ in range(4)]
    ads.append(ads[0][:20] + ads[1][20:])
    rows = []
    for i in range(n):
        kind = draw.randrange(7)
        words = list(ads[kind]) if kind < 5 else [word() for _ in range(30)]
        for _ in range(draw.choice([0, 0, 1, 3])):
            words[draw.randrange(len(words))] = word()
        rows.append((i, 1 + i, 3600.0 * (i // 9) + i, " ".join(words[:20] + ["sol"] * draw.choice([0, 1, 1]) + words[20:] + ["sol"])))
    return rows


def spots_of(members):
    report = similarity.cluster_report(members)
    return (
        {(r["search_id"], r["cluster_id"], r["match_id"]) for r in members.collect()},
        {(r["search_id"], r["cluster_id"], r["size"], r["common_fragment"]) for r in report.collect()},
    )


@pytest.mark.parametrize("seed", [4])
def test_daily_additions_equal_one_run(spark, tmp_path, seed):
    draw, path = random.Random(seed), str(tmp_path / "spots")
    rows = campaign(draw, 90)
    s = searches(spark, search(1, dedup_channel=False), search(2, keywords=["sol"], dedup_channel=False))
    found = lambda part: matching.backfill(chunks(spark, part), s)
    draw.shuffle(rows)  # a later day's match may have the lower id, and join two old spots
    for part in (rows[:30], rows[30:60], rows[30:60], rows[60:]):
        spots.add_matches(found(part), path)
    want = spots_of(similarity.cluster_members(similarity.windows(found(rows))))
    assert spots_of(spots.read_members(spark, path)) == want and len(want[1]) >= 4
    # an edited search is scanned anew; the other one keeps its spots
    fewer = [r for r in rows if r[0] % 3]
    spots.replace_searches(found(fewer), s.filter("search_id = 2"), path)
    members, report = spots_of(spots.read_members(spark, path))
    only = spots_of(similarity.cluster_members(similarity.windows(found(fewer).filter("search_id = 2"))))
    assert {m for m in members if m[0] == 1} == {m for m in want[0] if m[0] == 1}
    assert {m for m in members if m[0] == 2} == only[0] and {r for r in report if r[0] == 2} == only[1]


def test_only_touched_spots_are_scored_again(spark, tmp_path):
    path = str(tmp_path / "spots")
    text = lambda k: " ".join(f"{k}{i}" for i in range(12)) + " sol " + " ".join(f"{k}{i}" for i in range(20, 30))
    s = searches(spark, search(1, dedup_channel=False))
    found = lambda part: matching.backfill(chunks(spark, part), s)
    first = [(i, 1 + i, 60.0 * i, text("ab"[i % 2])) for i in range(6)]
    assert spots.add_matches(found(first), path).count() == 2
    assert spots.add_matches(found([(9, 9, 0.0, text("a")), (10, 10, 0.0, text("c"))]), path).count() == 1
    assert spots.add_matches(found([(11, 11, 0.0, "sol y nada")]), path).count() == 0
    assert sorted(r["size"] for r in similarity.cluster_report(spots.read_members(spark, path)).collect()) == [3, 4]
    assert spots.read_members(spark, str(tmp_path / "none")).count() == 0 and at(0)
