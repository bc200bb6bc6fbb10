import random

import numpy as np
import pytest
from mediawatch.llm import negatives


def whole(v):
    return [int(np.floor(256 * float(x))) for x in v]


def brute(rows, every=50):
    usable = [
        (n, i, (label + 1) % 10 if i % 7 == 0 else label, whole(v)) for n, (i, v, label) in enumerate(rows)
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for n, i, label, v in usable:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m, l) for m, j, l, w in usable if m != n and len(w) == len(v))
        for p, pid, _, _ in [s for s in scored if s[3] == label][:5]:
            near = [s for s in scored if s[3] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(i, pid, rank + 1, s[1], -p, -s[0]) for rank, s in enumerate(near)]
    return sorted(out)


def table(spark, rows, parts=2):
    return spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, score int, _row string"
    ).repartition(parts)


@pytest.mark.parametrize("block,anchors", [(4096, 512), (7, 3)])
def test_negatives_equal_all_scores(spark, monkeypatch, block, anchors):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    draw = random.Random(11)
    rows = []
    for i in range(260):
        size = draw.choice([12, 12, 12, 3, 0])
        v = [draw.choice([0.0, 0.5, -0.25, draw.gauss(0.2, 1)]) for _ in range(size)]
        odd_one = draw.random()
        if odd_one < 0.06:
            v = draw.choice([None, [None, *v], [float("nan"), *v], [float("inf"), *v]])
        i = draw.choice([0, 50, 100, 350, -50, None, 7]) if draw.random() < 0.25 else i
        rows.append((i, v, None if draw.random() < 0.03 else draw.randrange(3)))
    rows += [rows[3], rows[3], (50, [1.0] * 12, 1), (50, [1.0] * 12, 1)]
    got = sorted(tuple(r) for r in negatives.hard_negatives(table(spark, rows)).collect())
    assert got == brute(rows) and len(got) > 60


def test_ties_and_many_copies_of_one_vector(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 32)
    one = [0.5, 0.25, -0.5, 1.0]
    rows = [(i, one, i % 2) for i in range(150)] + [(200 + i, [0.4 + i / 1000, 0.25, -0.5, 1.0], 5) for i in range(40)]
    got = sorted(tuple(r) for r in negatives.hard_negatives(table(spark, rows, 5)).collect())
    assert got == brute(rows)


def test_scores_past_doubles_are_exact(spark):
    draw = random.Random(4)
    rows = [(i, [draw.choice([1, 3]) * 4e5 + draw.randrange(50) / 256 for _ in range(6)], i % 3) for i in range(120)]
    got = sorted(tuple(r) for r in negatives.hard_negatives(table(spark, rows)).collect())
    assert got == brute(rows) and len(got) > 5 and max(r[4] for r in got) > 2**53


def test_scan_drops_only_what_cannot_be_in_a_window():
    draw = np.random.default_rng(1)
    columns = draw.integers(-300, 300, (40, 500)).astype(float)
    for _ in range(20):
        q = (draw.normal(0, 100, 40) * draw.random(40) ** 4).astype(int).astype(float)
        exact = q @ columns
        top = exact.max()
        windows = np.array([[top * 0.3, top * 0.6], [top * 0.5, top * 0.9], [-5.0, 5.0]])
        at, score = negatives.scan(q, columns, columns.min(axis=1), columns.max(axis=1), np.arange(500), windows, [-np.inf] * 3, 3)
        assert (score == exact[at]).all() and len(at) < 250
        for low, high in windows:
            want = [c for c in np.argsort(-exact, kind="stable") if low <= exact[c] <= high][:3]
            assert set(want) <= set(at)


def test_empty_tables_and_anchors_without_partners(spark):
    assert negatives.hard_negatives(table(spark, [])).count() == 0
    assert negatives.hard_negatives(table(spark, [(50, [1.0], 1)])).count() == 0
    assert negatives.hard_negatives(table(spark, [(50, [1.0], 1), (51, [1.0], 1), (52, [-1.0], 2)])).count() == 0
