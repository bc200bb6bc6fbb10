import random
import zlib
from collections import Counter

import numpy as np
import odd
import pytest
from mediawatch.llm import sharding, topk


def brute(rows, k, every):
    usable = [
        (i, [int(np.floor(64 * float(x))) for x in v], n)
        for n, (i, v) in enumerate(rows)
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i, v, n in usable:
        if i % every == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in usable if m != n and len(w) == len(v))
            out += [(i, rank + 1, j, -s) for rank, (s, j, _) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("slices", [1, 3])
def test_search_equals_all_scores(spark, slices):
    draw = random.Random(3)
    pick = lambda: draw.choice([0.0, 1.0, -1.5, None if draw.random() < 0.02 else 2.0, float("nan") if draw.random() < 0.02 else 0.3])
    rows = [
        (draw.choice([0, 20, 40, -20, 7, None]) if draw.random() < 0.3 else i, None if draw.random() < 0.05 else [pick() for _ in range(draw.choice([3, 3, 4, 0]))])
        for i in range(120)
    ]
    rows += [(60, [1e13, 1.0, 2.0]), (61, [1.0, 3.0, 4.0]), (62, [float("inf"), 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, score int, _row string").coalesce(2)
    got = sorted(tuple(r) for r in topk.top_k(df, k=5, slices=slices).collect())
    assert got == brute(rows, 5, 20)


def test_search_without_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df).count() == 0
    one = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one).count() == 0


def test_shards_are_gapless_and_hold_the_key_law(spark):
    docs = odd.documents(spark)
    got = sharding.shard_documents(docs, parts=3).collect()
    want = Counter(
        (r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()
    )
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert len({(r["doc_id"], r["shard"], r["grown_shard"]) for r in got}) == len({r["doc_id"] for r in got})
    assert sharding.shard_documents(odd.empty(spark)).count() == 0


def test_one_more_shard_takes_rows_only_into_itself(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "cast(doc_id as string) text")
    got = sharding.shard_documents(df).collect()
    moved = [r for r in got if r["shard"] != r["grown_shard"]]
    assert {r["grown_shard"] for r in moved} == {24} and 600 < len(moved) < 1000
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) < 1.15 * 20_000 / 24


def test_weights_set_the_share(spark):
    df = sharding.assign(spark.range(30_000), "id", [1.0, 2.0, 0.0, 3.0])
    sizes = {r["shard"]: r["count"] for r in df.groupBy("shard").count().collect()}
    assert 2 not in sizes and abs(sizes[3] - 15_000) < 600 and abs(sizes[0] - 5_000) < 400
    heavier = sharding.assign(df, "id", [1.0, 2.5, 0.0, 3.0], "after")
    assert {r["after"] for r in heavier.filter("shard <> after").select("after").distinct().collect()} == {1}


def test_copies_of_one_row_are_dealt_in_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 4)
    df = spark.createDataFrame([(1, "a")] * 11 + [(2, "b")] * 3, "doc_id long, text string")
    got = sharding.shard_documents(df, shards=1).collect()
    assert sorted(r["slot"] for r in got) == list(range(14))


def plan_nodes(node):
    yield node
    inner = [node.initialPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.children().apply(i) for i in range(node.children().size())]
    for x in inner:
        yield from plan_nodes(x)


def test_blocks_are_never_broadcast(spark, monkeypatch):
    """Every plan of the search, also if all tables are small enough for Spark to broadcast them by their files."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    sent, kept = [], topk.stored

    def looked_at(df):
        for x in plan_nodes(df._jdf.queryExecution().executedPlan()):
            if "BroadcastExchange" in x.nodeName():
                sent.extend(c.simpleString() for c in [x.output().apply(i).dataType() for i in range(x.output().size())])
        return df

    monkeypatch.setattr(topk, "stored", lambda df, name: kept(looked_at(df), name))
    df = spark.createDataFrame([(i, [i % 5 - 2.0, i % 3 * 1.0, 1.0]) for i in range(200)], "vec_id long, embedding array<double>")
    assert looked_at(topk.top_k(df.coalesce(2), k=3)).count() == 30
    assert "binary" not in sent


def test_many_cells_equal_all_scores(spark, monkeypatch):
    for name, size in (("BLOCK", 16), ("QUERIES", 4), ("SHELF", 2), ("CELLS", 64)):
        monkeypatch.setattr(topk, name, size)
    draw = random.Random(9)
    size = lambda i: 10.0 ** (i % 4 * 3)  # noqa: E731  one, two, four and eight bytes a component
    rows = [(2 * i, [draw.randint(-9, 9) * size(i) for _ in range(3 + i % 2)]) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(3)
    assert sorted(tuple(r) for r in topk.top_k(df, k=4).collect()) == brute(rows, 4, 20)


def test_components_are_kept_in_as_few_bytes_as_they_need():
    for kind in topk.KINDS:
        table = np.array([[np.iinfo(kind).min, 0, 1], [np.iinfo(kind).max, -1, 2]], dtype=np.int64)
        assert (topk.table_of(table.astype(kind).tobytes(), 2, 3) == table).all()
    assert topk.table_of(b"", 2, 0).shape == (2, 0)
