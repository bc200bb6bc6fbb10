import random
import re

import numpy as np
import odd
import xxhash
from mediawatch.llm import simhash as S


def plain(text, words=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fps, radius=3):
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [min((x for x, g in zip(ids, group) if g == own and x is not None), default=None) for own in group]


def test_some_table_covers_every_difference():
    masks = S.covering_masks(3)
    assert len(masks) == 15
    draw = random.Random(1)
    for _ in range(5000):
        bits = sum(1 << b for b in draw.sample(range(64), 3))
        assert any(not bits & m for m in masks)


def test_fingerprints_follow_the_definition():
    for t in [*odd.TEXTS, "A B c", "ÀB\x0bc\x85d e f", "É é"]:
        if t is not odd.LONG:
            assert S.simhash(t) == plain(t)


def test_groups_equal_all_pairs(spark):
    docs = odd.documents(spark)
    got = S.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    ids = [r["doc_id"] for r in got]
    fps = [r["fp"] & (2**64 - 1) for r in got]
    assert [r["component_id"] for r in got] == components(ids, fps)
    assert S.near_duplicates(odd.empty(spark)).count() == 0
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["component_id"] for r in got} | {None}


def test_tiled_buckets_lose_no_link(spark):
    draw = random.Random(3)
    centres = [draw.getrandbits(64) for _ in range(6)]
    fps = list({c ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 3))) for c in centres for _ in range(40)})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    links = {(r["a"], r["b"]) for r in S.near_links(df, tile=8).collect()}
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 64 for a, b in links)
    group = {f: f for f in (r["fp"] for r in df.collect())}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in links:
        group[root(a)] = root(b)
    ids = sorted(group)
    want = components(ids, [i & (2**64 - 1) for i in ids])
    lowest = {}
    for i in ids:
        lowest[root(i)] = min(lowest.get(root(i), i), i)
    assert [lowest[root(i)] for i in ids] == want
