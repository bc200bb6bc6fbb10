import bisect
import random
import zlib
from collections import Counter

import numpy as np
import odd
import public_tokenizers
import pytest
from mediawatch.llm import packing as P
from tokenizers import Tokenizer


def test_fillings_use_every_piece_once_and_fit():
    draw = random.Random(5)
    for _ in range(20):
        counts = Counter(draw.randint(1, 64) for _ in range(draw.randint(0, 400)))
        plan = P.fillings(counts, 64)
        used = Counter()
        for own, times in plan:
            assert sum(own) <= 64
            for n in own:
                used[n] += times
        assert used == counts
        total = sum(n * c for n, c in counts.items())
        assert sum(t for _, t in plan) <= -(-total // 64) * 1.25 + 1


def test_the_smallest_piece_gives_way_to_a_better_pair():
    # greedy: 60 + 25, nothing fits in the other 15; 25 gives way to 20 + 19
    assert P.best_pair([19, 20, 25], Counter({19: 1, 20: 1, 25: 1}), 40, 25) == (20, 19)
    assert P.fillings({60: 1, 25: 1, 20: 1, 19: 1}, 100)[0][0] == [60, 20, 19]


def best_fit_decreasing(counts, capacity):
    rooms, n = [], 0
    for length in sorted(counts.elements(), reverse=True):
        at = bisect.bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms.pop(at)
        else:
            room, n = capacity, n + 1
        if room > length:
            bisect.insort(rooms, room - length)
    return n


def test_no_more_sequences_than_best_fit_decreasing():
    draw = random.Random(7)
    fewer = 0
    for i in range(50):
        low, high, capacity = [(1, 1023, 1024), (1, 700, 1024), (200, 600, 1024), (1, 64, 64), (10, 30, 64)][i % 5]
        counts = Counter(draw.randint(low, high) for _ in range(draw.randint(10, 2000)))
        plan = P.planned(counts, capacity)
        used = Counter()
        for own, times in plan:
            assert sum(own) <= capacity
            for n in own:
                used[n] += times
        assert used == counts
        n, plain = sum(times for _, times in plan), best_fit_decreasing(counts, capacity)
        assert n <= plain
        fewer += n < plain
    assert fewer >= 10


def test_cuts():
    assert P.cuts(10, 4) == [(0, 2), (2, 6), (6, 10)]
    assert P.cuts(8, 4) == [(0, 4), (4, 8)]
    assert P.cuts(3, 4) == [(0, 3)]


def test_ids_are_those_of_the_tokenizer_file():
    whole, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), P.Encoder()
    texts = ["", " ", "a\n\n b", "Ñandú's 12 éà 日本 ​\U0001f600", "x" * 5000, "a<|endoftext|>b", odd.LONG, "\t\r\n \n"]
    for t in texts:
        assert encode(t) == whole.encode(t, add_special_tokens=False).ids


def test_every_piece_has_a_place(spark):
    docs = odd.documents(spark)
    got = [r.asDict() for r in P.pack_documents(docs, with_ids=True).collect()]
    encode = P.Encoder()
    want = Counter()
    for r in docs.collect():
        ids = [*encode(r["text"] or ""), 2]
        for piece, (a, b) in enumerate(P.cuts(len(ids), 1024)):
            want[r["doc_id"], piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at and len(r["ids"]) == r["length"]
            at += r["length"]
        assert at <= 1024
    assert P.pack_documents(odd.empty(spark)).count() == 0


def test_pack_keeps_clashing_columns_and_refuses_odd_lengths(spark):
    rows = spark.createDataFrame([(5, "a", 1), (5, "b", 2), (3, "c", 3), (8, "d", 4)], "length long, _low string, offset int")
    got = P.pack(rows, 8).collect()
    assert {r["_low"] for r in got} == {"a", "b", "c", "d"} and len({r["sequence_id"] for r in got}) == 3
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame([(9,)], "length long"), 8)
