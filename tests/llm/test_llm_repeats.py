import hashlib
import random
from collections import Counter

import numpy as np
import odd
import pytest
from mediawatch.llm import repeats as R


def brute(texts, length):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def removed(df, **how):
    rows = sorted(R.without_repeats(df, **how).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    return [(r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows]


@pytest.mark.parametrize("length, anchor, most, seed", [(40, 13, 2048, 1), (24, 9, 8, 2)])
def test_equals_all_windows(spark, length, anchor, most, seed):
    draw = random.Random(seed)
    base = ["".join(draw.choice("ab") for _ in range(draw.randint(0, 60))) for _ in range(25)]
    texts = ["".join(draw.choice(base) for _ in range(draw.randint(0, 4))) for _ in range(50)]
    texts += [None, "", "abc" * 40, "a" * 300, "a" * 100 + "é" + "a" * 100, texts[0], "é" * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    assert removed(df, length=length, anchor=anchor, most=most) == brute(texts, length)


def test_intervals_are_the_common_prefixes():
    words = sorted(["aa", "aab", "aac", "ab", "b", "ba"])
    shared = [R.common(a.encode(), b.encode()) for a, b in zip(words, words[1:])]
    got = {(d, tuple(words[a : b + 1])) for d, a, b in R.intervals(shared)}
    assert (2, ("aa", "aab", "aac")) in got and (1, ("aa", "aab", "aac", "ab")) in got and (1, ("b", "ba")) in got
    assert (0, tuple(words)) in got


def test_chunks_of_a_long_text_agree(monkeypatch):
    draw = random.Random(4)
    text = bytes(draw.choice(b"abcd") for _ in range(3000))
    whole = R.Sampler(40, 13)(text)
    monkeypatch.setattr(R, "CHUNK", 128)
    cut = R.Sampler(40, 13)(text)
    assert all((a == b).all() for a, b in zip(whole, cut))


def test_odd_rows(spark):
    docs = odd.documents(spark)
    texts = [r["text"] for r in docs.collect()]
    order = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert Counter(removed(docs)) == Counter(brute([r["text"] for r in order], 400)) and len(texts) == len(order)
    assert R.without_repeats(odd.empty(spark)).count() == 0


def test_planted_passages_go_from_400_bytes_on(spark):
    """Passages of over 50 words, each in three documents between neighbours of their own: bytes decide, not words."""
    draw = random.Random(11)
    words = lambda n: " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(n))
    sizes = [310, 350, 398, 399, 400, 401, 450, 900]
    texts, want = [words(draw.randint(0, 300)) for _ in range(20)], [0] * 20
    for size in sizes:
        passage = words(size)[:size]
        assert len(passage.split()) > 50
        for edge in "-.;":
            texts.append(words(draw.randint(0, 200)) + edge + passage + edge + words(draw.randint(0, 200)))
            want.append(size if size >= 400 else 0)
    got = removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2))
    assert got == brute(texts, 400)
    assert [(n, gone, runs) for n, gone, runs, _ in got] == [(len(t), w, int(w > 0)) for t, w in zip(texts, want)]


def test_a_large_group_is_divided_in_few_rounds(spark, monkeypatch):
    """Runs of one word that stop at different places: the members of the group differ at every byte."""
    draw = random.Random(5)
    texts = [f"{n % 7}" * (n % 5) + "the " * draw.randint(12, 40) + "," * (n % 3) + "the " * (n % 23) for n in range(120)]
    rounds, kept = [], R.stored
    monkeypatch.setattr(R, "stored", lambda df, name: [rounds.append(name), kept(df, name)][1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    real = R.grouped
    monkeypatch.setattr(R, "grouped", lambda rows, length: [pytest.fail("more rounds than cuts") if rounds.count("large-groups") > 4 else None, real(rows, length)][1])
    assert removed(df, length=64, anchor=16, most=4) == brute(texts, 64)
    assert 1 < rounds.count("large-groups") <= 4  # 49 places, then 7, then 1


def test_members_are_compared_a_few_times_however_deep_the_intervals(monkeypatch):
    n, calls, real = 2000, [], R.common
    monkeypatch.setattr(R, "common", lambda a, b: [calls.append(1), real(a, b)][1])
    draw = random.Random(6)
    words = [b"".join(draw.choice([b"a", b"b"]) for _ in range(30)) for _ in range(n)]
    contexts = [(w + b"x" * (40 + i % 200) + b"%d" % i, 30) for i, w in enumerate(words)]
    got = R.extents(contexts, 60)
    assert len(calls) < 40 * n
    for i in draw.sample(range(n), 25):
        pairs = [(real(words[i][::-1], w[::-1]), real(contexts[i][0][30:], c[0][30:])) for j, (w, c) in enumerate(zip(words, contexts)) if j != i]
        good = [(a, b) for a, b in pairs if a + b >= 60]
        assert got[i] == (max((a for a, _ in good), default=0), max((b for _, b in good), default=0))
