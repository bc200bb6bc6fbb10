import random

import odd
import corpus_pipeline as P
from mediawatch.llm import near_copies as N
from mediawatch.llm import simhash
from pyspark.sql import functions as F


def jaccard(a, b):
    a, b = (set(N.shingle_set(t).tolist()) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def lowest(rows, least=0.8):
    """Lowest id of every group, by all pairs."""
    group = {i: i for i, _ in rows}
    for a, x in rows:
        for b, y in rows:
            if b < a and jaccard(x, y) >= least and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    return set(group.values())


def test_near_copies_of_every_similarity_equal_all_pairs(spark):
    draw = random.Random(5)
    rows = []
    for _ in range(25):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(40, 200))]
        for changed in (0, 1, 2, 3, 4, 6):
            own = list(words)
            for at in draw.sample(range(len(own)), changed):
                own[at] = "other"
            rows.append((len(rows), " ".join(own)))
    pairs = [jaccard(x, y) for i, (_, x) in enumerate(rows) for _, y in rows[:i]]
    assert sum(0.8 <= p < 0.9 for p in pairs) > 20 and sum(0.7 <= p < 0.8 for p in pairs) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    for tile in (1024, 2):
        assert sorted(r["doc_id"] for r in N.keep_one(df, tile=tile).collect()) == sorted(lowest(rows))


def test_repeated_rows_and_rows_without_id_leave_one(spark):
    docs = odd.documents(spark)
    got = N.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [
        (0, None), (3, "one"), (4, odd.TEXTS[4]), (6, odd.TEXTS[6]), (7, odd.LONG), (9, "...!!!"), (10, "12345 67890")
    ]
    assert N.keep_one(odd.empty(spark)).count() == 0
    unnamed = docs.filter("doc_id is null or doc_id in (4, 5)").withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(r["text"] or "" for r in N.keep_one(unnamed).collect()) == ["", odd.TEXTS[4]]


def test_the_pipeline_stage_links_fingerprints_and_similar_sets(spark):
    draw = random.Random(8)
    words = [f"w{draw.randrange(5000)}" for _ in range(60)]
    # Repeats weigh in the fingerprint alone: one passage twenty times with two ends has equal bits and unlike sets.
    flat = " ".join(["a b c d e f g h i"] * 20)
    near = [" ".join(words), " ".join(words[:-1] + ["other"])]
    twins = [f"{flat} q r s t", f"{flat} z v u w", "x1 a b c d e f g h i"]
    rows = [(i, t) for i, t in enumerate([*near, *twins, " ".join(words[::-1]), None])]
    group = {i: i for i, _ in rows}
    bits = 0
    for a, x in rows:
        for b, y in rows:
            close = (simhash.simhash(x) ^ simhash.simhash(y)).bit_count() <= 3
            bits += b < a and close and jaccard(x, y) < 0.8
            if b < a and (close or jaccard(x, y) >= 0.8) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    assert bits
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in P.keep_one_of_near_copies(spark, df, "").collect()} == set(group.values())
