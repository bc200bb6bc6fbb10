import random
from collections import defaultdict

import pytest
from helpers import at
from pyspark.sql import functions as F

from mediawatch.operators import graph, similarity
from test_guide_detail import MATCH, match


def windows_of(spark, texts, keyword="sol"):
    rows = [match(i + 1, 1, i * 100, t, keyword=keyword) for i, t in enumerate(texts)]
    return similarity.windows(spark.createDataFrame(rows, MATCH))


def components(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in parent}


def py_score(a, aa, b, ab):
    best = 0
    for ia in aa:
        for ib in ab:
            left = right = 0
            while ia - left > 0 and ib - left > 0 and a[ia - left - 1] == b[ib - left - 1]:
                left += 1
            while ia + right + 1 < len(a) and ib + right + 1 < len(b) and a[ia + right + 1] == b[ib + right + 1]:
                right += 1
            best = max(best, left + right + 1)
    return best


def py_shingles(ws):
    return {" ".join(ws[i : i + 5]) for i in range(len(ws) - 4)}


def brute_components(wins, max_docs):
    rows = [(r["match_id"], r["norm"], r["anchors"]) for r in wins.collect()]
    docs = defaultdict(set)
    for i, ws, _ in rows:
        for s in py_shingles(ws):
            docs[s].add(i)
    usable = {s for s, d in docs.items() if 2 <= len(d) and (max_docs is None or len(d) <= max_docs)}
    links = [
        (i, j)
        for i, a, aa in rows
        for j, b, ab in rows
        if i < j and py_shingles(a) & py_shingles(b) & usable and py_score(a, aa, b, ab) >= 12
    ]
    return components(links)


def noise(rng, n):
    return [f"w{rng.randrange(40)}" for _ in range(n)]


def sample(seed=3, n=60):
    rng = random.Random(seed)
    spot = noise(rng, 30)
    spot[8] = spot[20] = "sol"
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.6:
            body = list(spot)
            for _ in range(rng.randrange(4)):
                body[rng.randrange(30)] = f"w{rng.randrange(40)}"
            texts.append(" ".join(noise(rng, rng.randrange(25)) + body + noise(rng, rng.randrange(25))))
        else:
            texts.append(" ".join(noise(rng, 12) + ["soleado"] + noise(rng, 12)))
    return texts


@pytest.mark.parametrize("max_docs", [150, 8, 3, None])
def test_links_give_the_components_of_all_pairs(spark, max_docs):
    wins = windows_of(spark, sample()).cache()
    got = {
        r["match_id"]: r["cluster_id"] for r in similarity.clustered(wins, max_docs).select("match_id", "cluster_id").collect()
    }
    assert got == brute_components(wins, max_docs)


def test_scores_agree_with_brute_force(spark):
    wins = windows_of(spark, sample(5, 30)).cache()
    rows = {r["match_id"]: r for r in wins.collect()}
    scored = similarity.scored_links(wins, similarity.spot_links(wins)).collect()
    assert scored
    for r in scored:
        a, b = rows[r["a"]], rows[r["b"]]
        assert r["score"] == py_score(a["norm"], a["anchors"], b["norm"], b["anchors"]) >= 12


@pytest.mark.parametrize("shared,linked", [(11, False), (12, True)])
def test_threshold(spark, shared, linked):
    run = [f"a{i}" for i in range(shared - 1)]
    common = " ".join(run[:5] + ["sol"] + run[5:])
    wins = windows_of(spark, [f"x1 x2 {common} x3", f"y1 y2 {common} y3"])
    assert (similarity.spot_links(wins).count() > 0) is linked


@pytest.mark.parametrize("copies,clustered", [(150, 150), (151, 0)])
def test_common_shingle_cut(spark, copies, clustered):
    text = "uno dos tres cuatro cinco seis sol siete ocho nueve diez once doce trece"
    wins = windows_of(spark, [text] * copies).cache()
    assert similarity.clustered(wins, max_docs=150).count() == clustered
    assert similarity.clustered(wins).count() == copies


def test_a_spot_of_a_thousand_airings_is_one_cluster(spark):
    text = "uno dos tres cuatro cinco seis sol siete ocho nueve diez once doce trece"
    wins = windows_of(spark, [f"a{i} {text} b{i % 7}" for i in range(1000)])
    got = similarity.clustered(wins).groupBy("cluster_id").count().collect()
    assert [r["count"] for r in got] == [1000]


def test_connected_components(spark):
    rng = random.Random(1)
    links = [(1, 2), (2, 3), (10, 11)] + [(100 + i, 101 + i) for i in range(40)]
    links += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)]
    links = [(max(a, b), min(a, b)) for a, b in links if a != b]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in graph.connected_components(df).collect()}
    assert got == components(links)
    assert graph.connected_components(df.limit(0)).count() == 0


def test_star_links_are_linear_in_a_hot_group(spark):
    rows = spark.range(20000).select(F.lit("hot").alias("g"), F.col("id"))
    links = graph.star_links(rows, ["g"], "id")
    assert links.count() <= 20000 + graph.SALTS
    assert graph.connected_components(links).select("component").distinct().count() == 1


def test_report_merges_and_cuts(spark):
    words = [f"p{i}" for i in range(130)]
    words[60] = "sol"
    long_text = " ".join(words)
    spot = "compre ya el sol de la marca buena con todo el sabor de siempre hoy"
    texts = [long_text, long_text, f"uno {spot} dos", f"tres {spot} cuatro", "solo sol aqui"]
    rows = [match(i + 1, 1, i * 100, t, channel=i % 2 + 1) for i, t in enumerate(texts)]
    report = similarity.similarity_report(spark.createDataFrame(rows, MATCH))
    got = {r["cluster_id"]: r for r in report["clusters"].collect()}
    assert set(got) == {1, 3}
    block = got[1]["common_fragment"].split()
    assert len(block) == 26 and "sol" in block
    assert got[3]["common_fragment"] == spot
    assert got[3]["size"] == 2 and [c["count"] for c in got[3]["channels"]] == [1, 1]
    assert (got[3]["first_ts"], got[3]["last_ts"]) == (at(200), at(300))
    assert [r["match_id"] for r in report["unique"].collect()] == [5]
    shown = similarity.shown_clusters(report["clusters"], min_size=2)
    assert shown.count() == 2 and similarity.shown_clusters(report["clusters"]).count() == 0


def test_clusters_with_the_same_fragment_merge(spark):
    # The two spots mention the keyword at different places of the same script, so no pair lines up.
    script = [f"s{i}" for i in range(34)]
    early, late = list(script), list(script)
    early.insert(2, "sol")
    late.insert(30, "sol")
    texts = [" ".join(early)] * 2 + [" ".join(late)] * 2
    wins = windows_of(spark, texts).cache()
    assert similarity.clustered(wins).select("cluster_id").distinct().count() == 2
    assert similarity.cluster_members(wins).select("cluster_id").distinct().count() == 1


def test_links_count_no_shingles_of_unshared_keys(spark, monkeypatch):
    wins = windows_of(spark, sample()).cache()
    want = similarity.spot_links(wins).count()

    def unasked(*_):
        raise AssertionError("all shingles counted")

    monkeypatch.setattr(similarity, "shingle_counts", unasked)
    assert similarity.spot_links(wins, max_docs=10**9).count() == want > 0
    monkeypatch.setattr(similarity, "_runs", unasked)
    assert similarity.spot_links(wins).count() == want
