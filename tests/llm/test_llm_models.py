import math
import zlib

import numpy as np
import odd
from mediawatch.llm import language as L
from mediawatch.llm import toxicity as T
from pyspark.sql import functions as F

EN = "the cat and the dog went to the house with their friends and then they ate"
ES = "el gato y el perro fueron a la casa con sus amigos y luego comieron"


def softmax(x):
    x = np.exp(np.array(x) - max(x))
    return x / x.sum()


def brute_language(rows, known):
    """Plain version of `identified` for rows of (text, declared, host)."""
    counts = np.full((L.CELLS, len(known)), 0.5)
    for text in {(t, d) for t, d, _ in rows if d in known and t}:
        counts[:, known.index(text[1])] += sum(
            np.bincount(L.trigrams(text[0]), minlength=L.CELLS) for t, d, _ in rows if (t, d) == text
        )
    table = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    logs = []
    for t, _, _ in rows:
        cells = L.trigrams(t)
        logs.append(table[cells].sum(axis=0, dtype=np.float64) * min(1, 64 / len(cells)) if len(cells) else None)
    shares = [softmax(x) if x is not None else None for x in logs]
    n = len(known)
    total = sum((s for s in shares if s is not None), np.zeros(n))
    everywhere = (total + 1) / (total.sum() + n)
    tail = lambda h: ".".join(h.split(".")[-2:])
    ending = lambda h: h.split(".")[-1] if h and "." in h else None
    sums = lambda f: {k: sum((s for s, r in zip(shares, rows) if s is not None and f(r) == k), np.zeros(n)) for k in {f(r) for r in rows} if k}
    declared, suffix = sums(lambda r: r[1]), sums(lambda r: ending(r[2]))
    hosts, domains = sums(lambda r: r[2]), sums(lambda r: tail(r[2]) if r[2] else None)
    smooth = lambda c, p: (np.maximum(c, 0) + L.PARENT * p) / (c.sum() + L.PARENT)
    out = []
    for (t, d, h), x, s in zip(rows, logs, shares):
        z = np.zeros(n) if x is None else x.copy()
        for key, of in ((d, declared), (ending(h), suffix)):
            if key:
                z = z + np.log((of[key] + 1 / n) / (total + 1))
        prior = everywhere
        if h:
            own = np.zeros(n) if s is None else s
            prior = smooth(hosts[h] - own, smooth(domains[tail(h)], everywhere))
        p = softmax(z + np.log(prior))
        out.append((known[int(np.argmax(p))], round(float(p.max()), 6), x is not None and p.max() >= 0.5))
    return out


def test_fusion_equals_the_plain_version(spark):
    rows = [(f"{EN} {i}", "en", "a.example.com") for i in range(6)] + [(f"{ES} {i} {'y' * i}", "es", "b.example.es") for i in range(6)]
    rows += [("the gato", "es", "b.example.es"), ("xyz", None, "a.example.com"), ("xyz", None, "b.example.es"), ("12 !", "en", None),
             (None, "es", "c.example.es"), ("", None, None), (ES, "en", "a.example.com")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, host string").coalesce(2)
    got = {r["doc_id"]: r for r in L.identified(df, declared=F.col("lang"), address=F.col("host")).collect()}
    for i, (name, p, accepted) in enumerate(brute_language(rows, ["en", "es"])):
        assert got[i]["language"] == name and math.isclose(got[i]["posterior"], p, abs_tol=2e-5), (i, got[i], name, p)
        assert got[i]["accepted"] == accepted
    assert got[13]["language"] == "en" and got[14]["language"] == "es"  # the host decides
    assert got[18]["language"] == "es"  # the text outweighs a wrong declaration


def test_copies_of_a_sampled_text_count_once(spark):
    rows = [(f"{EN} {i}", "en") for i in range(5)] + [(f"{ES} {i}", "es") for i in range(5)]
    df = lambda x: spark.createDataFrame(x, "_text string, _declared string").coalesce(2)
    once, copied = (L.fitted(df(x), ["en", "es"], 400)[0] for x in (rows, rows + [rows[0]] * 500))
    assert np.array_equal(once, copied)


def test_rare_languages_are_found_and_unknown_text_is_rejected(spark):
    draw = np.random.default_rng(1)
    text = lambda words, i: " ".join(draw.choice(words.split(), 20)) + f" {i}"
    fi = "hyvää huomenta kaikille ja tervetuloa tänään kokoukseen jossa keskustelemme tulevaisuudesta"
    rows = [(text(EN, i), "en") for i in range(15_000)] + [(text(fi, i), "fi") for i in range(60)]  # 0.4 %
    rows += [(text(fi, 0), None), ("быстрая лиса прыгает через ленивую собаку и бежит домой", "en"), ("qzx vkj wqq zzxj kqvx jjwq xzk qvvz", "en")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").coalesce(2)
    got = {r["doc_id"]: r for r in L.identified(df, declared=F.col("lang")).collect()}
    assert all(got[i]["language"] == "fi" and got[i]["accepted"] for i in range(15_000, 15_061))
    assert all(got[i]["accepted"] for i in range(15_000)) and not got[15_061]["accepted"] and not got[15_062]["accepted"]


def test_language_of_odd_rows(spark):
    docs = odd.documents(spark)
    got = L.identified(docs, declared=F.col("lang"), address=F.col("source")).collect()
    assert len(got) == docs.count()
    kept = L.keep_identified(docs, declared=F.col("lang"), address=F.col("source"))
    assert kept.columns == docs.columns
    assert {r["text"] for r in kept.collect()} == {t for t in odd.TEXTS if t and any(c.isalpha() for c in t)}
    assert {r["language"] for r in L.identified(docs).collect()} == {"und"}
    assert L.identified(odd.empty(spark), declared=F.col("lang")).count() == 0


def test_page_evidence(spark):
    df = spark.createDataFrame(
        [("https://u@m.example.co:8/de/1", '<!DOCTYPE html><HTML class="a" LANG=\'de-AT\'><style>p{}</style><p>Hallo <b>du</b>'), ("src0", "x"), (None, None)],
        "url string, html string",
    )
    host = L.host_of(F.col("url"))
    got = df.select(host, L.domain_of(host), L.suffix_of(host), L.markup_language(F.col("html")), F.trim(L.visible(F.col("html")))).collect()
    assert [x.strip() if x else x for x in got[0]][:4] == ["m.example.co", "example.co", "co", "de"] and got[0][4].split() == ["Hallo", "du"]
    assert tuple(got[1])[:4] == ("src0", "src0", None, None) and tuple(got[2]) == (None,) * 5


def test_language_on_the_given_tables(spark):
    from pathlib import Path

    import pytest

    sf = "/root/testdata/sf0.01"
    if not Path(sf).exists():
        pytest.skip("driver tables not mounted")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = L.identified(docs, address=F.col("source"), declared=F.col("lang")).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.filter("text_language = lang").count() > 0.98 * docs.count()
    assert got.filter("not accepted").count() == 0


def test_pairs_say_what_single_terms_do_not():
    # a and b are harmless alone; together they are the label
    draw = np.random.default_rng(1)
    found, label = [], []
    for _ in range(3000):
        a, b = draw.random() < 0.5, draw.random() < 0.5
        found.append(np.array(sorted([1] * a + [2] * b + [int(draw.integers(10, 60))]), dtype=np.int32))
        label.append(float(a and b))
    m = T.fit(found, np.array(label), bits=6, most=64, epochs=60)
    v, w = m.factors[m.slot], m.weight[m.slot]
    pair = v[1] @ v[2]
    logit = lambda own: m.bias + sum(w[i] for i in own) + (pair if len(own) > 1 else 0)
    assert pair > 1 and logit([1]) < 0 and logit([2]) < 0 and logit([1, 2]) > 0


def test_scores_follow_the_machine_and_the_folds(spark):
    words = ["idiot", "scum"]
    texts = [f"{EN} {i} {words[i % 2]} there" if i % 3 == 0 else f"{EN} {i} there" for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = T.toxicity(docs, labels).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == int(r["doc_id"] % 3 == 0) and r["predicted"] == int(r["score"] >= 0.3)
    machine = T.learned(docs, labels)
    assert all(math.isclose(machine(texts[r["doc_id"]]), r["score"], rel_tol=1e-9) for r in got)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end toxic")
    again = {r["doc_id"]: r["score"] for r in T.toxicity(docs, flipped).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in got)  # held-out labels are never read


def test_toxicity_of_odd_rows(spark):
    docs = odd.documents(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    got = T.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert T.toxicity(docs, labels.limit(0)).filter("predicted = 1").count() == 0
    assert T.toxicity(odd.empty(spark), labels).count() == 0


def test_a_repeated_id_is_learned_once(spark):
    once = [(i, f"word{i % 7} {'bad group' if i % 3 == 0 else 'good day'}") for i in range(40)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)], "doc_id long, toxic int")
    many = spark.createDataFrame(once + [once[3]] * 500, "doc_id long, text string")
    a, b = T.learned(spark.createDataFrame(once, "doc_id long, text string"), labels), T.learned(many.repartition(7), labels)
    assert a.bias == b.bias and (a.weight == b.weight).all() and (a.factors == b.factors).all()
