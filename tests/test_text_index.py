"""The stored index: appends, removals and merges give what an index built anew gives; bounds skip what cannot win."""

import random

import pytest
from helpers import at, chunks
from pyspark.sql import functions as F

from mediawatch.operators import retrieval
from mediawatch.operators.retrieval import TextQuery, index_tables, ranked_search
from mediawatch.sources import manifest, text_index

WORDS = ["sol", "solar", "soleado", "mar", "marea", "viento", "lluvia", "llu", "y", "de", "gobierno", "gobernar", "ley"]
QUERIES = [
    TextQuery(any_of=["sol*", "ley"]), TextQuery(any_of=["de"], all_of=["gob*"]), TextQuery(any_of=["ma*", "lluvias*"]), TextQuery(all_of=["sol", "mar"]),
    TextQuery(any_of=["viento"], none_of=["y"]), TextQuery(any_of=["de"], phrase="sol y"), TextQuery(any_of=["nunca"]), TextQuery(any_of=["gobierno*"]),
]


def said(draw, ids):
    text = lambda: " ".join(draw.choices(WORDS, weights=range(len(WORDS), 0, -1), k=draw.randint(0, 25)))
    return [(i, 1 + i % 3, 30 * i, text()) for i in ids]


def answers(index, limit):
    return [[tuple(r) for r in ranked_search(index, q, limit=limit).collect()] for q in QUERIES]


def test_append_remove_and_merge_equal_an_index_built_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "DIRECT", 0)  # by bounds, however few postings
    draw, path = random.Random(3), str(tmp_path / "index")
    rows = said(draw, range(300))
    edited = said(draw, range(40, 60))
    for part in (rows[:100], rows[100:130], rows[130:]):
        text_index.append_index(chunks(spark, part), path)
    ids = spark.range(40, 70).withColumnRenamed("id", "doc_id").unionByName(spark.range(900, 905).withColumnRenamed("id", "doc_id"))
    text_index.remove_chunks(ids, path)
    text_index.append_index(chunks(spark, edited), path)  # appended again after its removal
    left = [r for r in rows if not 40 <= r[0] < 70] + edited
    fresh = index_tables(chunks(spark, left))
    want = answers(fresh, None)
    index = text_index.read_index(spark, path)
    before = text_index.segments(spark, path)
    assert len(before) == 5 and answers(index, None) == want
    assert answers(index, 10) == [w[:10] for w in want]
    text_index.merge_index(spark, path)
    merged = text_index.read_index(spark, path)
    assert len(text_index.segments(spark, path)) == 1
    assert answers(merged, 10) == [w[:10] for w in want]
    assert answers(index, 10)[0] == want[0][:10]  # a reader of the segments before the merge ends well
    gone = manifest.vacuum(spark, path, text_index.TABLES)
    assert {g.split("=")[-1] for g in gone} == {str(n) for n in before}
    merged = text_index.read_index(spark, path)
    assert answers(merged, None)[1] == want[1]
    counts = {(r["term"], r["prefix"]): r["df"] for r in merged.terms.collect()}
    sets = [set(r[3].split()) for r in left]
    assert all(n > 0 for n in counts.values())
    for term in ("sol", "de", "gobierno"):
        assert counts[term, False] == sum(term in s for s in sets)
    for lead in ("sol", "mar", "gob", "gobier"):
        assert counts[lead, True] == sum(any(w.startswith(lead) for w in s) for s in sets)


def test_statistics_are_read_from_the_dictionary(spark, tmp_path):
    path = str(tmp_path / "i")
    text_index.append_index(chunks(spark, said(random.Random(1), range(50))), path)
    index = text_index.read_index(spark, path)
    read = retrieval._document_counts(index, TextQuery(any_of=["sol*", "de"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "prefix" in read and "tf" not in read  # the dictionary alone
    assert "doc_id" not in index.totals.columns


def test_questions_give_the_same_from_stored_segments(spark, tmp_path):
    path, rows = str(tmp_path / "i"), said(random.Random(9), range(120))
    c = chunks(spark, rows)
    for part in (rows[:50], rows[50:]):
        text_index.append_index(chunks(spark, part), path)
    asked = spark.createDataFrame(
        [(1, "qué dijo del gobierno y la lluvia", "all", "", 5), (2, "sol", "all", "ch01", 4), (3, "gobernar marea", "all", "", 30)],
        "question_id int, question string, range string, channel string, top_n int",
    )
    out = [
        sorted((r["question_id"], r["rank"], r["id"], r["score"]) for r in retrieval.retrieve(i, c, asked, F.lit("2024-01-02").cast("timestamp_ntz")).collect())
        for i in (index_tables(c), text_index.read_index(spark, path))
    ]
    assert out[0] == out[1] and len(out[0]) > 20


@pytest.mark.parametrize("since", [None, 30 * 1500])
def test_blocks_below_the_threshold_are_not_read(spark, tmp_path, monkeypatch, since):
    monkeypatch.setattr(retrieval, "DIRECT", 0)
    draw, path = random.Random(8), str(tmp_path / "index")
    rows = [(i, 1, 30 * i, " ".join(["relleno"] * draw.randint(3, 60) + ["sol"] * (draw.random() < 0.3) + ["sol"] * (6 if i % 400 == 7 else 0))) for i in range(3000)]
    text_index.append_index(chunks(spark, rows), path)
    index, q = text_index.read_index(spark, path), TextQuery(any_of=["sol", "luna"])
    since = None if since is None else F.lit(at(since)).cast("timestamp_ntz")
    want = [tuple(r) for r in ranked_search(index_tables(chunks(spark, rows)), q, since=since, limit=None).collect()]
    rest = []
    for k in (3, 20, 200):
        assert [tuple(r) for r in ranked_search(index, q, since=since, limit=k).collect()] == want[:k]
        r = retrieval.postings_read(index, q, since=since, limit=k).first()
        rest.append(r["kept_rows"])
        assert r["kept_blocks"] <= r["blocks"]
    assert rest[0] < rest[1] < rest[2] <= r["rows"]


def test_an_empty_index_finds_nothing(spark, tmp_path):
    path = str(tmp_path / "i")
    assert ranked_search(text_index.read_index(spark, path), TextQuery(any_of=["sol"])).count() == 0
    text_index.append_index(chunks(spark, [(1, 1, 0, None), (2, 1, 5, "")]), path)
    text_index.remove_chunks(spark.range(5).withColumnRenamed("id", "doc_id"), path)
    assert ranked_search(text_index.read_index(spark, path), TextQuery(any_of=["sol"])).count() == 0
    text_index.merge_index(spark, path)
    assert text_index.read_index(spark, path).totals.first()["n"] == 0


def test_an_unfinished_publication_is_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    manifest.publish(spark, path, ["seg=1"])
    (tmp_path / "t" / "manifest" / "v2").mkdir()
    assert manifest.folders(spark, path) == ["seg=1"] and manifest.versions(spark, path) == [1]
    manifest.publish(spark, path, ["seg=1", "seg=2"])
    assert manifest.folders(spark, path) == ["seg=1", "seg=2"] and manifest.folders(spark, path, 1) == ["seg=1"]


def test_an_append_exchanges_terms_not_postings(spark, tmp_path, monkeypatch):
    """Postings are sorted where their block was dealt to: every block of a segment lies in the files of one task."""
    monkeypatch.setattr(text_index, "PART_BYTES", 1 << 13)
    path = str(tmp_path / "index")
    rows = said(random.Random(4), range(2000)) + [(3000, 1, 5, ""), (3001, 2, 5, "...")]
    text_index.append_index(chunks(spark, rows), path)
    index = text_index.read_index(spark, path)
    task = F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)
    per = index.postings.select("block", task.alias("task")).distinct().groupBy("block").count()
    assert per.filter("count > 1").isEmpty() and index.postings.select(task).distinct().count() > 1
    want = {tuple(r) for r in retrieval.postings(chunks(spark, rows)).selectExpr("doc_id", "term", "doc_len", "tf", "cast(places as string)").collect()}
    assert {tuple(r) for r in index.postings.selectExpr("doc_id", "term", "doc_len", "tf", "cast(places as string)").collect()} == want
    assert index.documents.filter("doc_len = 0").count() == sum(not r[3].strip(".") for r in rows)
