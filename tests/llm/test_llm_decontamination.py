import odd
from mediawatch.llm import decontamination as D

ITEM = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce"


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").coalesce(2)
    b = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").coalesce(1)
    return {(r["_doc"], r["_item"], r["n_shared"], r["n_item"]) for r in D.contained_items(d, b).collect()}


def test_short_items_in_long_documents(spark):
    w = ITEM.split()
    docs = [
        odd.LONG + " " + ITEM.upper() + ", " + odd.LONG,  # whole, in other case and between other signs
        "x " + " ".join(w[:12]) + " y",  # 8 of its 10 shingles
        "x " + " ".join(w[:11]) + " y",  # 7
        " ".join(w[:6]) + ". " + "z " * 50 + " ".join(w[3:]),  # in two pieces that overlap
        None, "", "...", "uno",
    ]
    assert found(spark, docs, [ITEM]) == {(0, 0, 10, 10), (1, 0, 8, 10), (3, 0, 9, 10)}


def test_items_of_every_size(spark):
    items = [None, "", "uno", "uno dos", ITEM, ITEM, odd.LONG]
    docs = ["Uno", "uno dos", "uno dos tres", odd.LONG]
    assert found(spark, docs, items) == {(0, 2, 1, 1), (1, 3, 1, 1), (3, 6, 977, 977)}
    assert found(spark, docs, []) == set() and found(spark, [], items) == set()


def test_stage_keeps_clean_and_odd_rows(spark):
    docs = odd.documents(spark)
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert {r["text"] for r in kept.collect()} == set(odd.TEXTS) - {"one two three four five six seven"}


def test_items_without_an_id_keep_their_pairs(spark):
    docs = spark.createDataFrame([(1, "x " + ITEM), (2, odd.LONG + " y z"), (3, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(None, ITEM), (None, odd.LONG), (7, ITEM)], "item_id long, text string")
    got = {(r["_doc"], r["_item"], r["n_item"]) for r in D.contained_items(docs, items).collect()}
    assert got == {(1, None, 10), (1, 7, 10), (2, None, 977)}
    assert [r["doc_id"] for r in D.decontaminate(docs, items).collect()] == [3]
