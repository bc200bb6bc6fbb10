import odd
from mediawatch.llm import line_templates as L
from pyspark.sql import functions as F


def cleaned(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    return {r["doc_id"]: r["text"] for r in L.drop_recurring_lines(df, **how).collect()}


def test_variable_fields_share_a_template_and_the_lowest_id_keeps_it(spark):
    rows = [(i, f"Body {'abcdef'[i]} of text\nPage {i} of this guide printed by user{i}\n\nend {'uvwxyz'[i]}") for i in range(6)]
    out = cleaned(spark, rows)
    assert out[0] == rows[0][1]
    for i in range(1, 6):
        assert out[i] == f"Body {'abcdef'[i]} of text\n\nend {'uvwxyz'[i]}"


def test_a_position_that_differs_becomes_variable(spark):
    names = ["ann", "bob", "cid", "dan", "eve"]
    rows = [(i, f"Posted by the user {n} on this site") for i, n in enumerate(names)] + [(9, "Posted by the way I like it all")]
    out = cleaned(spark, rows)
    assert [out[i] for i in (0, 1, 2, 3, 4)] == [rows[0][1], "", "", "", ""]
    assert out[9] == rows[5][1]


def test_too_few_documents_keep_their_lines(spark):
    rows = [(i, "All rights reserved.") for i in range(4)] + [(7, "x\n" * 50)]
    out = cleaned(spark, rows)
    assert out == dict(rows)


def test_odd_rows(spark):
    docs = odd.documents(spark)
    out = L.drop_recurring_lines(docs, min_documents=3)
    assert set(out.columns) == set(docs.columns) | {"n_dropped"}
    got = out.collect()
    assert len(got) == docs.count()
    same = [r["text"] for r in got if r["text"] in ("one two three four five six seven", "")]
    # documents 4 and 5 and the row without id hold the line; the lowest id and its repeated rows keep it
    assert sorted(same) == ["", "", ""] + ["one two three four five six seven"] * 3
    assert sum(r["text"] is None for r in got) == 2
    assert L.drop_recurring_lines(odd.empty(spark)).count() == 0
    assert L.drop_recurring_lines(docs.filter(F.col("text").isNull())).count() == 2


def test_fields_of_many_values_are_generalised_at_every_size(spark):
    for values, copies in ((4, 1), (6, 3), (12, 2)):  # a value is held by 4, 18 and 24 documents
        rows = [
            ((a * values + d) * copies + k, f"Written by staff member {'abcdefghijkl'[a]} for the {'abcdefghijkl'[d]} desk")
            for a in range(values) for d in range(values) for k in range(copies)
        ]
        out = cleaned(spark, rows, growth=L.GROWTH)
        assert [i for i in out if out[i]] == [0], (values, copies)


def test_a_specific_template_that_recurs_is_not_generalised(spark):
    rows = [(i, f"Posted by the user {'ann' if i < 30 else 'bob'} on this site") for i in range(60)]
    out = cleaned(spark, rows, growth=L.GROWTH)
    assert [i for i in sorted(out) if out[i]] == [0, 30]


def test_lists_beyond_the_bound_are_exchanged_with_the_same_result(spark, monkeypatch):
    rows = [(i, f"Body {i % 7} of text\nAll rights reserved here.\n{'x' * (i % 5)}") for i in range(40)]
    sent = cleaned(spark, rows, growth=L.GROWTH)
    monkeypatch.setattr("mediawatch.scale.SHIPPED_ROWS", 0)
    assert cleaned(spark, rows, growth=L.GROWTH) == sent and sum(t == rows[i][1] for i, t in sent.items()) < 5
