"""Short test items inside long documents: MinHash containment search over items partitioned by size.

An item of n distinct five-word shingles is contained in a document that holds at least c = ceil(0.8 n)
of them. Of the item's n - c + 1 lowest shingle hashes (its bottom MinHash values) such a document holds
at least one, however long it is, so looking these up loses no pair; signatures of whole documents could
not promise that for a short item in a long text. Items are partitioned by the power of two of their
size: a document's shingle is looked up only if, for some partition, the document has as many shingles as
its least demanding item needs and the hash is not above the highest it keeps. Pairs with a hit are then
decided by their distinct shingles, as strings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediawatch.llm.common import identity, shipped, stored, without
from mediawatch.scale import pinned

WORDS = 5
CONTAINED = 0.8


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits, with an empty entry at an end where the text has other signs."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def with_words(df: DataFrame, text: Column, to: str) -> DataFrame:
    """Add the words of a text as an array without the empty ends; rows without words go.

    `pinned` keeps the optimizer from splitting a text again for every filter and place that reads the words.
    """
    raw = pinned(df, to, words_of(text)).filter(F.size(to) > 0)
    skip = F.when(F.get(to, F.lit(0)) == "", 1).otherwise(0)
    tail = F.when(F.element_at(to, -1) == "", 1).otherwise(0)
    inner = pinned(raw, "_inner", F.slice(to, skip + 1, F.greatest(F.size(to) - skip - tail, F.lit(0))))
    return inner.filter(F.size("_inner") > 0).drop(to).withColumnRenamed("_inner", to)


def window(words: Column, at: Column, size: int) -> list[Column]:
    """The words from a place on; places beyond the end are null and add nothing to a hash."""
    return [F.get(words, at + i) for i in range(size)]


def starts(words: Column, size: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))


def shingles(words: Column, size: int) -> Column:
    """Distinct shingles as strings; fewer words than `size` are one shingle."""
    return F.array_distinct(
        F.transform(starts(words, size), lambda i: F.array_join(F.slice(words, i + 1, size), " "))
    )


def item_sketches(items: DataFrame, item_id: str, text_col: str, size: int, contained: float) -> tuple[DataFrame, DataFrame]:
    """Per item its shingles and size; per kept hash the item and its partition."""
    each = with_words(
        items.select(F.col(f"`{item_id}`").alias("_item"), F.col(f"`{text_col}`").alias("_text")).distinct(),
        F.col("_text"), "_words",
    )
    sized = each.withColumn("_shingles", shingles(F.col("_words"), size)).withColumn("_n", F.size("_shingles"))
    needed = F.ceil(F.lit(contained) * F.col("_n") - F.lit(1e-9)).cast("int")
    whole = stored(
        sized.select("_item", F.xxhash64("_text").alias("_item_hash"), "_words", "_shingles", "_n", needed.alias("_needed")),
        "test-items",
    )
    hashes = F.array_sort(
        F.array_distinct(
            F.transform(starts(F.col("_words"), size), lambda i: F.xxhash64(*window(F.col("_words"), i, size)))
        )
    )
    sketch = whole.select(
        "_item", "_item_hash", "_needed",
        F.floor(F.log2("_n")).cast("int").alias("_class"),
        F.explode(F.slice(hashes, F.lit(1), F.col("_n") - F.col("_needed") + 1)).alias("_h"),
    )
    return whole.drop("_words"), stored(sketch, "item-sketches")


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WORDS,
    contained: float = CONTAINED,
) -> DataFrame:
    """(_doc, _id, _text_hash, _item, n_item, n_shared, containment): every pair at or above `contained`.

    Null, empty and wordless texts have no shingles and no rows. A text of fewer than `size` words is one
    shingle, so an item that short is found only where a document has just these words. Repeated rows (equal id and
    text) give one row; items of one id, or of a null id, and different texts are told apart. A test set
    beyond the bound of `shipped` is joined by shuffle; an empty test set or table gives no rows.
    """
    whole, sketch = item_sketches(items, item_id, item_text, size, contained)
    least = sketch.groupBy("_class").agg(F.min("_needed").alias("_least"), F.max("_h").alias("_cutoff"))
    classes = least.collect()  # one row per power of two
    of_use = reduce(
        lambda a, b: a | b, [(F.col("_has") >= r["_least"]) & (F.col("_h") <= r["_cutoff"]) for r in classes], F.lit(False)
    )
    texts = docs.select(
        F.col(f"`{id_col}`").alias("_doc"), *identity(id_col, text_col), F.col(f"`{text_col}`").alias("_text")
    )
    parts = with_words(texts, F.col("_text"), "_words").drop("_text")
    has = F.greatest(F.size("_words") - (size - 1), F.lit(1))
    at = parts.select(
        "_doc", "_id", "_text_hash", has.alias("_has"), "_words", F.posexplode("_words").alias("_at", "_word")
    )
    hashed = at.filter(F.col("_at") < F.col("_has")).select(
        "_doc", "_id", "_text_hash", "_has", F.xxhash64(*window(F.col("_words"), F.col("_at"), size)).alias("_h")
    ).filter(of_use)
    candidates = stored(
        hashed.join(shipped(sketch), "_h")
        .filter(F.col("_has") >= F.col("_needed"))
        .select("_doc", "_id", "_text_hash", "_item", "_item_hash").distinct(),
        "containment-candidates",
    )
    listed = candidates.groupBy("_id", "_text_hash").agg(
        F.first("_doc").alias("_doc"), F.collect_set(F.struct("_item", "_item_hash")).alias("_items")
    )
    listed = shipped(stored(listed, "containment-documents"))
    suspects = texts.select("_id", "_text_hash", "_text").join(
        listed, texts["_id"].eqNullSafe(listed["_id"]) & (texts["_text_hash"] == listed["_text_hash"])
    ).select(listed["_doc"], listed["_id"], listed["_text_hash"], "_text", "_items")
    held = with_words(suspects, F.col("_text"), "_words")
    found = (
        pinned(held.drop("_text"), "_held", shingles(F.col("_words"), size))
        .select("_doc", "_id", "_text_hash", "_held", F.explode("_items").alias("_i"))
        .select("_doc", "_id", "_text_hash", "_held", F.col("_i._item").alias("_item"), F.col("_i._item_hash").alias("_item_hash"))
    )
    known = shipped(whole)
    checked = found.join(known, found["_item"].eqNullSafe(known["_item"]) & (found["_item_hash"] == known["_item_hash"])).select(
        "_doc", "_id", "_text_hash", found["_item"], F.col("_n").alias("n_item"), "_needed",
        F.size(F.array_intersect("_shingles", "_held")).alias("n_shared"),
    )
    return (
        checked.filter(F.col("n_shared") >= F.col("_needed"))
        .withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))
        .select("_doc", "_id", "_text_hash", "_item", "n_item", "n_shared", "containment")
        .distinct()
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs` that contain no test item, with all their columns; null and empty texts stay."""
    bad = contained_items(docs, items, id_col, text_col, **how).select("_id", "_text_hash").distinct()
    return without(docs, bad, id_col, text_col)
