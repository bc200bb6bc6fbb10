"""Grouping by shared keys without pairs: star links and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediawatch.scale import discard, stored

SALTS = 1024


def star_links(rows: DataFrame, group: list[str], member: str) -> DataFrame:
    """Links (a, b), b < a, that connect all members of each group: as many links as members, not pairs.

    Members first meet in one of 1024 salted parts of their group, then the parts' lowest members
    meet, so a group holding a third of all rows is spread over that many windows.
    """
    part = Window.partitionBy(*group, "_salt")
    whole = Window.partitionBy(*group)
    salted = rows.select(*group, F.col(member).alias("a")).withColumn(
        "_salt", F.pmod(F.xxhash64("a"), F.lit(SALTS))
    )
    inner = salted.withColumn("b", F.min("a").over(part))
    # Both kinds of link come out of one pass: a part's lowest member links on to the group's lowest.
    heads = inner.filter("a = b").select(*group, "a").withColumn("b", F.min("a").over(whole))
    links = inner.select("a", "b").unionByName(heads.select("a", "b"))
    return links.filter("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every linked id; the component is its lowest id.

    Lowest-label propagation with pointer jumping until no label moves; every round is a Parquet stage
    that replaces the one before. The label tables have one row per id, so a busy id is a skewed probe
    side that adaptive execution splits; the minimum itself is combined before each shuffle.
    """
    edges = stored(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "component-links"
    )
    labels = stored(
        edges.groupBy("a").agg(F.min("b").alias("_m")).select(
            F.col("a").alias("id"), F.least("a", "_m").alias("label"), F.lit(True).alias("moved")
        ),
        "component-labels",
    )
    while not labels.filter("moved").isEmpty():
        heard = (
            edges.join(labels.select(F.col("id").alias("b"), "label"), "b")
            .groupBy("a")
            .agg(F.min("label").alias("_heard"))
        )
        nearer = labels.join(heard, labels["id"] == heard["a"]).select(
            "id", F.col("label").alias("_old"), F.least("label", "_heard").alias("_new")
        )
        roots = labels.select(F.col("id").alias("_new"), F.col("label").alias("_root"))
        last, labels = labels, stored(
            nearer.join(roots, "_new", "left").select(
                "id",
                F.least("_new", F.coalesce("_root", "_new")).alias("label"),
                (F.least("_new", F.coalesce("_root", "_new")) < F.col("_old")).alias("moved"),
            ),
            "component-labels",
        )
        discard(last)
    discard(edges)
    return labels.select("id", F.col("label").alias("component"))
