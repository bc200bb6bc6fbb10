"""Spots kept from day to day: a day's matches meet the old ones by their keys, and only touched spots change.

Tables under a path, in folders by search: windows (of every match), heads (the first match that had each key), labels
(match_id, cluster_id of every linked match, before spots merge), fragments (cluster_id, common_fragment). Components
are found on a small graph: the new matches, and one node for each old spot or single match that they meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediawatch.operators import similarity
from mediawatch.operators.graph import connected_components, star_links
from mediawatch.scale import remove, shipped, stored
from mediawatch.sources.manifest import exists
from mediawatch.sources.tables import replace_parts

SCHEMAS = {
    "windows": "match_id bigint, keyword string, channel_name string, ts timestamp_ntz, text_len int, orig array<string>, "
    "norm array<string>, anchors array<int>, search_id int",
    "heads": "key string, head bigint, search_id int",
    "labels": "match_id bigint, cluster_id bigint, search_id int",
    "fragments": "cluster_id bigint, common_fragment string, search_id int",
}


def _table(spark: SparkSession, path: str, name: str, searches: list[int] | None = None) -> DataFrame:
    """Stored rows, of some searches' folders only if these are given; none before the first write."""
    if not exists(spark, f"{path}/{name}"):
        return spark.createDataFrame([], SCHEMAS[name])
    rows = spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")
    return rows if searches is None else rows.filter(F.col("search_id").isin(searches))


def _append(rows: DataFrame, path: str, name: str) -> None:
    rows.write.mode("append").partitionBy("search_id").parquet(f"{path}/{name}")


def add_matches(matches: DataFrame, path: str) -> DataFrame:
    """Take new matches into the stored spots; the ids (cluster_id) of the spots that changed.

    Only the folders of the matches' searches are read. Matches that are stored already change nothing, so an
    interrupted call is simply made again.
    """
    spark = matches.sparkSession
    wins = stored(similarity.windows(matches), "new-windows")
    searches = [r[0] for r in wins.select("search_id").distinct().collect()]
    known = {n: _table(spark, path, n, searches) for n in SCHEMAS}
    _append(stored(wins.join(known["windows"].select("match_id"), "match_id", "left_anti"), "unknown-windows"), path, "windows")

    keys = stored(similarity.run_keys(wins), "new-keys")
    met = stored(keys.join(known["heads"], ["search_id", "key"], "left"), "met-heads")
    fresh = met.filter(F.col("head").isNull()).select("search_id", "key", "match_id")
    labels = stored(known["labels"], "old-labels")
    node = labels.select(F.col("match_id").alias("head"), F.col("cluster_id").alias("_old"))
    old = met.filter(F.col("head").isNotNull()).join(node, "head", "left").select(
        "search_id", F.col("match_id").alias("a"), F.coalesce("_old", "head").alias("b")
    )
    own = labels.select(F.col("match_id").alias("a"), F.col("cluster_id").alias("_own"))
    # A match that is stored already stands for its spot.
    old = old.join(own, "a", "left").select("search_id", F.coalesce("_own", "a").alias("a"), "b")
    new = star_links(fresh, ["search_id", "key"], "match_id").join(
        wins.select(F.col("match_id").alias("a"), "search_id"), "a"
    ).select("search_id", "a", "b")
    links = stored(old.unionByName(new).filter("a <> b").distinct(), "new-links")
    comps = stored(connected_components(links.select("a", "b")), "new-components")
    owners = links.select("search_id", F.explode(F.array("a", "b")).alias("id")).distinct()

    to = comps.select(F.col("id").alias("cluster_id"), F.col("component").alias("_to"))
    moved = labels.join(to, "cluster_id", "left").select("match_id", F.coalesce("_to", "cluster_id").alias("cluster_id"), "search_id")
    first = comps.join(owners, "id").select(F.col("id").alias("match_id"), F.col("component").alias("cluster_id"), "search_id")
    now = stored(
        moved.unionByName(first.join(labels.select("match_id"), "match_id", "left_anti")), "new-labels"
    )
    touched = stored(comps.select(F.col("component").alias("cluster_id")).distinct(), "touched-spots")
    again = (
        _table(spark, path, "windows", searches)
        .join(now.join(shipped(touched), "cluster_id", "left_semi").select("match_id", "cluster_id"), "match_id")
    )
    changed = similarity.fragments_of(stored(again, "touched-members")).join(
        now.select("cluster_id", "search_id").distinct(), "cluster_id"
    )
    # A spot that went into another one, or has changed, gives up its fragment.
    kept = known["fragments"].join(comps.select(F.col("id").alias("cluster_id")), "cluster_id", "left_anti")
    fragments = stored(kept.unionByName(changed.select("cluster_id", "common_fragment", "search_id")), "new-fragments")

    mine = wins.select("search_id").distinct()
    _append(stored(fresh.groupBy("search_id", "key").agg(F.min("match_id").alias("head")), "new-heads"), path, "heads")
    replace_parts(fragments, mine, f"{path}/fragments", "search_id")
    replace_parts(now, mine, f"{path}/labels", "search_id")
    return touched


def replace_searches(matches: DataFrame, searches: DataFrame, path: str) -> None:
    """A rescan: what is stored of these searches gives way to the spots of the given matches."""
    spark = matches.sparkSession
    for r in searches.select("search_id").distinct().collect():  # one folder each
        for name in SCHEMAS:
            remove(f"{path}/{name}/search_id={r['search_id']}", spark)
    add_matches(matches.join(searches.select("search_id").distinct(), "search_id", "left_semi"), path)


def read_members(spark: SparkSession, path: str, searches: list[int] | None = None) -> DataFrame:
    """Members of the stored spots, as `similarity.cluster_members` gives them for all matches at once."""
    windows, labels, fragments = (_table(spark, path, n, searches) for n in ("windows", "labels", "fragments"))
    members = stored(windows.join(labels.select("match_id", "cluster_id"), "match_id"), "stored-members")
    return similarity.lowest_ids(similarity.merged(members, fragments.drop("search_id")))
