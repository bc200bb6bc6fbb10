"""Near-duplicate spots among the matches of a search.

Two matches are the same spot when, lined up on a mention of the keyword, at least 12 words around it
agree (the mention counts as one). Lined-up runs are found by equality of keys instead of pair by
pair: a run of 12 exists exactly when both texts share, for some l, the l words before and the 11 - l
words after the mention. Groups of equal keys are then connected by star links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediawatch.functions import text as T
from mediawatch.operators.graph import connected_components, star_links
from mediawatch.scale import shipped, stored

# Fixed values.
SHINGLE = 5
MIN_WORDS = 12
SIDE = 50
FRAGMENT_WORDS = 26
FULL_SPAN = 0.9
MIN_SHOWN = 3
SHOWN_CLUSTERS = 150


def windows(matches: DataFrame) -> DataFrame:
    """Each match's content words within 50 of its first mention, and the mentions inside.

    A text that never mentions the keyword word by word is centred on its middle.
    """
    text = F.concat_ws(" ", "prev_text", "cur_text", "next_text")
    kw = F.transform(T.words(F.col("keyword")), T.fold_word)
    glued = T.glue_context(F.col("prev_text"), F.col("cur_text"), F.col("next_text"))

    def cut(cw: Column) -> Column:
        n = F.size(cw)

        def around(pos: Column) -> Column:
            anchor = F.coalesce(F.get(pos, F.lit(0)), F.floor(n / 2).cast("int"))
            start = F.greatest(anchor - SIDE, F.lit(0))
            end = F.least(anchor + SIDE + 1, n)
            size = F.greatest(end - start, F.lit(0))
            inside = F.transform(F.filter(pos, lambda p: (p >= start) & (p < end)), lambda p: p - start)
            return F.struct(
                F.slice(cw["orig"], start + 1, size).alias("orig"),
                F.slice(cw["norm"], start + 1, size).alias("norm"),
                F.when(F.size(inside) > 0, inside).otherwise(F.array(anchor - start)).alias("anchors"),
            )

        return T.let(T.keyword_positions(cw["norm"], kw), around)

    return matches.select(
        "search_id",
        "match_id",
        "keyword",
        "channel_name",
        "ts",
        F.length(glued).alias("text_len"),
        T.let(T.content_words(text), cut).alias("_w"),
    ).select("search_id", "match_id", "keyword", "channel_name", "ts", "text_len", "_w.*")


def _runs(norm: str) -> Column:
    """Every 5-word run of a window, in order."""
    starts = F.when(
        F.size(norm) >= SHINGLE, F.sequence(F.lit(1), F.greatest(F.size(norm) - SHINGLE + 1, F.lit(1)))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(norm, i, SHINGLE), " "))


def shingle_counts(wins: DataFrame, max_docs: int | None = None) -> DataFrame:
    """Shingles held by at least two matches of a search; all are `usable` unless `max_docs` sets a limit."""
    held = wins.select("search_id", F.explode(F.array_distinct(_runs("norm"))).alias("shingle"))
    counts = held.groupBy("search_id", "shingle").agg(F.count(F.lit(1)).alias("n_docs")).filter("n_docs >= 2")
    usable = F.col("n_docs") <= max_docs if max_docs is not None else F.lit(True)
    return counts.withColumn("usable", usable)


def _held_by(wins: DataFrame, asked: DataFrame, max_docs: int) -> DataFrame:
    """(search_id, shingle) of those asked for that at most `max_docs` matches of the search hold."""
    held = wins.select("search_id", F.explode(F.array_distinct(_runs("norm"))).alias("shingle"))
    met = held.join(shipped(stored(asked.distinct(), "asked-shingles")), ["search_id", "shingle"], "left_semi")
    return met.groupBy("search_id", "shingle").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= max_docs).drop("n")


def spot_links(
    wins: DataFrame, min_words: int = MIN_WORDS, max_docs: int | None = None
) -> DataFrame:
    """Links between matches that share a run of `min_words` around a mention.

    Matches meet on the digests of their runs (`run_keys`). With `max_docs` a link also needs a shared shingle held by at
    most so many matches: a key all of whose inner shingles are held by more is then grouped once more by each
    usable shingle of its matches. Only the shingles inside shared keys, and of such matches, are counted.
    """
    if max_docs is None:
        return star_links(run_keys(wins, min_words).filter("search_id is not null"), ["search_id", "key"], "match_id")
    placed = F.struct("match_id", "ia", "l").alias("_at")
    keys = stored(_placed_keys(wins, min_words).filter("search_id is not null"), "spot-keys")
    shared = stored(
        keys.groupBy("search_id", "key").agg(F.min(placed).alias("_at"), F.max("match_id").alias("_last"))
        .filter(F.col("_at.match_id") < F.col("_last")).select("search_id", "key", "_at.*"), "shared-keys",
    )
    # A key fixes its words, so one match tells the shingles inside it.
    ia, l, r = F.col("ia"), F.col("l"), F.lit(min_words - 1) - F.col("l")
    inner = F.filter(
        F.transform(_runs("norm"), lambda s, p: F.struct(s.alias("shingle"), p.alias("p"))),
        lambda s: ((s["p"] >= ia - l) & (s["p"] <= ia - SHINGLE)) | ((s["p"] > ia) & (s["p"] <= ia + r - SHINGLE + 1)),
    )
    told = wins.select("search_id", "match_id", "norm").join(shared, ["search_id", "match_id"])
    held = stored(told.select("search_id", "key", F.explode(inner["shingle"]).alias("shingle")).distinct(), "key-shingles")
    usable = _held_by(wins, held.select("search_id", "shingle"), max_docs)
    direct = stored(held.join(usable, ["search_id", "shingle"]).select("search_id", "key").distinct(), "direct-keys")
    members = keys.join(shared.select("search_id", "key"), ["search_id", "key"]).select("search_id", "key", "match_id").distinct()
    links = star_links(members.join(direct, ["search_id", "key"]), ["search_id", "key"], "match_id")
    rest = stored(members.join(direct, ["search_id", "key"], "left_anti"), "indirect-keys")
    if rest.isEmpty():
        return links
    own = rest.select("search_id", "match_id").distinct()
    runs = wins.join(own, ["search_id", "match_id"], "left_semi").select(
        "search_id", "match_id", F.explode(F.array_distinct(_runs("norm"))).alias("shingle")
    )
    open_runs = runs.join(_held_by(wins, runs.select("search_id", "shingle"), max_docs), ["search_id", "shingle"])
    via = rest.join(open_runs.distinct(), ["search_id", "match_id"])
    indirect = star_links(via.select("search_id", "key", "match_id", "shingle"), ["search_id", "key", "shingle"], "match_id")
    return links.unionByName(indirect).distinct()


def _run(a: Column, b: Column, ia: Column, ib: Column, step: int, limit: Column) -> Column:
    """Equal words counted outwards from the two mentions."""
    return F.aggregate(
        F.when(limit > 0, F.sequence(F.lit(1), F.greatest(limit, F.lit(1)))).otherwise(F.array().cast("array<int>")),
        F.lit(0),
        lambda n, d: F.when((n == d - 1) & (F.get(a, ia + d * step) == F.get(b, ib + d * step)), n + 1).otherwise(n),
    )


def best_match(a: Column, anchors_a: Column, b: Column, anchors_b: Column) -> Column:
    """struct(total, start, stop) of the longest lined-up run, placed in `a`; first mentions win ties."""

    def scored(ia: Column, ib: Column) -> Column:
        left = _run(a, b, ia, ib, -1, F.least(ia, ib))
        right = _run(a, b, ia, ib, 1, F.least(F.size(a) - 1 - ia, F.size(b) - 1 - ib))
        return F.struct(
            (left + right + 1).alias("total"),
            (-ia).alias("na"),
            (-ib).alias("nb"),
            (ia - left).alias("start"),
            (ia + right).alias("stop"),
        )

    every = F.flatten(
        F.transform(anchors_a, lambda ia: F.transform(anchors_b, lambda ib: scored(ia, ib)))
    )
    return T.let(F.array_max(every), lambda m: F.struct(m["total"], m["start"], m["stop"]))


def scored_links(wins: DataFrame, links: DataFrame) -> DataFrame:
    """The links with the length of their longest lined-up run."""
    left = wins.select(F.col("match_id").alias("a"), F.col("norm").alias("na"), F.col("anchors").alias("aa"))
    right = wins.select(F.col("match_id").alias("b"), F.col("norm").alias("nb"), F.col("anchors").alias("ab"))
    score = best_match(F.col("na"), F.col("aa"), F.col("nb"), F.col("ab"))["total"]
    return links.join(left, "a").join(right, "b").select("a", "b", score.alias("score"))


def _against_reference(members: DataFrame) -> DataFrame:
    """Every other member beside its cluster's reference, the first longest text, with the best run `m`."""
    order = F.struct((-F.col("text_len")).alias("n"), "ts", "match_id")
    ref = members.groupBy("cluster_id").agg(
        F.min_by(F.struct("match_id", "orig", "norm", "anchors"), order).alias("ref")
    )
    m = best_match(F.col("ref.norm"), F.col("ref.anchors"), F.col("norm"), F.col("anchors"))
    return members.join(ref, "cluster_id").filter(F.col("match_id") != F.col("ref.match_id")).withColumn("m", m)


def scored_members(members: DataFrame) -> DataFrame:
    """(cluster_id, match_id, score): longest lined-up run of each member with the cluster's longest text."""
    return _against_reference(members).select("cluster_id", "match_id", F.col("m.total").cast("int").alias("score"))


def fragments_of(members: DataFrame) -> DataFrame:
    """(cluster_id, common_fragment): the run the longest text shares best with another member.

    The order of members is (ts, match_id): the first longest text is the reference and the first
    best run wins, found in salted parts of the cluster first. A run that fills nearly the whole window is a
    repeated block and is cut to 26 words.
    """
    ranked = F.struct((-F.col("m.total")).alias("n"), "ts", "match_id")
    best = (
        _against_reference(members)
        .groupBy("cluster_id", F.pmod(F.xxhash64("match_id"), F.lit(64)).alias("_part"))
        .agg(F.min_by(F.struct("m", "ref"), ranked).alias("_b"), F.min(ranked).alias("_r"))
        .groupBy("cluster_id").agg(F.min_by("_b", "_r").alias("_b"))
        .select("cluster_id", "_b.m", "_b.ref")
    )
    start, stop = F.col("m.start"), F.col("m.stop")
    filled = (stop - start + 1) >= FULL_SPAN * (2 * SIDE + 1)
    center = F.coalesce(
        F.get(F.filter("ref.anchors", lambda p: (p >= start) & (p <= stop)), F.lit(0)),
        F.floor((start + stop) / 2).cast("int"),
    )
    cut_start = F.when(filled, F.greatest(start, center - FRAGMENT_WORDS // 2)).otherwise(start)
    cut_stop = F.when(filled, F.least(stop, cut_start + FRAGMENT_WORDS - 1)).otherwise(stop)
    words = F.slice("ref.orig", cut_start + 1, cut_stop - cut_start + 1)
    fragment = F.when(F.col("m.total") >= MIN_WORDS, F.array_join(words, " ")).otherwise("")
    return best.select("cluster_id", fragment.alias("common_fragment"))


def clustered(wins: DataFrame, max_docs: int | None = None) -> DataFrame:
    """Windows that belong to a spot, with its cluster_id (the lowest match id) before merging."""
    comps = connected_components(spot_links(wins, max_docs=max_docs))
    return wins.join(
        comps.select(F.col("id").alias("match_id"), F.col("component").alias("cluster_id")), "match_id"
    )


def run_keys(wins: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(search_id, key, match_id): a key for every run of `min_words` around a mention, as `spot_links` compares them.

    Made from a match alone, whatever other matches there are; keys are digests.
    """
    return _placed_keys(wins, min_words).select("search_id", "key", "match_id").distinct()


def _placed_keys(wins: DataFrame, min_words: int) -> DataFrame:
    """(search_id, match_id, ia, l, key): the keys with the mention's place and the words before it."""
    need = min_words - 1
    at = wins.select("search_id", "match_id", "norm", F.explode("anchors").alias("ia"))
    ia, lefts = F.col("ia"), F.sequence(F.greatest(F.lit(0), need - (F.size("norm") - 1 - F.col("ia"))), F.least(F.col("ia"), F.lit(need)))
    room = F.size("norm") >= min_words

    def key(l: Column) -> Column:
        before, after = F.slice("norm", ia - l + 1, l), F.slice("norm", ia + 2, need - l)
        return F.md5(F.concat_ws(" ", l.cast("string"), F.array_join(before, " "), F.lit("|"), F.array_join(after, " ")))

    keyed = F.transform(lefts, lambda l: F.struct(l.alias("l"), key(l).alias("key")))
    return at.filter(room & (F.col("ia") >= 0)).select("search_id", "match_id", "ia", F.inline(keyed))


def merged(members: DataFrame, fragments: DataFrame | None = None) -> DataFrame:
    """Members after clusters whose fragments share a 12-word run became one.

    Two word lists share a contiguous run of 12 exactly when they share a 12-gram. Fragments (cluster_id,
    common_fragment) are found anew unless given.
    """
    spots = members.select("cluster_id", "search_id").distinct()
    norm = F.transform(T.words(F.col("common_fragment")), T.fold_word)
    grams = F.when(F.size("_n") >= MIN_WORDS, T.shingles(F.col("_n"), MIN_WORDS)).otherwise(
        F.array().cast("array<string>")
    )
    runs = (
        (fragments_of(members) if fragments is None else fragments)
        .join(spots, "cluster_id")
        .withColumn("_n", norm)
        .select("search_id", "cluster_id", F.explode(grams).alias("gram"))
    )
    same = connected_components(star_links(runs, ["search_id", "gram"], "cluster_id"))
    to = same.select(F.col("id").alias("cluster_id"), F.col("component").alias("_to"))
    return members.join(to, "cluster_id", "left").withColumn("cluster_id", F.coalesce("_to", "cluster_id")).drop("_to")


def cluster_members(wins: DataFrame, max_docs: int | None = None) -> DataFrame:
    """Final members: cluster_id is the lowest match id of the merged cluster."""
    return lowest_ids(merged(stored(clustered(wins, max_docs), "spot-members")))


def lowest_ids(merged_members: DataFrame) -> DataFrame:
    rows = stored(merged_members, "merged-members")
    lowest = rows.groupBy("cluster_id").agg(F.min("match_id").alias("_low"))
    return rows.join(lowest, "cluster_id").withColumn("cluster_id", F.col("_low")).drop("_low")


def cluster_report(members: DataFrame) -> DataFrame:
    """One row per spot: size, fragment, channels by count, first and last time, largest first."""
    per_channel = members.groupBy("search_id", "cluster_id", F.coalesce("channel_name", F.lit("?")).alias("name")).agg(
        F.count(F.lit(1)).alias("count"), F.min("ts").alias("_f"), F.max("ts").alias("_l")
    )
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "name", "count")))
    return (
        per_channel.groupBy("search_id", "cluster_id")
        .agg(
            F.sum("count").alias("size"),
            F.transform(ranked, lambda c: F.struct(c["name"].alias("name"), c["count"].alias("count"))).alias("channels"),
            F.min("_f").alias("first_ts"),
            F.max("_l").alias("last_ts"),
        )
        .join(fragments_of(members), "cluster_id", "left")
    )


def unique_matches(matches: DataFrame, members: DataFrame) -> DataFrame:
    """Matches in no spot."""
    return matches.join(members.select("match_id"), "match_id", "left_anti")


def shown_clusters(report: DataFrame, min_size: int = MIN_SHOWN, cap: int | None = SHOWN_CLUSTERS) -> DataFrame:
    """Display list of each search: its largest spots, `cap` of them (None: all)."""
    w = Window.partitionBy("search_id").orderBy(F.col("size").desc(), "first_ts", "cluster_id")
    return (
        report.filter(F.col("size") >= min_size)
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= cap if cap is not None else F.lit(True))
    )


def display_counts(
    report: DataFrame, unique: DataFrame, min_size: int = MIN_SHOWN, cap: int = SHOWN_CLUSTERS, unique_cap: int | None = None
) -> DataFrame:
    """What a display list leaves out: hidden pairs, spots beyond its cap, unique matches beyond one for them."""
    spots = report.groupBy("search_id").agg(
        F.count_if(F.col("size") == 2).alias("n_pairs"), F.count_if(F.col("size") >= min_size).alias("n_shown")
    )
    singles = unique.groupBy("search_id").agg(F.count(F.lit(1)).alias("n_unique"))
    return spots.join(singles, "search_id", "full").na.fill(0).select(
        "search_id",
        (F.col("n_pairs") if min_size > 2 else F.lit(0)).alias("pairs_hidden"),
        F.greatest(F.col("n_shown") - cap, F.lit(0)).alias("clusters_truncated"),
        (F.greatest(F.col("n_unique") - unique_cap, F.lit(0)) if unique_cap is not None else F.lit(0).cast("bigint")).alias("unique_truncated"),
    )


def match_marks() -> list[Column]:
    """What a stored report remembers of a search's matches: their number, and a mark that any other set changes."""
    return [F.count(F.lit(1)).alias("match_count"), F.bit_xor(F.xxhash64("match_id", "cur_text")).alias("match_mark")]


def staleness(stored: DataFrame, matches: DataFrame) -> DataFrame:
    """Stored reports against the matches of today. stored: search_id, match_count, generated_at and, where the report
    has one, match_mark: then a match exchanged for another, or a changed text, counts as well."""
    number, mark = match_marks()
    marked = "match_mark" in stored.columns
    aggregates = [number.alias("current_count"), *([mark.alias("_mark")] if marked else [])]
    both = stored.join(matches.groupBy("search_id").agg(*aggregates), "search_id", "left").na.fill(0, ["current_count"])
    stale = F.col("match_count") != F.col("current_count")
    if marked:
        stale = stale | ~F.col("match_mark").eqNullSafe(F.col("_mark"))
    return both.withColumn("stale", stale).drop("_mark")


def to_generate(searches: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Searches whose report must be computed: all when forced, else those without a stored one.

    A stored report whose match count moved on is still served, with its `stale` flag.
    """
    ids = searches.select("search_id")
    return ids if force else ids.join(stored.select("search_id"), "search_id", "left_anti")


def similarity_report(matches: DataFrame, max_docs: int | None = None) -> dict[str, DataFrame]:
    """Spots of all the given searches in one job: clusters, their members and the unique matches."""
    wins = stored(windows(matches), "spot-windows")
    members = stored(cluster_members(wins, max_docs), "spot-clusters")
    return {
        "clusters": cluster_report(members),
        "members": members.select("search_id", "cluster_id", "match_id", "channel_name", "keyword", "ts"),
        "unique": unique_matches(matches, members),
    }
