"""Search detail, dashboard and export: facets, statistics, enrichment and paging of matches."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediawatch.functions import text as T
from mediawatch.functions.timefn import (
    epoch_seconds,
    floor_second,
    media_type,
    precise_timestamp,
    seconds,
)
from mediawatch.operators import guide
from mediawatch.scale import shipped, stored

CONTEXT_SECONDS = 15
#: Days that a plan names one by one.
LISTED_DAYS = 400
STATUS_ORDER = {"active": 0, "paused": 1, "completed": 2}


def owned_searches(searches: DataFrame, user_id: int, is_admin: bool) -> DataFrame:
    """Administrators see every search, users their own."""
    return searches if is_admin else searches.filter(F.col("user_id") == user_id)


def facet_filter(
    matches: DataFrame,
    keywords: list[str] | None = None,
    channels: list[str] | None = None,
    media: list[str] | None = None,
    date_from: date | str | None = None,
    date_to: date | str | None = None,
    titles: list[str] | None = None,
    programmes: DataFrame | None = None,
) -> DataFrame:
    """Matches that satisfy every facet given; an absent facet does not restrict."""
    out = matches
    if keywords:
        out = out.filter(F.col("keyword").isin(keywords))
    if channels:
        out = out.filter(F.col("channel_name").isin(channels))
    if media:
        out = out.filter(media_type(F.col("channel_id")).isin(media))
    if date_from:
        out = out.filter(F.col("ts") >= F.lit(date_from).cast("date"))
    if date_to:
        out = out.filter(F.col("ts") < F.date_add(F.lit(date_to).cast("date"), 1))
    if "date" in out.columns:  # written by day: only those folders are read
        out = out.filter(F.col("date") >= F.lit(date_from).cast("date")) if date_from else out
        out = out.filter(F.col("date") <= F.lit(date_to).cast("date")) if date_to else out
    if titles:
        out = guide.during_programmes(out, programmes, titles)
    return out


def enrich(matches: DataFrame, searches: DataFrame, side: int = 50) -> DataFrame:
    """Add word_idx, precise_ts, centered_text and channel_kind.

    The keyword is located in the chunk it was found in, never in its neighbours, and the index is
    then shifted by the words of the previous chunk and its mark.
    """
    flags = searches.select("search_id", "phonetic", "whole_word")
    phonetic = F.col("phonetic")
    cur = T.words(F.col("cur_text"))
    rows = (
        matches.join(flags, "search_id")
        .withColumn("_cw", cur)
        .withColumn("_nt", T.aligned_norm_text(F.col("_cw"), phonetic))
        .withColumn("_kt", T.aligned_norm_text(T.words(F.col("keyword")), phonetic))
        .withColumn("word_idx", T.locate_keyword(F.col("_nt"), F.col("_kt"), F.col("whole_word")))
    )
    nothing = F.array().cast("array<string>")
    prev = F.when(
        F.col("prev_text").isNotNull(),
        F.concat(T.words(F.col("prev_text")), F.array(F.lit(T.MARK_PREV))),
    ).otherwise(nothing)
    nxt = F.when(
        F.col("next_text").isNotNull(),
        F.concat(F.array(F.lit(T.MARK_NEXT)), T.words(F.col("next_text"))),
    ).otherwise(nothing)
    return (
        rows.withColumn("_pw", prev)
        .withColumn("_all", F.concat("_pw", "_cw", nxt))
        .withColumn("precise_ts", precise_timestamp(F.col("ts"), F.col("word_idx"), F.size("_cw")))
        .withColumn(
            "centered_text",
            T.center_words(F.col("_all"), F.col("word_idx") + F.size("_pw"), side),
        )
        .withColumn("channel_kind", media_type(F.col("channel_id")))
        .drop("_cw", "_nt", "_kt", "_pw", "_all", "phonetic", "whole_word")
    )


def nearby_text(matches: DataFrame, chunks: DataFrame, window: int = CONTEXT_SECONDS) -> DataFrame:
    """Speech within `window` seconds of each match on its channel, in time order, as `context`.

    Bounds are whole seconds, upper one exclusive. The equi key is (channel, half minute). The matches' half minutes
    are shipped to the texts (beyond the bounds of `shipped` exchanged with them); of chunks kept by day only the
    matches' days are read, and their neighbours at midnight.
    """
    width = 2 * window
    at = floor_second(F.col("ts"))
    spots = stored(
        matches.select("match_id", "channel_id", (at - seconds(window)).alias("_lo"), (at + seconds(window)).alias("_hi"))
        .withColumn("_first", F.floor(epoch_seconds(F.col("_lo")) / width).cast("bigint"))
        .withColumn("_b", F.explode(F.sequence(F.col("_first"), F.col("_first") + 1))),
        "match-spots",
    )
    near = (
        _days_of(chunks, spots).filter(T.is_speech(F.col("text")))
        .select("channel_id", F.col("ts").alias("_cts"), F.col("id").alias("_cid"), "text")
        .withColumn("_b", F.floor(epoch_seconds(F.col("_cts")) / width).cast("bigint"))
    )
    said = F.array_sort(F.collect_list(F.struct("_cts", "_cid", "text")))
    inside = (F.col("_cts") >= F.col("_lo")) & (F.col("_cts") < F.col("_hi"))
    context = (
        near.join(shipped(spots), ["channel_id", "_b"])
        .filter(inside)
        .groupBy("match_id")
        .agg(said.alias("_s"))
        .select("match_id", F.array_join("_s.text", " ").alias("context"))
    )
    return matches.join(context, "match_id", "left").na.fill("", ["context"])


def _days_of(chunks: DataFrame, spots: DataFrame) -> DataFrame:
    """The chunks of the spots' days, as a list of folders, or as a span if the list is long."""
    if "date" not in chunks.columns:
        return chunks
    days = spots.select(F.explode(F.array(F.to_date("_lo"), F.to_date("_hi"))).alias("d")).distinct()
    own = [r["d"] for r in days.limit(LISTED_DAYS + 1).collect()]
    if len(own) <= LISTED_DAYS:
        return chunks.filter(F.col("date").isin(own))
    span = days.agg(F.min("d").alias("lo"), F.max("d").alias("hi")).first()
    return chunks.filter(F.col("date").between(F.lit(span["lo"]), F.lit(span["hi"])))


def export_rows(
    matches: DataFrame, searches: DataFrame, programmes: DataFrame, chunks: DataFrame
) -> DataFrame:
    """Report rows: signal time, channel, programme, keyword, text, nearby text, detection time."""
    named = matches.join(searches.select("search_id", F.col("name").alias("search_name")), "search_id")
    rows = nearby_text(guide.with_programme(named, programmes), chunks)
    return rows.select(
        "search_id",
        T.sheet_name(F.col("search_name"), F.concat(F.lit("Search_"), F.col("search_id").cast("string"))).alias("sheet"),
        "match_id",
        floor_second(F.col("ts")).alias("signal_time"),
        F.col("channel_name").alias("channel"),
        "programme",
        "keyword",
        T.glue_context(F.col("prev_text"), F.col("cur_text"), F.col("next_text")).alias("matched_text"),
        "context",
        floor_second(F.col("found_at")).alias("found_at"),
    )


def counts_by(matches: DataFrame, column: str) -> DataFrame:
    """Matches per (search, value), the most frequent first."""
    return matches.groupBy("search_id", column).agg(F.count(F.lit(1)).alias("n"))


def heatmap(matches: DataFrame, searches: DataFrame, today: Column) -> DataFrame:
    """Dense day x hour counts from each search's first day to today or its last day."""
    last = F.greatest(F.least(today, F.col("date_end")), F.col("date_start"))
    cells = (
        searches.select("search_id", F.explode(F.sequence(F.col("date_start"), last)).alias("day"))
        .withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    )
    counts = matches.groupBy("search_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return cells.join(counts, ["search_id", "day", "hour"], "left").na.fill(0, ["n"])


def heatmap_rows(cells: DataFrame) -> DataFrame:
    """The heatmap as one 24-element array per day, with the search's maximum."""
    days = cells.groupBy("search_id", "day").agg(
        F.array_sort(F.collect_list(F.struct("hour", "n")))["n"].alias("hours"), F.max("n").alias("_m")
    )
    top = days.groupBy("search_id").agg(F.max("_m").alias("max_n"))
    return days.drop("_m").join(top, "search_id")


def search_counts(searches: DataFrame, matches: DataFrame) -> DataFrame:
    """Searches with their number of matches (zero if none)."""
    n = matches.groupBy("search_id").agg(F.count(F.lit(1)).alias("n_matches"))
    return searches.join(n, "search_id", "left").na.fill(0, ["n_matches"])


def user_counts(users: DataFrame, searches: DataFrame) -> DataFrame:
    n = searches.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_searches"))
    return users.join(n, "user_id", "left").na.fill(0, ["n_searches"])


def search_list(searches: DataFrame, matches: DataFrame, users: DataFrame) -> DataFrame:
    """Dashboard list: live searches first, newest first within a status."""
    rank = F.lit(3)
    for status, pos in STATUS_ORDER.items():
        rank = F.when(F.col("status") == status, pos).otherwise(rank)
    owner = users.select("user_id", F.col("name").alias("owner"))
    return (
        search_counts(searches, matches)
        .join(owner, "user_id")
        .withColumn("status_rank", rank)
        .orderBy("status_rank", F.col("created_at").desc())
    )


def dashboard_totals(searches: DataFrame, matches: DataFrame, users: DataFrame, today: Column) -> DataFrame:
    live = (F.col("status") == "active") & (F.col("date_end") >= today)
    totals = search_counts(searches, matches).agg(
        F.count(F.lit(1)).alias("total_searches"),
        F.count_if(live).alias("active_searches"),
        F.sum("n_matches").alias("total_matches"),
    )
    return totals.withColumn("total_users", users.agg(F.count(F.lit(1)).alias("n")).scalar())


def recent_matches(matches: DataFrame, searches: DataFrame, users: DataFrame, limit: int = 25) -> DataFrame:
    """Newest matches with search and owner names."""
    named = searches.join(users.select("user_id", F.col("name").alias("owner")), "user_id").select(
        "search_id", F.col("name").alias("search_name"), "owner"
    )
    top = matches.join(named.select("search_id"), "search_id", "left_semi").orderBy(
        F.col("ts").desc(), F.col("match_id").desc()
    ).limit(limit)
    return top.join(named, "search_id")


def match_page(
    matches: DataFrame, searches: DataFrame, search_id: int, page: int = 1, size: int = 50
) -> DataFrame:
    """One page of a search by chunk time, newest first, then put in order of the exact time."""
    rows = (
        matches.filter(F.col("search_id") == search_id)
        .orderBy(F.col("ts").desc(), F.col("match_id").desc())
        .offset((page - 1) * size)
        .limit(size)
    )
    return enrich(rows, searches).orderBy(F.col("precise_ts").desc(), F.col("match_id").desc())


def match_feed(
    matches: DataFrame, search_id: int, after_id: int | None = None, since: str | None = None
) -> DataFrame:
    """Incremental reads of one search: after an id (100), since a detection time (50), or latest 50."""
    own = matches.filter(F.col("search_id") == search_id)
    if after_id is not None:
        return own.filter(F.col("match_id") > after_id).orderBy("match_id").limit(100)
    if since is not None:
        own = own.filter(F.col("found_at") > F.lit(since).cast("timestamp_ntz"))
    return own.orderBy(F.col("found_at").desc(), F.col("match_id").desc()).limit(50)


def report_stats(matches: DataFrame, top: int = 5) -> DataFrame:
    """Per search: every keyword's count and the five busiest channels, ranked."""
    by_kw = counts_by(matches, "keyword").select(
        "search_id", F.lit("keyword").alias("kind"), F.col("keyword").alias("label"), "n"
    )
    by_ch = counts_by(matches, "channel_name").select(
        "search_id", F.lit("channel").alias("kind"), F.col("channel_name").alias("label"), "n"
    )
    w = Window.partitionBy("search_id", "kind").orderBy(F.col("n").desc(), "label")
    ranked = by_kw.unionByName(by_ch).withColumn("rank", F.row_number().over(w))
    return ranked.filter((F.col("kind") == "keyword") | (F.col("rank") <= top))


def facet_values(matches: DataFrame) -> DataFrame:
    """Distinct keywords and channels of each search."""
    kinds = [("keyword", "keyword"), ("channel", "channel_name")]
    parts = [
        matches.select("search_id", F.lit(kind).alias("facet"), F.col(col).alias("value")).distinct()
        for kind, col in kinds
    ]
    return parts[0].unionByName(parts[1])


def search_detail(
    matches: DataFrame,
    searches: DataFrame,
    programmes: DataFrame,
    search_id: int,
    today: Column,
    page: int = 1,
    **facets,
) -> dict[str, DataFrame]:
    """Everything a search page shows, as separate DataFrames over the same matches."""
    own = matches.filter(F.col("search_id") == search_id)
    shown = facet_filter(own, programmes=programmes, **facets)
    one = searches.filter(F.col("search_id") == search_id)
    return {
        "page": guide.with_programme(match_page(shown, searches, search_id, page), programmes),
        "total": shown.agg(F.count(F.lit(1)).alias("total")),
        "total_all": own.agg(F.count(F.lit(1)).alias("total_all")),
        "facets": facet_values(own),
        "titles": guide.programme_titles(own, programmes, guide.TITLES_SHOWN),
        "keyword_stats": counts_by(own, "keyword").orderBy(F.col("n").desc(), "keyword"),
        "channel_stats": counts_by(own, "channel_name").orderBy(F.col("n").desc(), "channel_name"),
        "heatmap": heatmap_rows(heatmap(own, one, today)),
    }
