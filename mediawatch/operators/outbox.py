"""Alert and report messages as tables for a separate sender."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediawatch.functions import text as T
from mediawatch.operators import ordered
from mediawatch.scale import stored

REPORT_ROWS = 1000
BLOCK_CHARS = 3800


def _glued() -> Column:
    return T.glue_context(F.col("prev_text"), F.col("cur_text"), F.col("next_text"))


def _chat_escape(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def alerts(
    matches: DataFrame, searches: DataFrame, users: DataFrame, global_chat: str | None = None
) -> DataFrame:
    """One row per message of newly stored matches: email in immediate mode, chat where asked for.

    The chat goes to the owner's id, else to the global one, else nowhere.
    """
    flags = searches.select(
        "search_id",
        F.col("name").alias("search_name"),
        "user_id",
        F.when(F.col("delivery_mode") == "immediate", F.nullif("report_email", F.lit(""))).alias("_email"),
        "notify_chat",
    ).join(users.select("user_id", "chat_id"), "user_id")
    own_chat = F.coalesce(F.nullif("chat_id", F.lit("")), F.lit(global_chat))
    rows = matches.join(flags, "search_id").withColumn("_text", _glued())
    email = F.struct(
        F.lit("email").alias("channel"),
        F.col("_email").alias("recipient"),
        F.concat(F.lit('Alert: "'), "keyword", F.lit('" heard on '), "channel_name").alias("subject"),
        F.col("_text").alias("body"),
    )
    chat = F.struct(
        F.lit("chat").alias("channel"),
        F.when(F.col("notify_chat"), own_chat).alias("recipient"),
        F.col("search_name").alias("subject"),
        F.substring("_text", 1, 300).alias("body"),
    )
    return (
        rows.select("match_id", "search_id", "keyword", "channel_name", "ts", F.explode(F.array(email, chat)).alias("_m"))
        .filter(F.col("_m.recipient").isNotNull())
        .select("match_id", "search_id", "keyword", F.col("channel_name").alias("station"), "ts", "_m.*")
    )


def webhook_payloads(matches: DataFrame, searches: DataFrame) -> DataFrame:
    """JSON bodies of match notifications, text cut to 300 characters."""
    named = matches.join(searches.select("search_id", F.col("name").alias("search_name")), "search_id")
    body = F.struct(
        F.lit("match").alias("event"),
        "search_name",
        "keyword",
        "channel_name",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.substring(_glued(), 1, 300).alias("matched_text"),
    )
    return named.select("match_id", F.to_json(body).alias("payload"))


def phone_payloads(matches: DataFrame, searches: DataFrame) -> DataFrame:
    """Phone messages of match notifications, text cut to 200 characters."""
    named = matches.join(searches.select("search_id", F.col("name").alias("search_name")), "search_id")
    return named.select(
        "match_id",
        F.concat_ws(
            "\n",
            "search_name",
            F.concat(F.lit("*"), "keyword", F.lit("*")),
            "channel_name",
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
            F.concat(F.lit("_"), F.substring(_glued(), 1, 200), F.lit("_")),
        ).alias("message"),
    )


def email_report(matches: DataFrame, rows: int = REPORT_ROWS) -> DataFrame:
    """One message body per search: the first 1000 matches by detection time, text cut to 140."""
    w = Window.partitionBy("search_id").orderBy("found_at", "match_id")
    line = F.concat_ws(
        "|",
        "keyword",
        "channel_name",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.substring(_glued(), 1, 140),
    )
    top = (
        matches.select("search_id", "found_at", "match_id", line.alias("line"))
        .withColumn("_n", F.row_number().over(w))
        .filter(F.col("_n") <= rows)
    )
    bodies = top.groupBy("search_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array_sort(F.collect_list(F.struct("_n", "line"))).alias("_l"),
    )
    totals = matches.groupBy("search_id").agg(F.count(F.lit(1)).alias("total"))
    return bodies.join(totals, "search_id").select(
        "search_id", "n_rows", "total", F.array_join("_l.line", "\n").alias("body")
    )


def chat_lines(matches: DataFrame) -> DataFrame:
    line = F.concat(
        F.lit("• "),
        F.date_format("ts", "yyyy-MM-dd HH:mm"),
        F.lit(" · "),
        _chat_escape(F.col("channel_name")),
        F.lit(" · <b>"),
        _chat_escape(F.col("keyword")),
        F.lit("</b>: <i>"),
        _chat_escape(F.substring(_glued(), 1, 100)),
        F.lit("</i>"),
    )
    return matches.select("search_id", "found_at", "match_id", line.alias("line"))


def chat_report(matches: DataFrame, block: int = BLOCK_CHARS) -> DataFrame:
    """Match lines of each search packed in order into messages of at most `block` characters.

    Every line has a place on its search's running length; a message starts at the first line that
    would overflow the one before. Running lengths are summed by day, hour, instant and part of the match
    ids (a backfill gives all its matches one instant), so no task holds a whole search.
    """
    lines = stored(
        chat_lines(matches)
        .withColumn("_len", F.length("line") + 1)
        .withColumn("_day", F.to_date("found_at"))
        .withColumn("_hour", F.hour("found_at"))
        .withColumn("_shelf", F.shiftright("match_id", 40))
        .withColumn("_part", F.shiftright("match_id", 20)),
        "chat-lines",
    )
    placed = ordered.running_total(
        lines, "_len", ["_day", "_hour", "found_at", "_shelf", "_part"], ["match_id"], "start_at", keys=["search_id"]
    )
    placed = stored(
        placed.withColumn("start_at", F.col("start_at").cast("bigint"))
        .withColumn("stop_at", F.col("start_at") + F.col("_len"))
        .withColumn("_on", F.lit(True))
        .select("search_id", "match_id", "line", "start_at", "stop_at", "_on"),
        "placed-lines",
    )
    starts = ordered.greedy_starts(
        placed, ["search_id"], "start_at", "stop_at", "match_id", "_on", block, 100 * block
    ).select("search_id", F.col("start_at").alias("block"))
    owned = ordered.asof_last(
        placed.select("search_id", "start_at", "line"), starts, ["search_id"], "start_at", "block", [],
        out="_block", bucket=lambda c: F.floor(c / (100 * block)).cast("bigint"),
    )
    return (
        owned.groupBy("search_id", F.col("_block.at").alias("block"))
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.array_sort(F.collect_list(F.struct("start_at", "line"))).alias("_l"),
        )
        .select("search_id", "block", "n_lines", F.array_join("_l.line", "\n").alias("body"))
    )
