"""Readers for landed playlists, guides, news, captions, recordings and logs.

Each reader is a thin `read_*` over Spark's file sources and a `*_from` that types its rows, so the
same shaping works on a stream or on rows from elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from mediawatch.functions import text as T
from mediawatch.functions.timefn import caption_duration, caption_end_ms, media_type, parse_guide_ts
from mediawatch.operators.matching import keyword_hits
from mediawatch.operators.recordings import parse_segments

NEWS_ITEMS = 50
# Fixed value: outlet of an item that names none.
NEWS_LABEL = "Google Noticias"


def read_playlists(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True)
    return playlist_from(files.select(F.input_file_name().alias("file"), F.col("value").alias("text")))


def playlist_from(files: DataFrame) -> DataFrame:
    """(file, channel_id, name, url, headers, kind) of each playlist text.

    The name after the first comma of #EXTINF and an optional #EXTHEADER belong to the next address;
    the channel id is the address's place in the whole list. User data in addresses is masked.
    """
    lines = files.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "raw")).withColumn(
        "line", F.regexp_replace("raw", T.EDGE_SPACE, "")
    )
    is_url = (F.col("line") != "") & ~F.startswith("line", F.lit("#"))
    named = F.startswith("line", F.lit("#EXTINF"))
    title = F.trim(F.regexp_extract("line", r",(.+)$", 1))
    per_file = Window.partitionBy("file").orderBy("pos")
    # Playlists are station lists, one file per window; an entry runs from one address to the next.
    tagged = (
        lines.withColumn("_url", is_url)
        .withColumn("_entry", F.coalesce(F.sum(F.col("_url").cast("int")).over(per_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_name", F.when(named, F.struct("pos", title.alias("t"))))
        .withColumn("_head", F.when(F.startswith("line", F.lit("#EXTHEADER:")), F.struct("pos", F.trim(F.substr("line", F.lit(12))).alias("t"))))
    )
    entries = tagged.groupBy("file", "_entry").agg(
        F.max(F.when(F.col("_url"), F.col("line"))).alias("url"),
        F.max("_name")["t"].alias("_n"),
        F.max("_head")["t"].alias("headers"),
    ).filter(F.col("url").isNotNull())
    channel_id = (F.col("_entry") + 1).cast("int")
    fallback = F.concat(F.lit("Canal_"), channel_id.cast("string"))
    return entries.select(
        "file",
        channel_id.alias("channel_id"),
        F.coalesce(F.nullif("_n", F.lit("")), fallback).alias("name"),
        T.mask_user_info(F.col("url")).alias("url"),
        "headers",
        media_type(channel_id).alias("kind"),
    )


def keep_channels(
    roster: DataFrame, only: list[str] | None = None, skip_ids: list[int] | None = None, skip_names: list[str] | None = None
) -> DataFrame:
    """A part of the roster; ids stay those of the whole list."""
    out = roster
    if only:
        out = out.filter(F.col("name").isin(only))
    if skip_ids:
        out = out.filter(~F.col("channel_id").isin(skip_ids))
    if skip_names:
        out = out.filter(~F.col("name").isin(skip_names))
    return out


def full_roster(tv: DataFrame, radio: DataFrame) -> DataFrame:
    """Television and radio channels in one list."""
    cols = ["channel_id", "name", "kind"]
    return tv.select(*cols).unionByName(radio.select(*cols)).orderBy("channel_id")


_PROGRAMME = ST.StructType(
    [
        ST.StructField("_channel", ST.StringType()),
        ST.StructField("_start", ST.StringType()),
        ST.StructField("_stop", ST.StringType()),
        ST.StructField("title", ST.ArrayType(ST.StringType())),
    ]
)
_CHANNEL = ST.StructType(
    [ST.StructField("_id", ST.StringType()), ST.StructField("display-name", ST.ArrayType(ST.StringType()))]
)


def read_guide_channels(spark: SparkSession, path: str) -> DataFrame:
    """(guide_id, file_pos, haystack) of the guide's channel elements."""
    rows = spark.read.format("xml").option("rowTag", "channel").schema(_CHANNEL).load(path)
    named = rows.filter((F.coalesce("_id", F.lit("")) != "") & (F.size("display-name") > 0))
    return named.select(
        F.col("_id").alias("guide_id"),
        F.monotonically_increasing_id().alias("file_pos"),
        F.concat_ws(" ", "_id", "display-name").alias("haystack"),
    )


def read_guide_programmes(spark: SparkSession, path: str, tz: str = "UTC", source: str = "guide") -> DataFrame:
    """Programmes of (gzipped) guide XML, still under the guide's channel ids."""
    rows = spark.read.format("xml").option("rowTag", "programme").schema(_PROGRAMME).load(path)
    return programmes_from(
        rows.select(F.col("_channel").alias("guide_id"), F.col("_start").alias("start"), F.col("_stop").alias("stop"), F.get("title", F.lit(0)).alias("title")),
        tz,
        source,
    )


def programmes_from(rows: DataFrame, tz: str = "UTC", source: str = "guide") -> DataFrame:
    """Typed programmes: readable start and stop, clean title."""
    return rows.select(
        "guide_id",
        parse_guide_ts(F.col("start"), tz).alias("start_ts"),
        parse_guide_ts(F.col("stop"), tz).alias("stop_ts"),
        T.clean_guide_title(F.col("title")).alias("title"),
        F.lit(source).alias("source"),
    ).filter(F.col("start_ts").isNotNull() & F.col("stop_ts").isNotNull())


_EVENTS = "entries array<struct<channelUuid:string,start:bigint,stop:bigint,title:string>>"


def read_guide_events(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    """Programmes of landed live-guide pages (JSON), under the live guide's channel uuids."""
    pages = spark.read.schema(_EVENTS).option("multiLine", True).json(path)
    return guide_events_from(pages.select(F.explode("entries").alias("e")).select(F.col("e.channelUuid").alias("uuid"), "e.start", "e.stop", "e.title"), tz)


def guide_events_from(events: DataFrame, tz: str = "UTC") -> DataFrame:
    """Typed programmes from unix bounds; zero or absent bounds are dropped."""

    def local(c: str) -> Column:
        utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col(c).cast("decimal(18,6)"))
        return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)

    timed = events.filter((F.coalesce("start", F.lit(0)) != 0) & (F.coalesce("stop", F.lit(0)) != 0))
    return timed.select(
        "uuid",
        local("start").alias("start_ts"),
        local("stop").alias("stop_ts"),
        F.array_join(T.words(F.col("title")), " ").alias("title"),
        F.lit("live").alias("source"),
    )


def name_programmes(programmes: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Programmes under internal channel names; channels nobody wants are dropped."""
    return programmes.join(names.select(key, F.col("name").alias("channel_name")), key).select(
        "channel_name", "start_ts", "stop_ts", "title", "source"
    )


_ITEM = ST.StructType(
    [
        ST.StructField("title", ST.StringType()),
        ST.StructField("link", ST.StringType()),
        ST.StructField("source", ST.StructType([ST.StructField("_VALUE", ST.StringType()), ST.StructField("_url", ST.StringType())])),
        ST.StructField("pubDate", ST.StringType()),
    ]
)


def read_news(spark: SparkSession, path: str, tz: str = "UTC", limit: int | None = None) -> DataFrame:
    """Articles of landed RSS files; with `limit` those among the first items of each."""
    rows = spark.read.format("xml").option("rowTag", "item").schema(_ITEM).load(path)
    placed = rows.select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), "title", "link",
        F.col("source._VALUE").alias("outlet"), F.col("pubDate").alias("published"),
    )
    return news_from(placed, tz, limit)


def news_from(items: DataFrame, tz: str = "UTC", limit: int | None = None) -> DataFrame:
    """(file, title, link, outlet, published) of items with title, link and a readable date.

    With `limit` only the first items of a file count, complete or not, as a feed lists its newest first.
    """
    w = Window.partitionBy("file").orderBy("pos")
    first = items if limit is None else items.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit)
    outlet = F.trim(F.coalesce("outlet", F.lit("")))
    title = F.trim("title")
    bare = F.regexp_replace(F.trim("published"), r"^[A-Za-z]{3,},?\s*", "")
    offset = F.regexp_replace(bare, r"\b(GMT|UTC|UT|Z)$", "+0000")
    when = F.try_to_timestamp(offset, F.lit("d MMM yyyy HH:mm:ss Z")).cast("timestamp_ntz")
    return (
        first.withColumn("_when", F.convert_timezone(F.current_timezone(), F.lit(tz), when))
        .filter((title != "") & (F.trim("link") != "") & F.col("_when").isNotNull())
        .select(
            "file",
            T.clean_news_title(title, outlet).alias("title"),
            F.trim("link").alias("link"),
            F.coalesce(F.nullif(outlet, F.lit("")), F.lit(NEWS_LABEL)).alias("outlet"),
            F.col("_when").alias("published"),
        )
    )


def read_caption_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Captions of landed SRT files with their file and place in it (`block`, from 0).

    Blocks end at a blank line, whatever the line ends; a file is read whole, as one half hour of one channel.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    unix = F.regexp_replace("value", "\r\n?", "\n")
    blocks = files.select("file", F.posexplode(F.split(unix, "\n(?:[ \t]*\n)+")).alias("block_no", "block"))
    return captions_from(blocks).withColumnRenamed("block_no", "block")


def caption_rows(captions: DataFrame, channels: DataFrame, started: Column) -> DataFrame:
    """Captions of files as rows of the live order: channel, end instant, duration, text and place.

    channels: file pattern (a part of the file's path), channel_id, channel_name. `started` is the instant the
    file begins; a caption ends at its time line's end after that.
    """
    seen = captions.withColumn("_text", F.lower("file"))
    owners = channels.select(F.lower("pattern").alias("norm_kw"), "channel_id", "channel_name")
    own = keyword_hits(seen.select("file", "block", "_text"), "_text", owners.select("norm_kw", F.lit(False).alias("whole_word"), F.lit(False).alias("phonetic")))
    return (
        captions.join(own.join(owners, "norm_kw").select("file", "block", "channel_id", "channel_name"), ["file", "block"])
        .withColumn("end_ts", started + F.make_dt_interval(secs=(F.col("end_ms") / 1000).cast("decimal(18,6)")))
        .select("channel_id", "channel_name", "block", "end_ts", "duration_sec", "text")
    )


def captions_from(blocks: DataFrame) -> DataFrame:
    """Blocks of at least three lines with a time line second: joined text, its duration and end in the file."""
    lines = F.split(F.regexp_replace("block", r"^[\r\n]+|[\r\n]+$", ""), r"\r?\n")
    spoken = F.filter(F.transform(F.slice("_lines", 3, F.size("_lines")), lambda t: F.regexp_replace(t, T.EDGE_SPACE, "")), lambda t: t != "")
    rest = [c for c in blocks.columns if c != "block"]
    return (
        blocks.withColumn("_lines", lines)
        .filter((F.size("_lines") >= 3) & F.contains(F.get("_lines", F.lit(1)), F.lit(" --> ")))
        .select(
            *rest,
            F.regexp_replace(F.array_join(spoken, " "), " {2,}", " ").alias("text"),
            caption_duration(F.get("_lines", F.lit(1))).alias("duration_sec"),
            caption_end_ms(F.get("_lines", F.lit(1))).alias("end_ms"),
        )
        .filter("text <> ''")
    )


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Recorded files below the channel folders; only their names and sizes are read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{ts,mp4,mkv}")
        .load(path)
        .select("path", "length", F.col("modificationTime").cast("timestamp_ntz").alias("modified"))
    )
    return parse_segments(files)


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
