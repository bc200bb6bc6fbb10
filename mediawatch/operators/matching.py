"""Keyword matching of transcript chunks against registered searches."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mediawatch.functions import text as T
from mediawatch.functions.timefn import CHUNK_SECONDS, media_type, seconds
from mediawatch.operators import ordered
from mediawatch.scale import SHIPPED_ROWS, shipped, stored
from mediawatch.sources.transcripts import between_days

HIT_KEY = ["search_id", "kw_pos", "keyword", "channel_id"]
MATCH_KEY = ["search_id", "keyword", "channel_id", "ts"]
DEDUP_SECONDS = 60
CAPTION_GRACE_SECONDS = 90
#: Characters of a keyword that are looked up in the texts.
PROBE = 3
#: Keywords that are simply all tried on a text.
FEW = 48
#: Log2 of the most bits in the bitmap of probes (it is part of the plan).
MOST_BITS = 20
#: Letters from frequent to rare; the order only decides which part of a keyword is looked up.
LETTERS_BY_USE = " eaosrnidlctumpbgvyqhfzjxkw"


def active_searches(searches: DataFrame, today: Column) -> DataFrame:
    """Searches a live run looks at: active, initialised and in range *today* (not at row time)."""
    return searches.filter(
        (F.col("status") == "active")
        & F.col("initialized")
        & (F.col("date_start") <= today)
        & (F.col("date_end") >= today)
    )


def keyword_table(searches: DataFrame) -> DataFrame:
    """One row per (search, keyword, medium) with the keyword already normalised."""
    phonetic = F.col("phonetic")
    return (
        searches.select(
            "search_id",
            "phonetic",
            "whole_word",
            "date_start",
            "date_end",
            "dedup_channel",
            "media_types",
            F.posexplode("keywords").alias("kw_pos", "keyword"),
        )
        .withColumn("norm_kw", T.normalise(F.col("keyword"), phonetic))
        .filter(F.col("norm_kw") != "")
        .withColumn("medium", F.explode("media_types"))
        .drop("media_types")
    )


def probe_of(norm_kw: Column) -> Column:
    """The part of a keyword that is looked up in the texts: its run of three characters with the rarest letters.

    A shorter keyword is looked up whole. Any part would do; a rare one has fewer false candidates.
    """

    def rarity(part: Column) -> Column:
        places = F.transform(F.split(part, ""), lambda c: F.position(c, F.lit(LETTERS_BY_USE)))
        return F.aggregate(places, F.lit(0), lambda n, i: n + F.when(i == 0, len(LETTERS_BY_USE)).otherwise(i))

    starts = F.sequence(F.lit(1), F.greatest(F.length(norm_kw) - (PROBE - 1), F.lit(1)))
    parts = F.transform(starts, lambda i: F.substring(norm_kw, i, F.lit(PROBE)))
    return F.array_max(F.transform(parts, lambda p: F.struct(rarity(p).alias("n"), p.alias("p"))))["p"]


def tried_keywords(rows: DataFrame, text: str, keywords: list) -> DataFrame:
    """Every (norm_kw, whole_word, phonetic) tried on every text, inside the row; only hits become rows."""
    ids = [F.col(c) for c in rows.columns if c != text]

    def held(value: Column, phonetic: bool) -> Column:
        own = [F.struct(F.lit(k).alias("norm_kw"), F.lit(w).alias("whole_word"), F.lit(p).alias("phonetic")) for k, w, p in keywords if p == phonetic]
        return T.let(value, lambda t: F.filter(F.array(*own), lambda k: T.keyword_hit(t, k["norm_kw"], k["whole_word"]))) if own else None

    both = T.let(
        F.col(text),
        lambda t: F.concat(*[h for h in (held(t, False), held(T.phonetic_of(t), True)) if h is not None]),
    )
    return rows.select(*ids, F.explode(both).alias("_k")).select(*ids, "_k.norm_kw", "_k.whole_word", "_k.phonetic")


def grams(text: Column, widths: list[int]) -> Column:
    """The distinct runs of so many characters, at every place of the text."""
    runs = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{w}}}))"), F.lit(1)) for w in widths]
    return F.array_distinct(F.concat(*runs))


def bitmap_of(probes: DataFrame, probe: str) -> tuple[Column, int]:
    """(bitmap as an array of 64-bit words, log2 of its bits) with the hash of every probe set.

    Sixteen bits and more to a probe, 2^12 bits at least and 2^MOST_BITS at most; beyond that more grams pass and the
    join on the probe, which decides, meets more of them.
    """
    n = probes.select(probe).distinct().count()
    bits = min(max(12, (16 * n).bit_length()), MOST_BITS)
    place = gram_place(F.col(probe), bits)
    words = {
        r["w"]: r["b"] for r in probes.select(place.alias("h")).groupBy(F.shiftright("h", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b")).collect()
    }
    listed = ",".join(str(words.get(i, 0)) for i in range(1 << (bits - 6)))
    return F.split(F.lit(listed), ",").cast("array<bigint>"), bits


def gram_place(gram: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(gram), 64 - bits)


def looked_up_keywords(rows: DataFrame, text: str, keywords: DataFrame) -> DataFrame:
    """Keywords are tried where a text holds their probe: its distinct grams are tested against a bitmap of all
    probes inside the row, those that pass meet the keywords by an equi join.

    The keywords are shipped within the bound of `shipped` and each candidate is decided on the spot; beyond it
    thin candidates are exchanged first and their texts are read again.
    """
    probes = stored(
        keywords.select("norm_kw", "whole_word", probe_of(F.col("norm_kw")).alias("_probe")).withColumn("_width", F.length("_probe")),
        "keyword-probes",
    )
    widths = [r[0] for r in probes.select("_width").distinct().collect()]  # 1 to 3
    bitmap, bits = bitmap_of(probes, "_probe")

    def set_in_bitmap(gram: Column) -> Column:
        h = gram_place(gram, bits)
        return F.getbit(F.get(bitmap, F.shiftright(h, 6).cast("int")), h.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1

    few = probes.limit(SHIPPED_ROWS + 1).count() <= SHIPPED_ROWS
    ids = [c for c in rows.columns if c != text]
    carried = [*ids, text] if few else ids
    passed = T.let(F.col(text), lambda t: F.filter(grams(t, widths), set_in_bitmap))
    met = rows.select(*carried, F.explode(passed).alias("_probe"))
    sent = F.broadcast(probes.drop("_width")) if few else probes.drop("_width")
    candidates = met.join(sent, "_probe").drop("_probe")
    here = candidates if few else candidates.distinct().join(rows, ids)
    return here.filter(T.keyword_hit(F.col(text), F.col("norm_kw"), F.col("whole_word"))).select(*ids, "norm_kw", "whole_word")


def keyword_hits(rows: DataFrame, text: str, keywords: DataFrame) -> DataFrame:
    """(columns of `rows` but the text, norm_kw, whole_word, phonetic) for every distinct keyword that a row's text holds.

    Texts have no accents; a phonetic keyword is looked for in their sounds. Up to `FEW` keywords are all tried;
    of more, those whose probe the text holds.
    """
    kws = keywords.select("norm_kw", "whole_word", "phonetic").filter("norm_kw <> ''").distinct()
    own = [tuple(r) for r in kws.limit(FEW + 1).collect()]
    if not own:
        return rows.drop(text).withColumns({"norm_kw": F.lit(""), "whole_word": F.lit(False), "phonetic": F.lit(False)}).limit(0)
    if len(own) <= FEW:
        return tried_keywords(rows, text, own)
    kws = stored(kws, "distinct-keywords")
    found = []
    for phonetic in sorted(r[0] for r in kws.select("phonetic").distinct().collect()):
        mine = kws.filter(F.col("phonetic") == phonetic)
        own = [tuple(r) for r in mine.limit(FEW + 1).collect()]
        if len(own) <= FEW:
            found.append(tried_keywords(rows, text, own))
        else:
            said = rows.withColumn(text, T.phonetic_of(F.col(text))) if phonetic else rows
            found.append(looked_up_keywords(said, text, mine).withColumn("phonetic", F.lit(phonetic)))
    return reduce(DataFrame.unionByName, found)


def match_chunks(chunks: DataFrame, searches: DataFrame, by_row_date: bool = True) -> DataFrame:
    """Thin hits (no text) of every keyword in every chunk its search covers.

    Each distinct (mode, normalised keyword) is tried once, however many searches have it; the searches
    come in afterwards. With `by_row_date` only the days that some search covers are read.
    """
    kws = keyword_table(searches)
    if by_row_date:
        span = searches.agg(F.min("date_start").alias("lo"), F.max("date_end").alias("hi")).first()
        if span["lo"] is not None:
            chunks = between_days(chunks, F.lit(span["lo"]), F.lit(span["hi"]))
    spoken = chunks.filter(T.is_speech(F.col("text"))).select(
        "id", "channel_id", "channel_name", "ts", T.strip_accents(F.col("text")).alias("plain")
    )
    hits = keyword_hits(spoken, "plain", kws)
    owned = hits.withColumn("medium", media_type(F.col("channel_id"))).join(
        kws, ["norm_kw", "whole_word", "phonetic", "medium"]
    )
    in_range = (F.col("ts") >= F.col("date_start")) & (F.col("ts") < F.date_add(F.col("date_end"), 1))
    return (owned.filter(in_range) if by_row_date else owned).select(*HIT_KEY, "channel_name", "id", "ts", "dedup_channel")


def spaced_hits(hits: DataFrame, gap: int = DEDUP_SECONDS) -> DataFrame:
    """Hits left after the per-channel minimum gap (and one row per match key).

    The fold reads its input twice; the thin hits are stored first so that chunks are scanned once.
    """
    keys = [*HIT_KEY, "channel_name"]
    return ordered.keep_spaced(stored(hits, "hits"), keys, "ts", "id", "dedup_channel", gap)


def with_context(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Attach the text of the hit's chunk and of its nearest neighbours on the channel.

    The neighbours are found on a narrow (channel, ts) projection. The hits of a chunk ask together for three instants; these are
    shipped to the texts (beyond the bounds of `shipped` exchanged with them), which are read once, from the days
    that hold one, and go to their hit with their role. A neighbour without speech is still the neighbour, and
    contributes nothing; of several chunks at one instant the lowest id is the neighbour.
    """
    marks = ordered.neighbour_instants(chunks, ["channel_id"], "ts")
    placed = hits.join(marks, ["channel_id", "ts"])
    at = ["channel_id", "ts", "id", "prev_ts", "next_ts"]
    rest = [c for c in placed.columns if c not in at]
    own = F.struct(*(rest or [F.lit(True).alias("_one")]))  # hits may have no other columns; Parquet has no empty structs
    centres = stored(
        placed.groupBy(*at).agg(F.collect_list(own).alias("_own")).withColumn("_hit", F.monotonically_increasing_id()), "placed-hits"
    )
    roles = [F.struct(F.lit(role).alias("role"), F.col(at).alias("ts")) for role, at in (("cur", "ts"), ("prev", "prev_ts"), ("next", "next_ts"))]
    asked = stored(
        centres.select("_hit", "channel_id", F.col("id").alias("_id"), F.explode(F.array(*roles)).alias("_a"))
        .select("_hit", "channel_id", "_id", "_a.role", "_a.ts").filter(F.col("ts").isNotNull()),
        "asked-instants",
    )
    span = asked.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    days = chunks if span["lo"] is None else between_days(chunks, F.lit(span["lo"].date()), F.lit(span["hi"].date()))
    told = days.select("channel_id", "ts", "id", "text").join(shipped(asked), ["channel_id", "ts"]).filter(
        (F.col("role") != "cur") | (F.col("id") == F.col("_id"))
    )

    def text_of(role: str) -> Column:
        mine = F.col("role") == role
        return F.min_by(F.when(mine, F.col("text")), F.when(mine, F.col("id")))

    def spoken(role: str) -> Column:
        return F.when(T.is_speech(F.col(role)), F.col(role)).alias(role)

    texts = told.groupBy("_hit").agg(
        text_of("cur").alias("cur_text"), text_of("prev").alias("prev_text"), text_of("next").alias("next_text"),
        F.count(F.when(F.col("role") == "cur", 1)).alias("_here"),
    ).filter("_here > 0").select("_hit", "cur_text", spoken("prev_text"), spoken("next_text"))
    found = centres.join(texts, "_hit").select("channel_id", "ts", "id", "cur_text", "prev_text", "next_text", F.inline("_own"))
    return found.select(*hits.columns, "cur_text", "prev_text", "next_text")


def as_matches(hits: DataFrame, found_at: Column | None = None) -> DataFrame:
    """Hits with context in the columns of the match table."""
    return hits.select(
        F.xxhash64(*MATCH_KEY).alias("match_id"),
        "search_id",
        "kw_pos",
        "keyword",
        "channel_id",
        "channel_name",
        "ts",
        F.col("id").alias("chunk_id"),
        "prev_text",
        "cur_text",
        "next_text",
        (found_at if found_at is not None else F.localtimestamp()).alias("found_at"),
        F.lit(None).cast("string").alias("source_url"),
    )


def backfill(
    chunks: DataFrame, searches: DataFrame, found_at: Column | None = None, by_row_date: bool = True
) -> DataFrame:
    """Matches of the given searches over the given chunks, with context, ready for the keyed sink."""
    hits = stored(spaced_hits(match_chunks(chunks, searches, by_row_date)), "spaced-hits")
    return as_matches(with_context(hits, chunks), found_at)


def drop_known(new: DataFrame, existing: DataFrame, key: list[str] = MATCH_KEY) -> DataFrame:
    """Insert-or-ignore: one row per key, none already stored. A NULL in the key never collides."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    unique = new.filter(whole).dropDuplicates(key).unionByName(new.filter(~whole))
    return unique.join(existing.select(*key), key, "left_anti")


def purge_duplicates(rows: DataFrame, key: list[str] = MATCH_KEY, row_id: str = "match_id") -> DataFrame:
    """Keep the lowest id of each key (a partial aggregate, so a hot key is combined map-side)."""
    rest = [c for c in rows.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.col(row_id)).alias("_r")
    return rows.groupBy(*key).agg(first).select(*key, "_r.*").select(*rows.columns)


def backfill_days(
    chunks: DataFrame, searches: DataFrame, first: date, last: date, found_at: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(matches, (search_id, first, last, rows_done)) of a backfill over the days first .. last.

    The rows are counted where the scan reads them, by an observation of the job that matches; a search's count
    is that of the chunks in its own dates. Searches are those of one rescan: one count each is observed.
    """
    spark = chunks.sparkSession
    own = searches.select("search_id", "date_start", "date_end").collect()
    day = F.to_date("ts")
    read = Observation("backfill")
    counts = [F.count_if(day.between(F.lit(r["date_start"]), F.lit(r["date_end"]))).alias(f"s{r['search_id']}") for r in own]
    days = between_days(chunks, F.lit(first), F.lit(last))
    seen = days.observe(read, F.count(F.lit(1)).alias("all"), *counts)
    hits = stored(match_chunks(seen, searches), "hits")
    done = read.get
    kept = stored(spaced_hits(hits), "spaced-hits")
    progress = spark.createDataFrame(
        [(r["search_id"], first, last, done[f"s{r['search_id']}"]) for r in own], "search_id int, first date, last date, rows_done bigint"
    )
    return as_matches(with_context(kept, chunks), found_at), progress


def backfill_progress(chunks: DataFrame, searches: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(search_id, rows_total[, rows_done]): chunks that each search's dates cover, and of them those that runs have read.

    done: the progress rows of `backfill_days`; a range of days that was run again counts once.
    """
    days = chunks.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    span = searches.select(
        "search_id", F.explode(F.sequence("date_start", "date_end")).alias("day")
    )
    counts = span.join(days, "day").groupBy("search_id").agg(F.sum("n").alias("rows_total"))
    out = searches.select("search_id").join(counts, "search_id", "left").na.fill(0, ["rows_total"])
    if done is None:
        return out
    once = done.groupBy("search_id", "first", "last").agg(F.max("rows_done").alias("rows_done"))
    read = once.groupBy("search_id").agg(F.sum("rows_done").alias("rows_done"))
    return out.join(read, "search_id", "left").na.fill(0, ["rows_done"])


def caption_first(chunks: DataFrame, grace: int = CAPTION_GRACE_SECONDS) -> DataFrame:
    """Chunks after source precedence: a recognised chunk yields to a caption seen in the
    `grace` seconds before the chunk was complete. Decided on thin rows; the chunks themselves are read once."""
    end = F.col("ts") + seconds(CHUNK_SECONDS)
    asr = chunks.filter(F.col("source") == "asr").select("id", "channel_id", "ts", end.alias("_end"))
    captions = chunks.filter(F.col("source") == "cc").select("channel_id", F.col("ts").alias("cc_ts"))
    seen = ordered.asof_last(asr, captions, ["channel_id"], "_end", "cc_ts", [], out="_cc")
    held = seen.filter(F.col("_cc.at") > F.col("_end") - seconds(grace)).select("id", "channel_id", "ts")
    gone = shipped(stored(held, "captioned"))
    kept = chunks.filter(F.col("source") == "asr").join(gone, ["id", "channel_id", "ts"], "left_anti").select(*chunks.columns)
    return kept.unionByName(chunks.filter(F.col("source").isNull() | (F.col("source") != "asr")))
