"""Chunk scans, keyword matching, spacing, context and keyed inserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediawatch import fixtures as X
from mediawatch.functions import text as T
from mediawatch.operators import detail, guide, matching
from mediawatch.plans import oracle as O
from mediawatch.plans.registry import query
from mediawatch.sources.transcripts import scan_chunks

_HIT_COLS = "search_id, keyword, channel_id, id, ts"


def _hit_rows(df: DataFrame) -> DataFrame:
    return df.select("search_id", "keyword", "channel_id", "id", "ts")


@query(
    "transcript_scan",
    O.with_ctes(
        """SELECT channel_id, count(*) AS n, min(id) AS first_id, max(ts) AS last_ts FROM chunks
        WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-03' GROUP BY channel_id"""
    ),
)
def transcript_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = scan_chunks(X.chunks(spark, sf), since="2024-01-01", until="2024-01-03")
    return rows.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("ts").alias("last_ts")
    )


@query(
    "speech_filter",
    O.with_ctes(
        """SELECT channel_id, count(*) FILTER (text IS NOT NULL AND text NOT IN ('', '[~]')) AS n_speech,
        sum(length(text)) FILTER (text NOT IN ('', '[~]'))::BIGINT AS n_chars FROM chunks GROUP BY channel_id"""
    ),
)
def speech_filter(spark: SparkSession, sf: str) -> DataFrame:
    return X.chunks(spark, sf).filter(T.is_speech(F.col("text"))).groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("n_speech"), F.sum(F.length("text")).alias("n_chars")
    )


@query("keyword_matches", O.with_ctes(f"SELECT {_HIT_COLS} FROM hits"))
def keyword_matches(spark: SparkSession, sf: str) -> DataFrame:
    return _hit_rows(X.hits(spark, sf))


@query("keyword_matches_phonetic", O.with_ctes(f"SELECT {_HIT_COLS} FROM hits WHERE search_id = 5"))
def keyword_matches_phonetic(spark: SparkSession, sf: str) -> DataFrame:
    return _hit_rows(matching.match_chunks(X.chunks(spark, sf), X.searches(spark).filter("phonetic")))


@query("keyword_matches_whole_word", O.with_ctes(f"SELECT {_HIT_COLS} FROM hits WHERE search_id = 3"))
def keyword_matches_whole_word(spark: SparkSession, sf: str) -> DataFrame:
    return _hit_rows(matching.match_chunks(X.chunks(spark, sf), X.searches(spark).filter("whole_word")))


@query("keyword_matches_sliced", O.with_ctes(f"SELECT {_HIT_COLS} FROM hits"))
def keyword_matches_sliced(spark: SparkSession, sf: str) -> DataFrame:
    """The same matches with ten thousand further keywords in the table, which no text holds."""
    own = X.searches(spark)
    other = F.transform(F.sequence(F.lit(1), F.lit(10_000)), lambda i: F.concat(F.lit("zzq"), i.cast("string"), F.lit("kwx")))
    more = own.filter("search_id = 1").withColumn("search_id", F.lit(99)).withColumn("keywords", other)
    return _hit_rows(matching.match_chunks(X.chunks(spark, sf), own.unionByName(more)))


@query("match_dedup", O.with_ctes(f"SELECT {_HIT_COLS} FROM kept"))
def match_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return _hit_rows(matching.spaced_hits(X.hits(spark, sf)))


@query(
    "match_context",
    O.with_ctes(
        """SELECT match_id, search_id, keyword, channel_id, ts, md5(prev_text) AS prev_md5, md5(cur_text) AS cur_md5,
        md5(next_text) AS next_md5 FROM matches"""
    ),
)
def match_context(spark: SparkSession, sf: str) -> DataFrame:
    """The whole backfill: match, space out, attach neighbours."""
    return X._build_matches(spark, sf).select(
        "match_id", "search_id", "keyword", "channel_id", "ts",
        F.md5("prev_text").alias("prev_md5"), F.md5("cur_text").alias("cur_md5"), F.md5("next_text").alias("next_md5"),
    )


@query(
    "match_glued_text",
    O.with_ctes("SELECT match_id, md5(matched_text) AS glued_md5, md5(trim(cur_text, ' ' || chr(10))) AS cur_md5 FROM glued"),
)
def match_glued_text(spark: SparkSession, sf: str) -> DataFrame:
    """Glue the three chunks with the invisible marks and take the middle one out again."""
    glued = X.matches(spark, sf).withColumn(
        "g", T.glue_context(F.col("prev_text"), F.col("cur_text"), F.col("next_text"))
    )
    return glued.select(
        "match_id", F.md5("g").alias("glued_md5"), F.md5(T.current_chunk_span(F.col("g"))).alias("cur_md5")
    )


_LOCATED = {
    "tokens": f"""SELECT id, ix, {O.strip_accents('wd')} AS plain, {O.phonetic('wd')} AS sound,
        lead({O.strip_accents('wd')}) OVER (PARTITION BY id ORDER BY ix) AS plain2 FROM (
        SELECT id, unnest({O.word_list('text')}) AS wd, unnest(range(len({O.word_list('text')}))) AS ix FROM chunks)""",
    "found": r"""SELECT m.match_id, min(t.ix) AS idx FROM matches m
        JOIN kws k ON k.search_id = m.search_id AND k.kw_pos = m.kw_pos JOIN tokens t ON t.id = m.chunk_id
        WHERE CASE WHEN k.norm_kw = 'the of' THEN contains(t.plain, 'the') AND contains(t.plain2, 'of')
          WHEN k.whole_word THEN CASE WHEN contains(t.plain, k.norm_kw) THEN
            regexp_matches(t.plain, '(^|[^\p{L}\p{N}_])' || regexp_escape(k.norm_kw) || '([^\p{L}\p{N}_]|$)') ELSE false END
          WHEN k.phonetic THEN contains(t.sound, k.norm_kw) ELSE contains(t.plain, k.norm_kw) END
        GROUP BY m.match_id""",
    "located": f"""SELECT m.*, f.idx, {O.word_list('prev_text')} AS pw, {O.word_list('cur_text')} AS cw,
        {O.word_list('next_text')} AS nw FROM matches m LEFT JOIN found f ON f.match_id = m.match_id""",
    "placed_words": """SELECT *,
        CASE WHEN prev_text IS NULL THEN [] ELSE list_append(pw, chr(8288)) END || cw ||
        CASE WHEN next_text IS NULL THEN [] ELSE list_prepend(chr(8203), nw) END AS allw,
        idx + CASE WHEN prev_text IS NULL THEN 0 ELSE len(pw) + 1 END AS idx_full FROM located""",
    "enriched": f"""SELECT *, CASE WHEN idx IS NOT NULL AND len(cw) > 0
        THEN date_trunc('second', ts + to_microseconds(round((idx + 0.5) / len(cw) * 30 * 1000000)::BIGINT)) ELSE ts END AS precise_ts,
        {O.centered('allw', 'idx_full')} AS centered_text FROM placed_words""",
}

_AT = """(SELECT p.title FROM programmes p WHERE p.channel_name = e.channel_name AND p.start_ts <= e.ts
    AND p.stop_ts > e.ts ORDER BY p.start_ts DESC LIMIT 1)"""


@query(
    "match_enriched",
    O.with_ctes(
        f"""SELECT match_id, search_id, keyword, channel_name, ts, precise_ts, coalesce({_AT}, '') AS programme,
        centered_text, {O.media('channel_id')} AS channel_kind, idx::INT AS word_idx FROM enriched e""",
        _LOCATED,
    ),
)
def match_enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: matches with exact time, programme on air and the words around the hit."""
    rows = detail.enrich(X.matches(spark, sf), X.searches(spark))
    return guide.with_programme(rows, X.programmes(spark, sf)).select(
        "match_id", "search_id", "keyword", "channel_name", "ts", "precise_ts", "programme",
        "centered_text", "channel_kind", "word_idx",
    )


@query(
    "match_insert",
    O.with_ctes(
        """SELECT search_id, keyword, channel_id, ts, min(id) AS id FROM hits h WHERE NOT EXISTS (
        SELECT 1 FROM kept k WHERE k.search_id = h.search_id AND k.keyword = h.keyword AND k.channel_id = h.channel_id
        AND k.ts = h.ts) GROUP BY ALL"""
    ),
)
def match_insert(spark: SparkSession, sf: str) -> DataFrame:
    """Insert-or-ignore: raw hits offered twice, minus the keys already stored."""
    offered = _hit_rows(X.hits(spark, sf))
    fresh = matching.drop_known(offered.unionByName(offered), X.matches(spark, sf))
    return fresh.select("search_id", "keyword", "channel_id", "ts", "id")


@query("match_key_dedup", O.with_ctes("SELECT search_id, keyword, channel_id, ts, match_id FROM matches"))
def match_key_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Purge of a table in which every match was stored twice."""
    cols = ["search_id", "keyword", "channel_id", "ts", "match_id"]
    once = X.matches(spark, sf).select(*cols)
    twice = once.unionByName(once.withColumn("match_id", F.col("match_id") + 10**15))
    return matching.purge_duplicates(twice)


@query(
    "active_searches",
    O.with_ctes(
        f"""SELECT s.search_id, s.user_id, count(c.id) AS n_today FROM searches s
        LEFT JOIN chunks c ON c.ts::DATE = DATE '2024-01-02'
        WHERE s.status = 'active' AND s.initialized AND s.date_start <= DATE '2024-01-02' AND s.date_end >= DATE '2024-01-02'
        GROUP BY s.search_id, s.user_id"""
    ),
)
def active_searches(spark: SparkSession, sf: str) -> DataFrame:
    today = F.lit("2024-01-02").cast("date")
    live = matching.active_searches(X.searches(spark), today)
    day = X.chunks(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return live.withColumn("day", today).join(day, "day", "left").select(
        "search_id", "user_id", F.coalesce("n", F.lit(0)).alias("n_today")
    )


@query(
    "caption_first",
    O.with_ctes(
        """SELECT a.id, a.channel_id, a.ts, a.source FROM chunks a WHERE a.source <> 'asr' OR NOT EXISTS (
        SELECT 1 FROM chunks c WHERE c.source = 'cc' AND c.channel_id = a.channel_id
        AND c.ts > a.ts + INTERVAL 30 SECOND - INTERVAL 90 SECOND AND c.ts <= a.ts + INTERVAL 30 SECOND)"""
    ),
)
def caption_first(spark: SparkSession, sf: str) -> DataFrame:
    chunks = X.chunks(spark, sf).select("id", "channel_id", "ts", "source")
    return matching.caption_first(chunks)
