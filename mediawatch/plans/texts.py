"""Text functions over the whole documents, conversations and pages tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediawatch import fixtures as X
from mediawatch.functions import text as T
from mediawatch.operators.matching import match_chunks
from mediawatch.plans import oracle as O
from mediawatch.plans.registry import query
from mediawatch.scale import pinned


@query(
    "text_normalise",
    O.with_ctes(f"""SELECT id, md5({O.strip_accents('text')}) AS plain_md5, md5({O.phonetic('text')}) AS sound_md5
    FROM chunks"""),
)
def text_normalise(spark: SparkSession, sf: str) -> DataFrame:
    plain = X.chunks(spark, sf).select("id", T.strip_accents(F.col("text")).alias("plain"))
    return plain.select(
        "id", F.md5("plain").alias("plain_md5"), F.md5(T.phonetic_of(F.col("plain"))).alias("sound_md5")
    )


@query(
    "content_words",
    O.with_ctes(
        f"""SELECT id, len(ws)::INT AS n_words, len(ns)::INT AS n_content, md5(array_to_string(ns, ' ')) AS norm_md5
        FROM (SELECT id, ws, list_filter(list_transform(ws, lambda w: {O.fold('w')}), lambda n: n <> '') AS ns
              FROM (SELECT id, {O.word_list('text')} AS ws FROM chunks))"""
    ),
)
def content_words(spark: SparkSession, sf: str) -> DataFrame:
    df = X.chunks(spark, sf).select(
        "id", F.size(T.words(F.col("text"))).alias("n_words"), T.content_words(F.col("text")).alias("cw")
    )
    return df.select(
        "id",
        "n_words",
        F.size("cw").alias("n_content"),
        F.md5(F.array_join("cw.norm", " ")).alias("norm_md5"),
    )


@query(
    "text_shingles",
    O.with_ctes(
        f"""SELECT id, count(DISTINCT sh) AS n_shingles, min(sh) AS first_shingle, max(sh) AS last_shingle FROM (
          SELECT id, array_to_string(ns[i:i + 4], ' ') AS sh FROM (
            SELECT id, ns, unnest(range(1, greatest(len(ns) - 3, 2))) AS i FROM (
              SELECT id, list_filter(list_transform({O.word_list('text')}, lambda w: {O.fold('w')}),
                lambda n: n <> '') AS ns FROM chunks) WHERE len(ns) > 0)) GROUP BY id"""
    ),
)
def text_shingles(spark: SparkSession, sf: str) -> DataFrame:
    # Counted inside the row: one thin row a chunk meets the others of its id, however many shingles it has.
    held = pinned(X.chunks(spark, sf).select("id", "text"), "sh", T.shingles(T.content_words(F.col("text"))["norm"]))
    rows = held.select("id", F.size("sh").alias("n"), F.array_min("sh").alias("first"), F.array_max("sh").alias("last"))
    return rows.filter("n > 0").groupBy("id").agg(
        F.sum("n").alias("n_shingles"),
        F.min("first").alias("first_shingle"),
        F.max("last").alias("last_shingle"),
    )


_POSITIONS = f"""SELECT id, count(*)::INT AS n_hits, min(pos)::INT AS first_hit, max(pos)::INT AS last_hit FROM (
    SELECT id, n, lead(n) OVER w AS n2, row_number() OVER w - 1 AS pos FROM (
      SELECT id, ix, {O.fold('wd')} AS n FROM (
        SELECT id, unnest({O.word_list('text')}) AS wd, unnest(range(len({O.word_list('text')}))) AS ix FROM chunks))
    WHERE n <> '' WINDOW w AS (PARTITION BY id ORDER BY ix))
    WHERE contains(n, 'the') AND contains(n2, 'an') GROUP BY id"""


@query("keyword_positions", O.with_ctes(_POSITIONS))
def keyword_positions(spark: SparkSession, sf: str) -> DataFrame:
    kw = F.array(F.lit("the"), F.lit("an"))
    df = X.chunks(spark, sf).select("id", T.content_words(F.col("text"))["norm"].alias("ns"))
    ps = df.select("id", T.keyword_positions(F.col("ns"), kw).alias("ps")).filter(F.size("ps") > 0)
    return ps.select(
        "id",
        F.size("ps").alias("n_hits"),
        F.get("ps", F.lit(0)).alias("first_hit"),
        F.element_at("ps", -1).alias("last_hit"),
    )


def _escape(e: str) -> str:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("''", "&#39;")):
        e = f"replace({e}, '{old}', '{new}')"
    return e


@query(
    "highlight_exact",
    O.with_ctes(
        rf"""SELECT h.search_id, h.keyword, h.id,
        md5(regexp_replace({_escape('h.text')}, '(?i)(' || regexp_escape(h.keyword) || ')', '<mark>\1</mark>', 'g')) AS html_md5
        FROM hits h JOIN searches s ON s.search_id = h.search_id WHERE NOT s.phonetic AND NOT s.whole_word"""
    ),
)
def highlight_exact(spark: SparkSession, sf: str) -> DataFrame:
    chunks = X.chunks(spark, sf)
    plain = X.searches(spark).filter("NOT phonetic AND NOT whole_word")
    hits = match_chunks(chunks, plain).select("search_id", "keyword", "id")
    html = T.highlight(F.col("text"), F.col("keyword"), F.lit(False))
    return hits.join(chunks.select("id", "text"), "id").select(
        "search_id", "keyword", "id", F.md5(html).alias("html_md5")
    )


@query(
    "highlight_phonetic",
    O.with_ctes(
        f"""SELECT m.match_id, any_value(length({_escape('m.cur_text')})) AS plain_len, count(*) FILTER (contains({O.phonetic('w.wd')}, {O.phonetic('m.keyword')})) AS n_marked
        FROM matches m JOIN searches s ON s.search_id = m.search_id AND s.phonetic
        JOIN (SELECT id, unnest({O.word_list('text')}) AS wd FROM chunks) w ON w.id = m.chunk_id GROUP BY m.match_id"""
    ),
)
def highlight_phonetic(spark: SparkSession, sf: str) -> DataFrame:
    """Words marked in each phonetic match, and the length of its HTML without the marks."""
    m = X.matches(spark, sf).join(X.searches(spark).filter("phonetic").select("search_id", "whole_word"), "search_id")
    html = T.highlight_phonetic(F.col("cur_text"), F.col("keyword"), F.col("whole_word"))
    marks = F.regexp_count(F.col("html"), F.lit("<mark>"))
    return m.select("match_id", html.alias("html")).select(
        "match_id",
        (F.length("html").cast("bigint") - marks * len("<mark></mark>")).alias("plain_len"),
        marks.cast("bigint").alias("n_marked"),
    )


_NOISE = "list_contains(['[música]', '[music]', '(música)', '(music)', '[silencio]', '[silence]'], bare)"


@query(
    "noise_lines",
    rf"""SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bare = '' OR {_NOISE}) AS n_noise FROM (
      SELECT doc_id, lower(trim(regexp_replace(line, '^\s+|\s+$', '', 'g'), '.,;:¿?¡!—-–…')) AS bare
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY doc_id""",
)
def noise_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(T.is_silent_or_noise(F.col("line"))).alias("n_noise")
    )


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_TERMS = rf"""list_filter(regexp_extract_all(text, '[A-Za-zÁÉÍÓÚÑáéíóúñü0-9]+'),
    lambda t: length(t) > 2 AND NOT list_contains({_STOP}, lower(t)))[1:6]"""


@query(
    "question_keywords",
    f"""SELECT conv_id, turn, CASE WHEN len(ts) = 0 THEN text
        ELSE array_to_string(list_transform(ts, lambda t: t || '*'), ' OR ') END AS fts_query
        FROM (SELECT conv_id, turn, text, {_TERMS} AS ts FROM conversations WHERE role = 'user')""",
)
def question_keywords(spark: SparkSession, sf: str) -> DataFrame:
    users = spark.read.parquet(f"{sf}/conversations.parquet").filter("role = 'user'")
    return users.select("conv_id", "turn", T.question_keywords(F.col("text")).alias("fts_query"))


@query(
    "code_switch",
    O.with_ctes(
        f"""SELECT id, {O.english('text')}::INT AS n_english, len({O.word_list('text')})::INT AS n_words,
        round({O.english('text')}::DOUBLE / greatest(len({O.word_list('text')}), 1), 6) AS ratio FROM chunks"""
    ),
)
def code_switch(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return X.chunks(spark, sf).select(
        "id",
        T.english_hits(t).alias("n_english"),
        F.size(T.words(t)).alias("n_words"),
        F.round(T.code_switch_ratio(t), 6).alias("ratio"),
    )


@query(
    "split_keywords",
    r"""SELECT doc_id, len(ks)::INT AS n_keywords, md5(array_to_string(ks, '|')) AS kw_md5 FROM (
      SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\n,]+'),
        lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ks FROM documents)""",
)
def split_keywords(spark: SparkSession, sf: str) -> DataFrame:
    ks = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.split_keywords(F.col("text")).alias("ks"))
    return ks.select("doc_id", F.size("ks").alias("n_keywords"), F.md5(F.array_join("ks", "|")).alias("kw_md5"))


@query(
    "safe_names",
    r"""SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}]', '_', 'g') AS folder,
        CASE WHEN cut = '' THEN 'Search_' || page_id ELSE cut END AS sheet
        FROM (SELECT page_id, url, substr(regexp_replace(url, '[\\/*?:\[\]]', '', 'g'), 1, 31) AS cut FROM pages)""",
)
def safe_names(spark: SparkSession, sf: str) -> DataFrame:
    fallback = F.concat(F.lit("Search_"), F.col("page_id").cast("string"))
    return spark.read.parquet(f"{sf}/pages.parquet").select(
        "page_id", T.safe_name(F.col("url")).alias("folder"), T.sheet_name(F.col("url"), fallback).alias("sheet")
    )


@query(
    "clean_titles",
    O.with_ctes(
        r"""SELECT page_id, CASE WHEN ends_with(raw, ' - ' || outlet) THEN substr(raw, 1, length(raw) - length(outlet) - 3)
          ELSE raw END AS news_title,
        regexp_replace(array_to_string(list_filter(regexp_split_to_array('[' || upper(substr(outlet, 1, 1)) || ']  ' || title, '\s+'),
          lambda w: w <> ''), ' '), '^\[[A-Z]\]\s*', '') AS guide_title
        FROM (SELECT *, title || ' - ' || outlet AS raw FROM articles)"""
    ),
)
def clean_titles(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat("title", F.lit(" - "), "outlet")
    tagged = F.concat(F.lit("["), F.upper(F.substring("outlet", 1, 1)), F.lit("]  "), "title")
    return X.articles(spark, sf).select(
        "page_id",
        T.clean_news_title(raw, F.col("outlet")).alias("news_title"),
        T.clean_guide_title(tagged).alias("guide_title"),
    )


@query(
    "stream_urls",
    """SELECT page_id, split_part(url, '?', 1) || '?profile=pass' AS raw_url, trim(split_part(url, ':', 1)) AS header_name,
       trim(substr(url, strpos(url, ':') + 1)) AS header_value FROM pages""",
)
def stream_urls(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return spark.read.parquet(f"{sf}/pages.parquet").select(
        "page_id",
        T.raw_stream_url(url).alias("raw_url"),
        T.header_name(url).alias("header_name"),
        T.header_value(url).alias("header_value"),
    )
