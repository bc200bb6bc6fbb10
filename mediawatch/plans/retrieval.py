"""Full-text retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediawatch import fixtures as X
from mediawatch.functions.text import STOP_WORDS
from mediawatch.operators import retrieval
from mediawatch.operators.retrieval import TextQuery
from mediawatch.plans import oracle as O
from mediawatch.plans.registry import query

_TOKENS = rf"SELECT id, channel_name, ts, text, regexp_extract_all({O.strip_accents('text')}, '[\p{{L}}\p{{N}}]+') AS ws FROM chunks WHERE text IS NOT NULL"
_SAT = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))"


@query(
    "postings",
    O.with_ctes(
        """SELECT id AS doc_id, term, len(ws)::INT AS doc_len, count(*) AS tf FROM
        (SELECT id, ws, unnest(ws) AS term FROM toks) GROUP BY id, term, len(ws)""",
        {"toks": _TOKENS},
    ),
)
def postings(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.postings(X.chunks(spark, sf)).drop("places")


_COUNTS = """SELECT *, len(ws) AS doc_len, len(list_filter(ws, lambda t: starts_with(t, 'eaux'))) AS c1,
    len(list_filter(ws, lambda t: t = 'que')) AS c2, len(list_filter(ws, lambda t: t = 'the')) AS c3,
    len(regexp_extract_all(' ' || replace(array_to_string(ws, ' '), ' ', '  ') || ' ', ' et  la ')) AS c4 FROM toks"""


@query(
    "boolean_match",
    O.with_ctes(
        "SELECT id, c1 + c2 + c4 AS n_hits FROM counts WHERE (c1 > 0 OR c2 > 0) AND c4 > 0 AND c3 = 0",
        {"toks": _TOKENS, "counts": _COUNTS},
    ),
)
def boolean_match(spark: SparkSession, sf: str) -> DataFrame:
    """Any of eaux*/que, the phrase "et la", and not "the"."""
    q = TextQuery(any_of=["eaux*", "que"], none_of=["the"], phrase="et la")
    rows = retrieval.matching_chunks(X.text_index(spark, sf), q)
    hits = sum((F.col(c) for c in rows.columns if c.startswith("_q")), F.lit(0))
    return rows.select("id", hits.cast("bigint").alias("n_hits"))


@query(
    "ranked_search",
    O.with_ctes(
        f"""SELECT id, channel_name, ts, round(greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * {_SAT.replace('tf', 'c1')}
          + greatest(ln((n - d2 + 0.5) / (d2 + 0.5)), 1e-6) * {_SAT.replace('tf', 'c2')}, 6) AS score
        FROM counts, (SELECT count(*) AS n, avg(doc_len) AS avg_len, count(*) FILTER (c1 > 0) AS d1, count(*) FILTER (c2 > 0) AS d2 FROM counts)
        WHERE (c1 > 0 OR c2 > 0) AND contains(lower(channel_name), 'ch1') AND ts >= TIMESTAMP '2024-01-01 06:00:00' AND ts <= TIMESTAMP '2024-01-03'
        ORDER BY score DESC, ts DESC, id DESC LIMIT 20""",
        {"toks": _TOKENS, "counts": _COUNTS},
    ),
)
def ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = retrieval.ranked_search(
        X.text_index(spark, sf),
        TextQuery(any_of=["eaux*", "que"]),
        channel="CH1",
        since=F.lit("2024-01-01 06:00:00").cast("timestamp_ntz"),
        until=F.lit("2024-01-03").cast("timestamp_ntz"),
    )
    return rows.select("id", "channel_name", "ts", "score")


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_CTES = {
    "toks": _TOKENS,
    "asked": rf"""SELECT *, list_filter(regexp_extract_all(question, '[A-Za-zÁÉÍÓÚÑáéíóúñü0-9]+'),
        lambda t: length(t) > 2 AND NOT list_contains({_STOP}, lower(t)))[1:6] AS sig FROM questions""",
    "terms": rf"""SELECT DISTINCT question_id, len(sig) = 0 AS need_all, len(sig) > 0 AS prefix, strip_accents(lower(unnest(
        CASE WHEN len(sig) > 0 THEN sig ELSE regexp_extract_all(question, '[\p{{L}}\p{{N}}]+') END))) AS term FROM asked""",
    "vocab": "SELECT DISTINCT term, prefix FROM terms",
    "words": "SELECT id, channel_name, ts, len(ws) AS doc_len, unnest(ws) AS w FROM toks",
    "tfs": """SELECT w.id, w.channel_name, w.ts, w.doc_len, v.term, v.prefix, count(*) AS tf FROM words w JOIN vocab v
        ON CASE WHEN v.prefix THEN starts_with(w.w, v.term) ELSE w.w = v.term END GROUP BY ALL""",
    "dfs": "SELECT term, prefix, count(*) AS df FROM tfs GROUP BY ALL",
    "scored": f"""SELECT t.question_id, f.id, f.channel_name, f.ts, round(sum(greatest(ln((s.n - d.df + 0.5) / (d.df + 0.5)), 1e-6) * {_SAT}), 6) AS score
        FROM tfs f JOIN dfs d ON d.term = f.term AND d.prefix = f.prefix JOIN terms t ON t.term = f.term AND t.prefix = f.prefix,
        (SELECT count(*) AS n, avg(len(ws)) AS avg_len FROM toks) s
        GROUP BY t.question_id, f.id, f.channel_name, f.ts, t.need_all
        HAVING NOT t.need_all OR count(*) = (SELECT count(*) FROM terms x WHERE x.question_id = t.question_id)""",
    "ranked": f"""SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, ts DESC, id DESC) AS rank FROM (
        SELECT c.*, greatest(least(q.top_n, 30), 3) AS k FROM scored c JOIN questions q ON q.question_id = c.question_id
        WHERE contains(lower(c.channel_name), lower(q.channel)) AND (q.range = 'all'
          OR c.ts >= TIMESTAMP '{X.NOW}' - to_hours(CASE q.range WHEN '7d' THEN 168 WHEN '30d' THEN 720 END)))""",
}


@query(
    "question_hits",
    O.with_ctes("SELECT question_id, rank::INT AS rank, id, score FROM ranked WHERE rank <= k", _CTES),
)
def question_hits(spark: SparkSession, sf: str) -> DataFrame:
    rows = retrieval.retrieve(X.text_index(spark, sf), X.chunks(spark, sf), X.questions(spark), X.now())
    return rows.select("question_id", "rank", "id", "score")


@query(
    "question_context",
    O.with_ctes(
        """SELECT q.question_id, count(r.id) AS n_sources, coalesce(md5(string_agg('[' || r.rank || '] [' || r.channel_name || ', ' ||
          strftime(r.ts, '%H:%M:%S') || '] ' || c.text, chr(10) ORDER BY r.rank)), md5('(sin fragmentos relevantes)')) AS context_md5
        FROM questions q LEFT JOIN ranked r ON r.question_id = q.question_id AND r.rank <= r.k LEFT JOIN chunks c ON c.id = r.id GROUP BY 1""",
        _CTES,
    ),
)
def question_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = retrieval.retrieve_context(X.text_index(spark, sf), X.chunks(spark, sf), X.questions(spark), X.now())
    return rows.select("question_id", "n_sources", F.md5("context").alias("context_md5"))


@query(
    "answer_messages",
    O.with_ctes(
        """SELECT r.question_id, 'source' AS type, r.rank::INT AS pos, md5(c.text) AS text_md5 FROM ranked r JOIN chunks c ON c.id = r.id WHERE r.rank <= r.k
        UNION ALL SELECT q.question_id, 'context', 0, coalesce(md5(string_agg('[' || r.rank || '] [' || r.channel_name || ', ' ||
          strftime(r.ts, '%H:%M:%S') || '] ' || c.text, chr(10) ORDER BY r.rank)), md5('(sin fragmentos relevantes)'))
        FROM questions q LEFT JOIN ranked r ON r.question_id = q.question_id AND r.rank <= r.k LEFT JOIN chunks c ON c.id = r.id GROUP BY 1""",
        _CTES,
    ),
)
def answer_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Outbox rows of every question: its sources and its context."""
    questions = X.questions(spark)
    found = retrieval.retrieve(X.text_index(spark, sf), X.chunks(spark, sf), questions, X.now())
    rows = retrieval.answer_messages(questions, found)
    said = F.when(F.col("type") == "source", F.md5(F.get_json_object("payload", "$.text"))).otherwise(F.md5("payload"))
    return rows.select("question_id", "type", "pos", said.alias("text_md5"))
