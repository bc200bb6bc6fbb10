"""Full-text retrieval: postings, structured matching, BM25 ranking and answer context."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediawatch.functions import text as T
from mediawatch.functions.timefn import range_cutoff
from mediawatch.scale import pinned, shipped, stored
from mediawatch.sources.transcripts import between_days

# Published Okapi BM25 parameters.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6

DEFAULT_TOP = 15
MIN_TOP, MAX_TOP = 3, 30
# Fixed value: context line when nothing was found.
NOTHING_FOUND = "(sin fragmentos relevantes)"


#: Folders of the postings table, by the first letter of the term.
BUCKETS = 64
#: Leading letters that a term and a prefix must share to meet in a join.
LEAD = 3
#: Lengths of the leading parts of terms that the dictionary counts documents of.
PARTS = (3, 6)
#: Document ids in a block of postings.
BLOCK_IDS = 64
#: Blocks that a search by bounds scores first, for its threshold; at least as many as it wants rows.
FIRST_BLOCKS = 8
#: Postings of a query that are simply all scored.
DIRECT = 1_000_000
#: Scores are rounded to six digits; a bound this much below one may still round up to it.
SLACK = 2e-6


def term_places(tokens: Column) -> Column:
    """array<struct<term,places>> of a token array: sorted with their places, then cut where the term changes."""
    placed = F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("at"))))

    def of(ws: Column) -> Column:
        n = F.size(ws)
        firsts = F.filter(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
            lambda i: (i < n) & ((i == 0) | (F.get(ws, i)["term"] != F.get(ws, i - 1)["term"])),
        )
        return T.let(
            firsts,
            lambda at: F.transform(
                at,
                lambda p, j: F.struct(
                    F.get(ws, p)["term"].alias("term"),
                    F.slice(ws, p + 1, F.coalesce(F.get(at, j + 1), n) - p)["at"].alias("places"),
                ),
            ),
        )

    return T.let(placed, of)


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, 1)), F.lit(BUCKETS)).cast("int")


def tokenised(chunks: DataFrame) -> DataFrame:
    """(doc_id, channel_name, ts, _t): the terms of every chunk with a text, in order."""
    spoken = chunks.filter(F.col("text").isNotNull()).select(F.col("id").alias("doc_id"), "channel_name", "ts", "text")
    return pinned(spoken, "_t", T.index_terms(F.col("text"))).drop("text")


def postings(chunks: DataFrame) -> DataFrame:
    """(doc_id, term, tf, doc_len, places) of every chunk, counted inside its row without a shuffle."""
    return _postings_of(tokenised(chunks))


def _postings_of(tokens: DataFrame) -> DataFrame:
    return (
        tokens
        .select("doc_id", F.size("_t").alias("doc_len"), F.inline(term_places(F.col("_t"))))
        .select("doc_id", "term", "doc_len", F.size("places").cast("bigint").alias("tf"), "places")
    )


@dataclass
class TextIndex:
    """Postings (doc_id, term, doc_len, tf, places, bucket) and documents (doc_id, channel_name, ts, doc_len).

    A stored index (`text_index`) also has a dictionary (term, prefix, bucket, df), whose rows add up, totals (n,
    len_sum), and blocks of postings (term, bucket, block, max_tf, min_len, n, first_ts, last_ts).
    """

    postings: DataFrame
    documents: DataFrame
    terms: DataFrame | None = None
    totals: DataFrame | None = None
    blocks: DataFrame | None = None


def index_tables(chunks: DataFrame) -> TextIndex:
    """The rows of both index tables for some chunks."""
    return tables_of(tokenised(chunks))


def tables_of(tokens: DataFrame) -> TextIndex:
    """The same from `tokenised` chunks."""
    documents = tokens.select("doc_id", "channel_name", "ts", F.size("_t").alias("doc_len"))
    return TextIndex(_postings_of(tokens).withColumn("bucket", bucket_of(F.col("term"))), documents)


@dataclass
class TextQuery:
    """Structured full-text query; a trailing * makes a term a prefix.

    A row matches if it has one of any_of (when given), all of all_of, the phrase, and none of none_of.
    """

    any_of: list[str] = field(default_factory=list)
    all_of: list[str] = field(default_factory=list)
    none_of: list[str] = field(default_factory=list)
    phrase: str | None = None


def _wanted(term: str) -> tuple[Column, Column]:
    """(postings of a query term, its folder): both reach the scan."""
    norm = F.get(T.index_terms(F.lit(term.rstrip("*"))), F.lit(0))
    hit = F.startswith(F.col("term"), norm) if term.endswith("*") else F.col("term") == norm
    return hit, bucket_of(norm)


def _idf(n: Column, df: Column) -> Column:
    return F.greatest(F.ln((n - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))


def _saturation(tf: Column, doc_len: Column, avg_len: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / avg_len))


def _parts(query: TextQuery) -> dict[str, str]:
    return {f"_q{i}": t for i, t in enumerate([*query.any_of, *query.all_of])}


def _phrase_counts(index: TextIndex, phrase: str) -> DataFrame:
    """(doc_id, _qp): places where the words of the phrase follow one another."""
    words = F.transform(T.index_terms(F.lit(phrase)), lambda w, i: F.struct(w.alias("term"), i.alias("offset"), bucket_of(w).alias("bucket")))
    asked = index.documents.sparkSession.range(1).select(F.explode(words).alias("w")).select("w.*")
    n = stored(asked, "phrase")
    size = n.count()
    starts = (
        index.postings.join(F.broadcast(n), ["bucket", "term"])  # as many rows as the phrase has words
        .select("doc_id", "offset", F.explode("places").alias("at"))
        .select("doc_id", "offset", (F.col("at") - F.col("offset")).alias("start"))
    )
    return (
        starts.groupBy("doc_id", "start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == size)
        .groupBy("doc_id").agg(F.count(F.lit(1)).alias("_qp"))
    )


def _counted(index: TextIndex, query: TextQuery, kept: DataFrame | None = None) -> DataFrame:
    """(doc_id, counts per query part, _banned) of the documents (in the blocks `kept`) that hold a term of the query."""
    parts = {name: _wanted(t) for name, t in _parts(query).items()}
    banned = [_wanted(t) for t in query.none_of]
    asked = [*parts.values(), *banned]
    no = F.lit(False)
    either = reduce(lambda a, b: a | b, [hit & (F.col("bucket") == bucket) for hit, bucket in asked], no)
    counts = [F.sum(F.when(hit, F.col("tf")).otherwise(0)).alias(name) for name, (hit, _) in parts.items()]
    out = F.max(reduce(lambda a, b: a | b, [hit for hit, _ in banned], no)).alias("_banned")
    rows = index.postings.filter(either)
    if kept is not None:
        rows = rows.join(shipped(kept.select("block")), "block", "left_semi")
    held = rows.groupBy("doc_id").agg(*counts, out)
    if query.phrase:
        held = held.join(_phrase_counts(index, query.phrase), "doc_id", "full")
    return held.na.fill(0).na.fill(False)


def _matching(counted: DataFrame, query: TextQuery) -> DataFrame:
    names = [*_parts(query), *(["_qp"] if query.phrase else [])]
    n_any = len(query.any_of)
    some = reduce(lambda a, b: a | b, [F.col(n) > 0 for n in names[:n_any]], F.lit(n_any == 0))
    every = reduce(lambda a, b: a & b, [F.col(n) > 0 for n in names[n_any:]], F.lit(True))
    return counted.filter(some & every & ~F.col("_banned"))


def matching_chunks(index: TextIndex, query: TextQuery, kept: DataFrame | None = None) -> DataFrame:
    """(id, channel_name, ts, doc_len, counts) of every chunk (in the blocks `kept`) the query accepts. No text is read."""
    counted = _counted(index, query, kept)
    if not (query.any_of or query.all_of or query.phrase):  # whatever holds no banned term
        counted = index.documents.select("doc_id").join(counted, "doc_id", "left").na.fill(0).na.fill(False)
    return index.documents.join(_matching(counted, query), "doc_id").withColumnRenamed("doc_id", "id").drop("_banned")


def _totals(index: TextIndex) -> DataFrame:
    """One row (n, avg): documents and their mean length, read from the totals where the index keeps them."""
    if index.totals is None:
        return index.documents.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avg"))
    return index.totals.agg(F.sum("n").alias("n"), F.try_divide(F.sum("len_sum"), F.sum("n")).alias("avg"))


def _numbers(index: TextIndex, query: TextQuery) -> dict[str, float]:
    """What the scores of a query need to know of the whole index: n, avg and the documents that hold each part."""
    row = _document_counts(index, query).crossJoin(_totals(index)).first()  # one row beside one row
    return {k: v or 0 for k, v in row.asDict().items()}


def known_length(term: str) -> bool:
    """The dictionary counts the documents of this query term: a whole term, or a leading part of a length it keeps."""
    return not term.endswith("*") or PARTS[0] <= len(term) - 1 <= PARTS[1]


def _document_counts(index: TextIndex, query: TextQuery) -> DataFrame:
    """One row: the number of documents that hold each part of the query.

    From the dictionary, where the index has one; a phrase, and a leading part of a length that the dictionary does
    not keep, are counted in the postings.
    """
    names = [*_parts(query), *(["_qp"] if query.phrase else [])]
    read = {n: t for n, t in _parts(query).items() if index.terms is not None and known_length(t)}
    entries = {}
    for name, term in read.items():
        norm = F.get(T.index_terms(F.lit(term.rstrip("*"))), F.lit(0))
        entries[name] = (F.col("term") == norm) & (F.col("prefix") == term.endswith("*")) & (F.col("bucket") == bucket_of(norm))
    rest = [n for n in names if n not in read]
    from_dictionary = None
    if entries:
        asked = index.terms.filter(reduce(lambda a, b: a | b, entries.values()))
        from_dictionary = asked.agg(*[F.coalesce(F.sum(F.when(e, F.col("df"))), F.lit(0)).alias(n) for n, e in entries.items()])
    if not rest:
        return index.documents.sparkSession.range(1) if from_dictionary is None else from_dictionary
    counts = _counted(index, query).agg(*[F.count_if(F.col(n) > 0).alias(n) for n in rest])
    return counts if from_dictionary is None else counts.crossJoin(from_dictionary)  # one row beside one row


def _score(names: list[str], numbers: dict[str, float]) -> Column:
    n, avg = F.lit(numbers["n"]), F.lit(numbers["avg"])
    parts = [_idf(n, F.lit(numbers[p])) * _saturation(F.col(p), F.col("doc_len"), avg) for p in names]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def ranked_search(
    index: TextIndex,
    query: TextQuery,
    channel: str | None = None,
    since: Column | None = None,
    until: Column | None = None,
    limit: int | None = 20,
) -> DataFrame:
    """(id, channel_name, ts, score): best chunks by relevance, then newest; `limit` None gives all.

    Statistics are those of the whole index, read from its dictionary where it has one. Only the query's postings are
    read, and the thin documents table. With blocks and a limit, blocks whose bound is below the limit-th best score
    of the most promising ones are not read (`block_bounds`).
    """
    numbers = _numbers(index, query)
    scored = partial(_scored, index, query, numbers, channel, since, until)
    order = (F.col("score").desc(), F.col("ts").desc(), F.col("id").desc())
    if limit is None:
        return scored(None).orderBy(*order)
    bounds, least = _threshold(index, query, numbers, scored, since, until, limit)
    return scored(None if least is None else reaching(bounds, least)).orderBy(*order).limit(limit)


def _scored(
    index: TextIndex, query: TextQuery, numbers: dict, channel: str | None, since: Column | None, until: Column | None,
    kept: DataFrame | None,
) -> DataFrame:
    names = [*_parts(query), *(["_qp"] if query.phrase else [])]
    found = _facets(matching_chunks(index, query, kept), channel, since, until)
    return found.select("id", "channel_name", "ts", F.round(_score(names, numbers), 6).alias("score"))


def postings_read(
    index: TextIndex, query: TextQuery, channel: str | None = None, since: Column | None = None, until: Column | None = None,
    limit: int = 20,
) -> DataFrame:
    """One row: blocks and postings of the query, and how many of them a search for the first `limit` reads last."""
    numbers = _numbers(index, query)
    scored = partial(_scored, index, query, numbers, channel, since, until)
    bounds, least = _threshold(index, query, numbers, scored, since, until, limit)
    bounds = block_bounds(index, query, numbers, since, until) if bounds is None else bounds
    kept = F.lit(True) if least is None else F.col("bound") >= least - SLACK
    return bounds.agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if(kept).alias("kept_blocks"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(kept, F.col("rows"))), F.lit(0)).alias("kept_rows"),
    )


def _threshold(
    index: TextIndex, query: TextQuery, numbers: dict, scored, since: Column | None, until: Column | None, limit: int
) -> tuple[DataFrame | None, float | None]:
    """(bounds of the query's blocks, the limit-th best score of the most promising ones).

    No score if one pass over the query's postings costs less than three (`DIRECT`), if the index has no blocks or the
    query no terms that bound a score, or if the first blocks hold too few documents.
    """
    held = sum(numbers[n] for n in _parts(query))
    if index.blocks is None or query.phrase or not held > DIRECT:
        return None, None
    bounds = stored(block_bounds(index, query, numbers, since, until), "block-bounds")
    first = stored(bounds.orderBy(F.desc("bound"), "block").limit(max(FIRST_BLOCKS, limit)), "first-blocks")
    best = scored(first).orderBy(F.desc("score")).limit(limit).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).first()
    return bounds, best["s"] if best["n"] == limit else None


def reaching(bounds: DataFrame, score: float) -> DataFrame:
    """The blocks that may hold a document of this (rounded) score."""
    return bounds.filter(F.col("bound") >= score - SLACK)


def block_bounds(
    index: TextIndex, query: TextQuery, numbers: dict[str, float], since: Column | None = None, until: Column | None = None
) -> DataFrame:
    """(block, bound, rows): the highest score a document of the block can have, and the block's postings of the query.

    A part's count in a document is at most the sum of its terms' highest counts in the block, the document at least as
    short as the block's shortest, and the score rises with the one and falls with the other. Blocks outside the
    time range, or without a part that all documents must hold, are left out.
    """
    parts = {name: _wanted(t) for name, t in _parts(query).items()}
    either = reduce(lambda a, b: a | b, [hit & (F.col("bucket") == bucket) for hit, bucket in parts.values()])
    rows = index.blocks.filter(either)
    if since is not None:
        rows = rows.filter(F.col("last_ts") >= since)
    if until is not None:
        rows = rows.filter(F.col("first_ts") <= until)
    most = [F.sum(F.when(hit, F.col("max_tf")).otherwise(0)).alias(name) for name, (hit, _) in parts.items()]
    per = rows.groupBy("block").agg(*most, F.min("min_len").alias("doc_len"), F.sum("n").alias("rows"))
    must = list(parts)[len(query.any_of) :]
    per = per.filter(reduce(lambda a, b: a & b, [F.col(n) > 0 for n in must], F.lit(True)))
    return per.select("block", _score(list(parts), numbers).alias("bound"), "rows")


def with_texts(winners: DataFrame, chunks: DataFrame) -> DataFrame:
    """The rows (id, ts, ...) with their texts: read from the days that hold one, next to the shipped rows."""
    rows = stored(winners, "winners")
    span = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    days = chunks if span["lo"] is None else between_days(chunks, F.lit(span["lo"].date()), F.lit(span["hi"].date()))
    return days.select("id", "text").join(shipped(rows), "id")


def _facets(rows: DataFrame, channel: str | None, since: Column | None, until: Column | None) -> DataFrame:
    if channel:
        rows = rows.filter(F.contains(F.lower("channel_name"), F.lit(channel.lower())))
    if since is not None:
        rows = rows.filter(F.col("ts") >= since)
    if until is not None:
        rows = rows.filter(F.col("ts") <= until)
    return rows


def question_table(questions: DataFrame, now: Column) -> DataFrame:
    """Questions as term lists: significant words as prefixes, any of them; or else the question's
    own words, all of them. Adds the cutoff of the named range and the clamped number of results."""
    sig = T.question_terms(F.col("question"))
    prefixes = F.transform(sig, lambda t: F.struct(F.get(T.index_terms(t), F.lit(0)).alias("term"), F.lit(True).alias("prefix")))
    own = F.transform(F.array_distinct(T.index_terms(F.col("question"))), lambda t: F.struct(t.alias("term"), F.lit(False).alias("prefix")))
    any_term = F.size(sig) > 0
    top = F.when(F.coalesce("top_n", F.lit(0)) == 0, DEFAULT_TOP).otherwise(F.col("top_n"))
    return questions.filter(F.trim("question") != "").select(
        "question_id",
        "question",
        F.array_distinct(F.when(any_term, prefixes).otherwise(own)).alias("terms"),
        (~any_term).alias("need_all"),
        range_cutoff(F.col("range"), now).alias("since"),
        F.lower(F.coalesce("channel", F.lit(""))).alias("channel"),
        F.greatest(F.least(top, F.lit(MAX_TOP)), F.lit(MIN_TOP)).alias("k"),
    )


def retrieve(index: TextIndex, chunks: DataFrame, questions: DataFrame, now: Column) -> DataFrame:
    """Top chunks of every question at once: (question_id, rank, score, id, channel_name, ts, text).

    The questions' terms (shipped within the bound of `shipped`) meet the postings on their folder and first
    letters, so only those folders are read and only hits are exchanged. Texts are fetched for the winners.
    """
    asked = question_table(questions, now)
    terms = asked.select("question_id", "need_all", F.size("terms").alias("n_terms"), F.explode("terms").alias("_t")).select(
        "question_id", "need_all", "n_terms", F.col("_t.term").alias("vterm"), "_t.prefix"
    )
    vocabulary = stored(
        terms.select("vterm", "prefix").distinct().withColumn("bucket", bucket_of(F.col("vterm")))
        .withColumn("_lead", F.substring("vterm", 1, LEAD)),
        "vocabulary",
    )
    totals = _totals(index).first()
    n, avg = F.lit(totals["n"] or 0), F.lit(totals["avg"] or 0.0)
    hit = (F.col("term") == F.col("vterm")) | (F.col("prefix") & F.startswith(F.col("term"), F.col("vterm")))
    tf = (
        index.postings.select("doc_id", "term", "doc_len", "tf", "bucket", F.substring("term", 1, LEAD).alias("_lead"))
        .join(shipped(vocabulary), ["bucket", "_lead"]).filter(hit)
        .groupBy("doc_id", "doc_len", "vterm", "prefix").agg(F.sum("tf").alias("tf"))
    )
    tf = stored(tf, "question-hits")
    df = _vocabulary_counts(index, vocabulary, tf)
    weighted = (
        tf.join(df, ["vterm", "prefix"])
        .withColumn("w", _idf(n, F.col("df")) * _saturation(F.col("tf"), F.col("doc_len"), avg))
    )
    limits = asked.select("question_id", "since", "channel", "k")
    scored = (
        weighted.join(terms, ["vterm", "prefix"])
        .groupBy("question_id", "need_all", "n_terms", "doc_id")
        .agg(F.round(F.sum("w"), 6).alias("score"), F.count(F.lit(1)).alias("_got"))
        .filter(~F.col("need_all") | (F.col("_got") == F.col("n_terms")))
        .join(index.documents.select("doc_id", "channel_name", "ts"), "doc_id")
        .join(limits, "question_id")
        .filter(F.col("since").isNull() | (F.col("ts") >= F.col("since")))
        .filter(F.contains(F.lower("channel_name"), F.col("channel")))
    )
    w = Window.partitionBy("question_id").orderBy(F.col("score").desc(), F.col("ts").desc(), F.col("doc_id").desc())
    top = (
        scored.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= F.col("k"))
        .select("question_id", "rank", "score", F.col("doc_id").alias("id"), "channel_name", "ts")
    )
    return with_texts(top, chunks)


def _vocabulary_counts(index: TextIndex, vocabulary: DataFrame, hits: DataFrame) -> DataFrame:
    """(vterm, prefix, df) of the questions' terms: from the dictionary what it keeps, the rest from their hits."""
    if index.terms is None:
        return hits.groupBy("vterm", "prefix").agg(F.count(F.lit(1)).alias("df"))
    size = F.length("vterm")
    known = ~F.col("prefix") | size.between(*PARTS)
    asked = vocabulary.filter(known).select("vterm", F.col("prefix").alias("_prefix"), F.col("bucket").alias("_bucket"))
    same = (F.col("bucket") == F.col("_bucket")) & (F.col("term") == F.col("vterm")) & (F.col("prefix") == F.col("_prefix"))
    read = index.terms.join(shipped(asked), same).groupBy("vterm", "prefix").agg(F.sum("df").alias("df"))
    return read.unionByName(hits.filter(~known).groupBy("vterm", "prefix").agg(F.count(F.lit(1)).alias("df")))


def answer_context(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """One context text per question: numbered lines in rank order, or the placeholder."""
    line = T.context_line(F.col("rank"), F.col("channel_name"), F.col("ts"), F.col("text"))
    lines = retrieved.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_l"),
        F.count(F.lit(1)).alias("n_sources"),
    )
    return questions.join(lines, "question_id", "left").select(
        "question_id",
        "question",
        F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
        F.coalesce(F.array_join("_l.line", "\n"), F.lit(NOTHING_FOUND)).alias("context"),
    )


def answer_messages(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Outbox of a question: one `sources` row per fragment and one `context` row."""
    sources = retrieved.select(
        "question_id",
        F.lit("source").alias("type"),
        F.col("rank").alias("pos"),
        F.to_json(F.struct("channel_name", "ts", "text")).alias("payload"),
    )
    context = answer_context(questions, retrieved).select(
        "question_id", F.lit("context").alias("type"), F.lit(0).alias("pos"), F.col("context").alias("payload")
    )
    return sources.unionByName(context)


def retrieve_context(index: TextIndex, chunks: DataFrame, questions: DataFrame, now: Column) -> DataFrame:
    """Question in, assembled context out, for any number of questions."""
    return answer_context(questions, retrieve(index, chunks, questions, now))
