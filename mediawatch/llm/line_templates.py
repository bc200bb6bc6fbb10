"""Line dedup by a log-template tree: token count, leading tokens, then the tokens that recur in the leaf.

A line is filed under its token count and its first `depth` tokens (a token with a digit counts as
variable). Lines of one leaf share a template in which a position keeps its token only if enough
documents of the leaf have that token there; every other position is a variable field. A template that
recurs in enough documents and keeps enough fixed tokens is boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediawatch.llm.common import hidden, identity, shipped, stored

DEPTH = 3
MIN_DOCUMENTS = 5
FIXED_SHARE = 0.6
#: Parts a busy line, leaf or token is counted and looked up in.
SALTS = 16
#: From one level of generalising to the next, a token needs so many times the documents to stay fixed.
GROWTH = 4
FIELD = "<*>"
BLANKS = " \t\r"


def tokens(line: Column) -> Column:
    return F.split(F.trim(line, F.lit(BLANKS)), "[ \t\r]+")


def masked(token: Column) -> Column:
    """Digits mark a variable field."""
    return F.when(token.rlike("[0-9]"), F.lit(FIELD)).otherwise(token)


def leaf_key(words: Column, depth: int) -> Column:
    """Path in the tree: token count, then the leading tokens; shorter lines end early."""
    lead = [F.coalesce(masked(F.get(words, F.lit(i))), F.lit("")) for i in range(depth)]
    return F.xxhash64(F.size(words), *lead)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_doc, _id, _text_hash, _line): every line that is not blank."""
    return docs.select(
        F.col(f"`{id_col}`").alias("_doc"),
        *identity(id_col, text_col),
        F.explode(F.split(F.col(f"`{text_col}`"), "\n")).alias("_line"),
    ).filter(F.trim("_line", F.lit(BLANKS)) != "")


def salted(df: DataFrame) -> DataFrame:
    """Every row once per part, for a join whose other side deals a busy key over the parts."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def salt(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int").alias("_salt")


def recurring_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    min_documents: int = MIN_DOCUMENTS,
    fixed_share: float = FIXED_SHARE,
    growth: int | None = None,
) -> DataFrame:
    """(_id, _text_hash, _line_hash, template): the lines to drop, by document.

    A template recurs when at least `min_documents` documents hold it and at least `fixed_share` of its
    positions are fixed, of all as of those after the leading tokens (which the leaf fixes anyway). The lowest document id that holds a template keeps its lines. Documents are
    told apart by id and text, so repeated rows count once and lose the same lines.

    With `growth` a line whose template does not recur is generalised level by level: at level k a token stays
    fixed if min_documents * growth^k line holders of the leaf have it there. A line belongs to the most specific of its
    templates that recurs, so the values of a variable field are generalised however often each of them occurs.
    """
    lines = lines_of(docs, id_col, text_col)
    thin = stored(
        lines.select(
            "_doc", "_id", "_text_hash",
            F.xxhash64("_line").alias("_line_hash"),
            leaf_key(tokens(F.col("_line")), depth).alias("_leaf"),
        ).distinct(),
        "line-leaves",
    )
    # Leaves held by too few documents cannot hold a template that recurs.
    leaves = (
        thin.select("_leaf", "_id", "_text_hash").distinct()
        .groupBy("_leaf").agg(F.count("*").alias("_n"))
        .filter(F.col("_n") >= min_documents).select("_leaf")
    )
    per_line = thin.groupBy("_leaf", "_line_hash").agg(F.count("*").alias("_documents"))
    busy = stored(per_line.join(leaves, "_leaf"), "busy-lines")
    texts = (
        lines.select(F.xxhash64("_line").alias("_line_hash"), "_line")
        .join(shipped(busy.select("_line_hash")), "_line_hash", "left_semi")
        .groupBy("_line_hash").agg(F.min("_line").alias("_line"))
    )
    words = busy.join(texts, "_line_hash").select(
        "_line_hash", "_leaf", "_documents", F.posexplode(tokens(F.col("_line"))).alias("_at", "_token")
    ).withColumn("_token", masked(F.col("_token")))
    words = stored(words, "busy-words")
    fixed = salted(
        words.filter(F.col("_token") != FIELD)
        .groupBy("_leaf", "_at", "_token").agg(F.sum("_documents").alias("_held"))
        .filter(F.col("_held") >= min_documents)
        .select("_leaf", "_at", "_token", F.lit(True).alias("_kept"), "_held")
    )
    if growth is not None:
        return generalised_lines(thin, words, fixed, depth, min_documents, fixed_share, growth)
    fixed = fixed.drop("_held")
    shown = F.when(F.col("_kept"), F.col("_token")).otherwise(F.lit(FIELD))
    templates = (
        words.withColumn("_salt", salt("_line_hash"))
        .join(fixed, ["_leaf", "_at", "_token", "_salt"], "left")
        .groupBy("_line_hash", "_leaf")
        .agg(
            F.array_sort(F.collect_list(F.struct("_at", shown.alias("_shown")))).alias("_parts"),
            F.count("_kept").alias("_fixed"),
            F.count("*").alias("_n"),
            F.count(F.when(F.col("_at") >= depth, F.col("_kept"))).alias("_tail_fixed"),
            F.count(F.when(F.col("_at") >= depth, 1)).alias("_tail"),
        )
        .filter((F.col("_fixed") >= fixed_share * F.col("_n")) & (F.col("_tail_fixed") >= fixed_share * F.col("_tail")))
        .select("_line_hash", "_leaf", F.array_join(F.transform("_parts", lambda p: p["_shown"]), " ").alias("template"))
    )
    held = stored(
        thin.drop("_leaf").withColumn("_salt", salt("_id", "_text_hash"))
        .join(salted(templates), ["_line_hash", "_salt"])
        .select("_doc", "_id", "_text_hash", "_line_hash", "_leaf", "template"),
        "held-templates",
    )
    recurring = salted(
        held.select("_doc", "_id", "_text_hash", "_leaf", "template").distinct()
        .groupBy("_leaf", "template").agg(F.count("*").alias("_n"), F.min("_doc").alias("_keeper"))
        .filter(F.col("_n") >= min_documents).drop("_n")
    )
    return (
        held.withColumn("_salt", salt("_id", "_text_hash"))
        .join(recurring, ["_leaf", "template", "_salt"])
        .filter(~F.col("_doc").eqNullSafe(F.col("_keeper")))
        .select("_id", "_text_hash", "_line_hash", "template")
    )


def generalised_lines(
    thin: DataFrame, words: DataFrame, fixed: DataFrame, depth: int, min_documents: int, fixed_share: float, growth: int
) -> DataFrame:
    """The lines to drop if each belongs to its most specific recurring template of any level."""
    level = F.floor(F.log(float(growth), F.col("_held") / min_documents) + 1e-9).cast("int")
    parts = (
        words.withColumn("_salt", salt("_line_hash"))
        .join(fixed.withColumn("_up_to", level), ["_leaf", "_at", "_token", "_salt"], "left")
        .groupBy("_line_hash", "_leaf")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "_token", F.coalesce("_up_to", F.lit(-1)).alias("_up_to")))).alias("_parts"))
    )
    tail = F.filter("_parts", lambda p: p["_at"] >= depth)
    kept = lambda of, k: F.size(F.filter(of, lambda p: p["_up_to"] >= k))
    enough = lambda k: (kept(F.col("_parts"), k) >= fixed_share * F.size("_parts")) & (kept(tail, k) >= fixed_share * F.size(tail))
    # A template changes only at the levels that one of the tokens does not reach.
    steps = F.array_distinct(F.concat(F.array(F.lit(0)), F.transform("_parts", lambda p: p["_up_to"] + 1)))
    leveled = parts.select("_line_hash", "_leaf", "_parts", F.explode(F.filter(steps, enough)).alias("_level"))
    shown = F.transform("_parts", lambda p: F.when(p["_up_to"] >= F.col("_level"), p["_token"]).otherwise(F.lit(FIELD)))
    templates = stored(
        leveled.select("_line_hash", "_leaf", "_level", F.array_join(shown, " ").alias("template")), "leveled-templates"
    )
    held = (
        thin.withColumn("_salt", salt("_id", "_text_hash"))
        .join(salted(templates.select("_line_hash", "_leaf", "template").distinct()), ["_line_hash", "_leaf", "_salt"])
        .select("_doc", "_id", "_text_hash", "_leaf", "template").distinct()
    )
    recurring = salted(
        held.groupBy("_leaf", "template").agg(F.count("*").alias("_n"), F.min("_doc").alias("_keeper"))
        .filter(F.col("_n") >= min_documents).drop("_n")
    )
    chosen = (
        templates.withColumn("_salt", salt("_line_hash")).join(recurring, ["_leaf", "template", "_salt"])
        .groupBy("_line_hash", "_leaf").agg(F.min(F.struct("_level", "template", "_keeper")).alias("_best"))
        .select("_line_hash", "_leaf", "_best.template", "_best._keeper")
    )
    return (
        thin.withColumn("_salt", salt("_id", "_text_hash"))
        .join(salted(stored(chosen, "chosen-templates")), ["_line_hash", "_leaf", "_salt"])
        .filter(~F.col("_doc").eqNullSafe(F.col("_keeper")))
        .select("_id", "_text_hash", "_line_hash", "template")
    )


def drop_recurring_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    min_documents: int = MIN_DOCUMENTS,
    fixed_share: float = FIXED_SHARE,
    growth: int | None = None,
) -> DataFrame:
    """Every row of `docs` with its recurring lines taken out of the text, plus what was done to it.

    All columns stay; `n_lines` (lines that are not blank) and `n_dropped` are added (a column of that name
    is replaced). Null and empty texts stay as they are, with no lines; blank lines stay; ties do not
    exist (a line is judged by its template alone, the lowest id keeps it); repeated rows lose the same
    lines; an empty table gives no rows. One list of dropped line hashes is gathered per document, at
    most as long as the document. The lists are shipped to the texts; beyond the bounds of `shipped` both sides are
    exchanged.
    """
    gone = stored(
        recurring_lines(docs, id_col, text_col, depth, min_documents, fixed_share, growth)
        .groupBy("_id", "_text_hash").agg(F.collect_set("_line_hash").alias("_gone")),
        "dropped-lines",
    )
    gone = shipped(gone)
    plain = docs.drop("n_lines", "n_dropped")
    names = {c: hidden(docs, c.strip("_")) for c in ("_id", "_text_hash", "_gone")}
    for old, new in names.items():
        gone = gone.withColumnRenamed(old, new)
    key_id, key_text = (c.alias(names[n]) for n, c in zip(("_id", "_text_hash"), identity(id_col, text_col)))
    left = plain.select("*", key_id, key_text)
    joined = left.join(
        gone,
        left[names["_id"]].eqNullSafe(gone[names["_id"]]) & (left[names["_text_hash"]] == gone[names["_text_hash"]]),
        "left",
    ).select(*[left[f"`{c}`"] for c in plain.columns], gone[names["_gone"]])
    text, taken = F.col(f"`{text_col}`"), F.col(names["_gone"])
    parts = F.split(text, "\n")
    full = F.size(F.filter(parts, lambda p: F.trim(p, F.lit(BLANKS)) != ""))
    is_gone = lambda p: F.array_contains(taken, F.xxhash64(p))
    kept = F.filter(parts, lambda p: ~is_gone(p))
    return joined.select(
        *[
            F.when(taken.isNotNull(), F.array_join(kept, "\n")).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`")
            for c in plain.columns
        ],
        F.coalesce(full, F.lit(0)).alias("n_lines"),
        F.when(taken.isNotNull(), F.size(F.filter(parts, is_gone))).otherwise(F.lit(0)).alias("n_dropped"),
    )
