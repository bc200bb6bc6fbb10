"""The registered queries of the numbered operators and the SQL that some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediawatch.llm import (
    alignment, decontamination, language, line_templates, negatives, packing, quality, rendering, repeats, sharding, simhash, topk,
    toxicity,
)
from mediawatch.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents"), growth=line_templates.GROWTH)
    return done.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identified(
        table(spark, sf_dir, "documents"), declared=F.col("lang"), address=F.col("source")
    )
    return found.select("doc_id", "language", "posterior", "text_language", "accepted")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("_doc").alias("doc_id"), F.col("_item").alias("item_id"), "n_item", "n_shared", "containment"
    )


def op5_repeat_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_layout_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.rendered(table(spark, sf_dir, "pages")).select("page_id", "url", "text")


def op11_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.judged(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "failed", "version", "decisive", "regained",
    )


def op12_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_asof_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.token_alignment(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_line_templates, op2_best_two_fit, op3_language_fusion, op4_decontamination, op5_repeat_intervals,
        op6_covering_simhash, op7_threshold_topk, op8_rendezvous_sharding, op9_factorization_toxicity,
        op10_layout_rendering, op11_rule_ledger, op12_bond_negatives, op13_asof_alignment,
    )
}

LINE_TEMPLATES_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, trim(line, ' ' || chr(9) || chr(13)) AS bare
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM documents)
), held AS (
  SELECT DISTINCT doc_id, line, regexp_split_to_array(bare, '[ \t\r]+') AS words FROM lines WHERE bare <> ''
), filed AS (
  SELECT *, [CAST(len(words) AS VARCHAR)]
    || list_transform(words[1:3], lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS leaf
  FROM held
), leaves AS (
  SELECT leaf FROM filed GROUP BY leaf HAVING count(DISTINCT doc_id) >= 5
), distinct_lines AS (
  SELECT line, leaf, words, count(*) AS documents FROM filed JOIN leaves USING (leaf) GROUP BY ALL
), tokens AS (
  SELECT line, leaf, documents, generate_subscripts(words, 1) AS spot, unnest(words) AS raw FROM distinct_lines
), masked AS (
  SELECT line, leaf, documents, spot, CASE WHEN regexp_matches(raw, '[0-9]') THEN '<*>' ELSE raw END AS token FROM tokens
), fixed AS (
  SELECT leaf, spot, token, CAST(floor(ln(sum(documents) / 5.0) / ln(4) + 1e-9) AS INTEGER) AS up_to
  FROM masked WHERE token <> '<*>' GROUP BY ALL HAVING sum(documents) >= 5
), parts AS (
  SELECT m.line, m.leaf, m.spot, m.token, coalesce(f.up_to, -1) AS up_to
  FROM masked m LEFT JOIN fixed f ON m.leaf = f.leaf AND m.spot = f.spot AND m.token = f.token
), steps AS (
  SELECT line, leaf, 0 AS level FROM parts UNION SELECT line, leaf, up_to + 1 FROM parts
), templates AS (
  SELECT p.line, p.leaf, s.level,
    string_agg(CASE WHEN p.up_to < s.level THEN '<*>' ELSE p.token END, ' ' ORDER BY p.spot) AS template
  FROM parts p JOIN steps s ON p.line = s.line AND p.leaf = s.leaf
  GROUP BY p.line, p.leaf, s.level HAVING count(*) FILTER (p.up_to >= s.level) >= 0.6 * count(*)
    AND count(*) FILTER (p.up_to >= s.level AND p.spot > 3) >= 0.6 * count(*) FILTER (p.spot > 3)
), recurring AS (
  SELECT leaf, template, min(doc_id) AS keeper
  FROM filed JOIN templates USING (line, leaf) GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5
), chosen AS (
  SELECT line, min_by(keeper, level) AS keeper FROM templates JOIN recurring USING (leaf, template) GROUP BY line
), marked AS (
  SELECT l.doc_id, l.i, l.line, l.bare, coalesce(l.doc_id <> c.keeper, false) AS gone
  FROM lines l LEFT JOIN chosen c ON l.line = c.line
)
SELECT d.doc_id, CAST(count(*) FILTER (m.bare <> '') AS INTEGER) AS n_lines,
  CAST(count(*) FILTER (m.gone) AS INTEGER) AS n_dropped,
  CASE WHEN d.text IS NOT NULL THEN md5(coalesce(string_agg(m.line, chr(10) ORDER BY m.i) FILTER (NOT m.gone), '')) END AS kept_md5
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id
GROUP BY d.doc_id, d.text
"""

DECONTAMINATION_SQL = r"""
WITH texts AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words, true AS is_doc FROM documents
  UNION ALL
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''), false FROM benchmark
), shingles AS (
  SELECT DISTINCT id, is_doc, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM texts WHERE len(words) > 0)
), items AS (
  SELECT id AS item_id, shingle, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE NOT is_doc
)
SELECT s.id AS doc_id, i.item_id, CAST(i.n AS INTEGER) AS n_item, CAST(count(*) AS INTEGER) AS n_shared,
  round(count(*) / i.n, 6) AS containment
FROM shingles s JOIN items i USING (shingle) WHERE s.is_doc
GROUP BY s.id, i.item_id, i.n HAVING 5 * count(*) >= 4 * i.n
"""

TOPK_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

LEDGER_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT r, i, words[i : i + 2] AS gram
  FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM docs)
), twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, gram) > 1
), runs AS (
  SELECT r, count(DISTINCT i + s) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS s) GROUP BY r
), measured AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) AS n_letter_words,
    len(list_filter(words, lambda w: regexp_matches(w, '\p{Lu}[^\p{Lu}]*\p{Lu}') AND NOT regexp_matches(w, '\p{Ll}'))) AS n_caps_words,
    len(list_filter(lines, lambda l: regexp_matches(l, '^[ \t\n\x0b\x0c\r]*[-*•‣·]'))) AS n_bullet_lines,
    len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[ \t\n\x0b\x0c\r]*$'))) AS n_ellipsis_lines
  FROM docs LEFT JOIN runs USING (r)
), tested AS (
  SELECT *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, n_words > 100000, word_chars < 3 * n_words, word_chars > 10 * n_words,
    10 * n_symbols > n_words, 100 * n_letter_words < 80 * n_words, 100 * n_dup_lines > 30 * n_lines, 100 * n_caps_words > 50 * n_words,
    100 * n_bullet_lines > 90 * n_lines, 100 * n_ellipsis_lines > 30 * n_lines] AS fails,
    ['few_words', 'repeated_runs', 'many_words', 'short_words', 'long_words', 'symbols', 'few_letters', 'repeated_lines', 'capitals',
     'bullets', 'cut_lines'] AS names
  FROM measured
), verdicts AS (
  SELECT *, list_sum(list_transform(fails, lambda f, i: CASE WHEN f THEN 1 << (i - 1) ELSE 0 END)) AS failed,
    list_filter(names, lambda x, i: fails[i] AND i NOT IN (3, 10, 11)) AS against,
    CAST(fails[3] AS INTEGER) + CAST(fails[10] AS INTEGER) + CAST(fails[11] AS INTEGER) AS doubts
  FROM tested
), decided AS (
  SELECT *, len(against) = 0 AND doubts <= 1 AS kept,
    CASE WHEN len(against) = 1 AND doubts <= 1 THEN against[1] END AS decisive
  FROM verdicts
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, fails[1] OR fails[2] AS base_failed, kept,
  CAST(failed AS BIGINT) AS failed, '3' AS version, decisive,
  CASE WHEN decisive IS NOT NULL THEN count(*) OVER (PARTITION BY decisive) END AS regained
FROM decided
"""

NEGATIVES_SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, c.r AS other, c.vec_id, a.label = c.label AS same,
    CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM usable a JOIN usable c ON a.r <> c.r AND len(a.v) = len(c.v) WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n
  ON p.anchor = n.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""

#: The others have no SQL (hash functions, tokenizers, fitted models, suffix arrays, page trees); see tests/llm.
ORACLES: dict[str, str] = {
    "op1_line_templates": LINE_TEMPLATES_SQL,
    "op4_decontamination": DECONTAMINATION_SQL,
    "op7_threshold_topk": TOPK_SQL,
    "op11_rule_ledger": LEDGER_SQL,
    "op12_bond_negatives": NEGATIVES_SQL,
}
