"""Language by Bayesian fusion of evidence: text, declared language, address suffix and host.

The text likelihood comes from hashed byte trigrams, fitted on a bounded sample of rows with a declared language. What
a declaration, a suffix and a host are worth is counted over all rows by grouped aggregation of the text
evidence; a host's prior is smoothed towards its domain's, and that towards the whole table's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediawatch.llm.common import identity, shipped, stored, without

CELLS = 1 << 15
#: Rows of each language to fit on: the lowest hashes of their texts.
SAMPLE = 400
#: Parts that the rows of one language are ranked in first.
PARTS = 64
#: A declared value is a language if so many different texts have it, or at least this share of the declaring rows.
ENOUGH = 50
SHARE = 0.005
#: Prior of a text of no language, whose trigrams are all equally likely.
OTHER = 0.01
#: Trigrams that count as independent; a longer text weighs no more.
INDEPENDENT = 64
#: Rows of its parent that a host or domain starts from.
PARENT = 20.0
LEAST_POSTERIOR = 0.5
UNKNOWN = "und"

LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def trigrams(text: str | None) -> np.ndarray:
    """Cells of the byte trigrams of a lower-case text; ASCII signs and digits count as blanks."""
    data = b" " + b" ".join((text or "").lower().encode().translate(LETTERS_ONLY).split()) + b" "
    if len(data) < 3:
        return np.zeros(0, dtype=np.uint32)
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    return ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(17)


def declared_languages(rows: DataFrame, share: float, enough: int = ENOUGH) -> list[str]:
    """Declared values with `enough` different texts, whatever their share, or with at least the share of the declaring rows."""
    each = rows.filter("_declared is not null").groupBy("_declared", F.xxhash64("_text").alias("_hash")).agg(
        F.count("*").alias("n"), F.max((F.octet_length("_text") > 0).cast("int")).alias("text")
    )
    counts = stored(each.groupBy("_declared").agg(F.sum("n").alias("n"), F.sum("text").alias("texts")), "declared-values")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return sorted(r[0] for r in counts.filter((F.col("n") >= share * total) | (F.col("texts") >= enough)).collect())


def fitted(rows: DataFrame, languages: list[str], sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities, one row per cell and one column per language, from `sample` texts of each; texts read of each."""
    place = {name: i for i, name in enumerate(languages)}
    inside = Window.partitionBy("_declared", "_part").orderBy("_hash")
    order = Window.partitionBy("_declared").orderBy("_hash")
    chosen = (
        rows.filter(F.col("_declared").isin(languages) & (F.octet_length("_text") > 0))
        .select("_declared", F.xxhash64("_text").alias("_hash")).distinct()
        .withColumn("_part", F.pmod("_hash", F.lit(PARTS)))
        .withColumn("_rank", F.row_number().over(inside)).filter(F.col("_rank") <= sample)
        .withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= sample).drop("_rank", "_part")
    )

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = np.full((CELLS, len(languages)), 0.5), np.zeros(len(languages))
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts[:, place[name]] += np.bincount(trigrams(text.as_py()), minlength=CELLS)
                texts[place[name]] += 1
        yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f8").tobytes()], pa.binary()) for x in (counts, texts)], ["counts", "texts"])

    texts = rows.select("_declared", F.xxhash64("_text").alias("_hash"), "_text")
    model = (
        texts.join(F.broadcast(chosen), ["_declared", "_hash"])
        .groupBy("_declared", "_hash").agg(F.min("_text").alias("_text")).select("_declared", "_text")  # copies count once
        .repartition(1).mapInArrow(counted, "counts binary, texts binary").first()
    )
    counts = np.frombuffer(model["counts"], dtype="<f8").reshape(CELLS, len(languages))
    return np.log(counts / counts.sum(axis=0)).astype(np.float32), np.frombuffer(model["texts"], dtype="<f8")


def normalised(logs: Column) -> Column:
    """Probabilities from an array of logarithms."""
    raised = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def summed(n: int, what: str) -> list[Column]:
    return [F.coalesce(F.sum(F.get(what, F.lit(i))), F.lit(0.0)).alias(f"_{i}") for i in range(n)]


def vector(n: int) -> Column:
    return F.array(*[F.col(f"_{i}") for i in range(n)])


def host_of(url: Column) -> Column:
    """Host of an address, or of a bare host name, in lower case; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def domain_of(host: Column) -> Column:
    """The last two labels; the host itself if it has fewer."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    """The last label of a host that has several."""
    return F.when(host.contains("."), F.substring_index(host, ".", -1))


def markup_language(html: Column) -> Column:
    """Main part of the language declared on the html element, in lower case; null if there is none."""
    lang = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    return F.when(lang != "", lang)


def visible(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", " ")


def evidence(rows: DataFrame, table: np.ndarray, judges: np.ndarray) -> DataFrame:
    """The rows with `_logs`, the text's log likelihood per language (null without letters), and `_explained` instead of the text.

    A text is unexplained if equally likely trigrams, with the prior of such texts, explain it better than
    its best language does, and that is one that judges.
    """
    chance, other = -np.log(CELLS), np.log(OTHER)

    def likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs, explained = [], []
            for t in batch.column(0):
                cells = trigrams(t.as_py())
                own = table[cells].sum(axis=0, dtype=np.float64) * min(1.0, INDEPENDENT / len(cells)) if len(cells) else None
                logs.append(own)
                explained.append(own is None or not judges[own.argmax()] or bool(own.max() >= min(len(cells), INDEPENDENT) * chance + other))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(logs, pa.list_(pa.float64())), pa.array(explained, pa.bool_())],
                [*batch.schema.names[1:], "_logs", "_explained"],
            )

    rest = rows.select("_text", *[c for c in rows.columns if c != "_text"])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields[1:])
    return rest.mapInArrow(likely, f"{kept}, _logs array<double>, _explained boolean")


def worth(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, `_counts`, `_all`): text evidence summed per value of the key, in all and per language."""
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*summed(n, "_share"))
    return counts.select(key, vector(n).alias("_counts"))


def likelihood(rows: DataFrame, key: str, totals: list[float]) -> DataFrame:
    """(key, `_log_<key>`): log P(value | language), each value starting from one row per language."""
    n = len(totals)
    per = F.array(*[F.lit(t + 1.0) for t in totals])
    return worth(rows, key, n).select(
        key, F.zip_with("_counts", per, lambda c, t: F.log((c + 1.0 / n) / t)).alias(f"_log{key}")
    )


def identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None,
    address: Column | None = None, sample: int = SAMPLE, share: float = SHARE, languages: list[str] | None = None,
    enough: int = ENOUGH,
) -> DataFrame:
    """(doc_id, _id, _text_hash, language, posterior, text_language, accepted): one row per row of `docs`.

    A null declaration or address says nothing (without address the prior is the whole table's). A text without
    letters, null and empty ones included, says nothing either and is not accepted; nor is a row whose best
    posterior is under one half, nor a text that equally likely trigrams explain better than any language (noise, or a
    language that is not in the model), if its best language was fitted on `enough` texts: one fitted on fewer has not
    seen most of its own trigrams. Ties go to the first language by name. A row's own text is left out of its
    host's counts. Repeated rows count each and get equal results; a table that declares nothing gives
    'und' throughout, an empty table no rows. Very long texts are read whole and weigh as much as 64
    independent trigrams; further columns are not read.
    """
    null = F.lit(None).cast("string")
    rows = docs.select(
        F.col(f"`{text_col}`").cast("string").alias("_text"), F.col(f"`{id_col}`").alias("doc_id"),
        *identity(id_col, text_col),
        F.lower(null if declared is None else declared).alias("_declared"),
        host_of(null if address is None else address).alias("_host"),
    )
    known = languages or declared_languages(rows, share, enough)
    if not known:
        return rows.select(
            "doc_id", "_id", "_text_hash", F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("posterior"),
            F.lit(UNKNOWN).alias("text_language"), F.lit(False).alias("accepted"),
        )
    n = len(known)
    table, texts = fitted(rows, known, sample)
    seen = stored(evidence(rows, table, texts >= min(enough, sample)), "language-evidence").select(
        "*", domain_of(F.col("_host")).alias("_domain"), suffix_of(F.col("_host")).alias("_suffix"),
        F.when(F.col("_logs").isNotNull(), normalised(F.col("_logs"))).alias("_share"),
    )
    whole = seen.agg(*summed(n, "_share")).first()
    totals = list(whole)
    base = [(t + 1.0) / (sum(totals) + n) for t in totals]
    everywhere = F.array(*[F.lit(p) for p in base])

    def smoothed(counts: Column, parent: Column) -> Column:
        size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, parent, lambda c, p: (F.greatest(c, F.lit(0.0)) + PARENT * p) / (size + PARENT))

    domains = worth(seen, "_domain", n).select("_domain", smoothed(F.col("_counts"), everywhere).alias("_domain_prior"))
    hosts = worth(seen, "_host", n).withColumnRenamed("_counts", "_host_counts")
    joined = (
        seen.join(shipped(stored(hosts, "hosts")), "_host", "left")
        .join(shipped(stored(domains, "domains")), "_domain", "left")
        .join(shipped(stored(likelihood(seen, "_declared", totals), "declared")), "_declared", "left")
        .join(shipped(stored(likelihood(seen, "_suffix", totals), "suffixes")), "_suffix", "left")
    )
    none = F.array(*[F.lit(0.0)] * n)
    others = F.zip_with("_host_counts", F.coalesce("_share", none), lambda c, own: c - own)
    prior = F.coalesce(smoothed(others, F.col("_domain_prior")), everywhere)
    logs = reduce(
        lambda a, b: F.zip_with(a, b, lambda x, y: x + y),
        [F.coalesce(F.col(c), none) for c in ("_logs", "_log_declared", "_log_suffix")] + [F.transform(prior, lambda x: F.log(x))],
    )
    names = F.array(*[F.lit(x) for x in known])
    scored = joined.withColumn("_sum", logs).withColumn("_posterior", normalised(F.col("_sum")))
    best = F.array_max("_posterior")
    return scored.select(
        "doc_id", "_id", "_text_hash",
        F.element_at(names, F.array_position("_posterior", best).cast("int")).alias("language"),
        F.round(best, 6).alias("posterior"),
        F.coalesce(F.element_at(names, F.array_position("_logs", F.array_max("_logs")).cast("int")), F.lit(UNKNOWN)).alias("text_language"),
        (F.col("_logs").isNotNull() & (best >= LEAST_POSTERIOR) & F.col("_explained")).alias("accepted"),
    )


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs` whose language is accepted, with all their columns."""
    bad = identified(docs, id_col, text_col, **how).filter("not accepted").select("_id", "_text_hash").distinct()
    return without(docs, bad, id_col, text_col)
