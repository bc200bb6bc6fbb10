"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as
Parquet and read again. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediawatch.llm import decontamination, language, line_templates, near_copies, packing, simhash
from mediawatch.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the text, the declared language and the host agree on well enough."""
    return language.keep_identified(docs, declared=F.col("lang"), address=F.col("source"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose template recurs; `n_chars` follows the text."""
    kept = line_templates.drop_recurring_lines(docs, growth=line_templates.GROWTH)
    return kept.withColumn(
        "n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    ).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the lowest id, of every group of near copies.

    op6's covering search links SimHash fingerprints at three bits; MinHash bands find the pairs beyond its reach, with a
    Jaccard similarity of 0.8 on five words. Groups are what links of either kind connect.
    """
    return near_copies.keep_one(docs, radius=simhash.RADIUS)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of every document: the tokens it covers, their checksum, and its place in a sequence."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_dedup", keep_one_of_near_copies),
    ("decontamination", drop_test_items),
    ("packing", pack_sequences),
]

#: Fingerprints and token ids have no SQL; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
