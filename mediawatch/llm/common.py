"""What the operators of this package share: stored stages, hidden column names, row identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediawatch.scale import shipped, stored  # noqa: F401  (re-exported)

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hidden(df: DataFrame, name: str) -> str:
    """A column name that no column of the table has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = f"_{name}"
    while out.lower() in taken:
        out = f"_{out}"
    return out


def identity(id_col: str, text_col: str) -> list[Column]:
    """Columns that name a document: its id (null included) and a hash of its text.

    Rows equal in both are copies of one row and share every decision.
    """
    return [F.col(f"`{id_col}`").cast("string").alias("_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("_text_hash")]


def without(docs: DataFrame, bad: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` whose identity is not in `bad` (_id, _text_hash), with their own columns."""
    key, text_hash = hidden(docs, "id"), hidden(docs, "text_hash")
    gone = shipped(stored(bad.select(F.col("_id").alias("bad_id"), F.col("_text_hash").alias("bad_hash")), "rejected"))
    left = docs.select("*", *(c.alias(n) for c, n in zip(identity(id_col, text_col), (key, text_hash))))
    same = left[key].eqNullSafe(gone["bad_id"]) & (left[text_hash] == gone["bad_hash"])
    return left.join(gone, same, "left_anti").drop(key, text_hash)
