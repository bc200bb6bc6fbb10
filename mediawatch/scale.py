"""Helpers that keep plans safe when the data grows: stored stages and checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoint into the shared folder the session names; a scratch one only on a local master."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if shared:
        if current is None or shared.rstrip("/") not in current:
            context.setCheckpointDir(shared)
    elif current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="mediawatch-ckpt-"))


_PATHS: WeakKeyDictionary = WeakKeyDictionary()
_WRITTEN: dict[str, SparkSession] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as a named Parquet stage into the folder all executors share, and read them back.

    The lineage ends there: a lost executor costs tasks of one stage, and a second reader computes nothing
    again. Stages are removed by `discard`, at the latest when the program ends.
    """
    spark = df.sparkSession
    path = own_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def own_folder(spark: SparkSession, name: str) -> str:
    """A new name in the folder all executors share; what is written there is removed when the program ends."""
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def discard(df: DataFrame) -> None:
    """Remove the files of a stored table that nothing reads any more."""
    path = _PATHS.pop(df, None)
    if path is not None:
        remove(path, _WRITTEN.pop(path))


def place_of(path: str, spark: SparkSession) -> tuple:
    """(file system, path) of a folder of the table store, wherever that is."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def remove(path: str, spark: SparkSession) -> None:
    """Delete a folder of the table store."""
    system, place = place_of(path, spark)
    system.delete(place, True)


def make_folder(spark: SparkSession, path: str) -> None:
    system, place = place_of(path, spark)
    system.mkdirs(place)


def whole_folder(spark: SparkSession, path: str) -> bool:
    """A write into the folder has ended well."""
    system, place = place_of(f"{path}/_SUCCESS", spark)
    return system.exists(place)


@atexit.register
def _remove_stages() -> None:
    for path, spark in _WRITTEN.items():
        if spark.sparkContext._jsc is not None:
            remove(path, spark)


#: Rows, and bytes of a stored table's files, that may be shipped to every executor.
SHIPPED_ROWS = 500_000
SHIPPED_BYTES = 64 << 20


def stored_bytes(df: DataFrame) -> int | None:
    """Size of a stored table's files, None for any other table."""
    path = _PATHS.get(df)
    if path is None:
        return None
    system, place = place_of(path, df.sparkSession)
    return system.getContentSummary(place).getLength()


def shipped(df: DataFrame, rows: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """Mark a stored table for a broadcast join if its rows and its files are within the bounds; else leave it to a shuffle."""
    rows = SHIPPED_ROWS if rows is None else rows
    if (stored_bytes(df) or 0) > (SHIPPED_BYTES if most_bytes is None else most_bytes):
        return df
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def pinned(df: DataFrame, name: str, value) -> DataFrame:
    """Add a costly column that later filters and projections read instead of computing it again.

    A one-element explode stops the optimizer from copying the expression into every use.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
