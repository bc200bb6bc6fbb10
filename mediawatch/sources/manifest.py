"""Which folders make up a table: an atomic pointer over immutable folders.

A table's folders are written once and never changed. A write publishes a new list of folders as the next version; it
counts from the moment its write has ended. A reader keeps the folders of the version it began with: they stay until
`vacuum`. One writer per table at a time.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from mediawatch.scale import place_of, remove


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, in order."""
    system, place = place_of(f"{path}/manifest/v*/_SUCCESS", spark)
    return sorted(int(f.getPath().getParent().getName()[1:]) for f in system.globStatus(place) or [])


def exists(spark: SparkSession, path: str) -> bool:
    system, place = place_of(path, spark)
    return system.exists(place)


def folders(spark: SparkSession, path: str, version: int | None = None) -> list[str]:
    """Names of the current (or another) version's folders; none before the first."""
    known = versions(spark, path)
    if not known:
        return []
    at = known[-1] if version is None else version
    return sorted(r["folder"] for r in spark.read.schema("folder string").parquet(f"{path}/manifest/v{at}").collect())


def all_folders(spark: SparkSession, path: str) -> set[str]:
    """Names that any version kept names."""
    return {n for v in versions(spark, path) for n in folders(spark, path, v)}


def publish(spark: SparkSession, path: str, names: list[str]) -> int:
    """Make these folders the table; the number of the new version. An interrupted publication is written over."""
    version = (versions(spark, path) or [0])[-1] + 1
    rows = spark.createDataFrame([(n,) for n in sorted(names)], "folder string")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v{version}")
    return version


def vacuum(spark: SparkSession, path: str, tables: list[str], keep: int = 1) -> list[str]:
    """Remove the folders of the tables under `path` that none of the last `keep` versions names; what was removed.

    For when no reader of an older version is left.
    """
    known = versions(spark, path)
    live = {n.split("/")[0] for v in known[-keep:] for n in folders(spark, path, v)}
    gone = []
    for table in tables:
        system, place = place_of(f"{path}/{table}/*=*", spark)
        own = sorted(f.getPath().getName() for f in system.globStatus(place) or [])
        gone += [f"{table}/{n}" for n in own if n not in live]
    for name in gone:
        remove(f"{path}/{name}", spark)
    for v in known[:-keep]:
        remove(f"{path}/manifest/v{v}", spark)
    return gone
