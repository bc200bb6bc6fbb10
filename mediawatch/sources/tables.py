"""Keyed sinks over Parquet tables: insert-or-ignore, latest-wins and report exports.

One writer per table at a time; a crashed write leaves no partial files and is simply run again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediawatch.operators import guide, matching
from mediawatch.operators.health import latest_status
from mediawatch.operators.similarity import match_marks, staleness
from mediawatch.scale import remove, stored
from mediawatch.sources import manifest

#: Buckets of a keyed table; the same for all of its writes.
KEY_BUCKETS = 32


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at `path`, or an empty one shaped like the given rows before the first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return like.limit(0)


def same_days(table: DataFrame, rows: DataFrame, ts: str = "ts") -> DataFrame:
    """The part of a table written by `date` that can hold the rows' days."""
    span = rows.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
    if "date" not in table.columns or span["lo"] is None:
        return table
    return table.filter(F.col("date").between(F.lit(span["lo"].date()), F.lit(span["hi"].date())))


def insert_matches(new: DataFrame, path: str) -> DataFrame:
    """Append the rows whose key is not stored yet and return them. Only the rows' days are compared."""
    spark = new.sparkSession
    dated = new.withColumn("date", F.to_date("ts"))
    known = same_days(read_or_empty(spark, path, dated), dated)
    fresh = stored(matching.drop_known(dated, known), "fresh-matches")
    fresh.write.mode("append").partitionBy("date").parquet(path)
    return fresh.drop("date")


def replace_days(rows: DataFrame, touched: DataFrame, path: str) -> None:
    """Write the stored rows over their days' folders; a touched day (column date) without rows is removed."""
    replace_parts(rows, touched, path, "date")


def replace_parts(rows: DataFrame, touched: DataFrame, path: str, by: str) -> None:
    """Write the stored rows over their folders by the column `by`; a touched folder without rows is removed."""
    gone = touched.select(by).distinct().join(rows.select(by).distinct(), by, "left_anti").collect()  # folders, not rows
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    for r in gone:
        remove(f"{path}/{by}={r[by]}", rows.sparkSession)


def replace_searches_matches(rebuilt: DataFrame, stale_ids: DataFrame, path: str) -> None:
    """Rescan of edited searches: their stored matches give way to the rebuilt ones. Only the days that
    hold either are read and written."""
    spark = rebuilt.sparkSession
    dated = stored(rebuilt.withColumn("date", F.to_date("ts")), "rebuilt-matches")
    known = read_or_empty(spark, path, dated)
    stale = known.join(stale_ids, "search_id", "left_semi").select("date")
    touched = stored(stale.unionByName(dated.select("date")).distinct(), "touched-days")
    days = [r["date"] for r in touched.collect()]
    left = known.filter(F.col("date").isin(days)).join(stale_ids, "search_id", "left_anti")
    replace_days(stored(left.select(*dated.columns).unionByName(dated), "day-matches"), touched, path)


def insert_programmes(new: DataFrame, path: str) -> None:
    """Append programmes whose (channel, start) is not stored yet; the first source wins. The guide is
    kept by day of start, and only the new programmes' days are compared."""
    spark = new.sparkSession
    first = guide.first_source_wins(new).withColumn("date", F.to_date("start_ts"))
    known = same_days(read_or_empty(spark, path, first), first, "start_ts").select("channel_name", "start_ts")
    fresh = stored(first.join(known, ["channel_name", "start_ts"], "left_anti"), "fresh-programmes")
    fresh.write.mode("append").partitionBy("date").parquet(path)


def upsert_latest(new: DataFrame, path: str, key: str, at: str) -> None:
    """Keep the latest row of each key over the stored and the new ones.

    Keys lie in `KEY_BUCKETS` buckets by their hash. Only the buckets that the new rows touch are read and written anew,
    beside the old ones; the list of current folders is then published at once. Readers of the list before keep
    their files until `manifest.vacuum(spark, path, ["data"])`.
    """
    spark = new.sparkSession
    placed = stored(new.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")), "new-rows")
    touched = {f"bucket={r[0]}" for r in placed.select("bucket").distinct().collect()}
    now = manifest.folders(spark, path)
    old = [n for n in now if n.split("/")[1] in touched]
    both = placed if not old else _folders_of(spark, path, old).unionByName(placed, allowMissingColumns=True)
    write = max([int(n.split("/")[0].split("=")[1]) for n in manifest.all_folders(spark, path)], default=0) + 1
    latest_status(both, key, at).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/write={write}")
    manifest.publish(spark, path, [n for n in now if n not in old] + [f"write={write}/{t}" for t in touched])


def _folders_of(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    data = f"{path}/data"
    return spark.read.option("basePath", data).parquet(*[f"{data}/{n}" for n in names]).drop("write")


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """The table that `upsert_latest` keeps, as of its current version."""
    return _folders_of(spark, path, manifest.folders(spark, path)).drop("bucket")


def write_report(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """Export rows, one folder per search and sheet, in time order inside each.

    Sheet names are cut to 31 characters, so two searches may share one; their folders differ by search.
    """
    writer = (
        rows.withColumn("search", F.col("search_id"))
        .repartitionByRange("search", "signal_time")
        .sortWithinPartitions("search", "signal_time", "match_id")
        .write.mode("overwrite")
        .partitionBy("search", "sheet")
    )
    if fmt == "csv":
        writer.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def write_similarity_report(
    report: dict[str, DataFrame], matches: DataFrame, generated_at, path: str, searches: DataFrame | None = None
) -> None:
    """Store the spots of searches: clusters, members and unique matches by search, and what they were made from.

    All that was stored of the reported searches (column search_id of `searches`, or else those of the matches) gives way:
    a search that has lost its last spot, member or match has none afterwards.
    """
    touched = stored((matches if searches is None else searches).select("search_id").distinct(), "reported-searches")
    counts = matches.groupBy("search_id").agg(*match_marks())
    counts = touched.join(counts, "search_id", "left").na.fill(0, ["match_count"])
    parts = {**report, "reports": counts.withColumn("generated_at", generated_at)}
    for name, rows in parts.items():
        replace_parts(stored(rows, name), touched, f"{path}/{name}", "search_id")


def read_similarity_reports(spark: SparkSession, matches: DataFrame, path: str) -> DataFrame:
    """Stored reports with their stale flag: the searches' matches have changed in number since."""
    return staleness(spark.read.parquet(f"{path}/reports"), matches)
