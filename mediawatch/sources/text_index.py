"""The stored text index: immutable segments, a dictionary of additive counts, removals and merges.

Tables under a path, each in folders by segment (`seg`), postings, dictionary and blocks also by first letter (`bucket`):
postings, documents, terms (documents per term and per leading part), totals, blocks (bounds of a run of document
ids), removed (document ids whose postings in earlier segments no longer count). An append or a removal writes one new
segment and publishes it; a removal's counts are negative, so sums over the segments are those of a rebuild. A merge
writes one segment without what was removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediawatch.operators.retrieval import BLOCK_IDS, PARTS, TextIndex, bucket_of, tables_of, term_places, tokenised
from mediawatch.scale import discard, pinned, shipped, stored, stored_bytes
from mediawatch.sources import manifest

TABLES = ["postings", "documents", "terms", "totals", "blocks", "removed"]
SCHEMAS = {
    "postings": "doc_id bigint, term string, doc_len int, tf bigint, places array<int>, block bigint, seg int, bucket int",
    "documents": "doc_id bigint, channel_name string, ts timestamp_ntz, doc_len int, seg int",
    "terms": "term string, prefix boolean, df bigint, seg int, bucket int",
    "totals": "n bigint, len_sum bigint, seg int",
    "blocks": "block bigint, term string, max_tf bigint, min_len int, n bigint, first_ts timestamp_ntz, last_ts timestamp_ntz, seg int, bucket int",
    "removed": "doc_id bigint, seg int",
}

#: Most bytes of stored terms whose postings one task sorts, in memory; and least, as a task writes a file a bucket.
PART_BYTES, LEAST_BYTES = 32 << 20, 1 << 20


def segments(spark: SparkSession, path: str) -> list[int]:
    return [int(n.split("=")[1]) for n in manifest.folders(spark, path)]


def _table(spark: SparkSession, path: str, name: str, live: list[int]) -> DataFrame:
    """The rows of the live segments; a table no segment has written is empty."""
    if not manifest.exists(spark, f"{path}/{name}"):
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}").filter(F.col("seg").isin(live))


def _write(rows: DataFrame, path: str, name: str, seg: int) -> None:
    """One segment of one table; a hot term's rows are dealt over tasks by the block they lie in."""
    folder = f"{path}/{name}/seg={seg}"
    order = [c for c in ("bucket", "term", "block") if c in rows.columns]
    if "bucket" in rows.columns:
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(folder)
    else:
        rows.write.mode("overwrite").parquet(folder)


def dictionary(sets: DataFrame) -> DataFrame:
    """(term, prefix, bucket, df) of documents' distinct terms (column terms): the documents that hold each term, and
    each leading part of a kept length. Parts are made inside the row, so counts alone are exchanged."""
    lengths = F.array(*[F.lit(n) for n in range(PARTS[0], PARTS[1] + 1)])
    leads = F.transform("terms", lambda w: F.transform(F.filter(lengths, lambda n: n <= F.length(w)), lambda n: F.substring(w, F.lit(1), n)))

    def entries(terms, prefix: bool):
        return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(prefix).alias("prefix")))

    both = F.concat(entries(F.col("terms"), False), entries(F.array_distinct(F.flatten(leads)), True))
    counts = sets.select(F.explode(both).alias("_e")).groupBy("_e.term", "_e.prefix").agg(F.count(F.lit(1)).alias("df"))
    return counts.withColumn("bucket", bucket_of(F.col("term")))


def block_rows(postings: DataFrame, documents: DataFrame) -> DataFrame:
    """What bounds the scores, and the time, of a term's postings in a block of document ids."""
    spans = documents.groupBy(block_of(F.col("doc_id")).alias("block")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    per = postings.groupBy("bucket", "term", "block").agg(
        F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len"), F.count(F.lit(1)).alias("n")
    )
    return per.join(spans, "block")


def block_of(doc_id):
    return F.floor(doc_id / BLOCK_IDS).cast("bigint")


def _segment(spark: SparkSession, path: str, postings: DataFrame, documents: DataFrame, seg: int) -> None:
    _write(postings, path, "postings", seg)
    _write(documents, path, "documents", seg)
    written = {n: spark.read.schema(SCHEMAS[n]).parquet(f"{path}/{n}").filter(F.col("seg") == seg) for n in ("postings", "documents")}
    _write(block_rows(written["postings"], written["documents"]), path, "blocks", seg)


def _new_segment(tokens: DataFrame, path: str, seg: int) -> None:
    """A segment of `tokenised` chunks. The texts' terms are dealt out by block, as one string a chunk, which is several
    times less than their postings; a part's postings are then sorted where they are, without another exchange."""
    spark = tokens.sparkSession
    size = stored_bytes(tokens)
    parts = max(min(spark.sparkContext.defaultParallelism, 1 + size // LEAST_BYTES), -(-size // PART_BYTES))
    said = tokens.select("doc_id", block_of(F.col("doc_id")).alias("block"), F.array_join("_t", " ").alias("_s"))
    dealt = pinned(said.filter("_s <> ''").repartition(parts, "block"), "_t", F.split("_s", " "))  # terms have no spaces
    postings = dealt.select("doc_id", F.size("_t").alias("doc_len"), "block", F.inline(term_places(F.col("_t")))).select(
        "doc_id", "term", "doc_len", F.size("places").cast("bigint").alias("tf"), "places", "block", bucket_of(F.col("term")).alias("bucket")
    )
    _write_sorted(postings, path, "postings", seg)
    _write(tables_of(tokens).documents, path, "documents", seg)
    written = {n: spark.read.schema(SCHEMAS[n]).parquet(f"{path}/{n}").filter(F.col("seg") == seg) for n in ("postings", "documents")}
    _write_sorted(block_rows(written["postings"], written["documents"]), path, "blocks", seg)


def _write_sorted(rows: DataFrame, path: str, name: str, seg: int) -> None:
    """One segment of one table, each task's rows in order; a hot term's rows lie in the files of many tasks."""
    rows.sortWithinPartitions(*[c for c in ("bucket", "term", "block") if c in rows.columns]).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}/seg={seg}")


def append_index(chunks: DataFrame, path: str) -> int:
    """Add new chunks as a segment: only their own postings, counts and bounds are written. The segment's number."""
    spark = chunks.sparkSession
    seg = _next(spark, path)
    tokens = stored(tokenised(chunks), "tokenised-chunks")
    _new_segment(tokens, path, seg)
    _write_sorted(dictionary(tokens.select(F.array_distinct("_t").alias("terms"))), path, "terms", seg)
    _write(_totals(tables_of(tokens).documents), path, "totals", seg)
    discard(tokens)
    manifest.publish(spark, path, [*manifest.folders(spark, path), f"seg={seg}"])
    return seg


def _totals(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).cast("bigint").alias("len_sum"))


def _next(spark: SparkSession, path: str) -> int:
    return max([int(n.split("=")[1]) for n in manifest.all_folders(spark, path)], default=0) + 1


def remove_chunks(gone: DataFrame, path: str) -> int:
    """Take chunks (column doc_id) out of the index; ids it does not hold are ignored. The number of the new segment.

    Their postings stay until a merge, hidden by the removed ids; their counts are written once more, negative. A chunk
    appended again later counts again.
    """
    spark = gone.sparkSession
    live = segments(spark, path)
    seg = _next(spark, path)
    index = read_index(spark, path)
    ids = stored(index.documents.join(gone.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "doc_len"), "removed-ids")
    if live and not ids.isEmpty():
        held = index.postings.join(shipped(ids.select("doc_id")), "doc_id", "left_semi")
        sets = held.groupBy("doc_id").agg(F.collect_set("term").alias("terms"))
        _write(dictionary(sets).withColumn("df", -F.col("df")), path, "terms", seg)
        totals = _totals(ids)
        _write(totals.select((-F.col("n")).alias("n"), (-F.col("len_sum")).alias("len_sum")), path, "totals", seg)
        _write(ids.select("doc_id"), path, "removed", seg)
        manifest.publish(spark, path, [*manifest.folders(spark, path), f"seg={seg}"])
    return seg


def merge_index(spark: SparkSession, path: str) -> int:
    """Write all live segments as one, without what was removed; counts are summed, not taken anew. Its number.

    Readers of the segments before it go on reading them until `manifest.vacuum(spark, path, TABLES)`.
    """
    live = segments(spark, path)
    seg = _next(spark, path)
    index = read_index(spark, path)
    _segment(spark, path, index.postings, index.documents.select("doc_id", "channel_name", "ts", "doc_len"), seg)
    terms = _table(spark, path, "terms", live).groupBy("term", "prefix", "bucket").agg(F.sum("df").alias("df"))
    _write(terms.filter(F.col("df") != 0), path, "terms", seg)
    totals = _table(spark, path, "totals", live).agg(F.sum("n").alias("n"), F.sum("len_sum").alias("len_sum"))
    _write(totals, path, "totals", seg)
    manifest.publish(spark, path, [f"seg={seg}"])
    return seg


def read_index(spark: SparkSession, path: str) -> TextIndex:
    """The index as of the current version; later versions do not change what this one reads."""
    live = segments(spark, path)
    tables = {n: _table(spark, path, n, live) for n in TABLES}
    gone = tables["removed"].select(F.col("doc_id").alias("_gone"), F.col("seg").alias("_at"))
    if not gone.isEmpty():
        hidden = shipped(stored(gone.groupBy("_gone").agg(F.max("_at").alias("_at")), "removed-from-index"))
        for n in ("postings", "documents"):
            rows = tables[n]
            tables[n] = rows.join(hidden, (F.col("doc_id") == F.col("_gone")) & (F.col("seg") < F.col("_at")), "left_anti")
    return TextIndex(
        tables["postings"].drop("seg"), tables["documents"].drop("seg"), tables["terms"], tables["totals"], tables["blocks"],
    )

