"""SimHash near-duplicates found by covering locality-sensitive hashing.

Each of the 64 bits gets a vector of r + 1 random bits; each of the 2^(r+1) - 1 other nonzero vectors v
is a table whose mask keeps the bits with an odd product with v. Up to r differing bits have at most r
vectors, and some v is orthogonal to all of them: its mask keeps none of the differing bits, so the two
fingerprints share that table's key. No pair within r bits is missed.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediawatch.llm.common import hidden, shipped, stored
from mediawatch.operators.graph import connected_components

WORDS = 3
RADIUS = 3
SEED = 42
#: Fingerprints compared with one another in one step; a fuller bucket is compared in tiles of this many.
TILE = 1024
#: Parts that the documents of one fingerprint are looked up in.
SALTS = 8


def covering_masks(radius: int = RADIUS, seed: int = SEED) -> list[int]:
    """The 2^(radius+1) - 1 masks; fixed by the seed."""
    draw = random.Random(seed)
    vectors = [draw.randrange(2 ** (radius + 1)) for _ in range(64)]
    return [
        sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))
    ]


def simhash(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Fingerprint of a text's word shingles, repeats included; 0 without words."""
    parts = (text or "").encode().lower().split()  # both take ASCII alone
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]).tolist()
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = [digest(joined, seed)]
    else:
        begins = [0, *ends[: len(parts) - words]]
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip(begins, ends[words - 1 :])]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp): one row per document; fp holds the 64 bits as a signed long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(t.as_py(), words) for t in batch.column(1)]
            fp = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        scored, f"doc_id {id_type}, fp long"
    )


def bucket_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(a, b), b < a: links that connect what pairs within the radius connect, fewer than there are members."""
    fps = np.unique(fps)
    seen = np.zeros(len(fps), dtype=bool)
    bits = fps.view(np.uint64)
    out = []
    for root in range(len(fps)):
        if seen[root]:
            continue
        seen[root] = True
        edge = [root]
        while edge:
            near = np.flatnonzero(~seen & (np.bitwise_count(bits ^ bits[edge.pop()]) <= radius))
            seen[near] = True
            edge.extend(near.tolist())
            out.extend((int(fps[i]), int(fps[root])) for i in near)
    return out


def near_links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp) that connect all pairs within the radius.

    A bucket is compared in one step if it has at most `tile` members; a fuller one is cut into tiles by hash and
    every two tiles are compared in a step of their own, so no step holds more than twice that.
    """
    masks = covering_masks(radius)
    signed = np.array(masks, dtype=np.uint64).view(np.int64).tolist()
    keys = F.array(
        *[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)]
    )
    keyed = distinct.select("fp", F.explode(keys).alias("_key")).select("fp", "_key.t", "_key.k")
    shared = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    members = keyed.join(shared, ["t", "k"]).select("fp", "t", "k", tiles.alias("tiles")).withColumn(
        "own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    )
    # With one tile, one step; else own with every other (a single tile is inside each of these).
    partner = F.explode(
        F.when(F.col("tiles") <= 2, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))
    )
    steps = (
        members.withColumn("other", partner)
        .filter((F.col("tiles") <= 2) | (F.col("own") != F.col("other")))
        .select(
            "t", "k", "fp",
            F.when(F.col("tiles") <= 2, 0).otherwise(F.least("own", "other")).alias("i"),
            F.when(F.col("tiles") <= 2, 0).otherwise(F.greatest("own", "other")).alias("j"),
        )
    )

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by step; the step that a batch ends in waits for the next batch."""

        def linked(table: pa.Table, rows: int) -> pa.RecordBatch:
            columns = [table.column(c).to_numpy() for c in ("t", "k", "i", "j")]
            fp = table.column("fp").to_numpy()
            new = np.zeros(len(fp), dtype=bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            edges = [0, *np.flatnonzero(new).tolist(), len(fp)]
            out = []
            for a, b in zip(edges, edges[1:]):
                if a < rows and b - a > 1:
                    out += bucket_links(fp[a:b], radius)
            a, b = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            last = [held.column(c)[held.num_rows - 1] for c in ("t", "k", "i", "j")]
            same = np.ones(held.num_rows, dtype=bool)
            for c, x in zip(("t", "k", "i", "j"), last):
                same &= held.column(c).to_numpy() == x.as_py()
            done = int(np.argmax(same))
            if done:
                yield linked(held.slice(0, done), done)
                held = held.slice(done)
        if held is not None:
            yield linked(held, held.num_rows)

    return (
        steps.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
        .select("t", "k", "i", "j", "fp").mapInArrow(link, "a long, b long").distinct()
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS,
) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of `docs`.

    component_id is the lowest id reachable over fingerprints at most `radius` bits apart, itself
    included; null ids take part and are named by the lowest other id, or null. Null, empty and blank
    texts have fingerprint 0, which links like any other. Copies share a fingerprint and are one member
    of the search, however many there are; an empty table gives no rows.
    """
    marked = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    groups = connected_components(near_links(distinct, radius))
    owned = distinct.join(groups.withColumnRenamed("id", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    named = owned.groupBy("component").agg(F.min("least").alias("component_id"))
    lookup = owned.select("fp", "component").join(named, "component").select(
        "fp", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    )
    return (
        marked.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        .join(lookup, ["fp", "_salt"]).select("doc_id", "fp", "component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs` with the lowest id of their group, all columns kept; repeated rows and rows without id stay."""
    found = near_duplicates(docs, id_col, text_col, **how)
    name = hidden(docs, "extra")
    extra = shipped(stored(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "near-copies"))
    return docs.join(extra, docs[f"`{id_col}`"] == extra[name], "left_anti")
