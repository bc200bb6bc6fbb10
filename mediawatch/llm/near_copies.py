"""Near copies by the Jaccard similarity of their five-word shingles: MinHash bands find, exact sets decide.

At a similarity of 0.8 SimHash fingerprints of 64 bits differ in 10 bits on average and often in more than 15, so
covering masks (2^(r + 1) - 1 of them) cannot reach these pairs. A band is four MinHash values; a pair of similarity
s shares one of 24 bands with probability 1 - (1 - s^4)^24, which is 0.999997 at 0.8. Whatever shares a band
is then decided by the sets of shingle hashes (64 bits) themselves. SimHash links (`simhash.near_links`) can be
asked for as well; groups are then what links of either kind connect.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediawatch.llm import simhash
from mediawatch.llm.common import hidden, shipped, stored
from mediawatch.operators.graph import connected_components

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 4
SEED = 42
#: Sets compared with one another in one step; a fuller band is compared in tiles of this many.
TILE = 1024
#: Parts that the documents of one set are looked up in.
SALTS = 8

#: Texts whose shingles a task holds at once.
SLICE = 256
_DRAW = np.random.default_rng(SEED)
_TIMES = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; fewer words than `words` are one shingle."""
    parts = (text or "").encode().lower().split()  # both take ASCII alone
    if not parts:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]).tolist()
    begins = [0, *ends[: max(len(parts) - words, 0)]]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a : b - 1], SEED) for a, b in zip(begins, ends[min(words, len(parts)) - 1 :])], dtype="<u8"))


def bands(found: np.ndarray) -> np.ndarray:
    """One key per band; sets without shingles have none."""
    if not len(found):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for first in range(0, len(found), 4096):
        mixed = found[first : first + 4096, None] * _TIMES + _PLUS
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        least = np.minimum(least, mixed.min(axis=0))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), SEED) for b in least.reshape(BANDS, ROWS)], dtype=np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= least * (len(a) + len(b) - shared) - 1e-9


def links_within(names: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """(a, b): links that connect what similar pairs connect, fewer than there are members."""
    left, out = list(range(len(sets))), []
    while left:
        root = left.pop(0)
        edge = [root]
        while edge and left:
            own = sets[edge.pop()]
            near = [i for i in left if similar(own, sets[i], least)]
            if near:
                out.extend((int(names[i]), int(names[root])) for i in near)
                edge.extend(near)
                gone = set(near)
                left = [i for i in left if i not in gone]
    return out


def row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, fingerprints: bool = False) -> DataFrame:
    """(_id, _row, _set, _bands, _fp): per row its id, a hash of all its columns, its set's hash and band keys, and its
    SimHash fingerprint if `fingerprints` are wanted (else null)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            found = [shingle_set(t.as_py(), words) for t in batch.column(2)]
            names = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found], dtype=np.uint64).view(np.int64)
            keys = pa.array([bands(s) for s in found], pa.list_(pa.int64()))
            own = [simhash.simhash(t.as_py()) for t in batch.column(2)] if fingerprints else []
            fps = pa.array(np.array(own, dtype=np.uint64).view(np.int64)) if fingerprints else pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names), keys, fps], ["_id", "_row", "_set", "_bands", "_fp"]
            )

    return docs.select(F.col(f"`{id_col}`").alias("_id"), row_hash(docs).alias("_row"), F.col(f"`{text_col}`").cast("string")).mapInArrow(
        sketched, f"_id {id_type}, _row long, _set long, _bands array<long>, _fp long"
    )


def fingerprint_links(marked: DataFrame, radius: int) -> DataFrame:
    """(a, b) links between distinct sets (of `sketches`) that connect all rows whose fingerprints are within `radius` bits.

    The lowest set of a fingerprint stands for it; the covering search links the fingerprints.
    """
    owned = stored(marked.select("_fp", "_set").distinct(), "fingerprint-sets")
    heads = stored(owned.groupBy("_fp").agg(F.min("_set").alias("_head"), F.count("*").alias("_n")), "fingerprint-heads")
    near = simhash.near_links(heads.select(F.col("_fp").alias("fp")), radius)
    a, b = (heads.select(F.col("_fp").alias(c), F.col("_head").alias(f"_{c}")) for c in ("a", "b"))
    between = near.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    within = owned.join(heads.filter("_n > 1"), "_fp").select(F.col("_set").alias("a"), F.col("_head").alias("b"))
    return between.unionByName(within).filter("a <> b")


def links(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str, words: int, least: float, tile: int) -> DataFrame:
    """(a, b) links between distinct sets that connect all pairs that are similar and share a band."""
    keyed = distinct.select("_set", F.posexplode("_bands").alias("t", "k"))
    shared = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    members = keyed.join(shared, ["t", "k"]).select("_set", "t", "k", tiles.alias("tiles")).withColumn(
        "own", F.pmod(F.xxhash64("_set"), F.col("tiles")).cast("int")
    )
    # With one or two tiles, one step; else own with every other (a single tile is inside each of these).
    partner = F.explode(F.when(F.col("tiles") <= 2, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1)))
    steps = stored(
        members.withColumn("other", partner)
        .filter((F.col("tiles") <= 2) | (F.col("own") != F.col("other")))
        .select(
            "t", "k", "_set",
            F.when(F.col("tiles") <= 2, 0).otherwise(F.least("own", "other")).alias("i"),
            F.when(F.col("tiles") <= 2, 0).otherwise(F.greatest("own", "other")).alias("j"),
        ),
        "band-members",
    )
    wanted = shipped(stored(
        distinct.join(steps.select("_set").distinct(), "_set", "left_semi").select("_set", "_first._row", "_first._id"), "band-sets"
    ))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shingle_set(t.as_py(), words).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["_set", "_shingles"])

    texts = docs.select(row_hash(docs).alias("_own"), F.col(f"`{id_col}`").alias("_own_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    sets = (
        texts.join(wanted, (F.col("_own") == F.col("_row")) & F.col("_own_id").eqNullSafe(F.col("_id"))).select("_set", "_text")
        .mapInArrow(read, "_set long, _shingles binary").groupBy("_set").agg(F.min("_shingles").alias("_shingles"))
    )

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by step; a step's rows are gathered until the next begins."""

        def linked() -> pa.RecordBatch:
            a, b = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        step, names, found, out = None, [], [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(4))))
            for key, name, shingles in zip(keys, batch.column(4).to_pylist(), batch.column(5)):
                if key != step:
                    out += links_within(np.array(names), found, least)
                    step, names, found = key, [], []
                names.append(name)
                found.append(np.frombuffer(shingles.as_py(), dtype="<u8"))
            yield linked()
            out = []
        out += links_within(np.array(names), found, least)
        yield linked()

    return (
        steps.join(sets, "_set").repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
        .select("t", "k", "i", "j", "_set", "_shingles").mapInArrow(link, "a long, b long").distinct()
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = SIMILAR, tile: int = TILE,
    radius: int | None = None,
) -> DataFrame:
    """One row of every group of near copies, all columns kept: that with the lowest id.

    Groups are what pairs of Jaccard similarity `least` or more connect, and with a `radius` also pairs whose SimHash
    fingerprints differ in so many bits at most. Texts without words are copies of one another. A row without id stays only if no row of its group has one; of rows with the lowest id, and of repeated
    rows, one stays. An empty table gives no rows.
    """
    marked = stored(sketches(docs, id_col, text_col, words, radius is not None), "shingle-sketches")
    place = F.struct(F.col("_id").isNull().alias("_none"), F.col("_id"), F.col("_row"))
    distinct = stored(
        marked.groupBy("_set").agg(F.min(place).alias("_first"), F.count("*").alias("_n"), F.min("_bands").alias("_bands")), "distinct-sets"
    )
    linked = links(docs, distinct, id_col, text_col, words, least, tile)
    if radius is not None:
        linked = linked.unionByName(fingerprint_links(marked, radius)).distinct()
    groups = connected_components(linked)
    owned = distinct.drop("_bands").join(groups.withColumnRenamed("id", "_set"), "_set", "left").withColumn(
        "component", F.coalesce("component", "_set")
    )
    named = owned.groupBy("component").agg(F.min("_first").alias("_keeper"), F.sum("_n").alias("_n")).filter("_n > 1")
    lookup = stored(
        owned.select("_set", "component").join(named, "component")
        .select("_set", "_keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")), "copied-sets",
    )
    own_id, own_row = hidden(docs, "copy_id"), hidden(docs, "copy_row")
    copies = stored(
        marked.drop("_bands", "_fp").withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
        .join(shipped(lookup), ["_set", "_salt"])
        .groupBy(F.col("_id").alias(own_id), F.col("_row").alias(own_row))
        .agg(F.count("*").alias("_n"), F.first(place == F.col("_keeper")).alias("_stays")),
        "near-copies",
    )
    keyed = docs.withColumn(hidden(docs, "row"), row_hash(docs))

    def listed(rows: DataFrame, how: str) -> DataFrame:
        rows = shipped(rows.select(own_id, own_row))
        same = keyed[f"`{id_col}`"].eqNullSafe(rows[own_id]) & (keyed[hidden(docs, "row")] == rows[own_row])
        return keyed.join(rows, same, how).select(*[keyed[f"`{c}`"] for c in docs.columns])

    whole = listed(copies.filter("not _stays or _n > 1"), "left_anti")
    repeated = copies.filter("_stays and _n > 1")
    return whole.unionByName(listed(repeated, "left_semi").dropDuplicates()) if repeated.limit(1).count() else whole
