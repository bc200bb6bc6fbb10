"""Exact inner-product search by a three-phase uniform threshold.

A score is the sum of partial scores over slices of the dimensions. Phase one gathers the best entries of
each slice's score list, scores them in full and so gets a cutoff: a query's k-th best full score so far, which
the true k-th best cannot be below. Phase two sends the cutoffs to the lists: an entry below cutoff / slices
in every slice is below the cutoff in total, so only the others are collected. Phase three scores these
in full and keeps the best. The query set meets all rows in blocks; a score list exists one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediawatch.llm.common import stored

K = 20
SCALE = 64.0
EVERY = 20
SLICES = 2
#: Vectors in a block of candidates and of queries.
BLOCK = 4096
QUERIES = 2048
#: Query blocks that a cell of the grid holds at once.
SHELF = 8
#: Scores that one step holds.
CELLS = 1 << 21
#: Partitions of the grid at most.
CELLS_AT_ONCE = 4096
#: Signed types of components, the narrowest first.
KINDS = (np.int8, np.int16, np.int32, np.int64)


def whole_numbers(vector: Column) -> Column:
    """floor(64 x) of every component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(SCALE)))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector of long): rows with an id and a vector of finite components, numbered by `_row`."""
    x = F.col(f"`{vector_col}`")
    finite = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf")))
    return df.filter(F.col(f"`{id_col}`").isNotNull() & x.isNotNull() & F.forall(x, finite)).select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), whole_numbers(x).alias("vector"),
        F.monotonically_increasing_id().alias("_row"),
    )


def blocks(vectors: DataFrame, width: int) -> DataFrame:
    """(block, dim, ids, rows, data): blocks of at most `width` vectors of one dimension, without a shuffle.

    `data` has the components row by row, in the narrowest of the signed types that holds all of the block.
    """

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}

        def block(dim: int, parts: list[tuple]) -> pa.RecordBatch:
            ids, rows, table = (np.concatenate(x) for x in zip(*parts))
            kind = next(t for t in KINDS if not table.size or np.iinfo(t).min <= table.min() and table.max() <= np.iinfo(t).max)
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[0]]), pa.array([dim], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([rows], pa.list_(pa.int64())), pa.array([table.astype(kind).tobytes()], pa.binary())],
                ["block", "dim", "ids", "rows", "data"],
            )

        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            vectors, sizes = batch.column(1), batch.column(1).value_lengths().to_numpy()
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                table = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                parts = waiting.setdefault(dim, [])
                have = sum(len(x[0]) for x in parts)
                first = 0
                while first < len(at):
                    last = min(first + width - have, len(at))
                    parts.append((ids[at[first:last]], rows[at[first:last]], table[first:last]))
                    have += last - first
                    first = last
                    if have == width:
                        yield block(dim, parts)
                        parts.clear()
                        have = 0
        for dim, parts in waiting.items():
            if parts:
                yield block(dim, parts)

    return vectors.select("id", "vector", "_row").mapInArrow(
        packed, "block long, dim int, ids array<long>, rows array<long>, data binary"
    )


def table_of(data: bytes, n: int, dim: int) -> np.ndarray:
    """The components of a block of n vectors."""
    return np.frombuffer(data, dtype=f"<i{len(data) // (n * dim) if n * dim else 8}").reshape(n, dim)


def partial_scores(q: np.ndarray, c: np.ndarray, slices: int) -> tuple[list[np.ndarray], bool]:
    """A table of partial scores per slice, and whether they are floating: only if all sums are exact in these."""
    dim = q.shape[1]
    top = max_size(q) * max_size(c) * dim
    kind = np.float32 if top < 2.0**24 else np.float64 if top < 2.0**53 else np.int64
    q, c = q.astype(kind), c.astype(kind)
    edges = [dim * i // slices for i in range(slices + 1)]
    return [q[:, a:b] @ c[:, a:b].T for a, b in zip(edges, edges[1:])], kind is not np.int64


def max_size(x: np.ndarray) -> float:
    return max(float(x.max(initial=0)), -float(x.min(initial=0)))


def best_of_lists(parts: list[np.ndarray], q_rows: np.ndarray, c_rows: np.ndarray, k: int) -> np.ndarray:
    """The full scores of the best entries of each slice's list, without the query itself; -inf where there are fewer."""
    width = parts[0].shape[1]
    n = min(k + 1, width)  # the query itself may be one of the best
    tops = np.concatenate([np.argpartition(p, width - n, axis=1)[:, width - n :] for p in parts], axis=1)
    tops.sort(axis=1)
    score = sum(np.take_along_axis(p, tops, axis=1) for p in parts).astype(np.float64)
    score[:, 1:][tops[:, 1:] == tops[:, :-1]] = -np.inf
    score[c_rows[tops] == q_rows[:, None]] = -np.inf
    return score


def k_best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k highest of each row, at least one of which has k."""
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k :]


def cells(met: DataFrame) -> DataFrame:
    """Rows of a cell of the grid together: query blocks (0), their cutoffs (1), candidate blocks (2)."""
    return met.sortWithinPartitions("shelf", "group", "dim", "kind", "slot").select(
        "shelf", "group", "dim", "kind", "slot", "ids", "rows", "data"
    )


def walked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(queries by slot, cutoffs by slot, candidate block or None at the end of a cell) from the rows of cells."""
    key, queries, cutoffs = None, {}, {}
    for batch in batches:
        for at in range(batch.num_rows):
            row = {n: batch.column(n)[at] for n in batch.schema.names}
            own = tuple(row[n].as_py() for n in ("shelf", "group", "dim"))
            if own != key:
                if key is not None:
                    yield queries, cutoffs, None
                key, queries, cutoffs = own, {}, {}
            data, slot = row["data"].as_py(), row["slot"].as_py()
            if row["kind"].as_py() == 1:
                cutoffs[slot] = np.frombuffer(data)
                continue
            ids, rows = (row[n].values.to_numpy() for n in ("ids", "rows"))
            block = (ids, rows, table_of(data, len(ids), own[2]))
            if row["kind"].as_py() == 0:
                queries[slot] = block
            else:
                yield queries, cutoffs, block
    if key is not None:
        yield queries, cutoffs, None


def bounded(met: DataFrame, k: int, slices: int) -> DataFrame:
    """(slot, data): for each query of a block its cutoff, the k-th best of the scores found in the lists of all cells."""

    def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for queries, _, block in walked(batches):
            if block is None:
                for slot, found in best.items():
                    yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([found.tobytes()])], ["slot", "data"])
                best = {}
                continue
            _, c_rows, c = block
            step = max(1, CELLS // len(c_rows))
            for slot, (_, q_rows, q) in queries.items():
                if slot not in best:
                    best[slot] = np.full((len(q_rows), k), -np.inf)
                for first in range(0, len(q_rows), step):
                    own = slice(first, first + step)
                    found = best_of_lists(partial_scores(q[own], c, slices)[0], q_rows[own], c_rows, k)
                    best[slot][own] = k_best(np.concatenate([best[slot][own], found], axis=1), k)

    def united(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, best = None, None

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([best.min(axis=1).tobytes()])], ["slot", "data"])

        for batch in batches:
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.frombuffer(data.as_py()).reshape(-1, k)
                if own != slot:
                    if slot is not None:
                        yield sent()
                    slot, best = own, found
                else:
                    best = k_best(np.concatenate([best, found], axis=1), k)
        if slot is not None:
            yield sent()

    return (
        cells(met).mapInArrow(gathered, "slot int, data binary")
        .repartition("slot").sortWithinPartitions("slot").mapInArrow(united, "slot int, data binary")
    )


def collected(met: DataFrame, k: int, slices: int) -> DataFrame:
    """(query_row, query_id, vec_id, vec_row, score): up to k entries per query and block, with them all that can reach the cutoff."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for queries, cutoffs, block in walked(batches):
            if block is None:
                continue
            c_ids, c_rows, c = block
            step = max(1, CELLS // len(c_ids))
            for slot, (q_ids, q_rows, q) in queries.items():
                for first in range(0, len(q_ids), step):
                    parts, exact = partial_scores(q[first : first + step], c, slices)
                    own = cutoffs[slot][first : first + step]
                    if exact:
                        share = (own / slices).astype(parts[0].dtype)[:, None]
                        share = np.nextafter(share, -np.inf, dtype=share.dtype)  # it may have been rounded up
                        reach = parts[0] >= share
                        for p in parts[1:]:
                            reach |= p >= share
                        who, what = np.nonzero(reach)
                    else:
                        who, what = np.divmod(np.arange(parts[0].size), parts[0].shape[1])
                    score = sum(p[who, what] for p in parts)
                    keep = c_rows[what] != q_rows[first + who]
                    if exact:
                        keep &= score >= own[who]
                    who, what, score = who[keep], what[keep], score[keep]
                    order = np.lexsort((c_rows[what], c_ids[what], -score, who))
                    who, what, score = who[order], what[order], score[order]
                    rank = np.arange(len(who)) - np.searchsorted(who, who)
                    top = rank < k
                    who, what, score = who[top] + first, what[top], score[top].astype(np.int64)
                    if len(who):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x) for x in (q_rows[who], q_ids[who], c_ids[what], c_rows[what], score)],
                            ["query_row", "query_id", "vec_id", "vec_row", "score"],
                        )

    return cells(met).mapInArrow(search, "query_row long, query_id long, vec_id long, vec_row long, score long")


def top_k(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY,
    slices: int = SLICES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of floor(64 x) for each query.

    Queries are the rows whose id is divisible by `every`, candidates all rows but the query's own. Rows with a
    null id or vector, or a null or non-finite component, take no part; ties go to the smaller id; vectors
    meet only vectors of their own dimension; a repeated row is another row and is found as one; with fewer
    candidates there are fewer ranks; an empty table gives no rows. Scores are exact in 64 bits.
    A cell of the grid holds a shelf of query blocks while its group of candidate blocks passes one by one; the blocks
    of a cell are dealt to one task and never joined, so no task, and never the driver, holds their pairs.
    """
    rows = stored(usable(vectors, id_col, vector_col), "vectors")
    candidates = stored(blocks(rows, BLOCK), "candidate-blocks")
    number = Window.orderBy("dim", "block")  # one row per block of queries
    asked = stored(blocks(rows.filter(F.pmod("id", F.lit(every)) == 0), QUERIES), "query-blocks")
    slots = asked.select("block", "dim").withColumn("slot", F.row_number().over(number) - 1)
    slots = stored(slots.withColumn("shelf", F.floor(F.col("slot") / SHELF).cast("int")), "query-slots")
    n_blocks, n_asked = candidates.count(), slots.count()
    groups = max(1, n_blocks // 4)
    n_cells = groups * max(1, -(-n_asked // SHELF))

    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    none = [F.lit(None).cast("array<long>").alias(n) for n in ("ids", "rows")]
    homes = F.broadcast(slots.groupBy("dim").agg(F.collect_set("shelf").alias("shelves")))
    numbered = asked.join(F.broadcast(slots), ["block", "dim"])
    queries = numbered.select("shelf", "dim", F.lit(0).alias("kind"), "slot", "ids", "rows", "data", each)
    passing = candidates.join(homes, "dim").select(
        F.explode("shelves").alias("shelf"), "dim", F.lit(2).alias("kind"), F.lit(-1).alias("slot"), "ids", "rows", "data",
        F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"),
    )
    grid = lambda rows: rows.repartition(min(n_cells, CELLS_AT_ONCE), "shelf", "group", "dim")

    cutoffs = stored(bounded(grid(queries.unionByName(passing)), k, slices), "query-cutoffs")
    bounds = cutoffs.join(F.broadcast(slots), "slot").select("shelf", "dim", F.lit(1).alias("kind"), "slot", *none, "data", each)
    found = collected(grid(queries.unionByName(bounds).unionByName(passing)), k, slices)
    final = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    return (
        found.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
