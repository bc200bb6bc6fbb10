"""Hard negatives by a vertical scan with branch and bound on decomposed vectors.

Vectors lie in blocks of columns, one per dimension, with each dimension's least and greatest value. An anchor reads a
block's columns in the order of its own components' descending magnitude. After every few columns the rest of
a score is bounded by what the unread dimensions can add at least and at most, and the bitmap of candidates
shrinks to those that can still be among the first of some window of scores; the others' columns are not read
further. What is left after the last column has exact scores. Positives are the first of one window without
ends among the rows of the anchor's label; negatives those of the windows that the positives' scores open, among the
rows of other labels.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediawatch.llm.common import stored

SCALE = 256.0
EVERY = 50
POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these hundredths of the positive's.
LEAST, MOST = 50, 95
#: Vectors in a block of candidates and of anchors, and candidate blocks that meet an anchor block in one cell.
BLOCK = 4096
ANCHORS = 512
CELL = 4
#: Columns read between two looks at the bounds.
STEP = 8


def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector of long, _row): rows with an id, a label and a vector of finite components."""
    x, i = F.col(f"`{vector_col}`"), F.col(f"`{id_col}`").cast("bigint")
    label = F.col(f"`{label_col}`").cast("bigint")
    finite = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf")))
    return df.filter(i.isNotNull() & label.isNotNull() & x.isNotNull() & F.forall(x, finite)).select(
        i.alias("id"), F.when(i % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(SCALE))).alias("vector"),
        F.monotonically_increasing_id().alias("_row"),
    )


def column_blocks(vectors: DataFrame, width: int) -> DataFrame:
    """(block, dim, ids, labels, rows, data): at most `width` vectors of one dimension, column by column, unshuffled."""

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, labels, rows, data = zip(*waiting.pop(dim))
            columns = np.ascontiguousarray(np.array(data, dtype="<i8").reshape(len(ids), dim).T)
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (ids, labels, rows)]
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[0]]), pa.array([dim], pa.int32()), *lists, pa.array([columns.tobytes()], pa.binary())],
                ["block", "dim", "ids", "labels", "rows", "data"],
            )

        for batch in batches:
            for i, label, row, v in zip(*(c.to_pylist() for c in batch.columns)):
                waiting.setdefault(len(v), []).append((i, label, row, v))
                if len(waiting[len(v)]) == width:
                    yield block(len(v))
        for dim in list(waiting):
            yield block(dim)

    return vectors.select("id", "label", "_row", "vector").mapInArrow(
        packed, "block long, dim int, ids array<long>, labels array<long>, rows array<long>, data binary"
    )


def exact_in_doubles(*columns: np.ndarray) -> bool:
    """No sum of products of these rows of columns can pass 2^53."""
    top = [float(np.abs(c.astype(np.float64)).max(initial=0)) for c in columns]
    return top[0] * top[1] * len(columns[0]) < 2.0**53


def scan(
    q: np.ndarray, columns: np.ndarray, least: np.ndarray, most: np.ndarray, at: np.ndarray,
    windows: np.ndarray, floors: list[float], k: int,
) -> tuple[np.ndarray, np.ndarray]:
    """(candidates left, their exact scores) of the candidates `at`, for windows of (lowest, highest score).

    All of the first k of each window are left, unless they are under the window's floor.
    """
    order = np.argsort(-np.abs(q), kind="stable")
    ends = np.stack([q * least, q * most])[:, order]
    unread = np.zeros((2, len(q) + 1), dtype=q.dtype)  # what the dimensions from here on add at least, at most
    unread[0, :-1] = np.cumsum(ends.min(axis=0)[::-1])[::-1]
    unread[1, :-1] = np.cumsum(ends.max(axis=0)[::-1])[::-1]
    score = np.zeros(len(at), dtype=q.dtype)
    for first in range(0, len(q), STEP):
        dims = order[first : first + STEP]
        score = score + q[dims] @ columns[np.ix_(dims, at)]
        low, high = score + unread[0, first + len(dims)], score + unread[1, first + len(dims)]
        alive = np.zeros(len(at), dtype=bool)
        for (lowest, highest), floor in zip(windows, floors):
            inside = (high >= max(lowest, floor)) & (low <= highest)
            sure = low[(low >= lowest) & (high <= highest)]
            if len(sure) > k:
                inside &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
            alive |= inside
        if not alive.all():
            at, score = at[alive], score[alive]
        if not len(at):
            break
    return at, score


def scanned(pairs: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(anchor_row, window, vec_id, vec_row, score): up to k a window, from each block that an anchor meets.

    `windows` of an anchor is an array of struct<low, high>; a null end is open.
    """

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[float]] = {}  # best scores so far of the anchor block at hand
        block = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
                if row["a_block"] != block:
                    block, seen = row["a_block"], {}
                ids, labels, rows = (np.array(row[n], dtype=np.int64) for n in ("ids", "labels", "rows"))
                columns = np.frombuffer(row["data"], dtype="<i8").reshape(row["dim"], len(ids))
                anchors = np.frombuffer(row["a_data"], dtype="<i8").reshape(row["dim"], len(row["a_rows"]))
                if exact_in_doubles(columns, anchors):
                    columns, anchors = columns.astype(np.float64), anchors.astype(np.float64)
                least, most = columns.min(axis=1), columns.max(axis=1)
                out: list[tuple] = []
                for n, (own, label, windows) in enumerate(zip(row["a_rows"], row["a_labels"], row["windows"])):
                    if not windows:
                        continue
                    spans = np.array(
                        [[-np.inf if w["low"] is None else w["low"], np.inf if w["high"] is None else w["high"]] for w in windows]
                    )
                    best = [seen.get((own, w), []) for w in range(len(spans))]
                    floors = [b[-1] if len(b) == k else -np.inf for b in best]
                    fits = (labels == label) if same_label else (labels != label)
                    left, score = scan(
                        anchors[:, n], columns, least, most, np.nonzero(fits & (rows != own))[0], spans, floors, k
                    )
                    order = np.lexsort((rows[left], ids[left], -score))
                    left, score = left[order], score[order]
                    for w, (low, high) in enumerate(spans):
                        first = np.nonzero((score >= low) & (score <= high))[0][:k]
                        if len(first):
                            out += [(own, w, int(ids[left[f]]), int(rows[left[f]]), int(score[f])) for f in first]
                            seen[own, w] = sorted([*best[w], *score[first].tolist()], reverse=True)[:k]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*out)], ["anchor_row", "window", "vec_id", "vec_row", "score"]
                    )

    return pairs.mapInArrow(search, "anchor_row long, window long, vec_id long, vec_row long, score long")


def met(candidates: DataFrame, anchors: DataFrame, n_blocks: int, n_anchors: int) -> DataFrame:
    """Every anchor block beside every candidate block of its dimension, in cells of few candidate blocks.

    A cell's place is a hash of its blocks, so blocks need no numbers and two in one place meet the same others.
    """
    groups, slots = max(1, n_blocks // CELL), max(1, n_anchors)
    left = candidates.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    )
    right = anchors.withColumn("slot", F.pmod(F.xxhash64("a_block"), F.lit(slots)).cast("int")).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    )
    return left.join(right, ["slot", "group", "dim"])


def first_of(found: DataFrame, k: int, by: list[str], out: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "vec_row")
    return found.withColumn(out, F.row_number().over(order)).filter(F.col(out) <= k)


def score_window(positive_score: Column, least: int, most: int) -> Column:
    """The whole numbers n with least p <= 100 n <= most p; no window if there are none."""
    p = positive_score.cast("decimal(25,0)")
    low, high = F.ceil(p * least / 100), F.floor(p * most / 100)
    return F.when(low <= high, F.struct(low.cast("bigint").alias("low"), high.cast("bigint").alias("high")))


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = EVERY,
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    Anchors are the rows whose id is divisible by `every`; scores are inner products of floor(256 x), exact in 64 bits;
    higher scores come first, ties by the smaller id. An anchor's positives are its first other rows of its
    label, a positive's negatives the first rows of other labels with least / 100 to most / 100 of its score. Where
    the id is divisible by 7 the label first becomes (label + 1) % 10. Rows with a null id, label or vector, or a
    null or non-finite component, take no part; vectors meet only vectors of their own dimension; a repeated row is
    another row, as anchor, positive and negative; an anchor without positives or negatives gives no rows.
    """
    rows = stored(usable(vectors, id_col, vector_col, label_col), "labelled-vectors")
    candidates = stored(column_blocks(rows, BLOCK), "column-blocks")
    asked = stored(
        column_blocks(rows.filter(F.col("id") % every == 0), ANCHORS).select(
            F.col("block").alias("a_block"), "dim", F.col("labels").alias("a_labels"),
            F.col("rows").alias("a_rows"), F.col("data").alias("a_data"),
        ),
        "anchor-blocks",
    )
    n_blocks, n_asked = candidates.count(), asked.count()
    open_ended = F.expr("named_struct('low', cast(null as bigint), 'high', cast(null as bigint))")
    whole = asked.withColumn("windows", F.transform("a_rows", lambda _: F.array(open_ended)))
    near = scanned(met(candidates, whole, n_blocks, n_asked), positives, same_label=True)
    found = stored(
        first_of(near, positives, ["anchor_row"], "place").select(
            "anchor_row", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
        ).withColumn("span", score_window(F.col("positive_score"), least, most)),
        "positives",
    )

    # Positives with equal scores share a window; an anchor block gets its anchors' windows in their order.
    opened = found.filter(F.col("span").isNotNull()).groupBy("anchor_row").agg(
        F.array_sort(F.collect_set("span")).alias("windows")  # at most one a positive
    )
    each = asked.select("a_block", F.posexplode("a_rows").alias("at", "anchor_row")).join(opened, "anchor_row", "left")
    listed = each.groupBy("a_block").agg(F.array_sort(F.collect_list(F.struct("at", "windows"))).alias("w")).select(
        "a_block", F.transform("w", lambda x: x["windows"]).alias("windows")
    )
    sent = stored(asked.join(listed, "a_block"), "anchor-windows")
    far = scanned(met(candidates, sent, n_blocks, n_asked), negatives, same_label=False)
    ranked = first_of(far, negatives, ["anchor_row", "window"], "rank")
    spans = opened.select("anchor_row", F.posexplode("windows").alias("window", "span"))
    anchors = rows.filter(F.col("id") % every == 0).select(F.col("_row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    return (
        found.join(spans, ["anchor_row", "span"])
        .join(ranked.withColumn("window", F.col("window").cast("int")), ["anchor_row", "window"])
        .join(anchors, "anchor_row")
        .select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
