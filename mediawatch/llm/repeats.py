"""Long repeated byte strings: common-prefix interval trees over a sparse enhanced suffix array.

Suffixes are sampled where they can be found again: of every run of windows the place with the least
hash of its next `ANCHOR` bytes is an anchor, so equal strings of the required length hold an anchor at the same
place. Anchors that start equally form a group, and each group is a suffix array of its own: its
suffixes are sorted, a stack scan over their common prefixes closes one interval after the other, and
within an interval the texts to the left are scanned the same way. An interval whose members extend to
the left differently ends there; one that reaches the required length is a repeat of all its members.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediawatch.llm.common import identity, shipped, stored
from mediawatch.scale import discard

LENGTH = 400
ANCHOR = 128
#: Different contexts that one group compares at once; a larger group is divided by the place of shared strings.
GROUP = 32_768
#: Parts of a range of places that a large group is divided by.
WAYS = 8
CHUNK = 1 << 16
SALTS = 8
PLACE = np.uint64((1 << 20) - 1)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, base, dtype=np.uint64)
    down = np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Sampler:
    """Anchors of a byte string with the hash of their next bytes and of their whole context."""

    def __init__(self, length: int, anchor: int):
        self.length, self.anchor, self.run = length, anchor, length - anchor + 1
        n = CHUNK + 3 * length
        self.bytes = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.key, self.context = _powers(0x5851F42D4C957F2D, n), _powers(0x14057B7EF767814F, n)

    def hashes(self, data: np.ndarray, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(data * powers[0][: len(data)], out=total[1:])
        return total

    def __call__(self, text: bytes) -> tuple[np.ndarray, ...]:
        """(place, key, context hash, bytes to the left, bytes from the anchor on)."""
        n, k, run = len(text), self.anchor, self.run
        found = []
        whole = np.frombuffer(text, dtype=np.uint8)
        reach = self.length - k  # bytes before an anchor that a window with it may hold
        for first in range(0, max(n - self.length + 1, 0), CHUNK):
            last = min(first + CHUNK, n - self.length + 1)  # windows that start in first .. last - 1
            low, high = max(first - reach, 0), min(last + 2 * self.length, n)
            data = self.bytes[whole[low:high]]
            total = self.hashes(data, self.key)
            a, b = first - low, last + run - 1 - low  # places where an anchor may be
            key = (total[a + k : b + k] - total[a:b]) * self.key[1][a:b]
            rank = (_mixed(key) & ~PLACE) | np.arange(b - a, dtype=np.uint64)
            width, least = 1, rank
            while 2 * width <= run:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < run:
                least = np.minimum(least[: len(least) - (run - width)], least[run - width :])
            at = least & PLACE
            at = at[np.flatnonzero(np.diff(at, prepend=np.uint64(1 << 63)))].astype(np.int64)
            start, place = at + a, at + first
            left, right = np.minimum(place, reach), np.minimum(n - place, self.length)
            context = self.hashes(data, self.context)
            whole_context = (context[start + right] - context[start - left]) * self.context[1][start - left]
            mark = _mixed(whole_context + np.uint64(1009) * left.astype(np.uint64) + right.astype(np.uint64))
            found.append((place, _mixed(key[at] + np.uint64(k)).view(np.int64), mark.view(np.int64), left, right))
        if not found:
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
        columns = [np.concatenate(c) for c in zip(*found)]
        new = np.diff(columns[0], prepend=-1) > 0  # an anchor on the edge of two chunks is met twice
        return tuple(c[new] for c in columns)


def anchors(docs: DataFrame, id_col: str, text_col: str, length: int, anchor: int) -> DataFrame:
    """(_id, _text_hash, _at, _key, _context, _left, _right): one row per anchor of every row."""

    def sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = Sampler(length, anchor)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows, columns = [], [[] for _ in range(5)]
                for row, text in enumerate(part.column(2)):
                    got = sample(text.as_py())
                    rows.append(np.full(len(got[0]), row))
                    for to, x in zip(columns, got):
                        to.append(x)
                row = pa.array(np.concatenate(rows))
                at, key, context, left, right = (np.concatenate(c) for c in columns)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(row), part.column(1).take(row), pa.array(at), pa.array(key), pa.array(context),
                     pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))],
                    ["_id", "_text_hash", "_at", "_key", "_context", "_left", "_right"],
                )

    text = F.col(f"`{text_col}`").cast("binary")
    return (
        docs.filter(F.octet_length(text) >= length)
        .select(*identity(id_col, text_col), text.alias("_bytes"))
        .mapInArrow(sampled, "_id string, _text_hash long, _at long, _key long, _context long, _left int, _right int")
    )


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def intervals(shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every common-prefix interval, inner ones first, by a stack scan.

    shared[i] is the common prefix of the sorted strings i and i + 1.
    """
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*shared, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            inner, first = stack.pop()
            yield inner, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def extents(contexts: list[tuple[bytes, int]], length: int) -> list[tuple[int, int]]:
    """For each (bytes, place of the anchor): how far its repeats reach to the left and from the anchor on.

    (0, 0) if no string of the length that holds the anchor is in another context. An interval keeps its members
    in the order of their lefts and joins the smaller inner ones into the largest, so a member moves a few times
    however deep the intervals lie in each other. Only members with a new neighbour can reach further than in an
    inner, deeper interval.
    """
    rights = [c[at:] for c, at in contexts]
    lefts = [c[:at][::-1] for c, at in contexts]
    by_right = sorted(range(len(contexts)), key=rights.__getitem__)
    by_left = sorted(range(len(contexts)), key=lefts.__getitem__)
    rank = [0] * len(contexts)
    for i, x in enumerate(by_left):
        rank[x] = i
    lefts = [lefts[x] for x in by_left]
    reach, out = [0] * len(contexts), [(0, 0)] * len(contexts)  # by rank
    shared = [common(rights[a], rights[b]) for a, b in zip(by_right, by_right[1:])]
    held = {i: (i, [rank[x]]) for i, x in enumerate(by_right)}  # by the first place: the last one, the ranks in order
    for depth, first, last in intervals(shared):
        parts, at = [], first
        while at <= last:
            to, members = held.pop(at)
            parts.append(members)
            at = to + 1
        most = max(parts, key=len)
        rest = [x for members in parts if members is not most for x in members]
        if 8 * len(rest) >= len(most):
            most = sorted(most + rest)
            new = range(len(most) - 1)
        else:
            new = []
            for x in rest:
                insort(most, x)
            for x in rest:
                i = bisect_left(most, x)
                new += [i - 1, i]
        for i in new:
            if 0 <= i < len(most) - 1:
                a, b = most[i], most[i + 1]
                back = common(lefts[a], lefts[b])
                for x in (a, b):
                    reach[x] = max(reach[x], back)
                    if back + depth >= length:
                        out[x] = (max(out[x][0], back), max(out[x][1], depth))
        held[first] = (last, most)
    return [out[r] for r in rank]


def grouped(rows: DataFrame, length: int) -> DataFrame:
    """(_key, _context, _reach_left, _reach_right) of the members of each group (column _group)."""

    def solved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; the last group of a batch waits for the next batch."""
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            if len(held) > 1:
                for (_, key, context, *_), (a, b) in zip(held, extents([(h[3], h[4]) for h in held], length)):
                    if b:
                        out.append((key, context, a, b))
            held.clear()

        def sent() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                ["_key", "_context", "_reach_left", "_reach_right"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][0] != row[0]:
                    close()
                held.append(row)
            yield sent()
        close()
        yield sent()

    return (
        rows.select("_group", "_key", "_context", "_bytes", "_left")
        .repartition("_group").sortWithinPartitions("_group")
        .mapInArrow(solved, "_key long, _context long, _reach_left int, _reach_right int")
    )


def divided(level: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(members of smaller groups, reach found on the way) of the members of groups too large to compare.

    A string of the length holds `_lo` to `_hi` bytes before the anchor. That range is cut into `WAYS`; who shares a
    string of a smaller range shares what all of its strings have in common, and is grouped by that. Members that
    agree on every string of the range repeat each other over all of it: one of them goes on for the others.
    """
    step = F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.lit(WAYS)).cast("int")
    cut = F.transform(
        F.sequence(F.col("_lo"), F.col("_hi"), step),
        lambda lo: F.struct(lo.alias("lo"), F.least(lo + step - 1, F.col("_hi")).alias("hi")),
    )
    inner = F.expr(f"substring(_bytes, _left - _lo + 1, _lo + {length} - _hi)")
    outer = F.expr("substring(_bytes, _left - _a + 1, _a + _b)")
    members = stored(
        level.withColumn("_cut", F.explode(cut))
        .select("_key", "_context", "_left", "_right", "_bytes", F.col("_cut.lo").alias("_lo"), F.col("_cut.hi").alias("_hi"))
        .withColumn("_a", F.least("_hi", "_left"))
        .withColumn("_b", F.least(F.lit(length) - F.col("_lo"), F.col("_right")))
        .filter((F.col("_lo") <= F.col("_a")) & (F.lit(length) - F.col("_hi") <= F.col("_b")) & (F.col("_a") + F.col("_b") >= length))
        .select(
            "_key", "_context", "_lo", "_hi", "_a", "_b",
            F.xxhash64("_key", "_lo", "_hi", inner).alias("_group"), F.xxhash64("_a", "_b", outer).alias("_outer"),
        ),
        "divided-groups",
    )
    agree = ["_key", "_lo", "_hi", "_a", "_b", "_group", "_outer"]
    classes = stored(
        members.groupBy(*agree).agg(F.count("*").alias("_n"), F.min("_context").alias("_context")), "group-classes"
    )
    reach = members.join(classes.filter("_n > 1").select(*agree), agree, "left_semi").select(
        "_key", "_context", F.col("_a").alias("_reach_left"), F.col("_b").alias("_reach_right")
    )
    several = classes.groupBy("_group").agg(F.count("*").alias("_c")).filter("_c > 1").select("_group")
    further = classes.join(several, "_group", "left_semi").select("_key", "_context", "_group", "_lo", "_hi")
    return further, reach


def compared(contexts: DataFrame, length: int, anchor: int, most: int) -> DataFrame:
    """Reach of every context that shares a string of the length with another one of its anchor group.

    A group of more than `most` contexts is divided until it is small. Members of a group for strings of one place
    all share that string, so this ends after a few rounds, whatever the texts.
    """
    level = contexts.select("*", F.col("_key").alias("_group"), F.lit(0).alias("_lo"), F.lit(length - anchor).alias("_hi"))
    found = whole = None
    while True:
        sizes = level.groupBy("_group").agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
        large = stored(sizes.select("_group"), "large-groups")
        none = large.isEmpty()
        small = grouped(level if none else level.join(large, "_group", "left_anti"), length)
        found = small if found is None else found.unionByName(small)
        if none:
            return found
        level = level.join(large, "_group", "left_semi")
        if whole is None:
            level = stored(level, "large-group-contexts")
            whole = level.select("_key", "_context", "_left", "_right", "_bytes")
        further, reach = divided(level, length)
        found = found.unionByName(reach)
        level = stored(further.join(whole, ["_key", "_context"]), "divided-contexts")


def occurrences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR,
    most: int = GROUP,
) -> DataFrame:
    """(_id, _text_hash, group, start, end): all occurrences of maximal repeats, in bytes.

    `group` names the anchor that the members of a repeat share; `start` and `end` are where the repeats that
    hold it end. Together the rows cover exactly the bytes of every string of `length` bytes that starts
    anywhere else too. Members with one whole context (copies) are one member of the comparison.
    """
    every = stored(anchors(docs, id_col, text_col, length, anchor), "anchors")
    shared = every.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1").select("_key")
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    salt = F.pmod(F.xxhash64("_id", "_text_hash", "_at"), F.lit(SALTS)).cast("int")
    repeated = stored(
        every.withColumn("_salt", salt).join(shared.select("_key", spread), ["_key", "_salt"]).drop("_salt"), "shared-anchors"
    )
    discard(every)
    classes = stored(
        repeated.groupBy("_key", "_context", "_left", "_right").agg(
            F.count("*").alias("_n"), F.min(F.struct("_id", "_text_hash", "_at")).alias("_one")
        ),
        "anchor-contexts",
    )
    several = classes.groupBy("_key").agg(F.count("*").alias("_c")).filter("_c > 1").select("_key")
    own = F.pmod("_context", F.lit(SALTS)).cast("int")
    wanted = stored(
        classes.withColumn("_salt", own).join(several.select("_key", spread), ["_key", "_salt"], "left_semi").select(
            "_key", "_context", "_left", "_right", "_one._id", "_one._text_hash", "_one._at"
        ),
        "contexts-to-read",
    )
    owners = shipped(stored(wanted.select(F.col("_id").alias("_own"), F.col("_text_hash").alias("_own_hash")).distinct(), "context-owners"))
    texts = docs.select(*identity(id_col, text_col), F.col(f"`{text_col}`").cast("binary").alias("_bytes"))
    texts = texts.join(
        owners, texts["_id"].eqNullSafe(owners["_own"]) & (texts["_text_hash"] == owners["_own_hash"]), "left_semi"
    ).dropDuplicates(["_id", "_text_hash"])
    read = wanted.alias("w").join(
        texts.alias("t"), F.col("w._id").eqNullSafe(F.col("t._id")) & (F.col("w._text_hash") == F.col("t._text_hash"))
    ).select(
        "_key", "_context", "_left", "_right",
        F.expr("substring(_bytes, cast(_at as int) - _left + 1, _left + _right)").alias("_bytes"),
    )
    reach = compared(stored(read, "contexts"), length, anchor, most)
    copies = classes.filter("_n > 1").select(
        "_key", "_context", F.col("_left").alias("_reach_left"), F.col("_right").alias("_reach_right")
    )
    covered = (
        reach.unionByName(copies).groupBy("_key", "_context")
        .agg(F.max("_reach_left").alias("_reach_left"), F.max("_reach_right").alias("_reach_right"))
        .select("*", spread)
    )
    return (
        repeated.withColumn("_salt", salt).join(covered, ["_key", "_context", "_salt"])
        .select(
            "_id", "_text_hash", F.col("_key").alias("group"),
            (F.col("_at") - F.col("_reach_left")).alias("start"), (F.col("_at") + F.col("_reach_right")).alias("end"),
        )
    )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans; spans that touch are one run."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR,
    most: int = GROUP,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): one row per row of `docs`.

    `spans` are the removed runs as (start, end) in bytes of the text, `kept` the bytes that stay. Null and
    empty texts have no bytes; texts shorter than `length` stay whole; repeated rows repeat each other, so both lose
    what they share; an empty table gives no rows. A document gathers its own spans, no more than it has anchors.
    """
    spans = (
        occurrences(docs, id_col, text_col, length, anchor, most)
        .groupBy("_id", "_text_hash")
        .agg(F.collect_set(F.struct(F.col("start").alias("a"), F.col("end").alias("b"))).alias("_spans"))
    )
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sizes, removed, runs, kept = [], [], [], []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    text = text or b""
                    gone = merged([(s["a"], s["b"]) for s in found or ()])
                    edges = [0, *(x for run in gone for x in run), len(text)]
                    sizes.append(len(text))
                    removed.append(sum(b - a for a, b in gone))
                    runs.append([{"start": a, "end": b} for a, b in gone])
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                     pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "spans", "kept"],
                )

    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("_bytes"), *identity(id_col, text_col)
    ).alias("d")
    return (
        rows.join(
            spans.alias("s"),
            F.col("d._id").eqNullSafe(F.col("s._id")) & (F.col("d._text_hash") == F.col("s._text_hash")), "left",
        )
        .select("doc_id", "_bytes", "_spans")
        .mapInArrow(
            cut, f"doc_id {id_type}, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
        )
    )
