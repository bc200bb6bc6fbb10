"""Best-two-fit packing of tokenised documents into sequences of one length.

Pieces of equal length are interchangeable, so the plan is made on the number of pieces of each length
(at most `capacity` numbers, whatever the input) and then dealt to the pieces by their place among
pieces of their length. A sequence is filled greedily, largest piece first; as long as it has room left, its
smallest piece is given back for the two unpacked pieces that fill the larger gap best, if they fill it
better. A filling found once is used as often as the pieces last.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediawatch.llm.common import hidden, stored

CAPACITY = 1024
#: Least lengths, as parts of the capacity, of the two pieces that may replace a sequence's smallest.
PARTNERS = (0, 1 / 16, 1 / 8, 3 / 16, 1 / 4)
END = 2
#: Parts that the pieces of one length are numbered in.
PARTS = 256
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


class Encoder:
    """Ids of the tokenizer file.

    The rank file holds the same vocabulary and merges, which the faster library reads; a text that names
    a special token goes through the tokenizer file, which alone defines what that gives.
    """

    def __init__(self, tokenizer: str = TOKENIZER, ranks: str = RANKS):
        import base64
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = public_tokenizers.path(tokenizer)
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(public_tokenizers.path(ranks), "rb") as f:
            pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={}
        )

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n tokens; only the first may be shorter than the others."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    edges = [0, *range(first, n + 1, capacity)]
    return list(zip(edges, edges[1:]))


def tokenised(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END,
    tokenizer: str = TOKENIZER, ranks: str = RANKS, with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document; a null text is empty."""
    ids_field = ", ids array<int>" if with_ids else ""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or Encoder(tokenizer, ranks)
            # A few texts at a time: what is held does not grow with the batch.
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, pieces, starts, lengths, crcs, kept = [], [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    ids = np.array([*encode(text or ""), end], dtype="<u4")
                    for piece, (a, b) in enumerate(cuts(len(ids), capacity)):
                        rows.append(row)
                        pieces.append(piece)
                        starts.append(a)
                        lengths.append(b - a)
                        crcs.append(zlib.crc32(ids[a:b].tobytes()))
                        if with_ids:
                            kept.append(ids[a:b].astype("<i4"))
                out = [
                    part.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()),
                    pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long{ids_field}"
    )


def best_pair(lengths: list[int], left: Counter, room: int, above: int, partner: int = 1) -> tuple[int, int] | None:
    """The two unpacked lengths of at least `partner` whose sum is highest within `room` and over `above`."""
    best, pair = above, None
    low, high = bisect_left(lengths, partner), bisect_right(lengths, room - 1) - 1
    while low <= high and best < room:
        a, b = lengths[low], lengths[high]
        if a + b > room or (low == high and left[a] < 2):
            high -= 1
        else:
            if a + b > best:
                best, pair = a + b, (b, a)
            low += 1
    return pair


def planned(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """The fillings with the fewest sequences, of those with each least length of a replacing pair.

    A swap fills one sequence better with small pieces that a later one may lack. What is dearer depends on the
    lengths, so every bound in PARTNERS is planned; a plan reads the counts alone.
    """
    plans = [fillings(counts, capacity, max(int(capacity * p), 1)) for p in PARTNERS]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def fillings(counts: dict[int, int], capacity: int = CAPACITY, partner: int = 1) -> list[tuple[list[int], int]]:
    """[(lengths in one sequence, number of such sequences)] that use up all counted pieces.

    The smallest piece gives way to two others of at least `partner`. Every filling is used until one of its lengths runs out, so their number is bounded by the lengths.
    """
    left = Counter({n: c for n, c in counts.items() if c > 0})
    out = []
    while left:
        lengths = sorted(left)
        own, pool = [], left.copy()

        def take(n: int, pool: Counter = pool, lengths: list[int] = lengths, own: list[int] = own) -> None:
            own.append(n)
            pool[n] -= 1
            if not pool[n]:
                lengths.remove(n)

        take(lengths[-1])
        room = capacity - own[0]
        while room:
            at = bisect_right(lengths, room)
            if at:
                take(lengths[at - 1])
                room -= own[-1]
                continue
            if len(own) < 2:
                break
            least = min(own)
            pair = best_pair(lengths, pool, room + least, least, partner)
            if pair is None:
                break
            own.remove(least)
            for n in pair:
                take(n)
            if not pool[least]:
                lengths.insert(bisect_right(lengths, least), least)
            pool[least] += 1
            room += least - sum(pair)
        use = Counter(own)
        times = min(left[n] // c for n, c in use.items())
        out.append((own, times))
        for n, c in use.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return out


def deal(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first place, last place, sequence of the first, offset): who goes where."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for own, times in plan:
        offset = 0
        for n in own:
            rows.append((n, used[n], used[n] + times - 1, sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, parts: int = PARTS) -> DataFrame:
    """Every row of `pieces` (column length, 1 to capacity) with sequence_id and offset (both long).

    Offsets run from 0 without gaps in every sequence. Full pieces are sequences of their own, with negative
    numbers, and are not shuffled. Equal rows are dealt like any others; an empty table gives no rows; a
    column called sequence_id or offset is replaced. The rows are read more than once: pass a stored table.
    """
    spark = pieces.sparkSession
    rows = pieces.drop("sequence_id", "offset")
    odd = rows.filter((F.col("length") < 1) | (F.col("length") > capacity) | F.col("length").isNull())
    full = rows.filter(F.col("length") == capacity).select(
        "*", (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    part, before, place, size, low, high, first, offset = (
        hidden(rows, n) for n in ("part", "before", "place", "size", "low", "high", "first", "at")
    )
    short = rows.filter(F.col("length") < capacity).withColumn(
        part, F.pmod(F.xxhash64(*[c for c in rows.columns if c != "ids"]), F.lit(parts)).cast("int")
    )
    cells = short.groupBy("length", part).agg(F.count("*").alias(before))  # capacity x parts rows at most
    counts = {int(r[0]): int(r[1]) for r in cells.groupBy("length").agg(F.sum(before)).collect()}
    if any(n < 1 for n in counts) or not odd.isEmpty():
        raise ValueError(f"a piece's length is not from 1 to {capacity}")
    blocks = spark.createDataFrame(
        deal(planned(counts, capacity)), f"`{size}` long, `{low}` long, `{high}` long, `{first}` long, `{offset}` long"
    )
    running = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn(before, F.coalesce(F.sum(before).over(running), F.lit(0)))
    inside = Window.partitionBy("length", part).orderBy(*[c for c in rows.columns if c not in ("ids", "length")])
    numbered = (
        short.withColumn(place, F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["length", part])
        .withColumn(place, F.col(place) + F.col(before))
    )
    dealt = numbered.join(
        F.broadcast(blocks),
        (F.col("length") == F.col(size)) & F.col(place).between(F.col(low), F.col(high)),
    ).select(
        *[F.col(f"`{c}`") for c in rows.columns],
        (F.col(first) + F.col(place) - F.col(low)).alias("sequence_id"),
        F.col(offset).alias("offset"),
    )
    return dealt.unionByName(full)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, parts: int = PARTS, **tokens) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end token; longer documents than `capacity` are cut from
    their end, so only the first piece may be short; repeated rows and null ids are packed like others. With
    `with_ids` the token ids follow. The tokenised pieces are stored, so each text is encoded once.
    """
    pieces = stored(tokenised(docs, capacity=capacity, **tokens), "pieces")
    last = ["ids"] if "ids" in pieces.columns else []
    return pack(pieces, capacity, parts).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *last
    )
