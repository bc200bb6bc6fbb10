"""Alignment of two tokenizers over the same bytes, and how common each aligned pair of ids is.

Both token rows tile the bytes of a text. Within a batch of texts, keyed by document, `merge_asof` finds for every
token start of one side the token of the other side that covers it, in both directions: two tokens overlap
exactly when the later of their starts lies in the other token. Where tokens of both sides end together a group
ends. A document's distinct id pairs are kept with their number; documents are counted per pair over the whole
corpus, and the counts go back to the documents in two ways: pairs held by more than a fixed share of all
(document, pair) rows are few by arithmetic and are broadcast, each of the others is rare and goes through a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediawatch.llm.common import stored

RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
#: Bytes of text and texts that are aligned at once; a longer text is aligned alone.
BATCH_BYTES = 1 << 20
BATCH_TEXTS = 512
#: A pair is common if it has more than one in so many of the (document, pair) rows: at most so many pairs are.
COMMON = 200_000


class Tokens:
    """Ids and token bytes of both tokenizers for the same bytes: a space, then the text."""

    def __init__(self, ranks: str = RANKS, pieces: str = PIECES):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(public_tokenizers.path(ranks), "rb") as f:
            pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # Without special tokens: their strings inside a text are plain text.
        self.a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces))
        self.a_bytes = [b""] * (max(pairs.values()) + 1)
        for token, i in pairs.items():
            self.a_bytes[i] = token
        self.b_bytes = [self._piece(i) for i in range(self.b.vocab_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side]) for side in (self.a_bytes, self.b_bytes))
        # Ids as text with the mark that follows: within a side, after A's part of a group, after B's.
        n, m = len(self.a_bytes), len(self.b_bytes)
        self.marked = np.array(
            [f"{i}," for i in range(n)] + [f"{i}|" for i in range(n)] + [f"{i}," for i in range(m)] + [f"{i};" for i in range(m)],
            dtype=object,
        )

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def of(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides per text; none for a null or empty text or if either side has other bytes."""
        none = np.zeros(0, dtype=np.int64)
        left, right = [], []
        for text, b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1)):
            a = self.a.encode_ordinary(f" {text}") if text else []
            whole = f" {text or ''}".encode()
            same = text and b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))
            left.append(np.array(a, dtype=np.int64) if same else none)
            right.append(np.array(b, dtype=np.int64) if same else none)
        return left, right


def token_frame(ids: list[np.ndarray], sizes: np.ndarray) -> pd.DataFrame:
    """(doc, start, end, id) of a batch's tokens; byte places run on through the batch."""
    flat = np.concatenate(ids)
    end = np.cumsum(sizes[flat])
    doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    return pd.DataFrame({"doc": doc, "start": end - sizes[flat], "end": end, "id": flat, "place": np.arange(len(flat))})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of all tokens that share a byte, each once."""
    cover_a = pd.merge_asof(a[["doc", "start"]], b[["doc", "start", "place"]], on="start", by="doc")
    cover_b = pd.merge_asof(b[["doc", "start"]], a[["doc", "start", "place"]], on="start", by="doc")
    in_b, in_a = cover_a["place"].to_numpy(), cover_b["place"].to_numpy()
    # Tokens that start together are found from both sides.
    new = a["start"].to_numpy()[in_a] != b["start"].to_numpy()
    left = np.concatenate([a["place"].to_numpy(), in_a[new]])
    return left, np.concatenate([in_b, b["place"].to_numpy()[new]])


def aligned_batch(tokens: Tokens, texts: list[str | None]) -> dict[str, list]:
    """Numbers of tokens, groups and links, the digest of the groups, and the distinct id pairs, of each text."""
    n = len(texts)
    left, right = tokens.of(texts)
    a, b = token_frame(left, tokens.a_sizes), token_frame(right, tokens.b_sizes)
    if not len(a):
        return {"n_a": [0] * n, "n_b": [0] * n, "n_groups": [0] * n, "n_links": [0] * n, "groups_sha256": [""] * n, "pairs": [[]] * n}
    i, j = overlaps(a, b)
    a_doc, a_id, b_id = a["doc"].to_numpy(), a["id"].to_numpy(), b["id"].to_numpy()
    a_end, b_end = a["end"].to_numpy(), b["end"].to_numpy()

    ends = np.intersect1d(a_end, b_end, assume_unique=True)
    a_group, b_group = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
    a_last, b_last = ends[a_group] == a_end, ends[b_group] == b_end
    n_a, n_b = len(tokens.a_bytes), len(tokens.b_bytes)
    mark = np.concatenate([a_id + n_a * a_last, 2 * n_a + b_id + n_b * b_last])
    order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
    written = tokens.marked[mark[order]].tolist()
    sizes = np.array([len(x) + len(y) for x, y in zip(left, right)])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    digests = [
        hashlib.sha256("".join(written[s:e])[:-1].encode()).hexdigest() if e > s else "" for s, e in zip(edges, edges[1:])
    ]

    keys, times = np.unique((a_doc[i] * n_a + a_id[i]) * n_b + b_id[j], return_counts=True)
    rest, pair_b = np.divmod(keys, n_b)
    pair_doc, pair_a = np.divmod(rest, n_a)
    cut = np.searchsorted(pair_doc, np.arange(n + 1)).astype(np.int32)
    pairs = pa.ListArray.from_arrays(
        pa.array(cut),
        pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (pair_a, pair_b, times)], ["a", "b", "times"]),
    )
    return {
        "n_a": [len(x) for x in left], "n_b": [len(x) for x in right],
        "n_groups": np.bincount(a_doc[a_last], minlength=n), "n_links": np.bincount(a_doc[i], minlength=n),
        "groups_sha256": digests, "pairs": pairs,
    }


def in_parts(texts: list[str | None], most_bytes: int, most_texts: int) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of texts that are aligned together."""
    first, held = 0, 0
    for at, text in enumerate(texts):
        own = 4 * len(text or "")
        if at > first and (held + own > most_bytes or at - first == most_texts):
            yield first, at
            first, held = at, 0
        held += own
    if first < len(texts):
        yield first, len(texts)


def aligned(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, pieces: str = PIECES,
) -> DataFrame:
    """(_row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs) of every document.

    `_row` numbers the rows. `pairs` holds the document's distinct linked id pairs with the number of links, struct<a, b, times>. A null or
    empty text, or one that a tokenizer does not give back byte by byte, has zeros, '' and no pairs.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]
    pair_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int32())]))
    types = [pa.int64()] * 4 + [pa.string(), pair_type]

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in batches:
            tokens = tokens or Tokens(ranks, pieces)
            texts = batch.column(1).to_pylist()
            for first, end in in_parts(texts, BATCH_BYTES, BATCH_TEXTS):
                found = aligned_batch(tokens, texts[first:end])
                columns = [c if isinstance(c := found[f], pa.Array) else pa.array(c, t) for f, t in zip(fields, types)]
                own = [batch.column(c).slice(first, end - first) for c in (2, 0)]
                yield pa.RecordBatch.from_arrays([*own, *columns], ["_row", "doc_id", *fields])

    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
        F.monotonically_increasing_id().alias("_row"),
    ).mapInArrow(
        align,
        f"_row long, doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pairs array<struct<a:int,b:int,times:int>>",
    )


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, documents, best): how many documents hold each pair; whether that is the highest of its `a`."""
    counts = rows.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("documents"))
    top = counts.groupBy("a").agg(F.max("documents").alias("top"))
    return counts.join(top, "a").select("a", "b", "documents", (F.col("documents") == F.col("top")).alias("best"))


def with_pair_counts(rows: DataFrame, common: int = COMMON) -> DataFrame:
    """`rows` of `aligned`, stored, with n_best and count_sum in place of `pairs`.

    At most `common` pairs can each have more than 1 / `common` of all (document, pair) rows; these are broadcast.
    No other pair has more than that share, so the shuffle that the rest goes through has no hot key.
    """
    counts = stored(pair_counts(rows), "pair-counts")
    total = counts.agg(F.sum("documents")).first()[0] or 0
    often = F.col("documents") * F.lit(common) > F.lit(total)
    each = rows.select("_row", F.explode("pairs").alias("p")).select("_row", "p.a", "p.b", "p.times")
    key = ["a", "b"]
    usual = each.join(F.broadcast(counts.filter(often)), key)
    rare = each.join(F.broadcast(counts.filter(often).select(*key)), key, "left_anti").join(counts.filter(~often), key)
    found = [x.select("_row", "times", "documents", "best") for x in (usual, rare)]
    sums = found[0].unionByName(found[1]).groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("bigint").alias("n_best"),
        F.sum(F.col("times") * F.col("documents")).cast("bigint").alias("count_sum"),
    )
    return rows.drop("pairs").join(sums, "_row", "left").na.fill(0, ["n_best", "count_sum"])


def token_alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **tokenizers) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Side A encodes a space and the text, side B the text (and adds the space). Links are all pairs of token
    occurrences that share a byte; n_best counts the links whose id pair is, with ties, the one that most
    documents hold among the pairs of its A id; count_sum adds the pairs' numbers of documents over the links.
    Repeated rows are documents of their own and are counted as such, as are rows with a null id; an empty table
    gives no rows; other columns are not read.
    """
    rows = stored(aligned(docs, id_col, text_col, **tokenizers), "aligned")
    return with_pair_counts(rows).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
