"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed words and word beginnings. The machine adds a weight per term and the inner
product of two terms' vectors for every pair that occurs together, so that a pair can say what neither
term does. It is fitted on a bounded sample of the labelled rows and scores every text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
#: Labelled rows to learn from: the lowest hashes of their ids, so the same rows at every size.
SAMPLE = 24_000
#: Terms with a weight: those whose frequency differs most between the labels in the sample.
TERMS = 1024
#: Sampled documents that must hold a term for it to count; rarer ones say more about the sample than the label.
SUPPORT = 4
FACTORS = 8
EPOCHS = 40
RATE = 0.1
BATCH = 256
POSITIVE_WEIGHT = 2.0
CUTOFF = 0.3
#: crc32(id) modulo FOLDS; fold HELD_OUT is never learned from.
FOLDS = 4
HELD_OUT = 2

WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted numbers of the distinct words and their first four and five letters."""
    mask = (1 << bits) - 1
    out = set()
    for word in set(WORD.findall((text or "").lower())):
        out.add(zlib.crc32(word.encode()) & mask)
        for n in (4, 5):
            if len(word) > n:
                out.add(zlib.crc32(b"^" + word[:n].encode()) & mask)
    return np.array(sorted(out), dtype=np.int32)


@dataclass
class Machine:
    """Weights by slot; `slot` maps a hashed term to its slot, or -1."""

    bias: float
    slot: np.ndarray
    weight: np.ndarray
    factors: np.ndarray

    def __call__(self, text: str | None) -> float:
        own = self.slot[terms(text)]
        own = own[own >= 0]
        v = self.factors[own]
        out = self.bias + self.weight[own].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(out, -30, 30))))


def telling_terms(found: list[np.ndarray], label: np.ndarray, bits: int, most: int) -> np.ndarray:
    """The terms whose log odds between the labels are largest against their standard error."""
    n = 1 << bits
    empty = np.zeros(0, dtype=np.int32)
    yes = np.bincount(np.concatenate([empty, *(x for x, y in zip(found, label) if y)]), minlength=n) + 0.5
    no = np.bincount(np.concatenate([empty, *(x for x, y in zip(found, label) if not y)]), minlength=n) + 0.5
    odds = np.log(yes / (label.sum() + 1)) - np.log(no / ((1 - label).sum() + 1))
    seen = yes + no - 1 >= SUPPORT
    order = np.argsort(np.where(seen, -np.abs(odds) / np.sqrt(1 / yes + 1 / no), 0.0), kind="stable")[:most]
    return order[seen[order]]


def fit(
    found: list[np.ndarray], label: np.ndarray, bits: int = BITS, most: int = TERMS, factors: int = FACTORS,
    epochs: int = EPOCHS, rate: float = RATE, seed: int = 0,
) -> Machine:
    """Logistic loss by AdaGrad in small batches; the seed fixes order and first factors.

    Without rows of both labels the machine is a constant, near the label there is.
    """
    kept = telling_terms(found, label, bits, most)
    slot = np.full(1 << bits, -1, dtype=np.int32)
    slot[kept] = np.arange(len(kept))
    draw = np.random.default_rng(seed)
    n = max(len(kept), 1)
    weight, vectors, bias = np.zeros(n), draw.normal(0, 0.05, (n, factors)), 0.0
    if len(set(label.tolist())) < 2:
        return Machine(30.0 if label.any() else -30.0, np.full(1 << bits, -1, dtype=np.int32), weight, vectors)
    sum_w, sum_v, sum_b = np.full(n, 1e-6), np.full((n, factors), 1e-6), 1e-6
    rows = [x[x >= 0] for x in (slot[f] for f in found)]
    order = np.arange(len(rows))
    for _ in range(epochs):
        draw.shuffle(order)
        for first in range(0, len(order), BATCH):
            batch = order[first : first + BATCH]
            own = np.concatenate([rows[i] for i in batch])
            row = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            v = vectors[own]
            together = np.zeros((len(batch), factors))
            np.add.at(together, row, v)
            out = bias + np.bincount(row, weight[own], len(batch)) + 0.5 * (
                (together**2).sum(axis=1) - np.bincount(row, (v**2).sum(axis=1), len(batch))
            )
            y = label[batch]
            slope = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) * np.where(y > 0, POSITIVE_WEIGHT, 1.0) / len(batch)
            step_w = np.bincount(own, slope[row], n)
            step_v = np.zeros((n, factors))
            np.add.at(step_v, own, slope[row][:, None] * (together[row] - v))
            sum_w += step_w**2
            sum_v += step_v**2
            sum_b += slope.sum() ** 2
            weight -= rate * step_w / np.sqrt(sum_w)
            vectors -= rate * step_v / np.sqrt(sum_v)
            bias -= rate * slope.sum() / np.sqrt(sum_b)
    return Machine(float(bias), slot, weight, vectors)


def fold(id_column: Column) -> Column:
    """Fold of an id: crc32 of its decimal text; a null id is in fold 0."""
    return F.coalesce(F.crc32(id_column.cast("string")) % FOLDS, F.lit(0))


def learned(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = SAMPLE, **how,
) -> Machine:
    """Fit on at most `sample` labelled rows outside the held-out fold, in one task; null labels and ids are left out.

    Several labels of one id count as toxic if one is, and a repeated id counts once, with the text of least hash. The
    ids are chosen before any text is read and shipped to the texts.
    """
    chosen = (
        labels.filter(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & (fold(F.col(f"`{id_col}`")) != HELD_OUT))
        .groupBy(F.col(f"`{id_col}`").alias("_key")).agg((F.max(f"`{label_col}`") > 0).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key").limit(sample)
    )
    rows = docs.select(F.col(f"`{id_col}`").alias("_own"), F.col(f"`{text_col}`").cast("string").alias("_text"))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([terms(t.as_py()) for t in batch.column(3)], pa.list_(pa.int32()))], ["key", "label", "hash", "terms"]
            )

    def fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, label = [], []
        for batch in batches:
            label += batch.column(0).to_pylist()
            found += [np.array(t.as_py(), dtype=np.int32) for t in batch.column(1)]
        m = fit(found, np.array(label, dtype=np.float64), **how)
        parts = [m.slot.astype("<i4"), m.weight.astype("<f8"), m.factors.astype("<f8")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.bias]), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], ["bias", "slot", "weight", "factors"]
        )

    sampled = rows.join(F.broadcast(chosen), rows["_own"] == chosen["_key"]).select(
        F.xxhash64("_key").alias("key"), "_label", F.xxhash64("_text").alias("hash"), "_text"
    )
    model = (
        sampled.mapInArrow(hashed, "key long, label int, hash long, terms array<int>")
        .groupBy("key").agg(F.min(F.struct("hash", "terms", "label")).alias("row"))
        .repartition(1).sortWithinPartitions("key").select("row.label", "row.terms")
        .mapInArrow(fitted, "bias double, slot binary, weight binary, factors binary").collect()
    )
    if not model:  # no usable label, so no task was run
        return fit([], np.zeros(0), **how)
    weight = np.frombuffer(model[0]["weight"], dtype="<f8")
    return Machine(
        model[0]["bias"], np.frombuffer(model[0]["slot"], dtype="<i4"), weight,
        np.frombuffer(model[0]["factors"], dtype="<f8").reshape(len(weight), -1),
    )


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF, **how
) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of `docs`.

    The text alone decides the score: null, empty and wordless texts get the machine's bias, repeated rows
    the same score, very long texts are read whole. Without usable labels every score is near 0; an empty table
    gives no rows; other columns are not read.
    """
    machine = learned(docs, labels, id_col, text_col, **how)
    id_type = docs.schema[id_col].dataType.simpleString()

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array([machine(t.as_py()) for t in batch.column(2)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), score], ["doc_id", "held_out", "score"])

    return (
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"), (fold(F.col(f"`{id_col}`")) == HELD_OUT).alias("held_out"),
            F.col(f"`{text_col}`").cast("string").alias("text"),
        )
        .mapInArrow(scored, f"doc_id {id_type}, held_out boolean, score double")
        .withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
    )
