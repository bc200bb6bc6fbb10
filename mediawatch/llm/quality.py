"""Quality rules as a ledger of bits.

Every document is read once: its measurements are taken, every rule is evaluated on them, and what failed is stored
as one bit a rule beside the measurements. Policies are versioned masks over these bits. A new policy, a comparison of
policies or an ablation reads the ledger (in fact the counted bit patterns, of which there are at most two to the
number of rules), never the texts again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediawatch.llm.common import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
BULLETS = ("-", "*", "•", "‣", "·")
ELLIPSES = ("...", "…")
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_caps_words",
    "n_bullet_lines", "n_ellipsis_lines",
)


def _c(name: str) -> Column:
    return F.col(name)


#: Rule of each bit, from the lowest on: its name and when a document fails it. Bits are only ever added at the end.
RULES: tuple[tuple[str, object], ...] = (
    ("few_words", lambda: _c("n_words") < 50),
    ("repeated_runs", lambda: 100 * _c("n_repeat_words") > 50 * _c("n_words")),
    ("many_words", lambda: _c("n_words") > 100_000),
    ("short_words", lambda: _c("word_chars") < 3 * _c("n_words")),
    ("long_words", lambda: _c("word_chars") > 10 * _c("n_words")),
    ("symbols", lambda: 10 * _c("n_symbols") > _c("n_words")),
    ("few_letters", lambda: 100 * _c("n_letter_words") < 80 * _c("n_words")),
    ("repeated_lines", lambda: 100 * _c("n_dup_lines") > 30 * _c("n_lines")),
    ("capitals", lambda: 100 * _c("n_caps_words") > 50 * _c("n_words")),
    ("bullets", lambda: 100 * _c("n_bullet_lines") > 90 * _c("n_lines")),
    ("cut_lines", lambda: 100 * _c("n_ellipsis_lines") > 30 * _c("n_lines")),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Rules that no policy may leave out.
BASE = BITS["few_words"] | BITS["repeated_runs"]


@dataclass(frozen=True)
class Policy:
    """A version: any rule of `reject` rejects a document; of `suspect` it may fail `tolerated`."""

    version: str
    reject: tuple[str, ...]
    suspect: tuple[str, ...] = ()
    tolerated: int = 0

    @property
    def masks(self) -> tuple[int, int]:
        own = reduce(int.__or__, (BITS[n] for n in self.reject), BASE)
        return own, reduce(int.__or__, (BITS[n] for n in self.suspect), 0) & ~own

    @property
    def rules(self) -> list[str]:
        reject, suspect = self.masks
        return [n for n, bit in BITS.items() if (reject | suspect) & bit]

    def keeps(self, failed: Column) -> Column:
        reject, suspect = (F.lit(m).cast("bigint") for m in self.masks)
        return (failed.bitwiseAND(reject) == 0) & (F.bit_count(failed.bitwiseAND(suspect)) <= self.tolerated)


POLICIES: dict[str, Policy] = {
    p.version: p
    for p in (
        Policy("1", ("few_words", "repeated_runs")),
        Policy("2", ("few_words", "repeated_runs", "many_words", "short_words", "long_words", "symbols", "few_letters", "repeated_lines")),
        Policy(
            "3",
            ("few_words", "repeated_runs", "short_words", "long_words", "symbols", "few_letters", "repeated_lines", "capitals"),
            ("many_words", "bullets", "cut_lines"), 1,
        ),
    )
}
CURRENT = "3"


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a window of three that the sequence of word numbers holds twice or more."""
    if len(ids) < 4:
        return 0
    _, pair = np.unique(ids[:-1] * len(ids) + ids[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * len(ids) + ids[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    inside = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        inside[shift : shift + len(again)] |= again
    return int(inside.sum())


def measures_of(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text; a null text has no words."""
    text = text or ""
    words = WORD.findall(text)
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    times = np.bincount(ids, minlength=len(number))
    letters = np.fromiter((w.isalpha() or any(map(str.isalpha, w)) for w in number), bool, len(number))
    capitals = np.fromiter((w.isupper() and sum(map(str.isupper, w)) > 1 for w in number), bool, len(number))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    bare = [x.strip(" \t\n\x0b\x0c\r") for x in lines]
    return (
        len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)),
        repeated_words(ids), int(times[letters].sum()), int(times[capitals].sum()),
        sum(x.startswith(BULLETS) for x in bare), sum(x.endswith(ELLIPSES) for x in bare),
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, MEASURES) of every document, one pass over whole texts."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measures_of(x.as_py()) for x in batch.column(1)]
            columns = zip(*rows) if rows else [[] for _ in MEASURES]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *MEASURES]
            )

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        measure, f"doc_id {id_type}, " + ", ".join(f"{m} long" for m in MEASURES)
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, MEASURES, failed): one row per document, the bit of every rule it fails set in `failed`.

    A null or empty text measures zero everywhere. Repeated rows and null ids have rows of their own; an empty
    table gives none; other columns are not read.
    """
    bits = [F.when(fails(), F.lit(BITS[name]).cast("bigint")).otherwise(0) for name, fails in RULES]
    return measured(docs, id_col, text_col).withColumn("failed", reduce(Column.__add__, bits).cast("bigint"))


def patterns(entries: DataFrame) -> DataFrame:
    """(failed, documents, words): at most 2 ^ rules rows, whatever the corpus."""
    return entries.groupBy("failed").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_words").alias("words"))


def ablations(entries: DataFrame, policies: Iterable[Policy]) -> DataFrame:
    """What each policy does, and what leaving out each of its rules would change.

    (version, rule, kept, rejected, failing, regained, regained_words, always_with, ever_with): `failing` documents fail
    the rule, `regained` would be kept without it; `always_with` and `ever_with` are the bits that all, or any, of the
    failing documents fail besides. A rule that nothing fails has zeros. All from the counted patterns.
    """
    counted = stored(patterns(entries), "failure-patterns")
    out = []
    for policy in policies:
        kept = policy.keeps(F.col("failed"))
        for rule in policy.rules:
            bit = F.lit(BITS[rule]).cast("bigint")
            fails = F.col("failed").bitwiseAND(bit) != 0
            rest = F.col("failed").bitwiseAND(F.bitwise_not(bit))
            back = fails & ~kept & policy.keeps(rest)
            total = lambda when, n="documents": F.coalesce(F.sum(F.when(when, F.col(n))), F.lit(0))
            out.append(
                counted.agg(
                    total(kept).alias("kept"), total(~kept).alias("rejected"), total(fails).alias("failing"),
                    total(back).alias("regained"), total(back, "words").alias("regained_words"),
                    F.coalesce(F.bit_and(F.when(fails, rest)), F.lit(0)).alias("always_with"),
                    F.coalesce(F.bit_or(F.when(fails, rest)), F.lit(0)).alias("ever_with"),
                ).select(F.lit(policy.version).alias("version"), F.lit(rule).alias("rule"), "*")
            )
    return reduce(DataFrame.unionByName, out)


def decisive(policy: Policy, failed: Column) -> Column:
    """The rule without which the policy would keep a rejected document, or null if there is none or several do."""
    alone = [
        F.when(
            (failed.bitwiseAND(F.lit(BITS[r]).cast("bigint")) != 0)
            & policy.keeps(failed.bitwiseAND(F.lit(~BITS[r]).cast("bigint"))), F.lit(r),
        )
        for r in policy.rules
    ]
    found = F.filter(F.array(*alone), lambda r: r.isNotNull())
    return F.when(~policy.keeps(failed) & (F.size(found) == 1), F.get(found, F.lit(0)))


def judged(docs: DataFrame, policy: Policy = POLICIES[CURRENT], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger with base_failed, kept, version, decisive (a rule) and regained (documents kept without that rule)."""
    entries = stored(ledger(docs, id_col, text_col), "ledger")
    changes = ablations(entries, [policy]).select(F.col("rule").alias("decisive"), "regained")  # a row a rule
    return (
        entries.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(BASE).cast("bigint")) != 0)
        .withColumn("kept", policy.keeps(F.col("failed")))
        .withColumn("version", F.lit(policy.version))
        .withColumn("decisive", decisive(policy, F.col("failed")))
        .join(F.broadcast(changes), "decisive", "left")
    )
