"""Marking the words that an occurrence shares with its spot's fragment, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediawatch.functions.text import FOLD_FROM, FOLD_TO, html_escape, let

WORD = r"[\p{L}\p{N}]+"
#: A shared run of fewer words is marked only if it is the whole fragment.
SHORTEST_RUN = 4


def runs_of_letters(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def folded(words: Column) -> Column:
    return F.transform(words, lambda w: F.translate(F.lower(w), FOLD_FROM, FOLD_TO))


def longest_shared_run(a: Column, b: Column) -> Column:
    """struct(size, stop): length and last place in `a` of its longest run of words that `b` has too.

    Word by word of `a`, `open[j]` is the length of the shared run that ends here and at word j of `b`; the first longest wins.
    """
    given = F.struct(a.alias("a"), b.alias("b"), F.sequence(F.lit(0), F.greatest(F.size(b) - 1, F.lit(0))).alias("places"))
    return let(given, lambda g: _longest_shared_run(g["a"], g["b"], g["places"]))


def _longest_shared_run(a: Column, b: Column, places: Column) -> Column:
    start = F.struct(
        F.transform(places, lambda j: F.lit(0)).alias("open"), F.lit(0).alias("size"), F.lit(-1).alias("stop"), F.lit(0).alias("at")
    )

    def step(state: Column, word: Column) -> Column:
        grown = F.transform(
            places,
            lambda j: F.when(F.get(b, j) == word, F.coalesce(F.get(state["open"], j - 1), F.lit(0)) + 1).otherwise(F.lit(0)),
        )

        def kept(open_: Column) -> Column:
            longest = F.array_max(open_)
            better = longest > state["size"]
            return F.struct(
                open_.alias("open"),
                F.when(better, longest).otherwise(state["size"]).alias("size"),
                F.when(better, state["at"]).otherwise(state["stop"]).alias("stop"),
                (state["at"] + 1).alias("at"),
            )

        return let(grown, kept)

    return F.aggregate(a, start, step, lambda s: F.struct(s["size"].alias("size"), s["stop"].alias("stop")))


def mark_fragment(text: Column, fragment: Column) -> Column:
    """HTML of the text with its longest run of the fragment's words marked; case and accents do not count.

    A null text is empty; without a fragment, or a long enough run, nothing is marked.
    """

    def joined(gaps: Column, words: Column, first: Column, n: Column) -> Column:
        """n gaps from a place on, each with the word after it."""
        pairs = F.zip_with(F.slice(gaps, first + 1, n), F.slice(words, first + 1, n), lambda g, w: F.concat(g, w))
        return F.when(n > 0, F.array_join(pairs, "")).otherwise(F.lit(""))

    def marked(parts: Column) -> Column:
        words, gaps, own = parts["words"], parts["gaps"], parts["own"]

        def placed(run: Column) -> Column:
            first, n = run["stop"] - run["size"] + 1, F.size(words)
            inside = F.concat(F.get(words, first), joined_after(gaps, words, first, run["size"] - 1))
            after = F.concat(joined_after(gaps, words, run["stop"], n - 1 - run["stop"]), F.element_at(gaps, -1))
            before = F.concat(joined(gaps, words, F.lit(0), first), F.get(gaps, first))
            enough = (run["size"] > 0) & (run["size"] >= F.least(F.lit(SHORTEST_RUN), F.size(own)))
            return F.when(
                enough, F.concat(html_escape(before), F.lit("<mark>"), html_escape(inside), F.lit("</mark>"), html_escape(after))
            ).otherwise(html_escape(text))

        return let(longest_shared_run(folded(words), folded(own)), placed)

    def joined_after(gaps: Column, words: Column, place: Column, n: Column) -> Column:
        """The n words after a place, each with the gap before it."""
        return joined(gaps, words, place + 1, F.greatest(n, F.lit(0)))

    parts = F.struct(
        runs_of_letters(text).alias("words"), F.split(text, WORD).alias("gaps"),
        runs_of_letters(F.coalesce(fragment, F.lit(""))).alias("own"),
    )
    return F.when(text.isNull(), F.lit("")).otherwise(let(parts, marked))
