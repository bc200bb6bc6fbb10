"""Text normalisation, keyword location and display helpers as Column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word characters as a Unicode class; Java's \w is ASCII by default.
WORD = r"[\p{L}\p{N}_]"
NOT_BEFORE = rf"(?<!{WORD})"
NOT_AFTER = rf"(?!{WORD})"
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

SILENCE = "[~]"

# Accent folding used for word-by-word comparison.
FOLD_FROM = "áéíóúüñàèìòùâêîôûäëïöç"
FOLD_TO = "aeiouunaeiouaeiouaeioc"

# Spanish sound rules, applied in order after a silent initial h is dropped.
PHONETIC_RULES = [
    ("v", "b"), ("ll", "y"),
    ("que", "ke"), ("qui", "ki"),
    ("ce", "se"), ("ci", "si"),
    ("ge", "je"), ("gi", "ji"),
    ("z", "s"), ("ck", "k"), ("x", "ks"),
]

# Edge punctuation and markers that mean "no speech".
NOISE_EDGE = ".,;:¿?¡!—-–…"
NOISE_MARKERS = ["[música]", "[music]", "(música)", "(music)", "[silencio]", "[silence]"]

# English function words that reveal a language drift.
ENGLISH_WORDS = (
    "the of and with that this has been was were are is for from to in on "
    "more during first report potential actually already million thousand "
    "converted principal causes common niche diverse region which there their"
).split()

# Spanish stop-words ignored when a question becomes a query.
STOP_WORDS = """
a al algo alguna algunas alguno algunos ante antes aquel aquella aquellas aquello
aquellos aquí ayer bajo bien cada como con contra cual cuales cuando cuanta
cuantas cuanto cuantos cómo cuál cuándo cuánta cuántas cuánto cuántos de del desde
donde dónde dos el ella ellas ellos en entonces entre era eran eres es esa esas ese
eso esos esta estaba estado estamos están estar estas este esto estos fin fue fueron
ha hace hacen hasta hay he hemos hicieron hizo hoy la las le les lo los luego mas me
mi mis mucho muchos muy más ni no nos nosotros nuestra nuestras nuestro nuestros o
os otra otras otro otros para pero poco por porque pronto puede pues que qué quien
quienes quién quiénes se ser si sido siempre sobre solo somos son soy su sus sí sólo
también tampoco tan te tenemos tener tengo ti tiene tienen toda todas todo todos tras
tu tus tú un una unas uno unos usted ustedes va vaya vamos ven vez voy y ya yo él
""".split()

# Invisible marks around the current chunk in glued match text.
MARK_PREV = "⁠"
MARK_NEXT = "​"


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once per row, however often the optimizer copies it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Every letter whose canonical decomposition is one base character plus combining marks."""
    src, dst = [], []
    for code in range(0xC0, sys.maxunicode + 1):
        ch = chr(code)
        if unicodedata.category(ch)[0] != "L" or ch != ch.lower():
            continue
        base = [c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != ch:
            src.append(ch)
            dst.append(base[0])
    return "".join(src), "".join(dst)


def strip_accents(c: Column) -> Column:
    """Lower-case and drop diacritics (so n-tilde becomes n)."""
    src, dst = _accent_table()
    return F.regexp_replace(F.translate(F.lower(c), src, dst), r"\p{Mn}+", "")


def phonetic_of(plain: Column) -> Column:
    """Spanish sound key of an already accent-free text; rules apply in this order."""
    t = F.regexp_replace(plain, rf"{NOT_BEFORE}h", "")
    for old, new in PHONETIC_RULES:
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def phonetic_es(c: Column) -> Column:
    return phonetic_of(strip_accents(c))


def normalise(c: Column, phonetic: Column) -> Column:
    return F.when(phonetic, phonetic_es(c)).otherwise(strip_accents(c))


def fold_word(c: Column) -> Column:
    """Word key for spot comparison: lower-case, fixed accent table, letters and digits only."""
    return F.regexp_replace(F.translate(F.lower(c), FOLD_FROM, FOLD_TO), r"[^\p{L}\p{N}]", "")


def quote(c: Column) -> Column:
    """Regex-literal form of a column."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def bounded_by_words(text: Column, needle: Column) -> Column:
    """Needle present with no word character on either side; plain containment is tested first."""
    pattern = F.concat(F.lit(NOT_BEFORE), quote(needle), F.lit(NOT_AFTER))
    return F.contains(text, needle) & F.regexp_like(text, pattern)


def keyword_hit(norm_text: Column, norm_kw: Column, whole_word: Column) -> Column:
    """Keyword predicate over texts normalised the same way; an empty keyword never matches."""
    return (
        (norm_kw != "")
        & F.contains(norm_text, norm_kw)
        & (~whole_word | bounded_by_words(norm_text, norm_kw))
    )


def words(c: Column) -> Column:
    """Whitespace tokens without empties; NULL text has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), WHITESPACE), lambda w: w != "")


def aligned_norm_text(tokens: Column, phonetic: Column) -> Column:
    """Normalised tokens joined by single spaces; a token may normalise to nothing but keeps its place."""
    return normalise(F.array_join(tokens, " "), phonetic)


def aligned_norm_words(tokens: Column, phonetic: Column) -> Column:
    """Normalised form of each token, index-aligned."""
    joined = aligned_norm_text(tokens, phonetic)
    return let(
        joined,
        lambda j: F.when(j == "", F.array().cast("array<string>")).otherwise(F.split(j, " ")),
    )


def fold_words(tokens: Column) -> Column:
    """fold_word of every token, index-aligned, in one pass over the joined text."""
    folded = F.translate(F.lower(F.array_join(tokens, " ")), FOLD_FROM, FOLD_TO)
    return F.split(F.regexp_replace(folded, r"[^\p{L}\p{N} ]+", ""), " ")


def content_words(c: Column) -> Column:
    """array<struct<orig,norm>> of tokens that keep at least one letter or digit when folded."""

    def of(ws: Column) -> Column:
        pairs = F.arrays_zip(ws.alias("orig"), fold_words(ws).alias("norm"))
        return F.filter(pairs, lambda p: p["norm"] != "")

    return let(words(c), of)


def shingles(norm_words: Column, n: int = 5) -> Column:
    """Distinct n-word shingles; a shorter text is one shingle, an empty text none."""

    def of(ws: Column) -> Column:
        full = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(ws) - (n - 1), F.lit(1))),
            lambda i: F.array_join(F.slice(ws, i, n), " "),
        )
        return F.when(F.size(ws) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(full))

    return let(norm_words, of)


def _window_starts(n: Column, k: Column) -> Column:
    return F.when((k > 0) & (k <= n), F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)))).otherwise(
        F.array().cast("array<int>")
    )


def keyword_positions(norm_words: Column, kw_words: Column) -> Column:
    """Every word offset where each keyword word is a substring of the word it lines up with."""

    def of(ws: Column, kw: Column) -> Column:
        last = F.greatest(F.size(kw) - 1, F.lit(0))
        return F.filter(
            _window_starts(F.size(ws), F.size(kw)),
            lambda i: F.forall(
                F.sequence(F.lit(0), last),
                lambda j: (F.get(kw, j) != "") & F.contains(F.get(ws, i + j), F.get(kw, j)),
            ),
        )

    return let(norm_words, lambda ws: let(kw_words, lambda kw: of(ws, kw)))


def locate_keyword(norm_text: Column, norm_kw: Column, whole_word: Column) -> Column:
    """First word index of the keyword, or NULL; both sides come from aligned_norm_text.

    One word: substring of a token, or word-bounded inside it. Phrase: consecutive tokens, which in
    whole-word mode must be equal to the keyword's words.
    """

    def by_word(ws: Column, kw: Column) -> Column:
        k = F.size(kw)
        word = F.get(kw, F.lit(0))

        def at(i: Column) -> Column:
            single = bounded_by_words(F.get(ws, i), word)
            exact = F.slice(ws, i + 1, k) == kw
            loose = F.forall(
                F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))),
                lambda j: F.contains(F.get(ws, i + j), F.get(kw, j)),
            )
            return F.when(k == 1, single).when(whole_word, exact).otherwise(loose)

        return F.get(F.filter(_window_starts(F.size(ws), k), at), F.lit(0))

    def of(text: Column) -> Column:
        # A keyword without a space lies in the token that follows the spaces before it.
        before = F.call_function("substring_index", text, norm_kw, F.lit(1))
        spaces = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))
        words_of = let(F.split(text, " "), lambda ws: let(F.split(norm_kw, " "), lambda kw: by_word(ws, kw)))
        return (
            F.when((text == "") | (norm_kw == ""), F.lit(None).cast("int"))
            .when(~whole_word & ~F.contains(norm_kw, F.lit(" ")), F.when(F.contains(text, norm_kw), spaces))
            .otherwise(words_of)
        )

    return let(norm_text, of)


def center_words(tokens: Column, idx: Column, side: int = 50) -> Column:
    """Tokens within `side` words of the index (NULL means 0), with ellipses where text was cut."""

    def of(ws: Column, at: Column) -> Column:
        n = F.size(ws)
        start = F.greatest(at - side, F.lit(0))
        end = F.least(at + side + 1, n)
        kept = F.filter(
            F.slice(ws, start + 1, F.greatest(end - start, F.lit(0))),
            lambda w: ~w.isin(MARK_PREV, MARK_NEXT),
        )
        return F.when(n == 0, F.lit("")).otherwise(
            F.concat(
                F.when(start > 0, F.lit("… ")).otherwise(F.lit("")),
                F.array_join(kept, " "),
                F.when(end < n, F.lit(" …")).otherwise(F.lit("")),
            )
        )

    return let(tokens, lambda ws: let(F.coalesce(idx, F.lit(0)), lambda at: of(ws, at)))


def center_text(c: Column, idx: Column, side: int = 50) -> Column:
    return center_words(words(c), idx, side)


def glue_context(prev: Column, cur: Column, nxt: Column) -> Column:
    """Previous, current and next chunk in one text, the current one between invisible marks."""

    def spoken(c: Column) -> Column:
        return F.when(c.isNotNull() & ~c.isin("", SILENCE), c)

    return F.concat(
        F.coalesce(F.concat(spoken(prev), F.lit(f" {MARK_PREV} ")), F.lit("")),
        cur,
        F.coalesce(F.concat(F.lit(f" {MARK_NEXT} "), spoken(nxt)), F.lit("")),
    )


def current_chunk_span(glued: Column) -> Column:
    """The chunk between the invisible marks of a glued text."""
    after = F.when(
        F.contains(glued, F.lit(MARK_PREV)),
        F.get(F.split(glued, MARK_PREV, 2), F.lit(1)),
    ).otherwise(glued)
    return F.regexp_replace(F.substring_index(after, MARK_NEXT, 1), EDGE_SPACE, "")


def html_escape(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


@lru_cache(maxsize=1)
def _letter_classes() -> dict[str, str]:
    """Regex class of each plain Latin letter and its accented forms."""
    forms: dict[str, str] = {}
    for accented, base in zip(*_accent_table()):
        if "a" <= base <= "z":
            forms[base] = forms.get(base, base) + accented
    return {base: f"[{chars}]" for base, chars in forms.items()}


def _accent_blind(needle: Column) -> Column:
    """Regex of a literal in which every letter also stands for its accented forms."""
    classes = F.create_map(*[F.lit(x) for pair in _letter_classes().items() for x in pair])
    return F.array_join(
        F.transform(
            F.split(strip_accents(needle), ""),
            lambda ch: F.coalesce(F.try_element_at(classes, ch), quote(ch)),
        ),
        "",
    )


def highlight(
    c: Column, keyword: Column, whole_word: Column, accent_insensitive: bool = False
) -> Column:
    """HTML-escape and wrap case-insensitive hits in <mark>; accents must agree unless told otherwise."""
    kw = html_escape(keyword)
    kw = _accent_blind(kw) if accent_insensitive else quote(kw)
    bounded = F.concat(F.lit(f"(?iu)({NOT_BEFORE}"), kw, F.lit(f"{NOT_AFTER})"))
    loose = F.concat(F.lit("(?iu)("), kw, F.lit(")"))
    marked = F.regexp_replace(
        html_escape(c), F.when(whole_word, bounded).otherwise(loose), F.lit("<mark>$1</mark>")
    )
    return F.when(c.isNull(), F.lit("")).when(
        F.coalesce(keyword, F.lit("")) == "", html_escape(c)
    ).otherwise(marked)


def highlight_phonetic(c: Column, keyword: Column, whole_word: Column) -> Column:
    """Mark every run of words that sounds like the keyword, keeping the original spacing."""
    sounds = F.lit(True)

    def hit(norm: Column, kw: Column, i: Column) -> Column:
        return F.forall(
            F.sequence(F.lit(0), F.greatest(F.size(kw) - 1, F.lit(0))),
            lambda j: F.contains(F.get(norm, i + j), F.get(kw, j))
            & (~whole_word | bounded_by_words(F.get(norm, i + j), F.get(kw, j))),
        )

    def render(marked: Column, part: Column, pos: Column, lead: Column) -> Column:
        word = (pos - lead) % 2 == 0
        inside = F.array_contains(marked, F.floor((pos - lead) / 2).cast("int"))
        return F.when(
            (pos >= lead) & word & inside,
            F.concat(F.lit("<mark>"), html_escape(part), F.lit("</mark>")),
        ).otherwise(html_escape(part))

    def of(norm: Column, kw: Column) -> Column:
        starts = F.filter(_window_starts(F.size(norm), F.size(kw)), lambda i: hit(norm, kw, i))
        covered = F.flatten(F.transform(starts, lambda s: F.sequence(s, s + F.size(kw) - 1)))
        parts = F.split(c, r"(?U)(?<=\s)(?=\S)|(?<=\S)(?=\s)")
        lead = F.when(F.regexp_like(c, F.lit(r"(?U)^\s")), 1).otherwise(0)
        return let(
            covered,
            lambda marked: F.array_join(
                F.transform(parts, lambda part, pos: render(marked, part, pos, lead)), ""
            ),
        )

    marked_text = let(
        aligned_norm_words(words(c), sounds),
        lambda norm: let(aligned_norm_words(words(keyword), sounds), lambda kw: of(norm, kw)),
    )
    return F.when(c.isNull(), F.lit("")).when(
        F.coalesce(keyword, F.lit("")) == "", html_escape(c)
    ).otherwise(marked_text)


def is_silent_or_noise(c: Column) -> Column:
    """Empty, punctuation only, or one of the recogniser's no-speech markers."""
    bare = F.lower(F.trim(F.regexp_replace(c, EDGE_SPACE, ""), F.lit(NOISE_EDGE)))
    return c.isNull() | (bare == "") | bare.isin(NOISE_MARKERS)


def is_speech(c: Column) -> Column:
    return c.isNotNull() & ~c.isin("", SILENCE)


def question_terms(c: Column, max_terms: int = 6, stop_words: list[str] | None = None) -> Column:
    """Up to six significant words of a question, in order; empty when none is significant."""
    stop = F.array(*[F.lit(w) for w in (STOP_WORDS if stop_words is None else stop_words)])
    tokens = F.regexp_extract_all(c, F.lit("([A-Za-zÁÉÍÓÚÑáéíóúñü0-9]+)"), F.lit(1))
    keep = F.filter(tokens, lambda t: (F.length(t) > 2) & ~F.array_contains(stop, F.lower(t)))
    return F.slice(keep, 1, max_terms)


def question_keywords(c: Column) -> Column:
    """The prefix query of a question as one line; the question itself if nothing is left."""
    terms = question_terms(c)
    prefixes = F.transform(terms, lambda t: F.concat(t, F.lit("*")))
    return F.when(F.size(terms) == 0, c).otherwise(F.array_join(prefixes, " OR "))


def index_terms(c: Column) -> Column:
    """Search tokens: runs of letters and digits, accent-free and lower-case."""
    return F.regexp_extract_all(strip_accents(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def split_keywords(c: Column) -> Column:
    """Keyword box contents to a list: newline or comma separated, trimmed, no empties."""
    parts = F.transform(F.split(c, r"[\n,]+"), lambda p: F.regexp_replace(p, EDGE_SPACE, ""))
    return F.filter(parts, lambda p: p != "")


def parse_media_types(c: Column) -> Column:
    """CSV of media kinds to a set; empty means television and radio."""
    parts = F.array_distinct(
        F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")
    )
    return F.when(F.coalesce(c, F.lit("")) == "", F.array(F.lit("tv"), F.lit("radio"))).otherwise(
        parts
    )


def english_hits(c: Column) -> Column:
    pattern = rf"(?i){NOT_BEFORE}(?:{'|'.join(ENGLISH_WORDS)}){NOT_AFTER}"
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(pattern))


def code_switch_ratio(c: Column) -> Column:
    return english_hits(c) / F.greatest(F.size(words(c)), F.lit(1))


def safe_name(c: Column) -> Column:
    """Folder-safe form: anything but letters and digits becomes an underscore."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "_")


def sheet_name(c: Column, fallback: Column) -> Column:
    """Spreadsheet-safe form: forbidden characters dropped, 31 characters at most."""
    cut = F.substring(F.regexp_replace(c, r"[\\/*?:\[\]]", ""), 1, 31)
    return F.when(cut == "", fallback).otherwise(cut)


def clean_news_title(title: Column, outlet: Column) -> Column:
    """Headline without its ' - outlet' tail."""
    tail = F.concat(F.lit(" - "), outlet)
    cut = F.substring(title, F.lit(1), F.length(title) - F.length(tail))
    return F.when((F.coalesce(outlet, F.lit("")) != "") & F.endswith(title, tail), cut).otherwise(
        title
    )


def clean_guide_title(c: Column) -> Column:
    """Programme title with single spaces and without a leading one-letter tag."""
    return F.regexp_replace(F.array_join(words(c), " "), r"^\[[A-Z]\]\s*", "")


def context_line(rank: Column, channel: Column, ts: Column, text: Column) -> Column:
    return F.format_string(
        "[%d] [%s, %s] %s", rank, channel, F.date_format(ts, "HH:mm:ss"), text
    )


def raw_stream_url(c: Column) -> Column:
    """Stream address without its query, asking for the untouched profile."""
    return F.concat(F.substring_index(c, "?", 1), F.lit("?profile=pass"))


def mask_user_info(c: Column) -> Column:
    """Address with any user:password part removed."""
    return F.regexp_replace(c, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://)[^/@]*@", "$1")


def header_name(c: Column) -> Column:
    return F.trim(F.get(F.split(c, ":", 2), F.lit(0)))


def header_value(c: Column) -> Column:
    return F.trim(F.coalesce(F.get(F.split(c, ":", 2), F.lit(1)), F.lit("")))
