import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from mediawatch.functions import text as T
from mediawatch.functions.marking import longest_shared_run, mark_fragment


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def lit(s):
    return F.lit(s)


def py_plain(s):
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(c) != "Mn")


def py_sound(s):
    t = re.sub(r"\bh", "", py_plain(s))
    for old, new in T.PHONETIC_RULES:
        t = t.replace(old, new)
    return t


@pytest.mark.parametrize(
    "text,kw,whole,expected",
    [
        ("diálogo mediodía", "día", False, True),
        ("diálogo mediodía", "día", True, False),
        ("El día.", "dia", True, True),
        ("ødia", "dia", True, False),
        ("anything", "", False, False),
        ("a+b (c) x", "(c)", True, True),
    ],
)
def test_keyword_hit(spark, text, kw, whole, expected):
    plain = T.strip_accents
    assert one(spark, T.keyword_hit(plain(lit(text)), plain(lit(kw)), F.lit(whole))) is expected


def test_accents_and_sounds_agree_with_python(spark):
    samples = [
        "AÑO", "hoy", "vaca", "llave", "queso", "cena", "gente", "zapato", "rock", "taxi", "jacques",
        "Çelik Ḧöhe ǘ Ảnh Ёлка Ångström ﬁ ß ø éx", "hh h-h _h Hijo ququi cce", "日本 ガギ 한국",
    ]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = df.select("s", T.strip_accents(F.col("s")).alias("p"), T.phonetic_es(F.col("s")).alias("q")).collect()
    for r in got:
        if "한" not in r["s"]:  # syllable blocks decompose to several letters, alike on both sides
            assert r["p"] == py_plain(r["s"])
            assert r["q"] == py_sound(r["s"])


@pytest.mark.parametrize(
    "word,sound",
    list(zip(
        "hoy vaca llave queso cena gente zapato rock taxi jacques".split(),
        "oy baca yabe keso sena jente sapato rok taksi jakes".split(),
    )),
)
def test_phonetic_rules(spark, word, sound):
    assert one(spark, T.phonetic_es(lit(word))) == sound


def py_locate(text, kw, phonetic, whole):
    norm = py_sound if phonetic else py_plain
    ws, ks = [norm(w) for w in text.split()], [norm(w) for w in kw.split()]
    for i in range(len(ws) - len(ks) + 1 if ks else 0):
        win = ws[i : i + len(ks)]
        if len(ks) == 1 and whole:
            ok = re.search(rf"(?<!\w){re.escape(ks[0])}(?!\w)", win[0])
        elif whole:
            ok = win == ks
        else:
            ok = all(k in w for k, w in zip(ks, win))
        if ok:
            return i
    return None


def test_locate_keyword(spark):
    cases = [
        ("Uno  dos\ttres DÍA.", "dia", False, True),
        ("mediodía día", "dia", False, False),
        ("mediodía día", "dia", False, True),
        ("habla la casa blanca.", "casa blanca", False, True),
        ("habla la casa blanca.", "casa blanca", False, False),
        ("h hola vaca", "baca", True, False),
        ("", "x", False, False),
        ("a b c", "z", False, False),
    ]
    for text, kw, ph, whole in cases:
        got = one(
            spark,
            T.locate_keyword(
                T.aligned_norm_text(T.words(lit(text)), F.lit(ph)),
                T.aligned_norm_text(T.words(lit(kw)), F.lit(ph)),
                F.lit(whole),
            ),
        )
        assert got == py_locate(text, kw, ph, whole), (text, kw, ph, whole)


def test_phrase_at_the_end_with_full_stop_is_not_located(spark):
    norm = T.aligned_norm_text(T.words(lit("habla la casa blanca.")), F.lit(False))
    assert one(spark, T.locate_keyword(norm, lit("casa blanca"), F.lit(True))) is None


def test_shingles(spark):
    def sh(s):
        return one(spark, T.shingles(T.words(lit(s))))

    assert sh("a b c d e f") == ["a b c d e", "b c d e f"]
    assert sh("a b") == ["a b"]
    assert sh("") == []
    assert sh("a a a a a a") == ["a a a a a"]


def test_keyword_positions(spark):
    ws = F.array(*[lit(w) for w in "el dia otra dia tarde".split()])
    assert one(spark, T.keyword_positions(ws, F.array(lit("dia")))) == [1, 3]
    assert one(spark, T.keyword_positions(ws, F.array(lit("dia"), lit("tar")))) == [3]
    assert one(spark, T.keyword_positions(ws, F.array().cast("array<string>"))) == []
    assert one(spark, T.keyword_positions(ws, F.array(lit("")))) == []


def test_center_text(spark):
    assert one(spark, T.center_text(lit("a b c d e"), F.lit(2), 1)) == "… b c d …"
    assert one(spark, T.center_text(lit("a b c"), F.lit(None).cast("int"), 1)) == "a b …"
    assert one(spark, T.center_text(lit(""), F.lit(0), 1)) == ""


def test_glue_and_span(spark):
    glued = T.glue_context(lit("p q"), lit("c d"), lit("n"))
    assert one(spark, glued) == "p q ⁠ c d ​ n"
    assert one(spark, T.current_chunk_span(glued)) == "c d"
    assert one(spark, T.current_chunk_span(T.glue_context(lit("[~]"), lit("c"), lit(None)))) == "c"


def test_highlight(spark):
    def hl(text, kw, whole=False):
        return one(spark, T.highlight(lit(text), lit(kw), F.lit(whole)))

    assert hl("a <b> DÍA día dia", "día") == "a &lt;b&gt; <mark>DÍA</mark> <mark>día</mark> dia"
    assert hl("diálogo día", "día", True) == "diálogo <mark>día</mark>"
    assert hl("x $1 \\ y", "$1") == "x <mark>$1</mark> \\ y"
    assert hl("A & B", "") == "A &amp; B"
    blind = T.highlight(lit("DIA día (díà) medio"), lit("dia"), F.lit(False), accent_insensitive=True)
    assert one(spark, blind) == "<mark>DIA</mark> <mark>día</mark> (<mark>díà</mark>) medio"
    ph = T.highlight_phonetic(lit(" una  Vaca y baca"), lit("vaca"), F.lit(False))
    assert one(spark, ph) == " una  <mark>Vaca</mark> y <mark>baca</mark>"
    two = T.highlight_phonetic(lit("la bella vaca ve"), lit("vella baca"), F.lit(True))
    assert one(spark, two) == "la <mark>bella</mark> <mark>vaca</mark> ve"


def test_mark_fragment(spark):
    frag = "compre ahora el nuevo producto de limpieza para toda la casa"
    cases = [
        ("¡Hola! Compre, AHORA el nuevo producto de limpieza para toda la casa. Fin", frag,
         "¡Hola! <mark>Compre, AHORA el nuevo producto de limpieza para toda la casa</mark>. Fin"),
        ("antes compre ahora el nuevo producto de otra marca", frag,
         "antes <mark>compre ahora el nuevo producto de</mark> otra marca"),
        ("nada que ver aquí, el nuevo", frag, "nada que ver aquí, el nuevo"),
        ("a < b", None, "a &lt; b"),
        (None, frag, ""),
        ("", frag, ""),
        ("x compre ahora el nuevo y", "compre ahora el nuevo", "x <mark>compre ahora el nuevo</mark> y"),
        ("Sól", "sol", "<mark>Sól</mark>"),
        ("<sol> sol & sol", "sol sol", "&lt;<mark>sol&gt; sol</mark> &amp; sol"),
    ]
    df = spark.createDataFrame([(i, t, f) for i, (t, f, _) in enumerate(cases)], "i int, t string, f string")
    got = df.select("i", mark_fragment(F.col("t"), F.col("f")).alias("m")).orderBy("i").collect()
    assert [r["m"] for r in got] == [c[2] for c in cases]


def test_longest_shared_run_against_every_run(spark):
    rng = random.Random(4)
    rows = [([rng.choice("abc") for _ in range(rng.randrange(9))], [rng.choice("abc") for _ in range(rng.randrange(7))]) for _ in range(80)]

    def plain(a, b):
        held = {tuple(b[j : j + n]) for n in range(1, len(b) + 1) for j in range(len(b) - n + 1)}
        runs = [(n, -i) for i in range(len(a)) for n in range(1, len(a) - i + 1) if tuple(a[i : i + n]) in held]
        n, i = max(runs, default=(0, 0))
        return (n, -i + n - 1)

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<string>, b array<string>")
    got = df.select("i", longest_shared_run(F.col("a"), F.col("b")).alias("r")).orderBy("i").collect()
    assert [tuple(r["r"]) for r in got] == [plain(*r) for r in rows]


def test_noise_questions_and_lists(spark):
    for text, quiet in [("", True), (" ...", True), ("[Música].", True), ("hola", False), (None, True)]:
        assert one(spark, T.is_silent_or_noise(F.lit(text).cast("string"))) is quiet
    assert one(spark, T.question_keywords(lit("¿Qué dijo el presidente sobre Jalisco?"))) == "dijo* OR presidente* OR Jalisco*"
    assert one(spark, T.question_keywords(lit("el la los de"))) == "el la los de"
    assert one(spark, T.split_keywords(lit(" a, b\n\n,c "))) == ["a", "b", "c"]
    assert sorted(one(spark, T.parse_media_types(lit("")))) == ["radio", "tv"]
    assert one(spark, T.parse_media_types(lit("tv, news"))) == ["tv", "news"]
    assert one(spark, T.code_switch_ratio(lit("the end of theme"))) == 0.5


def test_names_and_addresses(spark):
    assert one(spark, T.safe_name(lit("N+ Ñ1"))) == "N__Ñ1"
    assert one(spark, T.sheet_name(lit("[a]/b" + "c" * 40), lit("z"))) == "ab" + "c" * 29
    assert one(spark, T.sheet_name(lit("[]"), lit("z"))) == "z"
    assert one(spark, T.clean_news_title(lit("Big - News - Paper"), lit("Paper"))) == "Big - News"
    assert one(spark, T.clean_guide_title(lit("[M]  Un   título "))) == "Un título"
    assert one(spark, T.raw_stream_url(lit("http://h/s?a=1&b=2"))) == "http://h/s?profile=pass"
    assert one(spark, T.mask_user_info(lit("http://u:p@h:1/s"))) == "http://h:1/s"
    assert one(spark, T.header_value(lit("Origin: https://x.y"))) == "https://x.y"


def test_shingles_are_counted_inside_the_row(spark, tmp_path):
    from mediawatch.plans import texts

    rows = [(1, "a b c d e f a b c d e"), (1, "z y"), (2, None), (3, "...")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = texts.text_shingles(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 7, "a b c d e", "z y")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "array_min" in plan and "partial_count" not in plan
