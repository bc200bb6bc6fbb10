import random
import re
from collections import Counter

import odd
import pytest
from mediawatch.llm import quality
from pyspark.sql import functions as F

ODD = [
    "a a a a", "a b c a b c", "a b c x a b", "x\ny\nx\n\n \t\nx \n", "uno\xa0dos tres cuatro", "# * $% &|<> \x0b\x0c\r a",
    "- one\n- two\n", "and so on...\nmore…\r\n", "LOUD WORDS A ÉÉ x", "1 2 3 4a", "word " * 49, "word " * 50, " ".join(f"w{i}" for i in range(60)),
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + s for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for s in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    earlier = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(len(w) for w in words), sum(c in "#*$%&|<>" for c in text), earlier, len(hit)


def test_measures_equal_a_plain_count(spark):
    draw = random.Random(5)
    made = [" ".join(draw.choice("abc") for _ in range(draw.randrange(40))) for _ in range(60)]
    texts = odd.TEXTS + ODD + made + ["\n".join(draw.choice(["x", "y z", " ", ""]) for _ in range(9)) for _ in range(20)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_words string").repartition(3)
    got = {r["doc_id"]: r for r in quality.judged(df).collect()}
    for i, text, _ in rows:
        r, want = got[i], plain(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_odd_documents_have_one_row_each(spark):
    got = quality.judged(odd.documents(spark)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in odd.documents(spark).collect())
    assert {r["n_words"] for r in got if r["doc_id"] in (0, 1, 2)} == {0} and not any(r["kept"] for r in got if r["n_words"] < 50)
    assert quality.judged(odd.empty(spark)).count() == 0
    assert {r["regained"] for r in quality.ablations(quality.ledger(odd.empty(spark)), quality.POLICIES.values()).collect()} == {0}


def verdict(policy, failed):
    reject, suspect = policy.masks
    return not failed & reject and bin(failed & suspect).count("1") <= policy.tolerated


@pytest.mark.parametrize("version", quality.POLICIES)
def test_policies_and_ablations_equal_a_loop_over_documents(spark, version):
    draw, policy = random.Random(7), quality.POLICIES[version]
    every = (1 << len(quality.RULES)) - 1
    bits = [draw.getrandbits(len(quality.RULES)) & draw.getrandbits(len(quality.RULES)) & draw.getrandbits(len(quality.RULES)) for _ in range(400)]
    rows = [(i, b, draw.randrange(90)) for i, b in enumerate([*bits, 0, every])]
    df = spark.createDataFrame(rows, "doc_id int, failed long, n_words long")
    kept = {r[0]: (r[1], r[2]) for r in df.select("doc_id", policy.keeps(F.col("failed")), quality.decisive(policy, F.col("failed"))).collect()}
    for i, b, _ in rows:
        alone = [n for n in policy.rules if b & quality.BITS[n] and verdict(policy, b & ~quality.BITS[n])]
        assert kept[i] == (verdict(policy, b), alone[0] if len(alone) == 1 and not verdict(policy, b) else None)
    for r in quality.ablations(df, [policy]).collect():
        bit = quality.BITS[r["rule"]]
        fails = [(b, w) for _, b, w in rows if b & bit]
        back = [w for b, w in fails if not verdict(policy, b) and verdict(policy, b & ~bit)]
        always, ever = every & ~bit, 0
        for b, _ in fails:
            always, ever = always & b, ever | (b & ~bit)
        assert (r["failing"], r["regained"], r["regained_words"]) == (len(fails), len(back), sum(back))
        assert (r["always_with"], r["ever_with"]) == (always, ever)
        assert r["kept"] + r["rejected"] == len(rows) and r["kept"] == sum(verdict(policy, b) for _, b, _ in rows)


def test_a_clean_text_is_kept_and_each_fault_has_its_bit(spark):
    draw = random.Random(2)
    words = ["river", "stone", "quiet", "morning", "over", "the", "field", "walks", "another", "village", "slowly", "and"]
    clean = " ".join(draw.choice(words) + draw.choice(["", "", ","]) + str(draw.randrange(9) if draw.random() < 0.03 else "") for _ in range(400))
    bad = {
        "few_words": "only these few words", "repeated_runs": "buy this now " * 40, "short_words": "a b " * 200 + clean[:50],
        "symbols": clean.replace(" ", " #", 100), "few_letters": " ".join(f"{w} {i}" for i, w in enumerate(clean.split())),
        "repeated_lines": "\n".join([clean[:60]] * 5 + [clean[200 + 90 * i : 290 + 90 * i] for i in range(4)]), "capitals": clean.upper(),
    }
    df = spark.createDataFrame([("clean", clean), *bad.items()], "doc_id string, text string")
    got = {r["doc_id"]: r for r in quality.judged(df).collect()}
    assert got["clean"]["kept"] and got["clean"]["failed"] == 0
    for name in bad:
        assert got[name]["failed"] & quality.BITS[name] and not got[name]["kept"], name


def test_each_rule_has_a_bit_and_no_policy_drops_the_base():
    assert list(quality.BITS.values()) == [1 << i for i in range(len(quality.RULES))] and len(quality.RULES) < 63
    assert all(p.masks[0] & quality.BASE == quality.BASE for p in quality.POLICIES.values())
