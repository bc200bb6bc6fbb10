import base64
import hashlib
import random
from collections import Counter

import odd
import public_tokenizers
import pytest
import sentencepiece
from mediawatch.llm import alignment
from mediawatch.llm.common import stored
from tokenizers import Tokenizer

TEXTS = [
    "Hello world", "hello  hello\nworld", "naïve café — ñandú 東京 🙂🙂", "a▁b", "▁", "<|endoftext|> and <s>x</s> <unk> <0x41>", "a\x00b", " leading",
    "trailing \t ", "é ﬁ Ǆ", "x" * 3000, "١٢٣ тест", "  ﻿", "word word word word", "�",
]


def level(c):
    """Byte of one character of the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return ord(c) if ord(c) in plain else rest[ord(c) - 256]


def brute(texts):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = []
    for text in texts:
        a = b = []
        if text:
            a = [(i, bytes(map(level, whole.id_to_token(i)))) for i in whole.encode(" " + text, add_special_tokens=False).ids]
            b = [
                (i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode())
                for i, p in ((i, pieces.id_to_piece(i)) for i in pieces.encode(text))
            ]
            if not b"".join(x for _, x in a) == (" " + text).encode() == b"".join(x for _, x in b):
                a = b = []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]] if len(a) < 800 else None
        ends = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups = [
            "|".join(",".join(str(x[2]) for x in side if low < x[1] <= high) for side in spans) for low, high in zip([0, *ends], ends)
        ]
        docs.append((len(a), len(b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    held = Counter(p for d in docs for p in set(d[3] or []))
    top = Counter()
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    return [
        (n_a, n_b, n_g, len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), sha)
        for n_a, n_b, n_g, links, sha in docs
    ]


def got_of(spark, rows, **how):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n_a int, _row string").repartition(3)
    return [tuple(r) for r in alignment.token_alignment(df, **how).orderBy("doc_id").collect()]


def test_alignment_equals_a_plain_double_loop(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_TEXTS", 4)
    draw = random.Random(3)
    alphabet = ["the ", "The", "re", "é", "ñ", " ", "\n", "東", "🙂", "12", "ing", "<", "|", "▁", "\t"]
    made = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(1, 60))) for _ in range(40)]
    texts = [None, "", *TEXTS, *made, TEXTS[0], TEXTS[0]]
    got = got_of(spark, list(enumerate(texts)))
    assert [r[1:] for r in got] == brute(texts)
    assert got[0][1:] == got[1][1:] == (0, 0, 0, 0, 0, 0, "")


@pytest.mark.parametrize("common", [1, 5, 50])
def test_common_and_rare_pairs_give_the_same_counts(spark, common):
    texts = TEXTS + [f"some words {i} and the" for i in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    done = alignment.with_pair_counts(stored(alignment.aligned(rows), "aligned"), common).orderBy("doc_id").collect()
    want = brute(texts)
    assert [(r["n_best"], r["count_sum"]) for r in done] == [w[4:6] for w in want]


def test_odd_documents(spark):
    docs = odd.documents(spark)
    got = alignment.token_alignment(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    long = [r for r in got if r["doc_id"] in (7, 8)]
    assert all(r["n_a"] > 30_000 and r["n_links"] >= max(r["n_a"], r["n_b"]) for r in long)
    assert alignment.token_alignment(odd.empty(spark)).count() == 0


def test_the_rank_file_holds_the_entries_of_the_tokenizer_file():
    tokens, whole = alignment.Tokens(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(bytes(map(level, whole.id_to_token(i))) == x for i, x in enumerate(tokens.a_bytes))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        assert sum(1 for line in f if base64.b64decode(line.split()[0])) == len(tokens.a_bytes)
