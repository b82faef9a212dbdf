import random

import pytest

from weftwork.llm.tokenizer import ByteBPE, count_tokens, encode_corpus, vocabulary_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    truth = tokenizers.Tokenizer.from_file(vocabulary_path())
    truth.encode_special_tokens = True
    return ByteBPE(vocabulary_path(), memo_entries=50), truth


def test_matches_merges_on_random_text(pair):
    ours, truth = pair
    rng = random.Random(3)
    signs = [chr(c) for c in range(0x180)] + list("  　 \x1c अि😀̀‍﻿") + ["'s", "'ll", " ", "  ", "\n", "\r\n", "the", "ing", "<|endoftext|>"] * 8
    texts = ["".join(rng.choices(signs, k=rng.randrange(1, 60))) for _ in range(4000)]
    for text, want in zip(texts, truth.encode_batch(texts, add_special_tokens=False)):
        assert ours.encode(text) == want.ids, ascii(text)


@pytest.mark.parametrize("text", ["a" * 20000, "ab" * 9000, "!" * 4000 + "é" * 4000, "x y" * 5000, " " * 3000])
def test_very_long_texts(pair, text):
    ours, truth = pair
    assert ours.encode(text) == truth.encode(text, add_special_tokens=False).ids


def test_null_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " ", "x"), (3, " ", "x"), (None, "Hi there", "y")], "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in encode_corpus(df).collect()))
    assert got == [(0, [17250, 612]), (1, []), (2, []), (3, [220]), (3, [220])]
    assert encode_corpus(df.limit(0)).count() == 0
    assert sorted(r["n_tokens"] for r in count_tokens(df, ["doc_id"]).collect()) == [0, 0, 1, 1, 2]
