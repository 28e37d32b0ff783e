"""Encoding against the reference implementation of the tokenizer."""

import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from aislewise.llm import bpe
from aislewise.llm.encode import default_vocabulary, encode_corpus


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary.load(default_vocabulary()))


@pytest.fixture(scope="module")
def truth():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def check(encoder, truth, texts):
    ids, offsets = encoder.encode(texts)
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == truth.encode(text or "", add_special_tokens=False).ids, repr(text)


HARD = [
    "", None, " ", "\n\n\nx", "  x  y ", "it's we'll 'tis ''s", "<|endoftext|>", "naïve café ½ ²³ ①", "你好，世界。", "👩🏽‍⚕️ ok", "a​b﻿", "\x00\x1b[31m", "١٢٣ ४५", "𝓻𝐛", "a" * 5000, "!" * 3001 + "'s",
    " \n" * 700, "ab" * 3000, "中" * 3000, "\t\r\n  x y", "don't stop—now…", "éê" * 50, "x" * 49 + " " + "é" * 40,
]


def test_hard_texts(encoder, truth):
    check(encoder, truth, HARD)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("ab '\n1é", max_size=200)), max_size=5))
def test_any_text(encoder, truth, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    check(encoder, truth, texts)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_words_are_those_of_the_pattern(text):
    assert bpe.split_words(text) == regex.findall(bpe.PATTERN, text)


def test_pairs_against_exact_merging(encoder):
    import numpy as np

    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 50_256, (2, 3000))
    good = encoder.compatible(a, b)
    text = {i: t for t, i in Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).get_vocab().items()}
    byte_of = {c: i for i, c in enumerate(bpe._byte_letters())}
    for x, y, ok in zip(a.tolist(), b.tolist(), good.tolist(), strict=True):
        data = bytes(byte_of[c] for c in text[x] + text[y])
        assert (encoder.merge(data) == [x, y]) == ok


def test_cache_starts_anew(truth, monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE_WORDS", 20)
    small = bpe.Encoder(bpe.Vocabulary.load(default_vocabulary()))
    for part in range(4):
        check(small, truth, [" ".join(f"word{i}x{part}" for i in range(30))])


def test_corpus(spark, truth):
    rows = [(i, t, "clash") for i, t in enumerate(HARD)] + [(0, "again", "clash"), (None, "no id", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids string")
    got = sorted((str(r["doc_id"]), list(r["ids"])) for r in encode_corpus(df).collect())
    assert got == sorted((str(i), truth.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)
    assert encode_corpus(df.limit(0)).count() == 0
