"""Encoding against the tokenizers library, text by text."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import bpe
from sparkloom.llm.queries import op2_bpe, tokenizer_path

HARD = [
    "", " ", "a", "aaaaaaaaaaa aaaa aaa aa", "<|endoftext|>a b<|startoftext|>  c<|endoftext|>", "<|endoftext", "Σας ΟΔΟΣ İ ﬁ ẛ̣ é é",
    "don't I'LL we've they'd 12345 ½ ²", "a\x1cb\x1d c\x85d e f​g", "日本語テキスト 한국어 \U0001f600\U0001f469‍\U0001f680", "x" * 3000 + " y", "\x00\x01 \t\n\r",
    "'s 't 're '''s", "Ontien | lyorth!! && %%% ***",
]


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(tokenizer_path())


def same(lib, vocabulary, texts, **how):
    for text, (n, ids, decoded) in zip(texts, bpe.Encoder(vocabulary, **how).encode(texts), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want))), repr(text[:80])
        assert decoded == lib.decode(want, skip_special_tokens=False) == bpe.decode(want, vocabulary)


def test_hard_texts(lib, vocabulary):
    same(lib, vocabulary, HARD)


def test_full_table_is_dropped_in_between(lib, vocabulary):
    texts = [f"word{i} again{i % 7} thing" for i in range(60)]
    got = list(bpe.Encoder(vocabulary, table_size=5).encode(texts, piece=50))
    assert got == list(bpe.Encoder(vocabulary).encode(texts))
    same(lib, vocabulary, texts, table_size=3)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abehinorst' AEΣσéñß1.,!|\n\t<>"), max_size=60))
def test_any_text(lib, vocabulary, text):
    same(lib, vocabulary, [text])


def test_runs_of_equal_symbols(vocabulary):
    words = [b"a" * n for n in range(1, 40)] + [b"hahaha" * 3, b"zzzz"]
    together, ends = bpe.merge_words(words, vocabulary)
    at = 0
    for w, end in zip(words, ends.tolist(), strict=True):
        assert together[at:end].tolist() == bpe.merge_words([w], vocabulary)[0].tolist()
        at = end


def test_query_over_whole_table(spark, sf, lib):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_bpe(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "y"), (None, "the cat", "z"), (2, "", "z")], "doc_id long, text string, ids string")
    rows = bpe.encode_texts(docs, tokenizer_path()).collect()
    assert sorted((str(r.id), len(r.ids), r.decoded) for r in rows) == [("1", 0, ""), ("1", 0, ""), ("2", 0, ""), ("None", 2, "the</w> cat</w>")]
    assert bpe.digests(docs.limit(0), tokenizer_path()).count() == 0


def test_letters_beyond_old_unicode_tables(lib, vocabulary):
    same(lib, vocabulary, ["ᲉꟋ \U00010d50x AᲉB", "<|endoftext|>Ᲊ Ǆ ǅ ẞ ΑΣ Σ ᾳͅ", " a b᠎c​", "１２ ² Ⅷ ⓐ"])


def test_table_keeps_what_many_slices_use(vocabulary):
    enc = bpe.Encoder(vocabulary, table_size=40)
    for i in range(30):
        list(enc.encode([f"often seen word{i} new{i} fresh{i}"]))
    assert len(enc.known) <= 40 and {"often", "seen"} <= set(enc.known.to_pylist())
