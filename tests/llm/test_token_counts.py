"""Totals over all rows against a plain recount, and the commit protocol."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from sparkloom.llm import token_counts as C
from sparkloom.llm.queries import op7_token_counts, tokenizer_path


def plain(rows):
    """{(source, lang, version): (docs, tokens)} over all rows."""
    from tokenizers import Tokenizer

    lib, out = Tokenizer.from_file(tokenizer_path()), {}
    patterns = {"words-1": r"[^\x09-\x0D\x20]+", "signs-2": r"[0-9A-Za-z]+|[^0-9A-Za-z\x00-\x20]"}
    for _, t, s, lang in rows:
        counts = {v: len(re.findall(p, t or "")) for v, p in patterns.items()}
        counts["word_bpe_49k"] = len(lib.encode(t or "", add_special_tokens=False).ids)
        for v, c in counts.items():
            n, k = out.get((s, lang, v), (0, 0))
            out[s, lang, v] = (n + 1, k + c)
    return out


def totals(df):
    return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in df.collect()}


def test_query_over_whole_table(spark, sf):
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert totals(op7_token_counts(spark, sf)) == plain(rows)


def test_nulls_repeats_long_texts_and_empty_table(spark):
    rows = [(1, None, "a", None), (2, "", "b", "en"), (3, "x  y é", None, "en"), (3, "x  y é", None, "en"), (4, "w " * 100_000, "a", "en")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, lang string, tokens int")
    assert totals(C.corpus_totals(df, tokenizer_path())) == plain(rows)
    assert C.corpus_totals(df.limit(0), tokenizer_path()).count() == 0


@pytest.fixture
def store(spark, tmp_path):
    return C.TokenTotals(spark, str(tmp_path / "totals"))


def rows(spark, *values):
    return spark.createDataFrame([("s", "en", "v1", t) for t in values] or [], "source string, lang string, version string, tokens long")


def test_signed_changes_and_replays(spark, store):
    assert store.totals().count() == 0
    assert store.apply("b1", C.inserts(rows(spark, 5, 7, 9)))
    assert not store.apply("b1", C.inserts(rows(spark, 100)))
    store.apply("b2", C.deletes(rows(spark, 7)))
    revised = rows(spark, 6).selectExpr("source", "lang", "version", "5L old_tokens", "tokens")
    store.apply("b3", C.revisions(revised))
    store.apply("b4", C.inserts(rows(spark)))
    assert totals(store.totals()) == {("s", "en", "v1"): (2, 15)}
    store.compact("c1")
    assert totals(store.totals()) == {("s", "en", "v1"): (2, 15)}
    assert not store.apply("b2", C.deletes(rows(spark, 7)))
    store.apply("b5", C.deletes(rows(spark, 6, 9)))
    assert totals(store.totals()) == {}


def test_batch_that_died_before_its_commit_is_written_anew(spark, store):
    C.inserts(rows(spark, 1, 2)).groupBy(*C.KEYS).agg({"n_docs": "sum"}).limit(0).write.parquet(f"{store.path}/batches/b1")
    assert store.totals().count() == 0
    store.apply("b1", C.inserts(rows(spark, 3)))
    assert totals(store.totals()) == {("s", "en", "v1"): (1, 3)}
    assert Counter(store.committed()) == {"b1": 1}


def test_late_writer_and_reader_between_the_steps_of_a_fold(spark, store):
    store.apply("b1", C.inserts(rows(spark, 4)))
    late = C.TokenTotals(spark, store.path)
    late._committed.get = lambda name: None  # a writer that looked before the other committed
    assert not late.apply("b1", C.inserts(rows(spark, 100)))
    assert totals(store.totals()) == {("s", "en", "v1"): (1, 4)}
    folder = store._write("fold", C.inserts(rows(spark, 4)))  # a fold that died before its marker
    assert totals(store.totals()) == {("s", "en", "v1"): (1, 4)}
    assert store.compact() and totals(store.totals()) == {("s", "en", "v1"): (1, 4)}
    store.apply("b2", C.inserts(rows(spark, 6)))
    store.vacuum()
    assert totals(store.totals()) == {("s", "en", "v1"): (2, 10)}
    assert folder not in C.Markers(spark, f"{store.path}/batches").names() and not store.apply("b1", C.inserts(rows(spark, 9)))
