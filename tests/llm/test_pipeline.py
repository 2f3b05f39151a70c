"""The whole pipeline against stages taken by hand, and each stage's hard rows."""

from __future__ import annotations

import pytest

import corpus_pipeline as P
from sparkloom.llm import decontaminate, near_copies, quality, toxicity
from tests.llm.test_decontaminate import plain_finds
from tests.llm.test_near_copies import plain


@pytest.fixture(scope="module")
def tables(spark, sf):
    return {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels", "benchmark")}


def test_run_against_brute_force(spark, sf, tables):
    from tokenizers import Tokenizer

    docs = sorted((r.doc_id, r.text) for r in tables["documents"].collect())
    q = quality.Scorer(quality.fit(tables["documents"], tables["labels"]))
    docs = [(i, t) for i, t in docs if q.score(t) >= 0.5]
    kept = spark.createDataFrame(docs, "doc_id long, text string")
    x = toxicity.Scorer(toxicity.fit(kept, tables["labels"]))
    docs = [(i, t) for i, t in docs if x.score(t) < 0.7]
    group = plain(docs)  # five-word shingles, similarity of 0.8 or more
    docs = [(i, t) for i, t in docs if group[i] == i]
    items = [(r.item_id, r.text) for r in tables["benchmark"].collect()]
    docs = [(i, t) for i, t in docs if not plain_finds(items, t)]
    lib = Tokenizer.from_file(P.tokenizer_path())
    want = sorted((i, lib.encode(t, add_special_tokens=False).ids) for i, t in docs)
    rows = P.run(spark, sf).collect()
    assert all(r.n_tokens == len(r.ids) for r in rows)
    got = sorted((r.doc_id, r.ids) for r in rows)
    assert got == want and len(got) < tables["documents"].count()


def test_stages_in_order_keep_columns_and_survive_hard_rows(spark, sf, tmp_path):
    assert [n for n, _ in P.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "bpe"]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 60_000, None, "s", 5), (3, None, "en", None, None)]
    for n, data, kind in (("labels", [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), ("benchmark", [(None, None), (1, "")], "item_id long, text string")):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{n}.parquet")
    for docs in (spark.createDataFrame(rows, columns), spark.createDataFrame([], columns)):
        for name, stage in P.STAGES:
            out = stage(spark, docs, str(tmp_path))
            out.count()
            if name != "bpe":
                assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_clean_documents_stay(spark, sf, tables):
    clean = tables["documents"].join(tables["labels"].where("quality = 1 and toxic = 0"), "doc_id", "left_semi")
    ids = {r.doc_id for r in clean.select("doc_id").collect()}
    for n, stage in P.STAGES[:2]:
        kept = {r.doc_id for r in stage(spark, clean, sf).select("doc_id").collect()}
        assert len(kept) >= 0.93 * len(ids), n
    assert near_copies.keep_one(clean).count() <= len(ids)
    assert decontaminate.keep_clean(clean, tables["benchmark"].limit(0)).count() == len(ids)
