"""Round trip of the ORC files against the tokenizers library."""

from __future__ import annotations

import glob
import zlib

import numpy as np
import pyarrow.orc as orc

from sparkloom.llm import token_store
from sparkloom.llm.queries import op3_token_store, tokenizer_path


def expected(rows):
    from tokenizers import Tokenizer

    lib, at, out = Tokenizer.from_file(tokenizer_path()), 0, []
    for doc_id, text in rows:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_over_whole_table(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, op3_token_store(spark, sf).collect())) == expected(docs)


def test_files_have_indexes_blooms_and_prune(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(500)], "doc_id long, text string")
    out = str(tmp_path / "ids")
    token_store.write(docs, tokenizer_path(), out)
    files = glob.glob(f"{out}/*.orc")
    assert files and sum(orc.ORCFile(f).nrows for f in files) == 500
    assert all(orc.ORCFile(f).compression == "ZSTD" for f in files)
    stored = token_store.read(spark, out)
    plan = stored.where("doc_id = 77")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in plan
    assert stored.where("doc_id = 77").count() == 1


def test_nulls_repeats_and_empty_table(spark, tmp_path):
    rows = [(3, None, 1), (3, "b a", 2), (1, "", 3), (2, "x" * 5000, 4), (None, "n", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int")
    out = str(tmp_path / "a")
    token_store.write(docs, tokenizer_path(), out)
    got = token_store.digests(token_store.read(spark, out)).collect()
    order = sorted(((d, t) for d, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(order)
    token_store.write(docs.limit(0), tokenizer_path(), str(tmp_path / "b"))
    assert token_store.digests(token_store.read(spark, str(tmp_path / "b"))).count() == 0
