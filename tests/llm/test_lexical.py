"""Ranked lexical search against a plain scan of every document and against SQL."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from sparkloom.llm import lexical
from sparkloom.llm.queries import ORACLES, op11_lexical

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=10):
    """[(item, rank, doc, score)] for (id, text) rows, equal ids included."""
    counted = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, tokens = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // tokens
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(map(str, out))


def found(df):
    return sorted(str(tuple(r)) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_query_over_whole_table(spark, sf):
    got = found(op11_lexical(spark, sf))
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert got == sorted(str(r) for r in duck.sql(ORACLES["op11_lexical"]).fetchall())
    docs = duck.sql("select doc_id, text from documents").fetchall()
    assert got == brute(docs, duck.sql("select item_id, text from benchmark").fetchall())


@pytest.mark.parametrize("rows", (3, 1000))
def test_shards_parts_ties_nulls_and_repeats(spark, rows):
    docs = [(i, f"common word{i % 7} Ärger größe-x{i % 3} " + "pad " * (i % 5)) for i in range(60)]
    docs += [(70, None), (71, ""), (72, " .,;"), (3, docs[3][1]), (3, "common other"), (None, docs[4][1]), (None, "common"), (80, "İstanbul ÀB ab common x"), (81, "lone " * 50_000)]
    items = [(1, "COMMON word3 word3 größe"), (1, "word2"), (2, None), (3, "nowhere"), (None, "ärger x2 pad"), (4, "Àb ÀB istanbul İstanbul lone"), (5, "common"), (6, "")]
    d = spark.createDataFrame([(*x, "t", 1) for x in docs], "doc_id long, text string, term string, score int").repartition(3)
    q = spark.createDataFrame([(*x, 9) for x in items], "item_id long, text string, rank int")
    assert found(lexical.search(lexical.build(d, rows=rows), q, item_bytes=20)) == brute(docs, items)
    assert found(lexical.search(lexical.build(d, rows=rows), q, k=2)) == brute(docs, items, 2)
    assert lexical.ranking(d.limit(0), q).count() == 0 == lexical.ranking(d, q.limit(0)).count()


def test_terms_are_those_of_the_pattern():
    every = "".join(map(chr, [*range(0x250), 0x2028, 0x3000, 0x4E2D, 0x1F600]))
    for text in (every, every[::-1], " a\u0085b C", "ſK"):
        assert [t.decode() for t in lexical.terms(text.encode())] == words(text)


def test_best_places_and_large_lengths():
    r = np.random.default_rng(1)
    for _ in range(200):
        acc = r.integers(0, 4, r.integers(1, 40))
        assert lexical.best(acc, 5).tolist() == sorted((i for i in range(len(acc)) if acc[i] > 0), key=lambda i: (-acc[i], i))[:5]
    lengths, n, total = np.array([1, 10**9]), 10**11, 10**14
    want = [10**9 * 3 // (3000 + 8 * (25 + 75 * x * n // total)) for x in lengths.tolist()]
    assert lexical.impacts(np.array([3, 3]), lengths, n, total).tolist() == want


def test_each_shard_is_a_file_of_its_own(spark):
    docs = spark.createDataFrame([(k, f"word{k} common") for k in range(40)], "doc_id long, text string").coalesce(1)
    index = lexical.build(docs, rows=4)
    assert index.shards.count() == 10
    assert len(index.shards.inputFiles()) == 10
