"""Top-k against the full matrix of scores."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import topk
from sparkloom.llm.queries import op6_topk


def brute(vectors, is_query, k=10):
    """{query: [(id, score)]} over valid rows of distinct ids."""
    out = {}
    ints = {i: np.floor(1024 * np.asarray(v, float)).astype(int) for i, v in vectors.items()}
    for q in filter(is_query, ints):
        def score(c, q=q):
            n = min(len(ints[q]), len(ints[c]))
            return int(ints[q][:n] @ ints[c][:n])

        ranked = sorted(((-score(c), c) for c in ints if c != q))[:k]
        out[q] = [(c, -s) for s, c in ranked]
    return out


def results(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_query_over_whole_table(spark, sf):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert results(op6_topk(spark, sf)) == brute(rows, lambda i: i % 100 == 0)


@pytest.mark.parametrize("seed", range(4))
def test_index_stops_only_on_proof(seed):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((8, 24))
    x = np.floor(1024 * (centres[r.integers(0, 8, 3000)] * 0.5 + 0.2 * r.standard_normal((3000, 24)))).astype(np.int64)
    x[100:400] = x[100]  # many equal rows: ties by id
    ids = np.arange(3000)
    index = topk.ImpactIndex(ids, ids, x)
    for q in range(0, 3000, 173):
        got, score = index.top(x[q], q, 10)
        s = x @ x[q]
        want = sorted((i for i in ids if i != q), key=lambda i: (-s[i], i))[:10]
        assert got.tolist() == want and score.tolist() == [s[i] for i in want]


@pytest.mark.parametrize("dims", (8, 16, 32, 64))
@pytest.mark.parametrize("kind", ("signs", "copies"))
def test_tied_segments_lose_no_row(dims, kind):
    r = np.random.default_rng(dims)
    x = r.standard_normal((2000, dims))
    if kind == "signs":
        x = np.sign(x)
    else:
        x[r.permutation(2000)[:1000]] = x[7]
    x, ids = np.floor(1024 * x).astype(np.int64), np.arange(2000)
    index = topk.ImpactIndex(ids, ids, x)
    for q in range(0, 2000, 33):
        got, score = index.top(x[q], q, 10)
        s = x @ x[q]
        want = sorted((i for i in ids if i != q), key=lambda i: (-s[i], i))[:10]
        assert got.tolist() == want and score.tolist() == [s[i] for i in want]


def plain(rows, is_query, k=10):
    """[(query id, rank, id, score)] of (id, vector) rows by full scans in Python integers; equal ids are rows of their own."""
    ints = [(i, [1024 * n // d for n, d in map(float.as_integer_ratio, v)]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for r, (q, x) in enumerate(ints):
        if is_query(q):
            scores = [(-max(-topk.MOST, min(topk.MOST, sum(a * b for a, b in zip(x, y, strict=False)))), i) for c, (i, y) in enumerate(ints) if c != r]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


def test_blocks_nulls_repeats_and_empty_table(spark):
    r = np.random.default_rng(9)
    good = [(i, r.standard_normal(6).tolist()) for i in range(120)]
    rows = good + [(3, good[3][1]), (20, good[7][1]), (20, good[20][1]), (500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, []), (None, good[0][1]), (600, [0.0] * 6), (700, [1.0, 2.0])]
    df = spark.createDataFrame([(*x, "x") for x in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    assert found(topk.search(df, F.col("id") % 20 == 0, k=7, room=200, queries=4)) == plain(rows, lambda i: i % 20 == 0, 7)
    assert found(topk.search(df.where("vec_id in (0, 1, 2)"), F.col("id") % 20 == 0)) == plain(good[:3], lambda i: i == 0)
    assert topk.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_huge_components_and_one_long_vector(spark):
    r = np.random.default_rng(11)
    rows = [(i, (r.standard_normal(4) * 10.0 ** r.integers(0, 9)).tolist()) for i in range(60)]
    rows += [(100, [70000.0, 70000.0]), (101, [70000.0, 70000.0]), (102, [1e30, -1e300, 1.0]), (103, [-1e30, 1e30]), (104, r.standard_normal(5000).tolist()), (120, r.standard_normal(7000).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(topk.search(df, F.col("id") % 20 == 0, k=9))
    assert got == plain(rows, lambda i: i % 20 == 0, 9)
    assert found(topk.search(df.where("vec_id in (100, 101)"), F.col("id") == 100)) == [(100, 1, 101, 2 * (70000 * 1024) ** 2)]
    block = topk.Block([np.arange(3)], [np.arange(3)], [np.ones(4, np.int64), np.ones(3, np.int64), np.ones(100_000, np.int64)])
    assert block.index.x.shape == (2, 4) and len(block.long) == 1


@pytest.mark.parametrize("scale", (1, 1000))
def test_work_ends_on_proof_before_half_of_the_postings(scale):
    r = np.random.default_rng(4)
    x = np.floor(scale * 128 * r.standard_normal((4096, 32))).astype(np.int64)
    ids = np.arange(4096)
    index, shares = topk.ImpactIndex(ids, ids, x), []
    for q in range(0, 4096, 211):
        got, score = index.top(x[q], q, 10)
        s = x @ x[q]
        want = sorted((i for i in ids if i != q), key=lambda i: (-s[i], i))[:10]
        assert got.tolist() == want and score.tolist() == [s[i] for i in want]
        shares.append(index.share)
    assert 0 < np.mean(shares) < 0.5
