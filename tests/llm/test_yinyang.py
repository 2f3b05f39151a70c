"""Group-bounded clustering against plain full scans in Python integers."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from sparkloom.llm import yinyang
from sparkloom.llm.queries import ORACLES, op13_centroids


def brute(rows, k, rounds, dims, scale=64):
    """[(id, cluster, distance, cluster inertia, inertia, digest)] for the rows (id, vector) that take part."""
    kept = [(i, [scale * n // d for n, d in map(float.as_integer_ratio, v)], v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v, x) for i, x, v in kept if i is not None)
    c = [x for *_, x in named][:k] + [x for _, x in sorted((v, x) for i, x, v in kept if i is None)][: max(0, k - len(named))]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        at = [nearest(x)[1] for _, x, _ in kept]
        for j in range(len(c)):
            own = [x for (_, x, _), a in zip(kept, at, strict=True) if a == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    got = [(i, *nearest(x)) for i, x, _ in kept]
    most, total = yinyang.MOST, sum(d for _, d, _ in got)
    of = {j: sum(d for _, d, a in got if a == j) for j in range(len(c))}
    return [(i, a, min(most, d), min(most, of[a]), min(most, total), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for i, d, a in got]


def rows_of(df):
    return sorted(map(str, map(tuple, df.select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())))


def test_query_over_whole_table_equals_its_sql(spark, sf):
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    got = op13_centroids(spark, sf)
    want = duck.sql(ORACLES["op13_centroids"])
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert rows_of(got.withColumnRenamed("vec_id", "id")) == sorted(map(str, brute(rows, 16, 3, 64)))


def test_odd_rows_ties_repeats_and_huge_components(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.integers(-2, 3, 4).astype(float).tolist()) for i in range(200)]  # a small grid: many ties
    rows += [(7, rows[8][1]), (7, [1.0, 2.0, 0.0, 1.0]), (None, [0.5, 0.5, 0.5, 0.5]), (900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan")] * 4), (903, [float("inf")] * 4), (904, [1.0] * 3), (905, [])]
    for extra in ([], [(950, [1e30, -1e300, 0.0, 3.0]), (951, [3e9, 0.0, 0.0, 0.0])]):
        df = spark.createDataFrame([(*x, "c", 1.0) for x in rows + extra], "vec_id long, embedding array<double>, cluster string, distance double").repartition(3)
        assert rows_of(yinyang.cluster(df, k=6, groups=3, dims=4)) == sorted(map(str, brute(rows + extra, 6, 3, 4)))
    few = df.where("vec_id < 3")
    assert rows_of(yinyang.cluster(few, k=6, dims=4)) == sorted(map(str, brute([x for x in rows if x[0] is not None and x[0] < 3], 6, 3, 4)))
    assert yinyang.cluster(df.limit(0), dims=4).count() == 0 == yinyang.cluster(df.where("vec_id > 901"), dims=5).count()


@pytest.mark.parametrize("seed", range(3))
def test_filters_skip_work_and_change_nothing(seed):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((20, 16)) * 300
    x = np.floor(centres[r.integers(0, 20, 3000)] + 40 * r.standard_normal((3000, 16))).astype(np.int64)
    c = x[:20].copy()
    group = yinyang.grouped(c.tolist(), 5)
    assert set(group) == set(range(group.max() + 1))
    at, upper, lower = yinyang.first_bounds(x, c, group)
    work = 0
    for _ in range(6):
        assert at.tolist() == yinyang.scanned(x, c)[0].tolist()
        new = np.stack([x[at == j].sum(0) // max(1, (at == j).sum()) if (at == j).any() else c[j] for j in range(20)])
        step = yinyang.Step(new.tolist(), yinyang._drift(c.tolist(), new.tolist()), group)
        c = new
        at, upper, lower, taken = yinyang.refined(x, c, step, at, upper, lower)
        work += taken
        d = np.sqrt(((x[:, None] - c[None]) ** 2).sum(2))
        assert (upper >= d[np.arange(3000), at]).all()
        d[np.arange(3000), at] = np.inf
        assert all((lower[:, g] <= d[:, group == g].min(1)).all() for g in range(lower.shape[1]))
    assert work < 0.25 * 6 * 3000 * 20
