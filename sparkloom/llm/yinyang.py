"""Clustering around centroids with group bounds (Yinyang): exact assignments, most distances never computed.

Vectors of exactly ``dims`` finite components become integers floor(scale * x). Centroids start as the ``k`` vectors
whose ids have the smallest sha256 of ``<seed>:<id>``. A round assigns every vector to its nearest centroid (squared
Euclidean distance, ties to the smaller number) and replaces each centroid by its vectors' componentwise floor of the
mean. Centroids are put into groups once, before the first round. A vector keeps an upper bound of the distance to
its own centroid and one lower bound per group. After centroids have moved, a vector whose upper bound lies below all
its lower bounds stays where it is (global filter), else whole groups are passed over (group filter), else single
centroids (local filter), and what survives is scanned exactly in integers. Bounds are rounded outwards, so a skipped
centroid is farther for certain and cannot even tie: results equal those of a full scan.

Scale: a round reads the vectors with their bounds once, without a shuffle, and writes them for the next one. Sums
are additive: after the first round only vectors that moved are read for them. A task returns one row per centroid
and component, which Spark sums; k * dims numbers reach the driver, however many vectors there are.

Defined results: a vector that is null, of another length, or holds null or non-finite components takes no part;
rows that repeat an id are vectors of their own (as starting centroids the smaller vector first); rows without an id
are clustered too but start no centroid while others are left; fewer than ``k`` vectors start fewer centroids; an
empty table gives an empty result; other columns are ignored. Sums, means and comparisons are exact for components of
any size; a distance or inertia beyond 64 bits is given as 2 ** 63 - 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, forget, stored

DIMS, SCALE, CLUSTERS, ROUNDS, GROUPS, SEED = 64, 64, 16, 3, 4, 1
#: Components below this size (of vectors and centroids) keep squared distances of up to 128 components inside 64 bits.
NARROW = 1 << 27
#: Bounds are widened by this share, far more than floating point can lose in one step.
SLACK = 1e-12
MOST = (1 << 63) - 1
LIMB = 10**30


class Step(NamedTuple):
    """What a round's tasks need: the centroids, how far each moved, and the group of each. ``moved`` is None before bounds exist."""

    centroids: list[list[int]]
    moved: np.ndarray | None
    group: np.ndarray


def integers(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * v) as 64-bit integers, or as Python integers where any is large."""
    with np.errstate(over="ignore"):
        x = np.floor(scale * v)
    if not x.size or np.abs(x).max() < NARROW:
        return x.astype(np.int64)
    exact = np.frompyfunc(lambda a: scale * a.as_integer_ratio()[0] // a.as_integer_ratio()[1], 1, 1)
    return exact(v.astype(object))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d) if d.dtype == np.int64 else (d * d).sum(1)


def scanned(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row (ties to the smaller number), and all squared distances."""
    d = np.stack([squared(x, row) for row in c], 1)
    at = np.zeros(len(x), np.int64)
    for j in range(1, len(c)):
        at = np.where(d[:, j] < d[np.arange(len(x)), at], j, at)
    return at, d


def _down(r: np.ndarray) -> np.ndarray:
    return r * (1 - SLACK)


def _up(r: np.ndarray) -> np.ndarray:
    return r * (1 + SLACK)


def _group_least(low: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The least bound of each group, the own centroid aside."""
    low[np.arange(len(low)), at] = np.inf
    return np.stack([low[:, group == g].min(1) for g in range(int(group.max()) + 1)], 1)


def first_bounds(x: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, d = scanned(x, c)
    root = np.sqrt(d.astype(np.float64))
    return at, _up(root[np.arange(len(x)), at]), _group_least(_down(root), at, group)


def refined(x: np.ndarray, c: np.ndarray, step: Step, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower) after the centroids have moved, and how many distances it took."""
    group, moved = step.group, _up(step.moved)
    before = _down(lower)
    lower = before - np.array([moved[group == g].max() for g in range(lower.shape[1])])
    at, upper, taken = at.copy(), _up(upper + moved[at]), 0
    r = np.flatnonzero(upper >= lower.min(1))  # global filter
    own = squared(x[r], c[at[r]])
    upper[r], taken = _up(np.sqrt(own.astype(np.float64))), len(r)
    keep = upper[r] >= lower[r].min(1)  # again, with the true distance
    r, best = r[keep], own[keep]
    if not len(r):
        return at, upper, lower, taken
    rows, old, now = x[r], at[r], at[r].copy()
    low = before[r][:, group] - moved  # what is known of each centroid without a look at it
    low[np.arange(len(r)), old] = _down(np.sqrt(best.astype(np.float64)))
    for g in range(lower.shape[1]):
        of_group = lower[r, g] <= _up(np.sqrt(best.astype(np.float64)))  # group filter
        for j in np.flatnonzero(group == g).tolist():
            k = np.flatnonzero(of_group & (old != j) & (low[:, j] <= _up(np.sqrt(best.astype(np.float64)))))  # local filter
            if len(k):
                d = squared(rows[k], c[j])
                taken += len(k)
                low[k, j] = _down(np.sqrt(d.astype(np.float64)))
                wins = k[(d < best[k]) | ((d == best[k]) & (j < now[k]))]
                best[wins], now[wins] = squared(rows[wins], c[j]), j
    at[r], upper[r], lower[r] = now, _up(np.sqrt(best.astype(np.float64))), _group_least(low, now, group)
    return at, upper, lower, taken


def assigned(v: np.ndarray, scale: int, step: Step, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One batch's clusters and bounds. Rows or centroids too large for 64-bit distances are scanned in Python integers."""
    c = np.array(step.centroids, object)
    if np.abs(c).max() < NARROW:
        x = integers(v, scale)
        wide = np.array([max(map(abs, row)) >= NARROW for row in x]) if x.dtype == object else np.zeros(len(x), bool)
        c = c.astype(np.int64)
    else:
        x, wide = None, np.ones(len(v), bool)
    out = at.copy(), np.full(len(v), np.inf), np.full((len(v), int(step.group.max()) + 1), -np.inf)
    if (r := np.flatnonzero(~wide)).size:
        narrow = x[r].astype(np.int64)
        got = first_bounds(narrow, c, step.group) if step.moved is None else refined(narrow, c, step, at[r], upper[r], lower[r])
        for to, values in zip(out, got, strict=False):
            to[r] = values
    if (r := np.flatnonzero(wide)).size:
        out[0][r] = scanned(_python(v[r], scale), c.astype(object))[0]  # without bounds, so always scanned anew
    return out


def _python(v: np.ndarray, scale: int) -> np.ndarray:
    return np.array([[scale * n // d for n, d in map(float.as_integer_ratio, row)] for row in v.tolist()], object)


def own_distances(v: np.ndarray, scale: int, centroids: list[list[int]], at: np.ndarray) -> np.ndarray:
    x, c = integers(v, scale), np.array(centroids, object)
    if x.dtype == np.int64 and np.abs(c).max() < NARROW:
        return squared(x, c.astype(np.int64)[at])
    return np.array([min(MOST, d) for d in squared(_python(v, scale), c[at])], np.int64)


def _vectors(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _round(state: DataFrame, step: Step, dims: int, scale: int, last: bool) -> DataFrame:
    """(id, v, cluster, was, upper, lower, distance) after one assignment; distances only in the ``last``."""
    kinds = dict(state.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, was, n = _vectors(b.column("v"), dims), b.column("cluster").to_numpy(), b.num_rows
            upper, lower = b.column("upper").to_numpy(), b.column("lower").flatten().to_numpy().reshape(n, -1)
            at, upper, lower = assigned(v, scale, step, was.astype(np.int64), upper, lower)
            distance = pa.array(own_distances(v, scale, step.centroids, at) if last else np.zeros(n, np.int64))
            bounds = pa.ListArray.from_arrays(pa.array(np.arange(0, lower.size + 1, lower.shape[1], dtype=np.int32)), pa.array(lower.ravel()))
            cols = [b.column("id"), b.column("v"), pa.array(at, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), bounds, distance]
            yield pa.RecordBatch.from_arrays(cols, ["id", "v", "cluster", "was", "upper", "lower", "distance"])

    return state.select("id", "v", "cluster", "upper", "lower").mapInArrow(
        run, f"id {kinds['id']}, v {kinds['v']}, cluster int, was int, upper double, lower array<double>, distance long"
    )


def _changes(state: DataFrame, dims: int, scale: int) -> dict[int, list[int]]:
    """What the vectors that moved add to each cluster: {cluster: [count, sum of each component]}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            x = integers(_vectors(b.column("v"), dims), scale)
            for sign, name in ((1, "cluster"), (-1, "was")):
                at = b.column(name).to_numpy()
                for c in np.unique(at[at >= 0]).tolist():
                    rows = x[at == c]
                    new = np.array([len(rows), *rows.sum(0).tolist()], object) * sign
                    sums[c] = sums[c] + new if c in sums else new
        out = []
        for c, values in sums.items():
            for part, value in enumerate(values.tolist()):
                limb, negative, value = 0, value < 0, abs(value)
                while value:
                    value, low = divmod(value, LIMB)
                    out.append((c, part, limb, Decimal(-low if negative else low)))
                    limb += 1
        cols = list(zip(*out, strict=True)) or [[]] * 4
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["cluster", "part", "limb", "value"])

    rows = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(run, "cluster int, part int, limb int, value decimal(38,0)")
    found: dict[int, list[int]] = {}
    for r in rows.groupBy("cluster", "part", "limb").agg(F.sum("value").alias("value")).toLocalIterator():
        found.setdefault(r.cluster, [0] * (dims + 1))[r.part] += int(r.value) * LIMB**r.limb
    return found


def grouped(centroids: list[list[int]], groups: int) -> np.ndarray:
    """The group of each centroid, by a few rounds of plain clustering of the centroids themselves; no group is empty."""
    c = np.array(centroids, np.float64)
    c /= max(1.0, np.abs(c).max())
    centre = c[:: max(1, -(-len(c) // groups))][:groups]
    for _ in range(5):
        near = ((c[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        centre = np.stack([c[near == g].mean(0) if (near == g).any() else centre[g] for g in range(len(centre))])
    return np.unique(near, return_inverse=True)[1]


def _drift(old: list[list[int]], new: list[list[int]]) -> np.ndarray:
    def root(a: list[int], b: list[int]) -> float:
        try:
            return float(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))) ** 0.5
        except OverflowError:
            return float("inf")

    return np.array([root(a, b) for a, b in zip(old, new, strict=True)])


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, groups: int = GROUPS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row for each vector that takes part."""
    v = fields(vectors, id=id_col, v=vector_col)
    if "float" not in dict(v.dtypes)["v"]:
        v = v.withColumn("v", F.col("v").cast("array<double>"))
    v = v.where((F.size("v") == dims) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    start = v.orderBy(by.asc_nulls_last(), "v").limit(k).select("v").collect()  # k rows
    centroids = _python(np.array([r.v for r in start], np.float64).reshape(-1, dims), scale).tolist()
    kind = dict(v.dtypes)["id"]
    if not centroids:
        return v.sparkSession.createDataFrame([], f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    step = Step(centroids, None, grouped(centroids, groups))
    none = F.array(*[F.lit(float("-inf"))] * (int(step.group.max()) + 1))
    state, sums = v.select("id", "v", F.lit(-1).alias("cluster"), F.lit(float("inf")).alias("upper"), none.alias("lower")), {}
    for _ in range(rounds):
        new = stored(_round(state, step, dims, scale, last=False), "yinyang-state")
        forget(state)
        state = new
        for c, change in _changes(state, dims, scale).items():
            sums[c] = [a + b for a, b in zip(sums.get(c, [0] * (dims + 1)), change, strict=True)]
        means = [[s // sums[c][0] for s in sums[c][1:]] if sums.get(c, [0])[0] else old for c, old in enumerate(step.centroids)]
        step = Step(means, _drift(step.centroids, means), step.group)
    done = stored(_round(state, step, dims, scale, last=True).select("id", "cluster", "distance"), "yinyang-clusters")
    forget(state)
    sizes = {r.cluster: int(r.total) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in step.centroids]

    def of_cluster(values: list) -> F.Column:
        return F.array(*[F.lit(x) for x in values])[F.col("cluster")]

    return done.select(
        "id",
        "cluster",
        "distance",
        of_cluster([min(MOST, sizes.get(c, 0)) for c in range(len(names))]).cast("long").alias("cluster_inertia"),
        F.lit(min(MOST, sum(sizes.values()))).cast("long").alias("inertia"),
        of_cluster(names).alias("centroid_sha256"),
    )


def cluster_sql(rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the query's rows: every round a full scan of all centroids."""
    parts = [
        """with v as (
  select vec_id, row_number() over () as r, list_transform(embedding, lambda x: cast(floor(64 * x::double) as bigint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (select cast(row_number() over (order by sha256('1:' || vec_id), v) - 1 as integer) as cluster, v as c from v
  qualify row_number() over (order by sha256('1:' || vec_id), v) <= 16)"""
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} as (
  select vec_id, r, v, unnest(list_sort(list({{'d': list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, 'cluster': cluster}}))[1:1], recursive := true)
  from v, c{n} group by vec_id, r, v)""")
        if n < rounds:
            parts.append(f"""c{n + 1} as (
  select cluster, coalesce(m, c) as c from c{n} left join (
    select cluster, list(((s - ((s % k) + k) % k) // k)::bigint order by i) as m from (
      select cluster, i, sum(v[i]) as s, count(*) as k from a{n}, range(1, 65) t(i) group by cluster, i) group by cluster) using (cluster))""")
    return ",\n".join(parts) + f"""
select vec_id, cluster, d as distance, cast(sum(d) over (partition by cluster) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
  sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} join c{rounds} using (cluster)"""
