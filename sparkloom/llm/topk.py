"""Exact top-k by inner product from an impact-ordered index, score at a time.

Components become integers floor(scale * x). Rows are dealt into blocks of bounded size, and the queries are sent
to every block: a task sorts its blocks' rows before their queries, builds each block's index once, and streams
the queries through it in Arrow batches. In an index every dimension keeps its postings in segments of falling
quantised impact. A query takes the segments of all dimensions in descending order of impact, the most that query
weight times value amounts to in either direction, and adds their contributions to accumulators; beside them it keeps
what is left of the row's and of the query's squared norm in the dimensions not taken yet. By Cauchy and Schwarz a row
can still gain at most the root of the product of the two, and at most the best segments to come of each dimension,
so rows whose accumulator plus this bound lies below the k-th best exact score known so far (the leading accumulators
are rescored for it) are out by proof. Processing ends when the rows left have fewer components than the segments left
have postings; they are rescored exactly. Ties go to the smaller id.

Defined results: rows whose vector is null, empty, or holds null or non-finite components, or whose id is null,
take no part; rows that repeat an id are rows of their own, as candidates (also for each other) and as queries;
vectors of different length are compared as if padded by zeros, and one far longer than its block's others is kept
beside the index and scored by itself; sums are exact for components of any size, a score beyond 64 bits counts as
the largest or smallest of 64 bits; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fields, stored

#: ``ROOM``: components in a block.
SCALE, ROOM, QUERIES, SEGMENTS, CHECKS = 1024, 1 << 20, 1024, 12, 32
MOST = (1 << 63) - 1


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) as 64-bit integers, or as Python integers where any is beyond them."""
    with np.errstate(over="ignore"):
        x = np.floor(scale * values)
    if not x.size or np.abs(x).max() < 1 << 62:
        return x.astype(np.int64)
    return np.array([scale * n // d for n, d in map(float.as_integer_ratio, values.tolist())], object)


def _size(x: np.ndarray) -> int:
    """The largest magnitude."""
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def product(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows of equal length with ``q``, inside 64 bits."""
    if _size(x) * _size(q) * max(1, len(q)) < 1 << 62:
        return x.astype(np.int64, copy=False) @ q.astype(np.int64, copy=False)
    exact = x.astype(object) @ q.astype(object)
    return np.array([min(MOST, max(-MOST, s)) for s in np.atleast_1d(exact).tolist()], np.int64).reshape(np.shape(exact))


class ImpactIndex:
    """Postings of one block: for each dimension, segments of rows in ascending order of value. Rows come in ascending order of id."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, x: np.ndarray, segments: int = SEGMENTS):
        self.keys, self.ids, self.x = keys, ids, x
        n, self.dims = x.shape
        self.most, self.share = _size(x), 0.0
        self.narrow = self.most * self.most * self.dims < 1 << 62
        if self.narrow:
            self.x = x = x.astype(np.int64, copy=False)
            order = np.argsort(x, axis=0, kind="stable").astype(np.int32)
            self.rows, self.values = order.T.copy(), np.take_along_axis(x, order, 0).T.copy()
            self.cuts = np.unique(np.linspace(0, n, min(segments, n) + 1).astype(int)).tolist()
            self.low, self.high = self.values[:, self.cuts[:-1]], self.values[:, np.array(self.cuts[1:]) - 1]
            self.norms = (x * x).sum(1)

    def top(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but the one whose key is ``own``; fewer if the block is smaller."""
        left = np.flatnonzero(self.keys != own)
        size = _size(q)
        if self.narrow and max(self.most, size) * size * self.dims < 1 << 62:
            left = self._possible(q.astype(np.int64, copy=False), left, k)
        scores = product(self.x[left], q)
        keep = np.lexsort((left, -scores))[:k]
        return self.ids[left][keep], scores[keep]

    def _possible(self, q: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
        """The rows that may be among the k best: all others are out by proof."""
        n, dims, count = len(self.ids), self.dims, len(self.cuts) - 1
        ends = q[:, None] * self.high, q[:, None] * self.low
        turn = np.argsort(-np.maximum(np.abs(ends[0]), np.abs(ends[1])).ravel(), kind="stable")
        best = np.maximum(0, np.maximum(*ends))  # the most that a row can gain in a segment
        open_, sizes = np.ones((dims, count), bool), np.diff(self.cuts)
        acc, rows_left, query_left = np.zeros(n, np.int64), self.norms.copy(), np.full(n, int(q @ q))
        least, at, rest, step = None, 0, n * dims, max(1, len(turn) // CHECKS)
        weight, square, cuts = q.tolist(), (q * q).tolist(), self.cuts
        while at < len(turn) and len(left) > k:
            for flat in turn[at : at + step].tolist():
                d, s = divmod(flat, count)
                rows, values = self.rows[d, cuts[s] : cuts[s + 1]], self.values[d, cuts[s] : cuts[s + 1]]
                acc[rows] += weight[d] * values
                rows_left[rows] -= values * values
                query_left[rows] -= square[d]
                open_[d, s] = False
                rest -= int(sizes[s])
            at += step
            # the k-th best exact score of the leading rows is one that the k-th best row of all reaches
            ahead = left[np.argpartition(acc[left], -k)[-k:]]
            known = int((self.x[ahead] @ q).min())
            least = known if least is None else max(least, known)
            root = np.sqrt(rows_left[left].astype(np.float64) * query_left[left].astype(np.float64)) * (1 + 1e-9) + 1
            gain = np.minimum(root, float(np.where(open_, best, 0).max(1).sum()))
            left = left[acc[left] + gain >= least]
            if len(left) * dims <= rest:
                break
        self.share = 1 - rest / (n * dims)
        return left


class Block:
    """The rows of one block: an index of those of about equal length, and the few far longer ones by themselves."""

    def __init__(self, keys: list[np.ndarray], ids: list[np.ndarray], vectors: list[np.ndarray]):
        order = np.lexsort((np.concatenate(keys), np.concatenate(ids)))
        keys, ids = np.concatenate(keys)[order], np.concatenate(ids)[order]
        vectors = [vectors[k] for k in order.tolist()]
        lengths = np.array([len(v) for v in vectors])
        # padded to this length, the rows that are no longer take twice the room of all components at most
        dims = max(d for d in np.unique(lengths).tolist() if d * int((lengths <= d).sum()) <= 2 * int(lengths.sum()) or d == lengths.min())
        short = lengths <= dims
        self.long = [(int(k), int(i), v) for k, i, v, s in zip(keys, ids, vectors, short, strict=True) if not s]
        rows = [v for v, s in zip(vectors, short, strict=True) if s]
        x = np.zeros((len(rows), dims), object if any(v.dtype == object for v in rows) else np.int64)
        for k, v in enumerate(rows):
            x[k, : len(v)] = v
        self.index = ImpactIndex(keys[short], ids[short], x)

    def top(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        dims = self.index.dims
        padded = np.concatenate([q[:dims], np.zeros(max(0, dims - len(q)), q.dtype)])
        ids, scores = self.index.top(padded, own, k)
        if self.long:
            more = [(i, int(product(v[: len(q)][None], q[: len(v)])[0])) for key, i, v in self.long if key != own]
            ids, scores = np.concatenate([ids, np.array([i for i, _ in more], np.int64)]), np.concatenate([scores, np.array([s for _, s in more], np.int64)])
            keep = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[keep], scores[keep]
        return ids, scores


def _vectors(lists: pa.Array, scale: int) -> list[np.ndarray]:
    offsets = lists.offsets.to_numpy()
    values = integers(lists.values.to_numpy(zero_copy_only=False).astype(np.float64)[offsets[0] : offsets[-1]], scale)
    return [values[a:b] for a, b in zip(offsets - offsets[0], offsets[1:] - offsets[0], strict=False)]


def _answers(batches: Iterator[pa.RecordBatch], k: int, scale: int, queries: int) -> Iterator[pa.RecordBatch]:
    """The best rows of each block for each query; rows come sorted by block, and a block's rows before its queries."""
    at, keys, ids, xs, block = None, [], [], [], None
    for whole in batches:
        for b in (whole.slice(k, queries) for k in range(0, whole.num_rows, queries)):
            blocks, query = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (query[1:] != query[:-1])) + 1).tolist(), b.num_rows]
            found: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            for s, e in zip(cuts, cuts[1:], strict=False):
                part = b.slice(s, e - s)
                if blocks[s] != at:
                    at, keys, ids, xs, block = blocks[s], [], [], [], None
                key, own, x = part.column(2).to_numpy(), part.column(3).to_numpy().astype(np.int64), _vectors(part.column(4), scale)
                if not query[s]:
                    keys.append(key)
                    ids.append(own)
                    xs += x
                    continue
                if block is None and ids:
                    block, keys, ids, xs = Block(keys, ids, xs), [], [], []
                if block is not None:
                    found += [(r, i, *block.top(q, r, k)) for r, i, q in zip(key.tolist(), own.tolist(), x, strict=True)]
            if found:
                n = [len(got) for *_, got, _ in found]
                cols = [np.repeat([r for r, *_ in found], n), np.repeat([i for _, i, *_ in found], n), np.concatenate([g for *_, g, _ in found]), np.concatenate([s for *_, s in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["row", "query_id", "vec_id", "score"])


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, room: int = ROOM, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for each row of which ``is_query`` (a column of ``id``) holds.

    A block has about ``room`` components; a task holds one block's index and the answers to at most ``queries`` queries.
    """
    v = fields(vectors, id=id_col, v=vector_col).where("id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = stored(v.where(~bad).select(F.monotonically_increasing_id().alias("row"), "id", "v"), "topk-vectors")  # row numbers stay as they are
    total = v.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // room))
    data = v.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("query"), "row", "id", "v")
    # the rows of a block are shuffled once; a query goes to each block, which the comparison with every row needs
    asks = v.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1).cast("int"))).alias("block"), F.lit(True).alias("query"), "row", "id", "v")
    dealt = data.unionByName(asks).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "query")  # a block a task, no two by chance
    found = dealt.mapInArrow(lambda batches: _answers(batches, k, scale, queries), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOPK_SQL = """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.r as r, q.vec_id as query_id, c.vec_id as vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from v q join v c on q.r <> c.r where q.vec_id % 100 = 0),
o as (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from o where rank <= 10
"""
