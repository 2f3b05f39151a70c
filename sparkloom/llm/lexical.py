"""Ranked lexical search: document shards of CSR postings with precomputed integer impacts, term at a time.

Terms are the runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased. ``build`` cuts
the documents into shards and writes one row per shard: its documents in ascending id, its terms, and for each term
the documents that hold it with their impacts, integers that depend on the term's count, the document's length and
the corpus' mean length only. ``search`` weighs terms by their document frequency, and every shard adds weight times
impact, term by term, to a dense accumulator; the shard's best documents are found by argpartition, with all that
tie at the end taken by ascending id, and the shards' best are merged.

Scale: texts are read once and never shuffled; shards are bounded in documents and in bytes of text and each is a file
of its own, so a task holds one shard's postings, however many it reads. Document frequencies are sums of the shards' counts, for the terms asked for only. Items are
taken in turns of at most ``ITEM_BYTES`` of text, so what is sent to the tasks has a bound; a part's results are
written before the next part goes out. A shard gives at most k rows per item.

Defined results: a null text has no terms; a document without terms is not counted and matches nothing; rows that
repeat a document id are documents of their own (equal rows keep unique ranks); a document without an id comes after
the others that tie with it; every row of the items is an item of its own, without terms it finds nothing; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fields, forget, slices, stored

K, SHARD_ROWS, SHARD_BYTES, ITEM_BYTES = 10, 8192, 16 << 20, 8 << 20
#: Every ASCII byte that is no letter or digit becomes a space; A-Z become a-z. Bytes from 128 on belong to characters beyond ASCII.
_TERM_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


class Index(NamedTuple):
    """One row per shard in ``shards``; ``documents`` counts those with terms, ``tokens`` all their terms."""

    shards: DataFrame
    documents: int
    tokens: int


class Shard:
    """Term counts of one shard's documents, gathered text by text."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.rows, self.counts, self.keys, self.lengths, self.bytes = [], [], [], [], 0

    def add(self, text: bytes) -> None:
        numbers, found = self.vocabulary, terms(text)
        counts = Counter(found)
        self.rows.append(np.full(len(counts), len(self.lengths), np.int32))
        self.keys.append(np.array([numbers.setdefault(t, len(numbers)) for t in counts], np.int32))
        self.counts.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.lengths.append(len(found))
        self.bytes += len(text)

    def row(self, ids: pa.Array) -> list[pa.Array]:
        """The shard as one row: ids and lengths by ascending id, terms, starts of their postings, places and counts."""
        order = pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        rows, keys, counts = (np.concatenate(x) for x in (self.rows, self.keys, self.counts))
        by_term = np.lexsort((place[rows], keys))
        starts = np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=len(self.vocabulary)))])
        names = pa.array(list(self.vocabulary), pa.binary()).cast(pa.string())

        def one(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        return [
            one(ids.take(pa.array(order))),
            one(pa.array(np.array(self.lengths, np.int64)[order])),
            one(names),
            one(pa.array(starts, pa.int64())),
            one(pa.array(place[rows][by_term], pa.int32())),
            one(pa.array(counts[by_term], pa.int32())),
        ]


SHARD = "ids array<{id}>, lengths array<long>, terms array<string>, starts array<long>, places array<int>, {last} array<int>"


def _shards(batches: Iterator[pa.RecordBatch], names: list[str], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    shard, ids = Shard(), []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(shard.row(pa.concat_arrays(ids)), names)

    for b in slices(batches):
        texts = b.column(1).cast(pa.large_binary())
        for k in range(b.num_rows):
            shard.add(texts[k].as_py() or b"")
            ids.append(b.column(0).slice(k, 1))
            if len(ids) >= rows or shard.bytes >= size:
                yield out()
                shard, ids = Shard(), []
    if ids:
        yield out()


def impacts(counts: np.ndarray, lengths: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 8 * m), m = 25 + (75 * n * N) div L, for each posting."""
    if int(lengths.max(initial=0)) * 75 * documents < 1 << 63:
        m = 25 + 75 * lengths * documents // tokens
    else:
        m = np.array([25 + 75 * n * documents // tokens for n in lengths.tolist()], np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SHARD_ROWS, size: int = SHARD_BYTES) -> Index:
    """Write the index of ``docs`` in the shared folder: term counts first, then, with the corpus' totals known, impacts."""
    d = fields(docs, id=id_col, text=text_col)
    kind = dict(d.dtypes)["id"]
    columns = SHARD.format(id=kind, last="counts")
    names = [c.split()[0] for c in columns.split(", ")]
    counted = stored(d.mapInArrow(lambda bs: _shards(bs, names, rows, size), columns), "lexical-counts", file_rows=1)
    total = counted.select(F.explode("lengths").alias("n")).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    documents, tokens = total[0], int(total[1] or 0)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                lengths, places, counts = (row.column(c).flatten().to_numpy() for c in ("lengths", "places", "counts"))
                values = pa.array(impacts(counts.astype(np.int64), lengths[places], documents, max(1, tokens)), pa.int32())  # below 1,000,000
                last = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([*row.columns[:-1], last], [*names[:-1], "impacts"])

    shards = stored(counted.mapInArrow(weighed, SHARD.format(id=kind, last="impacts")), "lexical-index", file_rows=1)
    forget(counted)
    return Index(shards, documents, tokens)


def document_frequencies(index: Index, wanted: DataFrame) -> DataFrame:
    """(term, df) for the terms of ``wanted``, summed over the shards."""
    both = F.arrays_zip("terms", F.expr("slice(starts, 1, size(terms))").alias("begin"), F.expr("slice(starts, 2, size(terms))").alias("end"))
    counts = index.shards.select(F.inline(both)).toDF("term", "begin", "end").select("term", (F.col("end") - F.col("begin")).alias("df"))
    return counts.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def best(acc: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest positive values, highest first, ties by ascending place; whatever ties with the last one is looked at."""
    found = np.flatnonzero(acc > 0)
    if len(found) > k:
        least = acc[found[np.argpartition(acc[found], -k)[-k:]]].min()
        above = found[acc[found] > least]
        found = np.concatenate([above, found[acc[found] == least][: k - len(above)]])
    return found[np.lexsort((found, -acc[found]))]


def _answers(batches: Iterator[pa.RecordBatch], items: list[tuple[int, list[tuple[str, int]]]], k: int) -> Iterator[pa.RecordBatch]:
    """Each shard's best documents for each item (number, [(term, weight times repeats)])."""
    wanted = {t for _, query in items for t, _ in query}
    for b in batches:
        for row in (b.slice(j, 1) for j in range(b.num_rows)):
            ids = row.column("ids").flatten()
            starts, places, impact = (row.column(c).flatten().to_numpy() for c in ("starts", "places", "impacts"))
            own = {t: n for n, t in enumerate(row.column("terms").flatten().to_pylist()) if t in wanted}
            numbers, taken, scores = [], [], []
            for number, query in items:
                acc = np.zeros(len(ids), np.int64)
                for term, weighs in query:
                    if (n := own.get(term)) is not None:
                        part = slice(starts[n], starts[n + 1])
                        acc[places[part]] += weighs * impact[part].astype(np.int64)  # a document stands once in a term's postings
                top = best(acc, k)
                numbers.append(np.full(len(top), number))
                taken.append(top)
                scores.append(acc[top])
            cols = [pa.array(np.concatenate(numbers), pa.int64()), ids.take(pa.array(np.concatenate(taken))), pa.array(np.concatenate(scores))]
            yield pa.RecordBatch.from_arrays(cols, ["item", "doc_id", "score"])


def _parts(items: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[DataFrame]:
    """The items as (item, item_id, text) in parts of about ``size`` bytes of text; ``item`` numbers the rows."""
    named = fields(items, item_id=id_col, text=text_col).where("text is not null").withColumn("item", F.monotonically_increasing_id())
    named = stored(named, "lexical-items")  # numbers stay as they are
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // size)
    for p in range(parts):
        yield named.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == p)


def search(index: Index, items: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents for each row of ``items``."""
    spark: SparkSession = items.sparkSession
    kind = dict(index.shards.dtypes)["ids"].removeprefix("array<")[:-1]
    out = spark.createDataFrame([], f"item_id {dict(items.dtypes)[id_col]}, rank int, doc_id {kind}, score long")
    for part in _parts(items, id_col, text_col, item_bytes):
        counts = [(r["item"], Counter(t.decode() for t in terms(r.text.encode()))) for r in part.select("item", "text").toLocalIterator()]  # at most about item_bytes
        if not counts:
            continue
        wanted = spark.createDataFrame(sorted({(t,) for _, c in counts for t in c}), "term string")
        df = {r.term: r.df for r in document_frequencies(index, wanted).toLocalIterator()}
        queries = [(n, [(t, weight(index.documents, df[t]) * times) for t, times in c.items() if t in df]) for n, c in counts]
        sent = spark.sparkContext.broadcast(queries)
        found = index.shards.mapInArrow(lambda bs, sent=sent: _answers(bs, sent.value, k), f"item long, doc_id {kind}, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "lexical-found")
        sent.destroy()
        out = out.unionByName(ranked.join(part.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def ranking(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    return search(build(docs), items, **how)


RANKING_SQL = """
with q as (select item_id, t, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) as t from benchmark) group by all),
w as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) as t from documents),
p as (select doc_id, t, count(*) as tf from w group by all),
d as (select doc_id, cast(sum(tf) as bigint) as n from p group by doc_id),
g as (select count(*) as nd, cast(sum(n) as bigint) as l from d),
v as (select t, cast(floor(1000 * ln((2 * nd + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from p, g where t in (select t from q) group by t, nd),
s as (
  select item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l)))) as bigint) as score
  from q join v using (t) join p using (t) join d using (doc_id), g group by item_id, doc_id),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 10
"""
