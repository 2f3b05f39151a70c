"""Near-duplicate documents by SimHash and pigeonhole blocks.

A document's words (ASCII letters lower-cased, split at ASCII white space) give ``shingle``-word shingles; each
is hashed by XXH64, and a fingerprint bit is 1 if it is set in over half the hashes. Two fingerprints link when
they differ in at most ``distance`` bits. The 64 bits are cut into ``blocks`` blocks: a pair within the distance
agrees on at least ``blocks - distance`` of them, so it meets under the key of some such set of blocks. Pairs
that meet are verified by their Hamming distance.

Scale: equal fingerprints are folded into one node before any pairing, so copies never multiply. The keys of 3
of 7 blocks are 27 bits wide, hence sparse also for very many documents. A key with over ``hot`` fingerprints is
dealt as pairs of chunks over many tasks, and a task returns a spanning forest of what it links, never all pairs
of a group. Components come from rounds of contraction; nothing but counters reaches the driver.

Defined results: null or empty text (no words) has fingerprint 0 and links like any other; repeated rows keep
one output row each, and rows that repeat an id with another text are judged by their own text; a null id keeps its row and never names a component unless no other id exists (then null);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, forget, stored

BLOCKS, DISTANCE, SHINGLE, SEED = 7, 4, 4, 42
HOT, CHUNK, SMALL = 2048, 1024, 8


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    view, digest, total = memoryview(joined), xxhash.xxh64_intdigest, len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    for k in range(0, total, 1 << 16):  # a very long text in bounded pieces
        m = min(total, k + (1 << 16))
        hashes = np.fromiter(
            (digest(view[a : b - 1], seed) for a, b in zip(starts[k:m], ends[k + shingle - 1 : m + shingle - 1], strict=True)), np.dtype("<u8"), m - k
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def distinct_texts(rows: list[tuple[str, int]], distance: int = DISTANCE) -> list[tuple[str, int]]:
    """(text, label) rows without near copies: of texts whose fingerprints chain within ``distance`` bits under one label, the first.

    For bounded samples on the driver; whole texts are compared, and never across labels.
    """
    out = []
    for y in sorted({y for _, y in rows}):
        texts = list(dict.fromkeys(t for t, c in rows if c == y))
        f = np.array([fingerprint(t) for t in texts], np.uint64)
        rest = np.arange(len(f))
        while rest.size:
            out.append((texts[rest[0]], y))
            front, rest = [rest[0]], rest[1:]
            while front and rest.size:
                near = np.bitwise_count(f[rest] ^ f[front.pop()]) <= distance
                front += rest[near].tolist()
                rest = rest[~near]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, text_key, fp) for every row; ``fp`` holds the 64 bits as a signed long, ``text_key`` tells texts of one id apart."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp, pa.int64())], ["id", "text_key", "fp"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, f"id {kind}, text_key long, fp long")


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, text_key): a null text counts as an empty one."""
    return fields(docs, id=id_col, text=text_col).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """A mask for each set of blocks that some close pair may share (as signed longs)."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(bits, blocks - distance))]


def forest(f: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all members of ``f`` which are linked directly or through other members."""
    a, b = [], []
    rest = np.arange(len(f))
    while rest.size:
        front, rest = [int(rest[0])], rest[1:]
        while front and rest.size:
            x = front.pop()
            near = np.bitwise_count(f[rest] ^ f[x]) <= distance
            if near.any():
                new = rest[near]
                a.append(np.full(len(new), f[x]))
                b.append(f[new])
                front.extend(new.tolist())
                rest = rest[~near]
    none = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _linked(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Verified links inside runs of equal (mask number, key, chunk pair); the rows come sorted by these."""
    carry: list[np.ndarray] | None = None

    def out(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        n, key, pair, fp = cols
        if not len(fp):
            return None
        f = fp.view(np.uint64)
        cut = np.flatnonzero((np.diff(n) != 0) | (np.diff(key) != 0) | (np.diff(pair) != 0)) + 1
        starts = np.concatenate([[0], cut])
        sizes = np.diff(np.concatenate([starts, [len(f)]]))
        left, right = [], []
        small = np.repeat(sizes, sizes) <= SMALL
        group = np.repeat(np.arange(len(sizes)), sizes)
        for lag in range(1, SMALL):
            if lag >= len(f):
                break
            ok = (group[lag:] == group[:-lag]) & small[lag:] & (np.bitwise_count(f[lag:] ^ f[:-lag]) <= distance)
            left.append(f[:-lag][ok])
            right.append(f[lag:][ok])
        for s, m in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            x, y = forest(f[s : s + m], distance)
            left.append(x)
            right.append(y)
        x, y = (np.concatenate(z) if z else np.empty(0, np.uint64) for z in (left, right))
        x, y = np.minimum(x.view(np.int64), y.view(np.int64)), np.maximum(x.view(np.int64), y.view(np.int64))
        if len(x):
            x, y = np.unique(np.stack([x, y]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if carry is not None:
            cols = [np.concatenate(p) for p in zip(carry, cols, strict=True)]
        change = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1])) if len(cols[0]) else np.empty(0, int)
        end = int(change[-1]) + 1 if len(change) else 0
        carry = [c[end:] for c in cols]
        if (b := out([c[:end] for c in cols])) is not None and b.num_rows:
            yield b
    if carry is not None and (b := out(carry)) is not None and b.num_rows:
        yield b


def close_links(nodes: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that keep every chain of close pairs."""
    masks = block_masks(blocks, distance)
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("n", "key"))
    crowded = keyed.groupBy("n", "key").agg(F.count("*").alias("size")).where(F.col("size") > hot)
    crowded = stored(crowded.withColumn("chunks", F.ceil(F.col("size") / chunk).cast("int")).drop("size"), "simhash-crowded")
    if crowded.isEmpty():
        dealt = keyed.select("n", "key", F.lit(0).alias("pair"), "fp")
    else:
        # a left join: Spark broadcasts the few crowded keys when they are small and splits skewed partitions otherwise
        own = F.pmod(F.xxhash64("fp"), F.col("chunks").cast("long")).cast("int")
        other = F.expr("sequence(0, chunks - 1)")
        pairs = F.transform(other, lambda j: F.least(j, own) * F.col("chunks") + F.greatest(j, own))
        dealt = keyed.join(crowded, ["n", "key"], "left").select(
            "n", "key", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("pair"), "fp"
        )
    ordered = dealt.repartition("n", "key", "pair").sortWithinPartitions("n", "key", "pair")
    return ordered.mapInArrow(lambda bs: _linked(bs, distance), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): equal roots mean the same component.

    Each round, every node moves to its neighbour (or itself) of least hash; links are renamed and those that
    became loops vanish. A constant share of nodes goes each round in expectation, whatever the order of ids.
    """
    links = stored(links.distinct(), "simhash-links")
    names, turn = None, 0
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = F.xxhash64(F.lit(turn), F.col("b"))
        best = both.groupBy("a").agg(F.min(F.struct(order.alias("h"), F.col("b").alias("b"))).alias("m"))
        own = F.struct(F.xxhash64(F.lit(turn), F.col("a")).alias("h"), F.col("a").alias("b"))
        moved = stored(best.select(F.col("a").alias("node"), F.least(F.col("m"), own)["b"].alias("root")), "simhash-moved")
        step = moved.withColumnRenamed("root", "to")
        renamed = (
            links.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        rest = stored(renamed, "simhash-links")
        if names is None:
            forget(links)
            names = moved
        else:
            joined = names.join(step.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            named = stored(joined, "simhash-names")
            forget(links, moved, names)
            names = named
        links = rest
        turn += 1
    if names is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    forget(links)
    return names


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, text_key, fp, cluster, component): one row for each input row.

    ``component`` is the smallest id reachable by links; ``cluster`` names the component whatever its ids are.
    """
    marked = stored(fingerprints(docs, id_col, text_col), "simhash-fp")
    nodes = stored(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    roots = components(close_links(nodes.select("fp"), **how))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("cluster"))
    ids = stored(named.groupBy("cluster").agg(F.min("least").alias("component")), "simhash-components")
    by_fp = stored(named.join(ids, "cluster").select("fp", "cluster", "component"), "simhash-by-fp")
    forget(nodes, ids, roots)
    return marked.join(by_fp, "fp").select("id", "text_key", "fp", "cluster", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group (see ``keep_first``)."""
    return keep_first(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each cluster that ``found`` (id, text_key, cluster, component) names.

    The row of the least id stays; where this id has several texts in the cluster, that of the least ``text_key``;
    of rows equal in id and text, the least by its other columns (maps aside). Rows without an id cannot be named as
    copies and stay. So every cluster stays represented, also where ids repeat with texts of different clusters.

    Only keys are shuffled for the common rows: what goes is found first and removed by an anti-join.
    """
    found = stored(found.where("id is not null").select("id", "text_key", "cluster", "component"), "simhash-found")
    # one row for each kept text; a cluster of any size is reduced before it is shuffled
    first = found.where("id = component").groupBy("cluster").agg(F.min("text_key").alias("first_key"))
    texts = found.groupBy("cluster", "id", "text_key", "component").agg(F.count("*").alias("rows"))
    texts = stored(texts.join(first, "cluster").select("id", "text_key", (F.expr("id = component") & (F.col("text_key") == F.col("first_key"))).alias("stays"), "rows"), "simhash-texts")
    text_key = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))

    def among(rows: DataFrame, how: str, left: DataFrame) -> DataFrame:
        rows = rows.select(F.col("id").alias("_id"), F.col("text_key").alias("_key"))
        return left.join(rows, (left[f"`{id_col}`"] == rows["_id"]) & (text_key == rows["_key"]), how)

    rest = among(texts.where("not stays"), "left_anti", docs)
    again = stored(texts.where("stays and rows > 1").select("id", "text_key"), "simhash-again")
    if not again.isEmpty():
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        order = F.struct(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
        repeated = among(again, "left_semi", rest)
        keys = [F.col(f"`{id_col}`").alias("_id"), text_key.alias("_key")]
        one = repeated.groupBy(*keys).agg(F.min_by(whole, order).alias("_row")).select("_row.*")
        rest = among(again, "left_anti", rest).unionByName(one)
    return rest.select(*[F.col(f"`{c}`") for c in docs.columns])
