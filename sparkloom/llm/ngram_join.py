"""N-gram Jaccard join: documents whose word n-gram sets are similar, by a prefix-tree join.

Words (ASCII letters lower-cased, split at ASCII white space) give the distinct ``SHINGLE``-word n-grams of a text,
as 64-bit hashes; a shorter text is one n-gram. Two sets link when 100 * intersection >= ``PERCENT`` * union.

One global order of n-grams runs from rare to frequent, by a fixed-size sketch of the corpus' counts (ties by hash);
any order gives the same links, a good one saves work. From its rare end come the prefixes that propose pairs: similar
sets share at least ``least_shared`` n-grams of their prefixes. From its frequent end come the tries that decide:
a group's sets are stored in a prefix tree, so that sets with equal beginnings share a path. Probes walk down it
together; the overlap with a shared path is counted once, and a subtree is left when neither the lengths of its sets
nor what a probe has left can reach the threshold. Overlaps at a set's end are exact, so links are exact.

Scale: equal sets are one node. First, sets with an equal minimum under one of ``MARKS`` hash functions meet in tries;
this is only a cheap start that joins most copies, in linear work (minima are taken over the more frequent half of a
set, which edits touch least). Then the prefixes, of which none is left out, propose every pair that may be similar and
is not joined yet, as (set, unit). A unit is a joined group of at least ``LARGE`` sets or the other sets of one minimum;
of two units the smaller one's sets probe the larger one's trie. A trie holds about ``ROOM`` n-grams; larger units are
dealt as chunks. A subtree whose sets are joined with a probe already is left too, so a task returns a spanning forest,
never all pairs of a group. Texts are read again where sets are needed instead of being shuffled or stored as sets;
components come from rounds of contraction; only the sketch and counters reach the driver.

Defined results: a text without words, or null, has the empty set and is linked with nothing; rows that repeat an id
are judged by their own text; a null id keeps its row and names a component only where all its ids are null; an empty
table gives an empty result; other columns are ignored. Sets and nodes are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import fields, forget, slices, stored

SHINGLE, PERCENT, SEED = 4, 85, 42
BUCKET_BITS, MARKS, ROOM, PROBES, LARGE = 16, 3, 1 << 20, 64, 64
#: Nodes whose texts are looked up by a broadcast of their keys (three numbers each); more are looked up by a shuffle.
BROADCAST_NODES = 500_000
_PICK = np.random.default_rng(SEED)
_TIMES = _PICK.integers(0, 1 << 64, 16, np.uint64) | np.uint64(1)
_MARKS = _PICK.integers(0, 1 << 64, (16, 1), np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def ngram_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The distinct n-gram hashes of each text, ascending. Words are cut and numbered by Arrow, each distinct one is hashed once."""
    # a copy of its own: Arrow's string kernels read a slice of a larger batch from the wrong place
    own = pc.fill_null(pc.take(texts, pa.array(np.arange(len(texts)))), "")
    lower = pc.ascii_trim_whitespace(pc.ascii_lower(own))
    words = pc.ascii_split_whitespace(lower)
    coded = words.flatten().dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    h = known[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.uint64)
    ends = np.cumsum(np.where(pc.binary_length(lower).to_numpy() > 0, pc.list_value_length(words).to_numpy(), 0))
    h = h[np.repeat(pc.binary_length(lower).to_numpy() > 0, pc.list_value_length(words).to_numpy())]  # an empty text is cut into one empty word

    def windows(h: np.ndarray, n: int) -> np.ndarray:
        total = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            total += h[k : len(h) - n + 1 + k] * _TIMES[k]
        return _mixed(total)

    every, out, start = windows(h, shingle) if len(h) >= shingle else h[:0], [], 0
    for end in ends.tolist():
        n = end - start
        out.append(np.unique(every[start : end - shingle + 1]) if n >= shingle else windows(h[start:end], n) if n else h[:0])
        start = end
    return out


def ngram_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    return ngram_sets(pa.array([text], pa.string()), shingle)[0]


def least_shared(n):
    """How many n-grams of their prefixes similar sets share at least, when the smaller one has ``n``; also for columns."""
    return 1 + (3 * n - 3 * n % 100) / 100 if not isinstance(n, int) else 1 + 3 * n // 100


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return min(n, n - -(-percent * n // 100) + least_shared(n))


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def sketch(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> np.ndarray:
    """How often the n-grams of each hash bucket occur in the corpus: a fixed number of counters, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in slices(batches):
            if b.num_rows:
                every = np.concatenate(ngram_sets(b.column(0), shingle))
                counts += np.bincount(_bucket(every), minlength=1 << BUCKET_BITS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], ["bucket", "n"])

    rows = fields(docs, text=text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def by_frequency(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set in the global order, from its rarest n-gram on."""
    return s[np.lexsort((s, counts[_bucket(s)]))]


def prefix(s: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The rarest n-grams of a set, as many as proposals need."""
    return by_frequency(s, counts)[: prefix_length(len(s), percent)]


def minima(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The least n-gram of the more frequent half of a set under each hash function."""
    return _mixed(by_frequency(s, counts)[len(s) // 2 :] * _MARKS[: max(1, MARKS)]).min(1) if len(s) else np.zeros(max(1, MARKS), np.uint64)


def signatures(docs: DataFrame, counts, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, text_key, node, n, marks, prefix) for every row; ``node`` is equal where the sets are. ``counts`` is a broadcast sketch."""
    kind = docs.schema[id_col].dataType.simpleString()

    def lists(parts: list[np.ndarray]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if b.num_rows:
                sets = ngram_sets(b.column(1), shingle)
                node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                marks = lists([minima(s, counts.value) for s in sets])
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array(node), sizes, marks, lists([prefix(s, counts.value, percent) for s in sets])],
                    ["id", "text_key", "node", "n", "marks", "prefix"],
                )

    return simhash.keyed_texts(docs, id_col, text_col).mapInArrow(run, f"id {kind}, text_key long, node long, n long, marks array<long>, prefix array<long>")


class Trie:
    """A prefix tree of sets (ascending places in the global order). A node stands for the part of a path between two branches."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.from_, self.to, self.row, self.end, self.children = sets, [0], [0], [0], [-1], [[]]
        keys = [s.astype(">u4").tobytes() for s in sets]
        path, before = [0], None
        for i in sorted(range(len(sets)), key=keys.__getitem__):
            shared, child = 0 if before is None else self._shared(sets[before], sets[i]), -1
            while self.to[path[-1]] > shared:
                child = path.pop()
            top = path[-1]
            if self.to[top] < shared:  # a branch inside the path to the set before
                new = self._node(i, self.to[top], shared, -1)
                self.children[top][-1], self.from_[child] = new, shared
                self.children[new].append(child)
                path.append(new)
                top = new
            leaf = self._node(i, shared, len(sets[i]), i)
            self.children[top].append(leaf)
            path.append(leaf)
            before = i
        self.order = [0]  # parents before children
        for k in self.order:
            self.order += self.children[k]
        self.low, self.high = [0] * len(self.row), [0] * len(self.row)
        for k in reversed(self.order):
            own = [self.to[k]] if self.end[k] >= 0 else []
            self.low[k] = min([*own, *(self.low[c] for c in self.children[k])], default=0)
            self.high[k] = max([*own, *(self.high[c] for c in self.children[k])], default=0)

    @staticmethod
    def _shared(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        other = np.flatnonzero(a[:n] != b[:n])
        return int(other[0]) if len(other) else n

    def _node(self, row: int, a: int, b: int, end: int) -> int:
        for to, value in ((self.row, row), (self.from_, a), (self.to, b), (self.end, end), (self.children, [])):
            to.append(value)
        return len(self.row) - 1

    def only_label(self, labels: np.ndarray) -> list[int | None]:
        """For each node the label that all sets below it have, None where they differ."""
        out: list[int | None] = [None] * len(self.row)
        for k in reversed(self.order):
            found = {out[c] for c in self.children[k]}
            if self.end[k] >= 0:
                found.add(int(labels[self.end[k]]))
            out[k] = found.pop() if len(found) == 1 else None
        return out


class Group:
    """The sets of one group in a trie, with labels: sets of one label are joined already."""

    def __init__(self, nodes: list[int], sets: list[np.ndarray], labels: list[int], counts: np.ndarray, percent: int = PERCENT):
        self.nodes, self.percent, self.labels, self.renamed = nodes, percent, np.array(labels, np.int64), {}
        self.words = np.unique(np.concatenate(sets))
        order = np.lexsort((self.words, -counts[_bucket(self.words)]))  # frequent ones first
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.trie = Trie([np.sort(self._places(s)[0]) for s in sets])
        self.visited = 0

    def _places(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        at = np.minimum(np.searchsorted(self.words, s), len(self.words) - 1)
        return self.rank[at[self.words[at] == s]], len(s)

    def label(self, of: int) -> int:
        while of in self.renamed:
            of = self.renamed[of]
        return of

    def links(self, nodes: list[int], sets: list[np.ndarray], labels: list[int]) -> list[tuple[int, int]]:
        step, out = max(1, min(PROBES, (64 << 20) // len(self.words))), []
        for k in range(0, len(nodes), step):
            out += self._walk(nodes[k : k + step], sets[k : k + step], np.array([self.label(x) for x in labels[k : k + step]], np.int64))
        return out

    def _walk(self, nodes: list[int], sets: list[np.ndarray], labels: np.ndarray) -> list[tuple[int, int]]:
        t, percent, out = self.trie, self.percent, []
        found = [np.sort(self._places(s)[0]) for s in sets]
        size, known = np.array([len(s) for s in sets]), np.array([len(p) for p in found])
        holds = np.zeros((len(self.words), len(sets)), bool)
        for k, p in enumerate(found):
            holds[p, k] = True
        # the places of all probes as one ascending list: how many of a probe's lie behind a place is one search away
        every, starts = np.concatenate([p + k * len(self.words) for k, p in enumerate(found)]), np.cumsum([0, *known[:-1]])
        only = t.only_label(self.labels)
        stack = [(0, np.arange(len(sets)), np.zeros(len(sets), np.int64))]
        while stack:
            node, probes, overlap = stack.pop()
            if (one := only[node]) is not None:
                keep = labels[probes] != self.label(one)
                probes, overlap = probes[keep], overlap[keep]
            if not len(probes):
                continue
            self.visited += 1
            a, b = t.from_[node], t.to[node]
            if b > a:
                part = t.sets[t.row[node]][a:b]
                overlap = overlap + (holds[part].sum(0)[probes] if 2 * len(probes) > len(sets) else holds[part[:, None], probes].sum(0))
                passed = np.searchsorted(every, probes * len(self.words) + part[-1] + 1) - starts[probes]
            else:
                passed = np.zeros(len(probes), np.int64)
            low, high, n = t.low[node], t.high[node], size[probes]
            # the most that the sets' lengths, and what the probe has left, still allow
            able = ((100 + percent) * (overlap + high - b) >= percent * (n + high)) & ((100 + percent) * (overlap + known[probes] - passed) >= percent * (n + low))
            probes, overlap = probes[able], overlap[able]
            if not len(probes):
                continue
            if (end := t.end[node]) >= 0:
                for p in probes[(100 + percent) * overlap >= percent * (size[probes] + b)].tolist():
                    if labels[p] != self.labels[end]:
                        out.append((nodes[p], self.nodes[end]))
                        old, new = int(labels[p]), int(self.labels[end])
                        self.renamed[old] = new
                        labels[labels == old] = new
                        self.labels[self.labels == old] = new
            stack += [(c, probes, overlap) for c in t.children[node]]
        return out


ROUTED = ["group", "chunk", "probe", "node", "joined", "ngrams"]


def _joined(batches: Iterator[pa.RecordBatch], counts, own: bool, percent: int) -> Iterator[pa.RecordBatch]:
    """Links of runs of equal (group, chunk); a run's sets come before its probes. ``own``: the sets probe each other."""
    at, nodes, sets, labels, group = None, [], [], [], None

    def built() -> Group | None:
        return Group(nodes, sets, labels, counts.value, percent) if nodes else None

    def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for b in batches:
        groups, chunks, probe, node, joined = (b.column(c).to_numpy(zero_copy_only=False) for c in ROUTED[:5])
        offsets = b.column("ngrams").offsets.to_numpy()
        words = b.column("ngrams").values.to_numpy().view(np.uint64)
        cuts = [0, *(np.flatnonzero((np.diff(groups) != 0) | (np.diff(chunks) != 0) | (probe[1:] != probe[:-1])) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            part = [words[offsets[k] : offsets[k + 1]] for k in range(s, e)]
            if at != (here := (groups[s], chunks[s])):
                if own and nodes:
                    yield out(built().links(nodes, sets, labels))
                at, nodes, sets, labels, group = here, [], [], [], None
            if probe[s]:
                group = group or built()
                if group is not None:
                    yield out(group.links(node[s:e].tolist(), part, joined[s:e].tolist()))
            else:
                nodes += node[s:e].tolist()
                labels += joined[s:e].tolist()
                sets += [p.copy() for p in part]  # not the whole batch
    if own and nodes:
        yield out(built().links(nodes, sets, labels))


def trie_links(members: DataFrame, probes: DataFrame | None, sets: DataFrame, counts, room: int = ROOM, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) of each group's ``members`` (group, node, n, joined) with its ``probes`` (group, node, joined); without probes with each other.

    Groups of over ``room`` n-grams are dealt as chunks. Without probes the least member stands in all chunks, so that
    copies in different chunks are joined through it; what it misses is left to the prefixes.
    """
    crowded = members.groupBy("group").agg(F.sum("n").alias("n"), F.min("node").alias("least")).where(F.col("n") > room)
    crowded = stored(crowded.select("group", F.ceil(F.col("n") / room).cast("int").alias("chunks"), "least"), "ngrams-crowded")
    own = F.pmod(F.xxhash64("node"), F.col("chunks").cast("long")).cast("int")
    every, first = F.expr("sequence(0, chunks - 1)"), F.array(F.lit(0))
    leads = (F.col("node") == F.col("least")) & F.lit(probes is None)
    placed = F.when(F.col("chunks").isNull(), first).when(leads, every).otherwise(F.array(own))
    rows = members.join(crowded, "group", "left").select("group", F.explode(placed).alias("chunk"), F.lit(False).alias("probe"), "node", "joined")
    if probes is not None:
        sent = F.when(F.col("chunks").isNull(), first).otherwise(every)
        rows = rows.unionByName(probes.join(crowded, "group", "left").select("group", F.explode(sent).alias("chunk"), F.lit(True).alias("probe"), "node", "joined"))
    routed = rows.join(sets, "node").select(*ROUTED).repartition("group", "chunk").sortWithinPartitions("group", "chunk", "probe")
    alone = probes is None
    return routed.mapInArrow(lambda bs: _joined(bs, counts, alone, percent), "a long, b long")


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, ngrams) for ``wanted`` (node, id, text_key): their texts are read and cut again, one for each node."""
    wanted = stored(wanted.select("node", F.col("id").alias("_id"), F.col("text_key").alias("_key")), "ngrams-wanted")
    few = wanted.count() <= BROADCAST_NODES
    texts = simhash.keyed_texts(docs, id_col, text_col)
    found = texts.join(F.broadcast(wanted) if few else wanted, (texts["text_key"] == wanted["_key"]) & texts["id"].eqNullSafe(wanted["_id"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = ngram_sets(b.column(1), shingle)
            flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["node", "ngrams"])

    cut = found.select("node", "text").mapInArrow(run, "node long, ngrams array<long>")
    sets = stored(cut.groupBy("node").agg(F.first("ngrams").alias("ngrams")), "ngrams-sets")
    forget(wanted)
    return sets


def _named(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return nodes.withColumn("joined", F.col("node"))
    return nodes.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").withColumn("joined", F.coalesce("root", "node")).drop("_n", "root")


def units(nodes: DataFrame) -> DataFrame:
    """Adds ``unit`` to nodes (node, joined, mark): what probes are sent to. Larger units have larger numbers; units that share one merely meet more probes."""
    sizes = nodes.groupBy("joined").agg(F.count("*").alias("size"))
    named = nodes.join(sizes, "joined").withColumn("_u", F.when(F.col("size") >= LARGE, F.xxhash64("joined")).otherwise(F.xxhash64("mark", F.lit(1))))
    rooms = named.groupBy("_u").agg(F.count("*").alias("_room"))
    low = F.col("_u").bitwiseAND(F.lit((1 << 56) - 1))
    return named.join(rooms, "_u").withColumn("unit", F.shiftleft(F.floor(F.log2("_room")), 56).bitwiseOR(low)).drop("_u", "_room", "size")


def joined_more(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after more links: only links between groups that are apart go through rounds of contraction again."""
    if roots is None:
        return simhash.components(links)
    of_a, of_b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in "ab")
    apart = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b")
    more = simhash.components(apart.distinct())
    old = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    out = stored(old.unionByName(more.join(roots.select("node"), "node", "left_anti")), "ngrams-roots")
    forget(roots, more)
    return out


def proposals(nodes: DataFrame, prefixes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, unit): sets of ``nodes`` (node, n, joined, unit) that may be similar to a set of another joined group in a larger unit, or in their own."""
    p = prefixes.join(nodes, "node").select("node", "n", "joined", "unit", F.explode("prefix").alias("ngram")).repartition("ngram")
    t = p.groupBy("ngram", F.col("unit").alias("to")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("joined").alias("a"), F.max("joined").alias("z"))
    apart = (F.col("to") >= F.col("unit")) & ((F.col("a") != F.col("joined")) | (F.col("z") != F.col("joined")))
    of_size = (F.col("high") * 100 >= F.col("n") * percent) & (F.col("low") * percent <= F.col("n") * 100)
    smallest = F.ceil(F.col("n") * percent / 100)
    shared = p.join(t, "ngram").where(apart & of_size).groupBy("node", "n", "joined", "to").agg(F.count("*").alias("shared"))
    return shared.where(F.col("shared") >= least_shared(smallest)).select("node", "joined", F.col("to").alias("unit"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, room: int = ROOM) -> DataFrame:
    """(id, text_key, n, cluster, component): one row for each input row; ``component`` is the smallest id reachable by links."""
    counts = docs.sparkSession.sparkContext.broadcast(sketch(docs, text_col, shingle))  # a fixed number of counters
    marked = stored(signatures(docs, counts, id_col, text_col, shingle, percent), "ngrams-marked")
    one = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "text_key")).alias("one")
    folded = marked.where("n > 0").groupBy("node").agg(one, F.first("n").alias("n"), F.first("marks").alias("marks"), F.first("prefix").alias("prefix"))
    nodes = stored(folded.select("node", "one.id", "one.text_key", "n", "marks", "prefix"), "ngrams-nodes")
    rows = stored(marked.select("id", "text_key", "node", "n"), "ngrams-rows")
    forget(marked)
    # copies first, by equal minima
    every = nodes.select("node", F.posexplode("marks").alias("turn", "mark")).where(F.col("turn") < MARKS)
    shared = every.groupBy("turn", "mark").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("turn", "mark")
    meets = every.join(shared, ["turn", "mark"]).select("node").distinct()
    sets = sets_of(docs, nodes.select("node", "id", "text_key").join(meets, "node", "left_semi"), id_col, text_col, shingle)
    roots = None
    for turn in range(MARKS):
        here = _named(nodes.select("node", "n", F.col("marks")[turn].alias("group")), roots)
        apart = here.groupBy("group").agg(F.min("joined").alias("a"), F.max("joined").alias("z")).where("a <> z").select("group")
        members = stored(here.join(apart, "group").select("group", "node", "n", "joined"), "ngrams-members")
        if members.isEmpty():
            continue
        links = stored(trie_links(members, None, sets, counts, room, percent), "ngrams-links")
        roots = joined_more(roots, links)
        forget(members, links)
    forget(sets)
    # then whatever the prefixes propose
    whole = stored(units(_named(nodes.select("node", "id", "text_key", "n", F.col("marks")[0].alias("mark")), roots)), "ngrams-joined")
    asked = stored(proposals(whole.select("node", "n", "joined", "unit"), nodes.select("node", "prefix"), percent), "ngrams-proposals")
    if not asked.isEmpty():
        members = stored(whole.join(asked.select("unit").distinct(), "unit", "left_semi").select(F.col("unit").alias("group"), "node", "n", "joined"), "ngrams-members")
        needed = members.select("node").unionByName(asked.select("node")).distinct()
        sets = sets_of(docs, whole.select("node", "id", "text_key").join(needed, "node", "left_semi"), id_col, text_col, shingle)
        links = stored(trie_links(members, asked.withColumnRenamed("unit", "group"), sets, counts, room, percent), "ngrams-links")
        roots = joined_more(roots, links)
        forget(members, sets, links)
    forget(whole, asked)
    if roots is None:
        roots = docs.sparkSession.createDataFrame([], "node long, root long")
    named = nodes.select("node", F.col("id").alias("least")).join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("cluster"))
    ids = named.groupBy("cluster").agg(F.min("least").alias("component"))
    by_node = stored(named.join(ids, "cluster").select("node", "cluster", "component"), "ngrams-by-node")
    forget(nodes, roots)
    found = rows.join(by_node, "node", "left")
    return found.select("id", "text_key", "n", "cluster", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component"))
