"""Benchmark passages inside training documents, by BM25 over an inverted index of the test items.

The index holds the test items: for each word the items that hold it, with the BM25 impact of the word in the
item, in blocks of items with the greatest impact of each block. Training documents are read as overlapping
windows of words, long enough that every item lies whole inside one; each window queries the index by block-max
WAND, which skips blocks of items whose summed maxima cannot reach their thresholds.

Block-max WAND: the lists are kept in order of their next item; the pivot is the first list at which the summed
greatest impacts of the lists up to it reach the least threshold that an item still to come may have. Items before
the pivot cannot reach theirs and are jumped over. If the block maxima at the pivot fall short of the block's least
threshold, the walk jumps behind the nearest block end; otherwise the lists before the pivot move up to it, and
an item at which they all stand is scored whole.

The threshold of an item follows from what is verified afterwards. An item is a question and an answer (its last
sentence, or its last third of words where it is one sentence). It counts as found when, of the ``shingle``-word
shingles of either part, at least ``overlap`` occur in the document's window. Each missing word breaks at least
one shingle, so a window that would pass lacks at most ``floor((1 - overlap) * shingles)`` words of a part: the
item's whole score less its greatest such impacts is a bound that no true find falls below.

Before the walk over postings, a window is admitted only if the impacts of its rare words (in few items) leave
some item reachable when all its common words are granted. This is the same bound, taken for a whole window
at once, and decides nearly all windows without touching a posting of a common word. An item that common words
alone could reach has an anchor instead: of its words, the ones in fewest items that together outweigh what it may
miss, so a find holds one of them, and only windows with such a word are admitted for it.

Defined results: words are lower-cased runs of letters and digits; null or empty texts hold nothing; null or
wordless items are never found; equal items are all reported; rows that repeat an id are one document with several
rows; an empty corpus or benchmark gives no finds; other columns are ignored; filtering keeps every row without a
find, with all its columns. The benchmark is the small side: it is sent in parts whose bytes are checked
(``MAX_ITEMS_BYTES``), of items of like length. A benchmark of one part, the rule, is one step over the rows. Of more
parts each is a job of its own over the corpus: its finds are written and its broadcast is destroyed before the next
part goes out, so a task holds one index in one worker, however many parts there are; the rows meet their finds last.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields, slices, stored
from .licenses import words_of

K1, B, BLOCK, RARE = 1.2, 0.75, 32, 3
SHINGLE, OVERLAP = 5, 0.8
MAX_ITEMS_BYTES = 32 << 20
SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def normal_words(text: str | None) -> list[bytes]:
    return words_of((text or "") if (text or "").isascii() else text.lower())


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of the question and of the answer."""
    parts = [w for w in (normal_words(p) for p in SENTENCE.split(text)) if w]
    if not parts:
        return [], []
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    cut = max(1, len(parts[0]) * 2 // 3)
    return parts[0][:cut], parts[0][cut:]


def shingles(words: list[bytes], n: int = SHINGLE) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


class ItemIndex:
    """Inverted index of the items with block maxima."""

    def __init__(self, items: list[tuple[int, str]], shingle: int = SHINGLE, overlap: float = OVERLAP):
        self.n, self.overlap = shingle, overlap
        self.ids, self.parts, self.lengths, bags = [], [], [], []
        for item_id, text in sorted(items, key=lambda x: (len(normal_words(x[1])), x[0])):  # blocks of like length
            q, a = question_answer(text or "")
            if not q and not a:
                continue
            self.ids.append(item_id)
            self.parts.append((q, a))
            bag: dict[bytes, int] = defaultdict(int)
            for w in q + a:
                bag[w] += 1
            bags.append(bag)
            self.lengths.append(len(q) + len(a))
        mean = sum(self.lengths) / max(1, len(self.lengths))
        df: dict[bytes, int] = defaultdict(int)
        for bag in bags:
            for w in bag:
                df[w] += 1
        self.term: dict[bytes, int] = {w: k for k, w in enumerate(sorted(df))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.term]
        self.threshold = np.zeros(len(self.ids))
        common = np.zeros(len(self.ids))
        rare: list[tuple[int, int, float]] = []
        weighed: list[list[tuple[int, bytes, float]]] = []
        for i, bag in enumerate(bags):
            norm = K1 * (1 - B + B * self.lengths[i] / mean)
            impacts = []
            weighed.append([])
            for w, tf in bag.items():
                x = math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + norm)
                postings[self.term[w]].append((i, x))
                impacts.append(x)
                weighed[i].append((df[w], w, x))
                if df[w] <= RARE:
                    rare.append((self.term[w], i, x))
                else:
                    common[i] += x
            missing = sum(math.floor((1 - overlap) * len(shingles(p, shingle)) + 1e-9) for p in self.parts[i])
            self.threshold[i] = sum(impacts) - sum(sorted(impacts, reverse=True)[:missing])
        self.postings = [(np.array([i for i, _ in p]), np.array([x for _, x in p])) for p in postings]
        # blocks of consecutive items: the greatest impact in each block that a word reaches
        self.blocks = [{int(b): float(x[(i // BLOCK) == b].max()) for b in np.unique(i // BLOCK)} for i, x in self.postings]
        count = -(-len(self.ids) // BLOCK)
        self.block_least = [float(self.threshold[b * BLOCK : (b + 1) * BLOCK].min()) for b in range(count)]
        # an item that common words alone could reach: its words in fewest items, until those left out cannot reach the threshold
        for i in np.flatnonzero(self.threshold - common - 1e-9 <= 0).tolist():
            left = sum(x for *_, x in weighed[i])
            rare = [r for r in rare if r[1] != i]
            for _, w, x in sorted(weighed[i]):
                if left < self.threshold[i] - 1e-9:
                    break
                rare.append((self.term[w], i, x))
                left -= x
            common[i] = left
        rare.sort()
        self.rare_start = np.searchsorted([t for t, *_ in rare], np.arange(len(self.term) + 1))
        self.rare_item = np.array([i for _, i, _ in rare], np.int64)
        self.rare_impact = np.array([x for *_, x in rare])
        self.rare_need = self.threshold - common - 1e-9
        self.most = [float(x.max()) for _, x in self.postings]
        # the least threshold of an item and all behind it
        self.least_behind = np.minimum.accumulate(self.threshold[::-1])[::-1] if self.ids else np.empty(0)
        self.reach = max(self.lengths, default=0)

    def windows(self, n_words: int) -> Iterator[tuple[int, int]]:
        """Windows of twice the longest item, half overlapping: each run of that many words lies inside one."""
        step = max(8, self.reach)
        for s in range(0, max(1, n_words - step), step):
            yield s, min(n_words, s + 2 * step)

    def admitted(self, terms: np.ndarray) -> list[tuple[int, int]]:
        """The windows of a document in which some item stays reachable by the rare words there."""
        step = max(8, self.reach)
        count = max(1, -(-(len(terms) - step) // step))
        at = np.flatnonzero(terms >= 0)
        at = at[self.rare_start[terms[at] + 1] > self.rare_start[terms[at]]]
        if not len(at):
            return []
        t = terms[at]
        lens = self.rare_start[t + 1] - self.rare_start[t]
        flat = np.repeat(self.rare_start[t] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        pos, item, gain = np.repeat(at, lens), self.rare_item[flat], self.rare_impact[flat]
        word = np.repeat(t, lens)
        w = pos // step
        # a place lies in window w (its first half) and in window w - 1 (its second half)
        win = np.concatenate([w, w - 1])
        item, gain, word = np.tile(item, 2), np.tile(gain, 2), np.tile(word, 2)
        ok = (win >= 0) & (win < count)
        win, item, gain, word = win[ok], item[ok], gain[ok], word[ok]
        key = (win * len(self.ids) + item) * len(self.term) + word
        _, first = np.unique(key, return_index=True)  # a word counts once in a window
        pair = win[first] * len(self.ids) + item[first]
        pairs, where = np.unique(pair, return_inverse=True)
        total = np.bincount(where, gain[first])
        good = np.unique(pairs[total >= self.rare_need[pairs % len(self.ids)]] // len(self.ids))
        return [(s, min(len(terms), s + 2 * step)) for s in (good * step).tolist()]

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose score for these distinct words reaches their own threshold."""
        lists = [[int(self.postings[t][0][0]), 0, t] for t in terms]  # (next item, cursor, word)
        out, end = [], len(self.ids)

        def move(entry: list[int], item: int) -> None:
            items = self.postings[entry[2]][0]
            entry[1] = int(np.searchsorted(items, item))
            entry[0] = int(items[entry[1]]) if entry[1] < len(items) else end

        while True:
            lists.sort()
            while lists and lists[-1][0] == end:
                lists.pop()
            if not lists:
                return out
            reach, pivot, least = 0.0, None, self.least_behind[lists[0][0]] - 1e-9
            for k, (_, _, t) in enumerate(lists):
                reach += self.most[t]
                if reach >= least:
                    pivot = k
                    break
            if pivot is None:  # no item still to come can reach its threshold
                return out
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            here = sum(self.blocks[t].get(block, 0.0) for _, _, t in lists[: pivot + 1])
            if here + 1e-9 < self.block_least[block]:
                # lists behind the pivot begin later: up to there, or to the block's end, nothing can reach its threshold
                jump = min((block + 1) * BLOCK, lists[pivot + 1][0] if pivot + 1 < len(lists) else end)
                for entry in lists[: pivot + 1]:
                    move(entry, max(jump, item + 1))
            elif lists[0][0] == item:
                score = 0.0
                for entry in lists[: pivot + 1]:
                    score += float(self.postings[entry[2]][1][entry[1]])
                    move(entry, item + 1)
                if score + 1e-9 >= self.threshold[item]:
                    out.append((item, score))
            else:
                for entry in lists[:pivot]:
                    if entry[0] < item:
                        move(entry, item)

    def finds(self, text: str | None) -> list[tuple[int, int, int, float, float, float]]:
        """(item id, first word, last word of the window, score, question overlap, answer overlap) of each item found, best window each."""
        words = normal_words(text)
        if not words or not self.ids:
            return []
        get = self.term.get
        terms = np.array([get(w, -1) for w in words], np.int64)
        best: dict[int, tuple] = {}
        for s, e in self.admitted(terms):
            here = np.unique(terms[s:e])
            hits = self.retrieve(here[here >= 0].tolist())
            if not hits:
                continue
            there = shingles(words[s:e], self.n)
            joined = b" " + b" ".join(words[s:e]) + b" "
            for item, score in hits:
                q, a = (self._share(p, there, joined) for p in self.parts[item])
                if min(q, a) >= self.overlap - 1e-9 and (item not in best or (q + a) > sum(best[item][4:])):
                    best[item] = (self.ids[item], s, e - 1, score, q, a)
        return sorted(best.values())

    def _share(self, part: list[bytes], there: set, joined: bytes) -> float:
        if not part:
            return 1.0
        if len(part) < self.n:  # too short for a shingle: the whole sequence
            return float(b" " + b" ".join(part) + b" " in joined)
        mine = shingles(part, self.n)
        return len(mine & there) / len(mine)


def benchmark_parts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items, in parts of at most ``MAX_ITEMS_BYTES`` (one item at least): the driver holds one part at a time."""
    items = fields(benchmark, id=id_col, text=text_col).where("id is not null and text is not null").distinct()
    part, size = [], 0
    for r in items.orderBy(F.octet_length("text"), "id", "text").toLocalIterator():
        more = len(r["text"].encode("utf-8", "surrogatepass"))
        if part and size + more > MAX_ITEMS_BYTES:
            yield part
            part, size = [], 0
        part.append((r["id"], r["text"]))
        size += more
    if part:
        yield part


@lru_cache(maxsize=1)
def _index(key: str, part: Broadcast) -> ItemIndex:
    """One for each worker process and part; ``key`` names the part."""
    return ItemIndex(part.value)


class SentPart:
    """A part of the benchmark on its way to the workers."""

    def __init__(self, docs: DataFrame, part: list[tuple[int, str]]):
        self.key, self.sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(part)

    def index(self) -> ItemIndex:
        return _index(self.key, self.sent)


FOUND = "item_id long, first_word long, last_word long, score double, question_overlap double, answer_overlap double"


def _finds(docs: DataFrame, part: SentPart, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, ``FOUND``): a row for each find of an item of one part."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "text_key", *(c.split()[0] for c in FOUND.split(", "))]
    kinds = [pa.int64()] * 3 + [pa.float64()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = part.index()
        for b in batches:
            rows, take = [], []
            for k, t in enumerate(b.column(2)):
                for f in index.finds(t.as_py()):
                    rows.append(f)
                    take.append(k)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names)

    return fields(docs, id=id_col, text=text_col).select("id", text_key(F.col("text")), "text").mapInArrow(run, f"doc_id {kind}, text_key long, {FOUND}")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key")


def in_turns(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[SentPart | None, DataFrame | None]:
    """The only part of a benchmark, or of several the finds (doc_id, text_key, ``FOUND``), each part's written before the next is sent."""
    parts = benchmark_parts(benchmark)
    first, second = next(parts, None), next(parts, None)
    if second is None:
        return (SentPart(docs, first) if first is not None else None), None
    found = []
    for part in chain([first, second], parts):
        sent = SentPart(docs, part)
        found.append(stored(_finds(docs, sent, id_col, text_col), "leaks-found"))
        sent.sent.destroy()
    return None, reduce(DataFrame.unionByName, found)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, last_word, score, question_overlap, answer_overlap): a row for each find."""
    one, found = in_turns(docs, benchmark, id_col, text_col)
    if found is None:
        kind = docs.schema[id_col].dataType.simpleString()
        found = _finds(docs, one, id_col, text_col) if one is not None else docs.sparkSession.createDataFrame([], f"doc_id {kind}, text_key long, {FOUND}")
    return found.drop("text_key")


VERDICT = "contaminated boolean, n_items long, item_ids array<long>, best_score double"


def verdicts(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, best_score) for every row of ``docs``; with a benchmark of one part, without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "contaminated", "n_items", "item_ids", "best_score"]
    one, found = in_turns(docs, benchmark, id_col, text_col)
    rows = fields(docs, doc_id=id_col, text=text_col)
    if one is None:
        none = docs.sparkSession.createDataFrame([], f"doc_id {kind}, text_key long, {FOUND}")
        items = (none if found is None else found).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("score").alias("score"))
        joined = rows.join(items, rows["doc_id"].eqNullSafe(items["_id"]) & (text_key(rows["text"]) == items["_key"]), "left")
        n = F.coalesce(F.size("items"), F.lit(0)).cast("long")
        return joined.select("doc_id", F.col("items").isNotNull().alias("contaminated"), n.alias("n_items"), F.coalesce("items", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("score", F.lit(0.0)).alias("best_score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = one.index()
        for b in batches:
            found = [index.finds(t.as_py()) for t in b.column(1)]
            items = [sorted({x[0] for x in f}) for f in found]
            best = [max((x[3] for x in f), default=0.0) for f in found]
            cols = [pa.array([bool(i) for i in items]), pa.array([len(i) for i in items], pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(best, pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    return rows.mapInArrow(run, f"doc_id {kind}, {VERDICT}")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    one, found = in_turns(docs, benchmark, id_col, text_col)
    if found is not None:
        keys = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
        return docs.join(keys, docs[f"`{id_col}`"].eqNullSafe(keys["_id"]) & (text_key(docs[f"`{text_col}`"]) == keys["_key"]), "left_anti")
    if one is None:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = one.index()
        for b in slices(batches):
            yield b.filter(pa.array([not index.finds(t.as_py()) for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
