"""Byte-pair encoding and decoding with a pair occurrence index.

The distinct chunks (runs between white space) of a part of the rows are laid out as one array of symbols. An
index holds, for each adjacent pair that the vocabulary can merge, all its positions; active ranks are taken in
ascending order from a heap, all places of a pair are merged at once, and the lists of the pairs that appear
beside them are updated. Pairs never cross a word, so this gives each word what one-word-at-a-time merging gives.

Texts are processed whole. Chunks repeat a lot, so each is encoded once for a table of at most ``table_size``
entries (more only while the texts of one slice use more); when it is full, what few slices used goes: memory is bounded whatever the input. Case, composed forms and classes of letters beyond Latin come from the
library's own normalizer and splitter, since Unicode tables differ between engines; merging is done here.

Defined results: null and empty text have no ids and decode to the empty string; repeated rows give equal
results; an empty table gives an empty one; other columns are ignored. A vocabulary whose merges use a symbol
before its own merge is refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import fields, gathered

#: White space of Unicode, at which texts fall apart, and what engines see differently.
BLANK = pa.scalar(" ", pa.large_string())
SPACE = regex.compile(r"\p{White_Space}+")
ODD_SPACE = "[\\x1c-\\x1f\\x85]"
#: Anything but the characters whose case, form and class Python and the tokenizers library see alike.
STRANGE = r"[^\x20-\x{24f}\x{2010}-\x{2027}\x{300}-\x{36f}]"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones stand for themselves."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A vocabulary file of the tokenizers library with words that end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.tokens.update({i: t for t, i in self.added.items()})
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.lines = regex.compile(f"{self.pattern.pattern}|\\n")
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        size = max(self.tokens) + 1
        self.size = size
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made: dict[int, int] = {}
        pairs, results = np.empty(len(merges), np.int64), np.empty(len(merges), np.int64)
        for rank, (a, b) in enumerate(merges):
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            if max(made.get(x, -1), made.get(y, -1)) >= rank:
                raise ValueError(f"merge {rank} uses a symbol before it is made")
            made.setdefault(z, rank)
            pairs[rank], results[rank] = x * size + y, z
        order = np.argsort(pairs, kind="stable")
        self.sorted_pairs, self.sorted_ranks = pairs[order], order
        self.pairs, self.results = pairs, results
        letters = byte_letters()
        self.byte_id = np.array([self.ids[c] for c in letters], np.int64)
        self.last_id = np.array([self.ids[c + self.suffix] for c in letters], np.int64)
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.path, self._steps = path, None

    def split(self, chunk: str) -> list[bytes]:
        """The words of a chunk as the library's own normalizer and splitter give them; for letters that engines may see differently."""
        if self._steps is None:
            from tokenizers import Tokenizer

            lib = Tokenizer.from_file(self.path)
            self._steps = lib.normalizer, lib.pre_tokenizer
        form, cut = self._steps
        return [bytes(self.byte_of[c] for c in word) for word, _ in cut.pre_tokenize_str(form.normalize_str(chunk))]

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        at = np.minimum(np.searchsorted(self.sorted_pairs, pairs), len(self.sorted_pairs) - 1)
        return np.where(self.sorted_pairs[at] == pairs, self.sorted_ranks[at], -1)


def _distinct(lists: list[np.ndarray]) -> np.ndarray:
    """The distinct values in ascending order; for short arrays quicker than numpy's own."""
    x = np.concatenate(lists)
    x.sort()
    first = np.empty(len(x), bool)
    first[:1] = True
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def merge_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the ids of all words in order, and where each word's ids end."""
    lengths = np.array([len(w) for w in words], np.int64)
    if not len(words) or not lengths.sum():
        return np.empty(0, np.int64), np.zeros(len(words), np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    n, stops = len(raw), np.cumsum(lengths)
    sym = v.byte_id[raw].copy()
    last = stops[lengths > 0] - 1
    sym[last] = v.last_id[raw[last]]
    following = np.arange(1, n + 1)
    following[last] = -1
    before = np.arange(-1, n - 1)
    before[np.concatenate([[0], last[:-1] + 1])] = -1
    alive = np.ones(n, bool)

    places: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def note(at: np.ndarray) -> None:
        """Add the pairs that start at these places to the index."""
        at = at[following[at] >= 0]
        if not len(at):
            return
        rank = v.ranks(sym[at] * v.size + sym[following[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.flatnonzero(np.diff(rank)) + 1
        firsts = [0, *cut.tolist(), len(at)]
        for s, e in zip(firsts, firsts[1:], strict=False):
            r = int(rank[s])
            if r not in places:
                places[r] = []
                heapq.heappush(heap, r)
            places[r].append(at[s:e])

    note(np.arange(n))
    while heap:
        r = heapq.heappop(heap)
        lists = places.pop(r)
        at = lists[0] if len(lists) == 1 else _distinct(lists)
        left, right = divmod(int(v.pairs[r]), v.size)
        nxt = following[at]
        ok = alive[at] & (sym[at] == left) & (nxt >= 0)
        at, nxt = at[ok], nxt[ok]
        ok = sym[nxt] == right
        at, nxt = at[ok], nxt[ok]
        if left == right and len(at) > 1:  # in a run of equal symbols every second place, from the left
            at, first = np.unique(at, return_index=True)
            nxt = nxt[first]
            linked = np.concatenate([[False], nxt[:-1] == at[1:]])
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
            at, nxt = at[run % 2 == 0], nxt[run % 2 == 0]
        if not len(at):
            continue
        sym[at] = v.results[r]
        alive[nxt] = False
        beyond = following[nxt]
        following[at] = beyond
        inner = beyond >= 0
        before[beyond[inner]] = at[inner]
        prior = before[at]
        note(_distinct([at, prior[prior >= 0]]))
    keep = np.flatnonzero(alive)
    return sym[keep], np.searchsorted(keep, stops)


class Lists:
    """Lists of ids, end to end: the k-th is ``flat[ends[k - 1]:ends[k]]``."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths.astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def take(self, which: np.ndarray) -> Lists:
        n = self.lengths[which]
        before = np.cumsum(n) - n
        small = np.int32 if max(len(self.flat), int(n.sum())) < 1 << 31 else np.int64
        at = np.repeat((self.starts[which] - before).astype(small), n)
        at += np.arange(len(at), dtype=small)
        return Lists(self.flat[at], n)

    def grouped(self, counts: np.ndarray) -> Lists:
        """Neighbours joined: the first ``counts[0]`` lists, then the next ``counts[1]``, and so on."""
        ends = np.concatenate([[0], np.cumsum(self.lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return Lists(self.flat, np.diff(ends))

    def int32(self) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(self.lengths)]), pa.int32()), pa.array(self.flat.astype(np.int32)))

    def arrow(self, values: pa.Array) -> pa.Array:
        """Lists of the values that the ids name."""
        offsets = pa.array(np.concatenate([[0], np.cumsum(self.lengths)]), pa.int64())
        return pa.LargeListArray.from_arrays(offsets, values.take(pa.array(self.flat)))


class Encoder:
    """Encodes texts, keeping what it knows of chunks in a table of bounded size.

    The table is Arrow columns by chunk number (ids, decimal ids joined by spaces, tokens joined by spaces), so a
    text is a list of chunk numbers, and its ids and strings are gathered and joined outside Python.
    """

    def __init__(self, v: Vocabulary, table_size: int = 400_000):
        self.v, self.table_size = v, table_size
        self.decimal = pa.array([str(i) for i in range(v.size)], pa.large_string())
        self.token = pa.array([v.tokens.get(i, "") for i in range(v.size)], pa.large_string())
        self.known = pa.array([], pa.string())
        self.ids = Lists(np.empty(0, np.int32), np.empty(0, np.int64))
        self.uses = np.empty(0, np.int64)
        self.strings = [pa.array([], pa.large_string())] * 2  # decimal ids, tokens

    def _cut(self, text: str) -> list[str]:
        """The chunks of a text that holds added tokens or odd white space; an added token is a chunk marked by a leading NUL pair."""
        v, out, parts = self.v, [], [(text, None)]
        if v.special is not None and "<" in text and (found := list(v.special.finditer(text))):
            parts, at = [], 0
            for m in found:
                parts += [(text[at : m.start()], None), ("", m[0])]
                at = m.end()
            parts.append((text[at:], None))
        for plain, added in parts:
            out += ["\0\0" + added] if added is not None else [p for p in SPACE.split(plain) if p]
        return out

    def _words(self, words: list[bytes]) -> Lists:
        ids, ends = merge_words(words, self.v)
        return Lists(ids.astype(np.int32), np.diff(ends, prepend=0))

    def _chunk_ids(self, chunks: pa.Array) -> Lists:
        """The ids of distinct chunks: white space is gone, letters may be of either case."""
        strange = pc.match_substring_regex(chunks, STRANGE).to_numpy(zero_copy_only=False)
        plain = chunks.filter(pa.array(~strange))
        text = "\n".join(plain.to_pylist())
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        coded = pa.array([*self.v.lines.findall(text.lower()), "\n"] if len(plain) else [], pa.string()).dictionary_encode()
        words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        stop = np.array([w == "\n" for w in words], bool)
        ends = stop[which] if words else np.empty(0, bool)
        known = self._words([w.encode() for w in words if w != "\n"])
        out = known.take((np.cumsum(~stop) - 1)[which[~ends]]).grouped(np.diff(np.flatnonzero(ends), prepend=-1) - 1)
        if not strange.any():
            return out
        # beyond Latin letters, case, form and classes of letters follow the Unicode tables of the library itself
        flat, counts, added = [], [], {}
        for k, c in enumerate(chunks.filter(pa.array(strange)).to_pylist()):
            if c.startswith("\0\0") and c[2:] in self.v.added:
                added[k], parts = self.v.added[c[2:]], []
            else:
                parts = self.v.split(c)
            flat += parts
            counts.append(len(parts))
        other = self._words(flat).grouped(np.array(counts))
        if added:
            at = other.starts[list(added)]
            lengths = other.lengths.copy()
            lengths[list(added)] = 1
            other = Lists(np.insert(other.flat, at, list(added.values())), lengths)
        both = Lists(np.concatenate([out.flat, other.flat]), np.concatenate([out.lengths, other.lengths]))
        return both.take(np.where(strange, len(plain) + np.cumsum(strange) - 1, np.cumsum(~strange) - 1))

    def _numbers(self, chunks: pa.Array) -> np.ndarray:
        """The place of each of these distinct chunks in the table; chunks that it lacks are learnt."""
        at = pc.index_in(chunks, value_set=self.known)
        old = at.drop_null().to_numpy()
        self.uses[old] += 1
        new = chunks.filter(pc.is_null(at))
        if not len(new):
            return at.to_numpy().astype(np.int64)
        if len(self.known) + len(new) > self.table_size:
            # what these texts use stays, and of the rest what most slices used, as far as half the table has room
            value = self.uses.copy()
            value[old] = np.iinfo(np.int64).max
            stay = np.sort(np.argsort(-value, kind="stable")[: max(len(old), self.table_size // 2 - len(new))])
            self.known, self.strings = self.known.take(pa.array(stay)), [s.take(pa.array(stay)) for s in self.strings]
            self.ids, self.uses = self.ids.take(stay), self.uses[stay]
        got = self._chunk_ids(new)
        self.known = pa.concat_arrays([self.known, new])
        self.ids = Lists(np.concatenate([self.ids.flat, got.flat]), np.concatenate([self.ids.lengths, got.lengths]))
        self.uses = np.concatenate([self.uses, np.ones(len(new), np.int64)])
        self.strings = [pa.concat_arrays([s, pc.binary_join(got.arrow(names), BLANK)]) for s, names in zip(self.strings, (self.decimal, self.token), strict=True)]
        return pc.index_in(chunks, value_set=self.known).to_numpy().astype(np.int64)

    def slices(self, texts: pa.Array, piece: int = 8 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(chunk numbers of texts end to end, how many each text has) for slices of about ``piece`` bytes, valid until the next one."""
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + piece, "right")))
            yield self._slice(texts.slice(at, end - at))
            at = end

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        for w in self.v.added:
            odd = pc.or_(odd, pc.match_substring(texts, w))
        lists = pc.utf8_split_whitespace(pc.ascii_lower(pc.if_else(odd, "", texts)))
        chunks, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
        odd = odd.to_numpy(zero_copy_only=False)
        if odd.any():
            cut = [self._cut(t) for t in texts.filter(pa.array(odd)).to_pylist()]
            chunks = pa.concat_arrays([chunks, pa.array([c for t in cut for c in t], pa.string())])
            counts = np.concatenate([counts, [len(t) for t in cut]]).astype(np.int64)
        coded = chunks.dictionary_encode()
        which = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        some = self.ids.lengths[which] > 0  # white space at an end of a text leaves an empty chunk
        if not some.all():
            ends = np.concatenate([[0], np.cumsum(some)])[np.concatenate([[0], np.cumsum(counts)])]
            which, counts = which[some], np.diff(ends)
        if odd.any():
            order = np.where(odd, len(odd) + np.cumsum(odd) - 1, np.arange(len(odd)))
            mixed = Lists(which, counts).take(order)
            which, counts = mixed.flat, mixed.lengths
        return which, counts

    def joined(self, which: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(numbers of ids, decimal ids, decoded texts) of the texts of a slice."""
        chunks = Lists(which, counts)
        n = np.diff(np.concatenate([[0], np.cumsum(self.ids.lengths[which])])[np.concatenate([[0], np.cumsum(counts)])])
        return n, *(pc.binary_join(chunks.arrow(s), BLANK) for s in self.strings)

    def id_lists(self, which: np.ndarray, counts: np.ndarray) -> Lists:
        return self.ids.take(which).grouped(counts)

    def encode(self, texts: list[str], piece: int = 1 << 21) -> Iterator[tuple[int, str, str]]:
        """(number of ids, decimal ids, decoded text) of each text, in order; new chunks of many texts are learnt at once."""
        for part in self.slices(pa.array(texts, pa.string()), piece):
            n, ids, tokens = self.joined(*part)
            yield from zip(n.tolist(), ids.to_pylist(), tokens.to_pylist(), strict=True)


def decode(ids: Iterable[int], v: Vocabulary) -> str:
    """The tokens of the ids, joined by single spaces, as this kind of vocabulary (it has no decoder) defines it."""
    return " ".join([v.tokens[i] for i in ids])


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", table_size: int = 400_000) -> DataFrame:
    """(id, ids array<int>, decoded string): what a training job reads."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, table_size)
        for b in gathered(batches):
            at = 0
            for part in enc.slices(b.column(1)):
                _, _, decoded = enc.joined(*part)
                ids = enc.id_lists(*part).int32()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(ids)), ids, decoded.cast(pa.string())], ["id", "ids", "decoded"])
                at += len(ids)
            pa.default_memory_pool().release_unused()

    return fields(docs, id=id_col, text=text_col).mapInArrow(run, f"id {kind}, ids array<int>, decoded string")


def _sha256(strings: pa.Array) -> pa.Array:
    """The digest of each string, in hex."""
    raw, ends = memoryview(strings.buffers()[2] or b""), np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1].tolist()
    return pa.array([hashlib.sha256(raw[s:e]).hexdigest() for s, e in zip(ends, ends[1:], strict=False)], pa.string())


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", table_size: int = 400_000, with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row, and ``ids`` array<int> if asked for; else no ids leave the task that made them."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, table_size)
        for b in gathered(batches):
            at = 0
            for part in enc.slices(b.column(1)):
                n, ids, decoded = enc.joined(*part)
                lists = [enc.id_lists(*part).int32()] if with_ids else []
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), pa.array(n, pa.int64()), _sha256(ids), _sha256(decoded), *lists], names)
                at += len(n)
            pa.default_memory_pool().release_unused()

    return fields(docs, id=id_col, text=text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


@lru_cache(maxsize=1)
def encoder(path: str, table_size: int = 400_000) -> Encoder:
    """One for each worker process: the vocabulary is read once, and what it learnt serves the next task."""
    return Encoder(Vocabulary(path), table_size)
