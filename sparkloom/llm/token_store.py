"""Token ids in ORC files, in ascending order of document ids.

Each row of a file is a document: its id, its ids (integer run-length encoding), how many they are, and where
they start in their part. Rows are range-partitioned and sorted by document id, so that files and stripes cover narrow ranges of
ids: readers prune by the stripes' minima and maxima, the row indexes, and Bloom filters on the document id, and
read stripes in parallel.

Defined results: null and empty text hold the end id alone; rows that repeat an id follow each other in order of
their text; a null id sorts first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import ODD_SPACE, STRANGE, Lists, Vocabulary
from .common import fields

END_ID = 2


class LibraryEncoder:
    """The tokenizers library, asked once for each distinct word of a slice of the input.

    Texts fall into chunks at white space and chunks into words by the file's own split pattern; no token crosses
    either. Arrow codes chunks and words by their distinct values; the words go to the library many to a call,
    joined by spaces, and the tokens that end a word part the answer; the ids of chunks and texts are then gathered
    by number. Memory is bounded by the size of a slice, whatever the input.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.whole = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        v = Vocabulary(path)
        self.pattern = regex.compile(f"{v.pattern.pattern}|\\n")
        self.last = np.zeros(v.size, bool)
        self.last[[i for t, i in v.ids.items() if v.suffix and t.endswith(v.suffix)]] = True

    def _ask(self, texts: list[str]) -> Lists:
        fast = getattr(self.lib, "encode_batch_fast", self.lib.encode_batch)
        got = [np.array(e.ids, "<u4") for e in fast(texts, add_special_tokens=False)]
        return Lists(np.concatenate(got) if got else np.empty(0, "<u4"), np.array([len(g) for g in got], np.int64))

    def _words(self, words: list[str], together: int = 1000) -> Lists:
        groups = [words[k : k + together] for k in range(0, len(words), together)]
        got = self._ask([" ".join(g) for g in groups])
        flat, lengths = [], []
        for g, s, n in zip(groups, got.starts.tolist(), got.lengths.tolist(), strict=True):
            ids = got.flat[s : s + n]
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(g) or ends[-1] != n:  # a word end inside a word: each word is asked for by itself
                single = self._ask(g)
                ids, ends = single.flat, np.cumsum(single.lengths)
            flat.append(ids)
            lengths.append(np.diff(ends, prepend=0))
        return Lists(np.concatenate(flat), np.concatenate(lengths)) if flat else self._ask([])

    def _chunks(self, chunks: pa.Array) -> Lists:
        """The ids of distinct chunks (ASCII letters are lower case already)."""
        strange = pc.match_substring_regex(chunks, STRANGE).to_numpy(zero_copy_only=False)
        plain = chunks.filter(pa.array(~strange))
        text = "\n".join(plain.to_pylist())
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).lower()
        coded = pa.array([*self.pattern.findall(text), "\n"] if len(plain) else [], pa.string()).dictionary_encode()
        words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        ends = np.array([w == "\n" for w in words], bool)[which] if words else np.empty(0, bool)
        known = self._words([w for w in words if w != "\n"])
        number = np.cumsum([w != "\n" for w in words]) - 1 if words else np.empty(0, np.int64)
        counts = np.diff(np.flatnonzero(ends), prepend=-1) - 1
        out = known.take(number[which[~ends]]).grouped(counts)
        if not strange.any():
            return out
        other = self._ask(chunks.filter(pa.array(strange)).to_pylist())  # beyond Latin letters, case and form are the library's
        both = Lists(np.concatenate([out.flat, other.flat]), np.concatenate([out.lengths, other.lengths]))
        return both.take(np.where(strange, len(plain) + np.cumsum(strange) - 1, np.cumsum(~strange) - 1))

    def encode(self, texts: pa.Array, piece: int = 1 << 24) -> Iterator[pa.ListArray]:
        """The ids of the texts, in order, as lists for slices of the input of about ``piece`` bytes."""
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + piece, "right")))
            got = self._slice(texts.slice(at, end - at))
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(got.lengths)]), pa.int32()), pa.array(got.flat.view("<i4")))
            at = end

    def _slice(self, texts: pa.Array) -> Lists:
        # a text that names an added token, or holds white space that engines see differently, goes to the library as it is
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        for w in self.whole:
            odd = pc.or_(odd, pc.match_substring(texts, w))
        lists = pc.utf8_split_whitespace(pc.ascii_lower(pc.if_else(odd, "", texts)))
        coded = lists.flatten().dictionary_encode()
        counts = np.diff(lists.offsets.to_numpy())
        out = self._chunks(coded.dictionary).take(coded.indices.to_numpy()).grouped(counts)
        odd = odd.to_numpy(zero_copy_only=False)
        if not odd.any():
            return out
        alone = self._ask(texts.filter(pa.array(odd)).to_pylist())
        both = Lists(np.concatenate([out.flat, alone.flat]), np.concatenate([out.lengths, alone.lengths]))
        return both.take(np.where(odd, len(out.lengths) + np.cumsum(odd) - 1, np.arange(len(odd))))


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    """One for each worker process: the vocabulary is read once."""
    return LibraryEncoder(path)


def write(docs: DataFrame, tokenizer_path: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, bloom_fpp: float = 0.01) -> None:
    """Encode the texts and write them to the folder ``out``.

    The text itself is shuffled, not the ids: it is smaller. Tasks that run again give the same files, since the
    rows of a part are sorted before they are encoded and numbered.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at = encoder(tokenizer_path), 0
        for b in batches:
            row = 0
            for lists in enc.encode(b.column(1)):
                part = b.slice(row, len(lists))
                row += len(lists)
                before, values = lists.offsets.to_numpy(), lists.values.to_numpy()
                closed = np.insert(values, before[1:], end_id)  # the end id behind each document
                bounds = before + np.arange(len(before))
                sizes = np.diff(bounds).astype(np.int64)
                starts = at + np.cumsum(sizes) - sizes
                ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(closed.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(starts), pa.array(sizes), ids], ["doc_id", "part", "start_in_part", "n_tokens", "ids"])
                at += int(sizes.sum())

    dealt = fields(docs, doc_id=id_col, text=text_col).repartitionByRange(F.col("doc_id").asc_nulls_first())
    rows = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).withColumn("part", F.spark_partition_id())
    (
        rows.mapInArrow(run, f"doc_id {kind}, part int, start_in_part long, n_tokens long, ids array<int>")
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(bloom_fpp))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(16 << 20))
        .option("compression", "zstd")
        .orc(out)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files. Filters on ``doc_id`` reach the stripes' statistics and Bloom filters."""
    return spark.read.orc(path)


def digests(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the rows that ``read`` gives.

    Only one total for each part is gathered to place the parts: parts are as many as the writer's tasks, so the
    window and the broadcast hold that many rows.
    """
    kind = stored.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            flat, o = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[s:e]) for s, e in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(o), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    each = stored.select("doc_id", "part", "start_in_part", "ids").mapInArrow(run, f"doc_id {kind}, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return each.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
