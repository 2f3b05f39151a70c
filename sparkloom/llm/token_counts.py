"""Additive token totals by source, language and tokenizer version, kept up to date by signed deltas.

A change is an insert, a delete or a revised count of a document; each batch of changes is summed to one signed
row (documents, tokens) for each key before anything is shuffled far. A store holds those summed rows, one folder
for each delivery, and for each committed batch a marker that names its folder. A marker comes into being whole
and is never replaced: a batch that comes again is left out, one that died half-way is written anew, and a late
writer of a committed batch leaves its rows unread. Totals are the sum over committed batches, so they need no
earlier documents to be read again. ``compact`` publishes one marker that names both the folded rows and the batches
that they stand for, so no moment shows a batch twice or not at all.

Tokenizer versions are two that expressions can count, and the byte-pair vocabulary of ``bpe``. Only batch names
reach the driver.

Defined results: null or empty text has 0 tokens and still counts as a document; every row counts, repeated ones
too; null sources or languages are keys of their own; an empty batch commits and changes nothing; keys whose
documents and tokens are both 0 vanish; an empty table has no totals; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.markers import Markers
from .bpe import encoder
from .common import fields, gathered, remove, shared_dir, stored

KEYS = ["source", "lang", "version"]
ROW = "source string, lang string, version string, n_docs long, n_tokens long"
#: Versions that expressions count: runs between ASCII white space; and ASCII words, other signs one by one.
VERSIONS = {"words-1": r"[^\x09-\x0D\x20]+", "signs-2": r"[0-9A-Za-z]+|[^0-9A-Za-z\x00-\x20]"}
BPE_VERSION = "word_bpe_49k"


def inserts(rows: DataFrame) -> DataFrame:
    """Signed rows for new documents; ``rows`` has the keys and ``tokens``."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.col("tokens").cast("long").alias("n_tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("tokens")).cast("long").alias("n_tokens"))


def revisions(rows: DataFrame) -> DataFrame:
    """Signed rows for new counts of known documents; ``rows`` has the keys, ``old_tokens`` and ``tokens``."""
    return rows.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), (F.col("tokens") - F.col("old_tokens")).cast("long").alias("n_tokens"))


class TokenTotals:
    """The store below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._committed, self._folds = Markers(spark, f"{self.path}/committed"), Markers(spark, f"{self.path}/folds")

    def committed(self) -> list[str]:
        return self._committed.names()

    def _write(self, name: str, rows: DataFrame) -> str:
        """Sum the rows by key into a folder of their own."""
        folder = f"{name}-{uuid.uuid4().hex}"
        summed = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        summed.write.parquet(f"{self.path}/batches/{folder}")
        return folder

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of signed rows once; False if it was committed before."""
        if self._committed.get(batch) is not None:
            return False
        folder = self._write(batch, changes)
        if self._committed.put(batch, folder):
            return True
        remove(self.spark, f"{self.path}/batches/{folder}")  # another delivery was first
        return False

    def _state(self) -> tuple[list[str], list[str]]:
        """(folders that make up the totals, names of the batches in them)."""
        last = max((int(n) for n in self._folds.names()), default=0)
        folded, *covered = (self._folds.get(str(last)) or "").split("\n")
        done = self.committed()
        rest = [self._committed.get(b) for b in done if b not in set(covered)]
        return [f for f in (folded, *rest) if f], done

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over the committed batches."""
        folders, _ = self._state()
        if not folders:
            return self.spark.createDataFrame([], ROW)
        rows = self.spark.read.schema(ROW).parquet(*[f"{self.path}/batches/{f}" for f in folders])
        summed = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self, name: str = "fold") -> bool:
        """Fold the committed batches into one folder; their markers stay, so none comes in again. False if another fold was first."""
        turn = max((int(n) for n in self._folds.names()), default=0) + 1
        folders, covered = self._state()
        if not folders:
            return True
        folder = self._write(name, self.spark.read.schema(ROW).parquet(*[f"{self.path}/batches/{f}" for f in folders]))
        if self._folds.put(str(turn), "\n".join([folder, *covered])):
            return True
        remove(self.spark, f"{self.path}/batches/{folder}")
        return False

    def vacuum(self) -> None:
        """Delete folders that the totals no longer need; call it when nobody reads older totals."""
        live, _ = self._state()
        for folder in Markers(self.spark, f"{self.path}/batches").names():
            if folder not in live:
                remove(self.spark, f"{self.path}/batches/{folder}")

    def drop(self) -> None:
        remove(self.spark, self.path)


def counted(docs: DataFrame, tokenizer_path: str, versions: dict[str, str] = VERSIONS, text_col: str = "text") -> DataFrame:
    """(source, lang, estimate, tokens array<struct<version, tokens>>) of every row; ``estimate`` is a first guess from the length."""
    text = F.coalesce("text", F.lit(""))
    rows = fields(docs, text=text_col, source="source", lang="lang")
    plain = [F.regexp_count(text, F.lit(p)).cast("long").alias(f"n{k}") for k, p in enumerate(versions.values())]
    rows = rows.select("text", "source", "lang", F.ceil(F.length(text) / 4).cast("long").alias("estimate"), *plain)
    names = ["source", "lang", "estimate", *(f"n{k}" for k in range(len(versions))), "bpe"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for b in gathered(batches):
            at = 0
            for part in enc.slices(b.column(0)):
                n = enc.id_lists(*part).lengths
                yield pa.RecordBatch.from_arrays([*b.slice(at, len(n)).columns[1:], pa.array(n, pa.int64())], names)
                at += len(n)
            pa.default_memory_pool().release_unused()

    each = [F.struct(F.lit(v).alias("version"), F.col(c).alias("tokens")) for v, c in [*((v, f"n{k}") for k, v in enumerate(versions)), (BPE_VERSION, "bpe")]]
    got = rows.mapInArrow(run, "source string, lang string, " + ", ".join(f"{n} long" for n in names[2:]))
    return got.select("source", "lang", "estimate", F.array(*each).alias("tokens"))


def by_version(rows: DataFrame, keep: Column | None = None) -> DataFrame:
    out = rows.select("source", "lang", "estimate", F.inline("tokens"))
    return out if keep is None else out.where(keep)


def corpus_totals(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Totals over all rows of a corpus, reached the way a living corpus gets there.

    All rows come in under the byte-pair version with counts guessed from their length; the other versions follow;
    the guesses are revised; rows without tokens are withdrawn and, after the batches so far are folded, restored.
    Every batch is delivered twice, as after a lost acknowledgement; the second delivery changes nothing.
    """
    spark = docs.sparkSession
    rows = stored(counted(docs, tokenizer_path), "token-counts")
    store = TokenTotals(spark, shared_dir(spark, "token-totals"))
    pairs, empty = F.col("version") == BPE_VERSION, F.col("tokens") == 0
    batches = {
        "0001-load": lambda: inserts(by_version(rows, pairs).withColumn("tokens", F.col("estimate"))),
        "0002-other-versions": lambda: inserts(by_version(rows, ~pairs)),
        "0003-counted": lambda: revisions(by_version(rows, pairs).withColumn("old_tokens", F.col("estimate"))),
        "0004-withdraw-empty": lambda: deletes(by_version(rows, empty)),
        "0005-restore-empty": lambda: inserts(by_version(rows, empty)),
    }
    for name, changes in batches.items():
        if name == "0005-restore-empty":
            store.compact()
        store.apply(name, changes())
        store.apply(name, changes())
    return store.totals()
