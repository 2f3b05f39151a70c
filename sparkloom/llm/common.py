"""What the operators of this package share: table access, shared storage, stable ids, bounded labelled samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import importable


#: Bytes of labelled text that a classifier's sample may bring to the driver.
SAMPLE_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder.

    Only a session whose executors are this very machine may go without that setting, as in tests.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("sparkloom.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("sparkloom.shared.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends here, and a lost executor loses nothing.

    Spark reads rows of a file by thousands at once; ``file_rows`` bounds the rows of a file where each is megabytes.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*frames: DataFrame | None) -> None:
    """Delete what ``stored`` wrote for these frames; only for frames that nothing unwritten reads any more."""
    for f in frames:
        if f is not None and (path := vars(f).get("_stored_at")):
            remove(f.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves 1 modulo 3; rows without an id are never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], id_col: str = "doc_id", text_col: str = "text"
) -> list[tuple[str, int]]:
    """At most ``per_class[c]`` (text, c) of each class, and ``SAMPLE_BYTES`` of text, from rows that are not held out.

    The bounds are the documented parameters of the classifiers; which rows are taken depends on a hash of the
    id only (a text that the bytes have no room for is left out whole). Null labels and ids take no part; of repeated label rows the largest label holds, of repeated
    documents the smallest text. The ids are fetched first (bounded), so text is read only for them.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label).cast("int")).alias("_y"))
    )
    wanted = None
    for y, n in sorted(per_class.items()):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
        wanted = part if wanted is None else wanted.unionByName(part)
    # at most sum(per_class) rows of two numbers each: a proven bound for the broadcast
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .join(F.broadcast(wanted), "_id")
        .groupBy("_id", "_y")
        .agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text"))
    )
    so_far = F.sum(F.octet_length("_text")).over(Window.partitionBy("_y").orderBy(F.xxhash64("_id"), "_id"))  # bounded rows
    texts = rows.withColumn("_sum", so_far).where(F.col("_sum") <= SAMPLE_BYTES // len(per_class)).select("_id", "_text", "_y").toArrow().sort_by("_id")
    return list(zip(texts.column("_text").to_pylist(), texts.column("_y").to_pylist(), strict=True))


def fields(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that extra or clashing ones cannot matter."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let this session send at most ``rows`` rows to Python at once: texts are long, and buffers of 10,000 of them add up."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, rows)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, and Arrow's idle memory given back in between: workers live on between tasks."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
        pa.default_memory_pool().release_unused()


def gathered(batches: Iterator[pa.RecordBatch], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches joined to ones of about ``size`` bytes (a larger one stays as it is), in order."""
    held, room = [], 0
    for b in batches:
        if held and room + b.nbytes > size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, room = [], 0
        if b.num_rows:
            held.append(b)
            room += b.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
