"""Journal files that may end in a torn line: good rows and quarantined ones go to two sinks under one commit.

A micro-batch writes its quarantine, then its events, each into a folder named by the batch, and last one marker.
Readers look at batches with a marker only, so what a crash left between the writes is never seen; the batch runs again
and replaces it. A batch whose marker is there is not written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import EVENT
from ..sources.markers import Markers

QUARANTINE = "file string, line_no long, warning string, sha256 string, size long, content string"


def source(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Journal segments as they arrive, each file whole: a segment is bounded by what a writer appends at once."""
    stream = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path, wholetext=True)
    return stream.select(F.col("_metadata.file_path").alias("file"), "value")


def split(segments: DataFrame, most_bytes: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """(events, quarantined rows). What follows a file's last line end is a torn tail, whether it parses or not."""
    pieces = F.split("value", "\n")
    rows = segments.select("file", (F.size(pieces) - 1).alias("last"), F.posexplode(pieces).alias("at", "line")).where(F.trim("line") != "")
    parsed = F.from_json("line", T.StructType([*EVENT.fields, T.StructField("_corrupt", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = rows.withColumn("e", parsed)
    broken = F.col("e").isNull() | F.col("e._corrupt").isNotNull() | F.col("e.sequence").isNull()
    rows = rows.withColumn("warning", F.when(F.col("at") == F.col("last"), "torn_tail").when(F.octet_length("line") > most_bytes, "line_too_long").when(broken, "corrupt_line"))
    aside = rows.where("warning is not null").select("file", (F.col("at") + 1).cast("long").alias("line_no"), "warning", F.sha2("line", 256).alias("sha256"), F.octet_length("line").cast("long").alias("size"), F.col("line").alias("content"))
    return rows.where("warning is null").select(*[F.col(f"e.{f.name}") for f in EVENT.fields]), aside


def recover(segments: DataFrame, out: str, checkpoint: str, between: Callable[[int], None] = lambda batch: None):
    """Start the query; ``between`` is called after the first write of a batch (a test lets it fail)."""
    spark = segments.sparkSession

    def put(batch: DataFrame, n: int) -> None:
        markers = Markers(spark, f"{out}/commits")
        if markers.get(f"batch-{n}") is not None:
            return
        batch = batch.persist()  # one read of the files for both sinks
        events, aside = split(batch)
        aside.write.mode("overwrite").parquet(f"{out}/quarantine/batch-{n}")
        between(n)
        events.write.mode("overwrite").parquet(f"{out}/events/batch-{n}")
        batch.unpersist()
        markers.put(f"batch-{n}", "committed")

    return segments.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, out: str, what: str) -> DataFrame:
    """The rows of all committed batches of ``events`` or ``quarantine``."""
    schema = EVENT if what == "events" else T.StructType.fromDDL(QUARANTINE)
    names = Markers(spark, f"{out}/commits").names()
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{out}/{what}/{n}" for n in names])


def warnings(quarantine: DataFrame) -> DataFrame:
    """Two drafts for each quarantined row: the bytes as evidence, and a typed warning that cites their digest."""
    payload = {
        "evidence_attached": F.struct(F.col("sha256").alias("evidence_id"), "size", F.lit("application/octet-stream").alias("media_type"), "sha256"),
        "recovery_warning": F.struct(F.col("warning").alias("reason_code"), F.col("sha256").alias("evidence_id"), "line_no"),
    }
    each = [quarantine.select("file", "line_no", F.lit(n).alias("draft_no"), F.lit(kind).alias("type"), F.to_json(x).alias("payload")) for n, (kind, x) in enumerate(payload.items(), 1)]
    return each[0].unionByName(each[1])
