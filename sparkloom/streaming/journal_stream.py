"""Streaming forms of the journal operators; each has a batch form that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import journal as J


def source(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Journal files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def lifecycle(events: DataFrame, key: str = "engagement_id") -> DataFrame:
    """The lifecycle fold, kept as state: (key, state, n_legal, n_illegal, n_reopened) after each batch that touched the key.

    Events must come in order of their sequence from batch to batch; within a batch they are sorted.
    """
    saved = T.StructType([T.StructField("state", T.StringType()), T.StructField("good", T.LongType()), T.StructField("bad", T.LongType()), T.StructField("again", T.LongType())])

    def step(k: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("sequence", kind="stable")
        before = tuple(state.get) if state.exists else ("open", 0, 0, 0)
        after = J.replay_from(before, list(zip(rows["sequence"], rows["type"], strict=True)))
        state.update(after)
        yield pd.DataFrame([(k[0], *after)], columns=[key, "state", "n_legal", "n_illegal", "n_reopened"])

    out = T.StructType([events.schema[key], *[T.StructField(n, t) for n, t in (("state", T.StringType()), ("n_legal", T.LongType()), ("n_illegal", T.LongType()), ("n_reopened", T.LongType()))]])
    return events.groupBy(key).applyInPandasWithState(step, out, saved, "update", GroupStateTimeout.NoTimeout)


def deduplicated(events: DataFrame, key: str = "idempotency_key", at: str = "occurred_at", delay: str = "10 minutes") -> DataFrame:
    """The first event of each idempotency key within the watermark."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str = "occurred_at", size: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Counts by tumbling event-time windows; late rows beyond the watermark are left out."""
    return events.withWatermark(at, delay).groupBy(F.window(at, size), "type").count()


def completions(starts: DataFrame, ends: DataFrame, key: str = "call_id", at: str = "occurred_at", most: str = "1 hour") -> DataFrame:
    """Starts with their completions as a stream-stream join bounded by time on both sides."""
    a = starts.withWatermark(at, most).select(F.col(key).alias("start_key"), F.col(at).alias("started_at"))
    b = ends.withWatermark(at, most).select(F.col(key).alias("end_key"), F.col(at).alias("ended_at"))
    return a.join(b, F.expr(f"start_key = end_key and ended_at >= started_at and ended_at <= started_at + interval {most}"), "left_outer")


def append_exactly_once(stream: DataFrame, out: str, checkpoint: str):
    """Write each micro-batch to its own folder, replaced if the batch runs again: a retry changes nothing."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
