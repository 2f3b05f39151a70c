"""Streaming forms against batch forms and a plain loop."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators import journal as J
from sparkloom.streaming import journal_stream as S

EVENT = T.StructType([T.StructField("engagement_id", T.LongType()), T.StructField("sequence", T.LongType()), T.StructField("type", T.StringType()), T.StructField("occurred_at", T.TimestampType()), T.StructField("idempotency_key", T.StringType()), T.StructField("call_id", T.StringType())])


def write_batches(events, folder, n):
    rows = events.orderBy("sequence").collect()
    size = -(-len(rows) // n)
    for k in range(n):
        part = rows[k * size : (k + 1) * size]
        (folder / f"{k:03d}.json").write_text("\n".join(json.dumps({"engagement_id": r.engagement_id, "sequence": r.sequence, "type": r.type, "occurred_at": r.at, "idempotency_key": f"{r.engagement_id}-{r.sequence}", "call_id": None}) for r in part))


def journal(spark, sf):
    rows = J.sequenced(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "ts", "event_id")
    return rows.select(F.col("user_id").alias("engagement_id"), F.col("seq").alias("sequence"), F.col("event_type").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


def test_lifecycle_stream_equals_batch_and_loop(spark, sf, tmp_path):
    events = journal(spark, sf)
    source = tmp_path / "in"
    source.mkdir()
    write_batches(events, source, 4)
    q = S.lifecycle(S.source(spark, str(source), EVENT)).writeStream.format("memory").queryName("lifecycle").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.table("lifecycle").collect():
        if r.engagement_id not in last or r.n_legal + r.n_illegal > last[r.engagement_id][1] + last[r.engagement_id][2]:
            last[r.engagement_id] = (r.state, r.n_legal, r.n_illegal, r.n_reopened)
    batch = {r.engagement_id: (r.state, r.n_legal, r.n_illegal, r.n_reopened) for r in J.reduce_state(events.withColumnRenamed("sequence", "seq"), "engagement_id").collect()}
    loop = {}
    for r in events.orderBy("engagement_id", "sequence").collect():
        loop[r.engagement_id] = J.replay_from(loop.get(r.engagement_id, ("open", 0, 0, 0)), [(r.sequence, r.type)])
    assert last == batch == loop


def test_dedupe_and_exactly_once_sink(spark, sf, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    events = journal(spark, sf).limit(200)
    write_batches(events, source, 2)
    write_batches(events, source.parent, 1)
    (tmp_path / "000.json").rename(source / "900.json")  # everything once more
    stream = S.deduplicated(S.source(spark, str(source), EVENT), delay="100 days")
    S.append_exactly_once(stream, str(out), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(out)).count() == events.count()


def test_serial_chain_against_a_loop(spark):
    import hashlib

    drafts = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "k string, draft_no long, p string")
    heads = spark.createDataFrame([("a", 7, "old"), ("a", 9, "head")], "k string, seq long, chain_hash string")
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    a1 = h(f"head|{h('x')}")
    want = {("a", 1, 10, a1), ("a", 2, 11, h(f"{a1}|{h('y')}")), ("b", 1, 1, h(f"|{h('z')}"))}
    assert {tuple(r) for r in J.append_events(heads, drafts, "k", ["p"]).collect()} == want
