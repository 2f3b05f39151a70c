"""The engagement reducer rule by rule, its stream against its batch on shuffled files, and the routing of completions."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import engagement as E
from sparkloom.plans import engagement_queries as Q
from sparkloom.streaming import engagement_stream as S


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, S.ROCKSDB)
    yield spark
    spark.conf.set(name, before)


def run(*events):
    """The state after (type, lane, payload) events in turn; a payload may be left out."""
    now = E.Engagement()
    for n, (kind, *rest) in enumerate([("engagement_opened",), *events], 1):
        lane, payload = (*rest, None, None)[:2]
        now.apply(n, f"e{n}", kind, lane, payload and json.dumps(payload))
    return dict(zip(E.COLUMNS, now.row(), strict=True))


L = ("lane_bound", "L")
CLOSE = [("closure_requested", None, {"terminal_watermark": 1}), ("report_generated", None, {"generation_reason": "closure", "journal_sequence": 2, "report_id": "r", "report_revision": 1}), ("engagement_closed", None, {"report_id": "r", "report_revision": 1, "closure_event_id": "e2", "terminal_watermark": 1})]
VERIFIED = [*CLOSE, ("engagement_verified", None, {"report_id": "r", "report_revision": 1})]


def step(kind, n=1, **more):
    return (kind, None, {"attempt_id": f"a{n}", "promotion_revision": n, "attempt_ordinal": n, "verification_event_id": "e5", "source_id": "s", "case_ids": ["c"], "promoted_case_ids": ["c"], "removed_case_ids": ["c"], "retry_count": 1} | more)


PATH = ["promotion_requested", "promotion_candidate_ready", "promotion_source_committed", "promotion_semantic_committed", "promotion_index_pending"]


def promoted(n=1):
    return [*(step(k, n) for k in PATH), step("case_promoted", n)]


@pytest.mark.parametrize(
    ("events", "want"),
    [
        ([], {"status": "active", "revision": 1, "error": None}),
        ([("surprise",)], {"error": "unknown_type", "error_sequence": 2, "revision": 1}),
        ([("decision_recorded", "L")], {"error": "lane_not_bound"}),
        ([L, ("decision_recorded", "L", {"decision_id": "d"}), ("lane_bound", "M")], {"n_lanes": 2, "n_decisions": 1}),
        ([L, ("decision_recorded", "L"), ("lane_unbound", "L"), L], {"n_lanes": 1, "n_decisions": 0}),
        ([("lane_unbound", "L")], {"error": "lane_not_bound"}),
        ([L, ("tool_call_started", "L", {"call_id": "c"}), ("tool_call_started", "L", {"call_id": "c"})], {"error": "call_repeated", "in_flight": ["c"]}),
        ([L, ("tool_call_started", "L", {"call_id": "c"}), ("tool_call_completed", "L", {"call_id": "c"}), ("tool_call_terminated", "L", {"call_id": "c"})], {"error": "call_ended", "in_flight": []}),
        ([L, ("tool_call_started", "L", {"call_id": "c"}), ("tool_call_completed", "M", {"call_id": "c"})], {"error": "call_lane"}),
        ([("tool_call_completed", "L", {"call_id": "c"})], {"error": "call_unknown"}),
        ([("closure_requested", None, {"terminal_watermark": 2})], {"error": "closure_snapshot"}),
        ([L, ("tool_call_started", "L", {"call_id": "c"}), ("closure_requested", None, {"terminal_watermark": 3, "in_flight_call_ids": ["c"]})], {"status": "closing", "closure_ready": False}),
        ([L, ("tool_call_started", "L", {"call_id": "c"}), ("closure_requested", None, {"terminal_watermark": 3, "in_flight_call_ids": ["c"]}), ("tool_call_terminated", "L", {"call_id": "c"})], {"closure_ready": True}),
        ([("closure_requested", None, {"terminal_watermark": 1}), ("plan_requested",)], {"error": "not_permitted"}),
        ([("closure_requested", None, {"terminal_watermark": 1}), ("closure_cancelled", None, {"closure_event_id": "x"})], {"error": "closure_unknown"}),
        ([L, ("closure_requested", None, {"terminal_watermark": 2}), ("closure_cancelled", None, {"closure_event_id": "e3"})], {"error": "restart_required", "status": "active", "revision": 4}),
        ([L, ("closure_requested", None, {"terminal_watermark": 2}), ("closure_cancelled", None, {"closure_event_id": "e3"}), ("user_note",)], {"error": "restart_required", "error_sequence": 5}),
        ([L, ("closure_requested", None, {"terminal_watermark": 2}), ("closure_cancelled", None, {"closure_event_id": "e3"}), ("tool_call_started", "L", {"call_id": "c"})], {"error": None, "in_flight": ["c"]}),
        (CLOSE, {"status": "closed_unverified", "n_reports": 1, "active_report": 1, "closure_ready": None}),
        ([CLOSE[0], ("report_generated", None, CLOSE[1][2] | {"journal_sequence": 1})], {"error": "closure_not_ready"}),
        ([CLOSE[0], CLOSE[2]], {"error": "close_needs_report"}),
        ([*CLOSE[:2], ("engagement_closed", None, CLOSE[2][2] | {"closure_event_id": "e1"})], {"error": "close_mismatch"}),
        ([*CLOSE, ("report_generated", None, {"report_id": "q", "report_revision": 3})], {"error": "report_revision"}),
        ([("report_generated", None, {"report_revision": 1})], {"error": "not_permitted"}),
        (VERIFIED, {"status": "closed_verified"}),
        ([*VERIFIED, ("engagement_verified", None, {"report_id": "r", "report_revision": 1})], {"error": "verify_mismatch"}),
        ([*VERIFIED, ("engagement_reopened",)], {"status": "active", "active_report": None, "n_reports": 1}),
        ([("engagement_abandoned",), ("tool_call_started", "L", {"call_id": "c"})], {"status": "abandoned", "error": "not_permitted"}),
        ([*VERIFIED, *promoted()], {"promotion_stage": "promoted", "n_promotions": 1, "error": None}),
        ([*VERIFIED, step("case_promoted")], {"error": "promotion_missing"}),
        ([*VERIFIED, step(PATH[0]), step(PATH[2])], {"error": "promotion_order"}),
        ([*VERIFIED, step(PATH[0]), step(PATH[0], 2)], {"error": "promotion_active"}),
        ([*VERIFIED, step(PATH[0], promotion_revision=2)], {"error": "promotion_ordinal"}),
        ([*VERIFIED, *promoted()[:3], step(PATH[3], source_id="t")], {"error": "promotion_source"}),
        ([*VERIFIED, *promoted()[:5], step("promotion_index_retry_failed"), step("promotion_index_retry_failed")], {"error": "promotion_retry", "promotion_stage": "retry_failed"}),
        ([*VERIFIED, step(PATH[0]), step("promotion_attempt_cancellation_requested", stage="requested"), step("promotion_attempt_terminated"), step(PATH[0], 2)], {"n_promotions": 2, "promotion_stage": "requested", "error": None}),
        ([*VERIFIED, *promoted(), step("promotion_revocation_requested"), step("case_promotion_revoked")], {"promotion_stage": "revoked", "error": None}),
        ([*VERIFIED, *promoted(), step("promotion_revocation_requested", source_id="t")], {"error": "revocation_mismatch"}),
        ([*VERIFIED, *promoted(), *promoted(2)[:5], step("case_promotion_superseded", prior_attempt_id="a1", replacement_attempt_id="a2"), step("case_promoted", 2)], {"promotion_stage": "promoted", "n_promotions": 2, "error": None}),
        ([*VERIFIED, *promoted(), *promoted(2)[:4], step("case_promotion_superseded", prior_attempt_id="a1", replacement_attempt_id="a2")], {"error": "supersession_mismatch"}),
    ],
)
def test_rules(events, want):
    got = run(*events)
    assert {k: got[k] for k in want} == want


def test_64_types_and_folded_attempts():
    assert len(E.EFFECT_OF) == 64 and set(E._BOUND) < set(E.EFFECT_OF) and set(E._STEPS) < set(E.EFFECT_OF)
    assert {t for t, *_ in Q.SCRIPT} <= set(E.EFFECT_OF)
    many = [s for n in range(1, 68) for s in (step(PATH[0], n), step("promotion_attempt_terminated", n))]
    got = run(*VERIFIED, *many)
    assert (got["n_promotions"], got["n_folded"], got["error"]) == (67, 3, None) and len(got["folded_sha256"]) == 64


def test_gaps_repeats_and_empty_journals(spark):
    rows = [("a", 1, "1", "engagement_opened"), ("a", 1, "1", "engagement_opened"), ("a", 3, "3", "user_note"), ("b", 2, "2", "user_note"), (None, 1, "1", "engagement_opened"), ("c", 1, "1", None)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "engagement_id string, sequence long, event_id string, type string, lane string, payload string")
    got = {r.engagement_id: (r.status, r.revision, r.error, r.error_sequence) for r in E.states(df).collect()}
    assert got == {"a": ("active", 1, "sequence", 3), "b": (None, 0, "sequence", 2), "c": (None, 0, "unknown_type", 1)}
    assert E.states(df.limit(0)).count() == 0


def rows_of(df):
    return {r.engagement_id: tuple(r)[1:] for r in df.collect()}


def drain(stream, folder, name):
    """Run what is there to the end from the checkpoint in ``folder``; the rows that came out, in order of batches."""
    out = []
    q = stream.writeStream.outputMode("update").option("checkpointLocation", str(folder / name)).trigger(availableNow=True).foreachBatch(lambda b, n: out.extend(b.collect())).start()
    q.awaitTermination()
    return out


def test_stream_over_shuffled_files_restarts_and_equals_batch(rocks, sf, tmp_path):
    events = Q.typed_events(rocks, sf).where("engagement_id < 8").select("engagement_id", *E.EVENT)
    rows = events.collect()
    random.Random(3).shuffle(rows)
    source = tmp_path / "in"
    source.mkdir()

    def put(n, part):
        (source / f"{n:03d}.json").write_text("\n".join(json.dumps(r.asDict()) for r in part))

    def stream():
        return S.engagements(rocks.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).json(str(source)))

    third = len(rows) // 3
    put(0, rows[:third])
    put(1, rows[third : 2 * third] + rows[:20])  # some come again
    seen = drain(stream(), tmp_path, "c")
    put(2, rows[2 * third :])
    seen += drain(stream(), tmp_path, "c")  # a new query from the checkpoint
    last = {}
    for r in seen:
        last[r.engagement_id] = max(last.get(r.engagement_id, ()), tuple(r)[1:], key=lambda t: t[1:2] + (t[-2] is not None,) if t else (-1,))
    assert last == rows_of(E.states(events))


def test_stream_starts_from_a_snapshot(rocks, sf, tmp_path):
    events = Q.typed_events(rocks, sf).where("engagement_id < 6").select("engagement_id", *E.EVENT)
    known = S.snapshots(events.where("sequence <= 30"))
    source = tmp_path / "in"
    source.mkdir()
    (source / "0.json").write_text("\n".join(json.dumps(r.asDict()) for r in events.where("sequence > 30").collect()))
    seen = drain(S.engagements(rocks.readStream.schema(events.schema).json(str(source)), snapshot=known), tmp_path, "c")
    assert {r.engagement_id: tuple(r)[1:] for r in seen} == rows_of(E.states(events))


def test_every_completion_is_routed_once(rocks, sf, tmp_path):
    events = Q.call_events(rocks, sf).withColumn("k", F.col("k") % 25).withColumn("arrived_at", F.date_trunc("day", "arrived_at")).select("k", "kind", "event_id", "occurred_at", "arrived_at")
    text = events.select("*", F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("o"), F.date_format("arrived_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("a")).orderBy("arrived_at").collect()
    source = tmp_path / "in"
    source.mkdir()
    by_day = {}
    for r in text:
        by_day.setdefault(r.a, []).append({"k": r.k, "kind": r.kind, "event_id": r.event_id, "occurred_at": r.o, "arrived_at": r.a})
    days = sorted(by_day)
    few = [days[k::1][0:1] for k in range(0, min(len(days), 14))]  # a file for each of the first days
    names = [h[0] for h in few]
    for n, h in enumerate(names):
        (source / f"{n:03d}.json").write_text("\n".join(json.dumps(x) for x in by_day[h]))
    end = {"k": -1, "kind": "start", "event_id": "end", "occurred_at": "2030-01-01T00:00:00Z", "arrived_at": "2030-01-01T00:00:00Z"}
    for n in (900, 901):  # time goes on, so that the waiting ones are told
        (source / f"{n}.json").write_text(json.dumps(end))
    for n, file in enumerate(sorted(source.iterdir())):
        os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))  # a file stream goes by the files' times
    came = rocks.read.schema(events.schema).json([str(source / f"{n:03d}.json") for n in range(len(names))])
    stream = rocks.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).json(str(source))
    wait = 10 * 365 * 86_400 // 2
    got = {}
    for r in drain(S.routed_completions(stream, ["k"], wait_seconds=wait), tmp_path, "c"):
        got[r.k, r.event_id, r.route] = got.get((r.k, r.event_id, r.route), 0) + 1
    want = {(r.k, r.event_id, r.route): r.n for r in S.routed_batch(came, ["k"]).collect()}
    assert got == want and {route for *_, route in got} >= {"completed", "duplicate", "repeated", "unmatched"}
    assert sum(got.values()) == came.where("kind = 'end'").count()
