"""Engagement state and completion routing over ``events``: a user is an engagement, its events follow a script of typed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import engagement as E
from ..operators import journal as J
from ..operators import situation as P
from ..streaming import engagement_stream as S
from .registry import query, table

#: What the events of a journal are, in turn: type, lane, call. After the last the script goes on with the second.
SCRIPT = [
    *[("engagement_opened", None, None), ("lane_bound", "L", None), ("session_started", "L", None), ("scope_changed", None, None), ("plan_requested", None, None), ("frontier_proposed", None, None)],
    *[("frontier_criticized", None, None), ("decision_recorded", "L", None), ("tool_call_started", "L", "a"), ("evidence_attached", None, None), ("tool_call_completed", "L", "a"), ("interpretation_succeeded", None, None)],
    *[("observation_extracted", None, None), ("hypothesis_formed", None, None), ("outcome_assessed", None, None), ("tool_call_started", "L", "b"), ("closure_requested", None, None), ("evidence_capture_failed", None, None)],
    *[("tool_call_terminated", "L", "b"), ("closure_cancelled", None, None), ("tool_call_started", "L", "d"), ("tool_call_completed", "L", "d"), ("unmatched_tool_completion", None, None), ("unplanned_action", None, None)],
    *[("control_tool_invoked", "L", None), ("source_suggested", None, None), ("uncertain_correlation", None, None), ("recovery_warning", None, None), ("user_note", None, None), ("missing_information_identified", None, None)],
    *[("interpretation_failed", None, None), ("objective_proof_observed", None, None), ("lane_bound", "M", None), ("child_lane_linked", "L", None), ("session_checkpointed", "L", None), ("agent_deviation_recorded", "L", None)],
    *[("objective_changed", None, None), ("strategy_reconciled", None, None), ("research_query_proposed", None, None), ("lane_unbound", "M", None), ("session_finalized", "L", None), ("closure_requested", None, None)],
    *[("report_generated", None, None), ("engagement_closed", None, None), ("report_generated", None, None), ("engagement_verified", None, None), ("promotion_requested", None, None), ("promotion_candidate_ready", None, None)],
    *[("promotion_source_committed", None, None), ("promotion_semantic_committed", None, None), ("promotion_index_pending", None, None), ("promotion_index_retry_failed", None, None), ("case_promoted", None, None), ("flag_rejected", None, None)],
    *[("promotion_revocation_requested", None, None), ("case_promotion_revoked", None, None), ("report_commit_abandoned", None, None), ("engagement_reopened", None, None), ("engagement_abandoned", None, None), ("engagement_reopened", None, None)],
]
TURNS = len(SCRIPT)
#: Rules that journals break, by user: where, and the error it must give.
FAULTS = [(None, None), (17, "closure_snapshot"), (11, "call_unknown"), (21, "restart_required"), (46, "not_permitted"), (53, "promotion_source")]


def typed_events(spark: SparkSession, d: str) -> DataFrame:
    """(engagement_id, sequence, event_id, type, lane, payload, occurred_at): the script with its faults, all payloads cited right."""
    rows = J.sequenced(table(spark, d, "events"), "user_id", "ts", "event_id")
    q, user = F.col("seq"), F.col("user_id")
    p = F.when(q <= TURNS, q).otherwise(F.pmod(q - 2, F.lit(TURNS - 1)) + 2).cast("int")
    rows = rows.withColumn("p", p).withColumn("c", F.floor((q - 2) / (TURNS - 1)).cast("long")).withColumn("fault", F.get(F.array(*[F.lit(at) for at, _ in FAULTS]), F.pmod(user, F.lit(len(FAULTS))).cast("int")) == q)
    wrong = F.coalesce("fault", F.lit(False))
    step = F.get(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(lane).alias("lane"), F.lit(call).alias("call")) for t, lane, call in SCRIPT]), F.col("p") - 1)
    name = lambda n: F.concat_ws("-", user, n)  # noqa: E731  the id of the event at a place of the journal
    attempt = F.concat(F.lit("attempt"), F.col("c"))
    fields = {
        "call_id": F.when(wrong & (q == 11), "nobody").when(step["call"].isNotNull(), F.concat(step["call"], F.col("c"))),
        "terminal_watermark": F.when(wrong & (q == 17), q).when(step["type"] == "closure_requested", q - 1).when(F.col("p") == 44, q - 3),
        "in_flight_call_ids": F.when(F.col("p") == 17, F.array(F.concat(F.lit("b"), F.col("c")))),
        "closure_event_id": F.when(F.col("p") == 20, name(q - 3)).when(F.col("p") == 44, name(q - 2)),
        "generation_reason": F.when(F.col("p") == 43, "closure"),
        "journal_sequence": q - 1,
        "report_id": F.concat(F.lit("report"), 2 * F.col("c") + F.when(F.col("p") < 45, 1).otherwise(2)),
        "report_revision": 2 * F.col("c") + F.when(F.col("p") < 45, 1).otherwise(2),
        "attempt_id": attempt,
        "attempt_ordinal": F.lit(1),
        "promotion_revision": F.col("c") + 1,
        "verification_event_id": name(q - 1),
        "source_id": F.when(wrong & (q == 53), "other").otherwise(F.concat(F.lit("source"), user)),
        "case_ids": F.array(F.lit("case")),
        "promoted_case_ids": F.array(F.lit("case")),
        "removed_case_ids": F.array(F.lit("case")),
        "retry_count": F.lit(1),
    }
    kind = F.when(wrong & (q == 21), "user_note").when(wrong & (q == 46), "plan_requested").otherwise(step["type"])
    payload = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    return rows.select(user.alias("engagement_id"), q.alias("sequence"), name(q).alias("event_id"), kind.alias("type"), step["lane"].alias("lane"), payload.alias("payload"), F.col("ts").alias("occurred_at"))


STATUS = {
    "engagement_opened": "active", "closure_requested": "closing", "closure_cancelled": "active", "engagement_closed": "closed_unverified", "engagement_verified": "closed_verified",
    "engagement_reopened": "active", "engagement_abandoned": "abandoned",
}
STAGE = {
    "promotion_requested": "requested", "promotion_candidate_ready": "candidate_ready", "promotion_source_committed": "source_committed", "promotion_semantic_committed": "semantic_committed",
    "promotion_index_pending": "index_pending", "promotion_index_retry_failed": "retry_failed", "case_promoted": "promoted", "promotion_revocation_requested": "revocation_requested", "case_promotion_revoked": "revoked",
}


def _case(column: str, names: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in names.items()) + " end"


def _text(x: str | None) -> str:
    return "null" if x is None else f"'{x}'"


#: Journals without faults need no fold: every part of their state is an aggregate over the events before the first fault.
STATES_SQL = f"""with q as (select user_id as u, row_number() over (partition by user_id order by ts, event_id) as q from events),
p as (select *, case when q <= {TURNS} then q else (q - 2) % {TURNS - 1} + 2 end as p, (q - 2) // {TURNS - 1} as c, max(q) over (partition by u) as last, [{", ".join(str(a) if a else "null" for a, _ in FAULTS)}][1 + u % {len(FAULTS)}] as fault from q),
t as (select *, [{", ".join(_text(t) for t, *_ in SCRIPT)}][p] as type, [{", ".join(_text(x) for _, x, _ in SCRIPT)}][p] as lane, [{", ".join(_text(x) for *_, x in SCRIPT)}][p] || c as call from p where fault is null or q < fault),
s as (select u, max(q) as revision, max(last) as last, max(fault) as fault, arg_max({_case("type", STATUS)}, q) filter (where {_case("type", STATUS)} is not null) as status, arg_max({_case("type", STAGE)}, q) filter (where {_case("type", STAGE)} is not null) as stage,
  max(q) filter (where type = 'closure_requested') as asked, max(q) filter (where type in ('closure_cancelled', 'engagement_closed', 'engagement_reopened')) as done, max(q) filter (where type = 'tool_call_started') as started, max(q) filter (where type = 'closure_cancelled') as cancelled,
  max(q) filter (where type = 'engagement_reopened') as reopened, max(q) filter (where p = 44 or p = 45) as reported, arg_max(2 * c + case when p = 44 then 1 else 2 end, q) filter (where p = 44 or p = 45) as report,
  count(*) filter (where p = 44 or p = 45) as n_reports, count(*) filter (where type = 'promotion_requested') as n_promotions from t group by u),
l as (select u, count(*) filter (where bound) as n_lanes, count(*) filter (where bound and decided > coalesce(freed, 0)) as n_decisions from (select u, lane, arg_max(type = 'lane_bound', q) filter (where type in ('lane_bound', 'lane_unbound')) as bound,
  max(q) filter (where type = 'lane_unbound') as freed, max(q) filter (where type = 'decision_recorded') as decided from t where lane is not null group by u, lane) group by u),
f as (select u, list(call order by call) as in_flight, min(a) as oldest from (select u, call, min(q) as a from t where call is not null group by u, call having count(*) = 1) group by u)
select u as engagement_id, status, revision, coalesce(n_lanes, 0) as n_lanes, coalesce(n_decisions, 0) as n_decisions, coalesce(in_flight, []) as in_flight, case when asked > coalesce(done, 0) then oldest is null end as closure_ready, n_reports,
  case when reported > coalesce(reopened, 0) then report end as active_report, stage as promotion_stage, n_promotions, 0::bigint as n_folded, null::varchar as folded_sha256,
  case when fault <= last then [{", ".join(_text(e) for _, e in FAULTS)}][1 + u % {len(FAULTS)}] when cancelled > coalesce(started, 0) then 'restart_required' end as error,
  case when fault <= last then fault when cancelled > coalesce(started, 0) then revision end as error_sequence from s left join l using (u) left join f using (u)"""


@query(STATES_SQL)
def q_engagement_state(spark: SparkSession, d: str) -> DataFrame:
    """The full reducer over every journal; journals that break a rule stop there."""
    return E.states(typed_events(spark, d))


def call_events(spark: SparkSession, d: str) -> DataFrame:
    """(k, kind, event_id, occurred_at, arrived_at): views start the call that their key names, others end one; each seventh comes twice, some late."""
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("long") + 1000 * F.floor(F.col("event_id") / 700))
    late = F.col("ts") + F.make_interval(hours=(F.col("event_id") % 5).cast("int"))
    each = rows.select("k", F.when(F.col("event_type") == "view", "start").otherwise("end").alias("kind"), F.col("event_id").cast("string").alias("event_id"), F.col("ts").alias("occurred_at"), F.date_trunc("hour", late).alias("arrived_at"))
    again = each.where("cast(event_id as long) % 7 = 0").withColumn("arrived_at", F.col("arrived_at") + F.make_interval(hours=F.lit(2)))
    return each.unionByName(again)


CALLS_SQL = """e as (select json_extract_string(props, '$.k')::bigint + 1000 * (event_id // 700) as k, case when event_type = 'view' then 'start' else 'end' end as kind, cast(event_id as varchar) as event_id, ts as occurred_at, date_trunc('hour', ts + to_hours(cast(event_id % 5 as integer))) as arrived_at from events),
x as (select * from e union all select k, kind, event_id, occurred_at, arrived_at + to_hours(2) from e where cast(event_id as bigint) % 7 = 0)"""


@query(f"""with {CALLS_SQL}, s as (select k, arg_min(occurred_at, (arrived_at, occurred_at)) as started_at, min(arrived_at) as begun from x where kind = 'start' group by k),
d as (select k, event_id, min(arrived_at) as came, any_value(occurred_at) as o, count(*) as times from x where kind = 'end' group by k, event_id),
j as (select d.*, started_at, begun, row_number() over (partition by k order by greatest(came, begun), o, event_id) as place from d left join s using (k)),
r as (select k, event_id, case when started_at is null then 'unmatched' when place > 1 then 'duplicate' when o > started_at + interval 1 hour then 'late' else 'completed' end as route, times from j)
select k, event_id, route, 1::bigint as n from r union all select k, event_id, 'repeated', times - 1 from r where times > 1""")
def q_completion_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Completions by what they were when they came: completed, late, duplicate, repeated, unmatched."""
    return S.routed_batch(call_events(spark, d), ["k"])


FAMILY_SQL = "case type " + " ".join(f"when '{k}' then '{f}'" for f, kinds in P.FAMILIES.items() for k in kinds) + " end"
_NAMES = sorted(P.FAMILIES)


def plain_events(spark: SparkSession, d: str) -> DataFrame:
    """Typed events with the events' own properties as payload; some cite the event before, some one that does not come before."""
    rows = typed_events(spark, d).select("engagement_id", "sequence", "event_id", "type")
    props = J.sequenced(table(spark, d, "events"), "user_id", "ts", "event_id").select(F.col("user_id").alias("engagement_id"), F.col("seq").alias("sequence"), F.col("props").alias("payload"))
    return rows.join(props, ["engagement_id", "sequence"])


@query(f"""with q as (select user_id as engagement_id, row_number() over (partition by user_id order by ts, event_id) as sequence, props as payload from events),
p as (select *, case when sequence <= {TURNS} then sequence else (sequence - 2) % {TURNS - 1} + 2 end as p, [{", ".join(str(a) if a else "null" for a, _ in FAULTS)}][1 + engagement_id % {len(FAULTS)}] as fault from q),
t as (select engagement_id, sequence, engagement_id || '-' || sequence as event_id, case when sequence = fault and fault = 21 then 'user_note' when sequence = fault and fault = 46 then 'plan_requested' else [{", ".join(_text(t) for t, *_ in SCRIPT)}][p] end as type, payload from p),
f as (select *, {FAMILY_SQL} as family, ('0x' || substr(sha256(concat_ws(chr(31), engagement_id, sequence, event_id, type, payload)), 1, 15))::bigint as h from t),
s as (select engagement_id, family, count(*) as n, max(sequence) as last, cast(sum(h::hugeint) % {P.MODULUS} as bigint) as digest from f where family is not null group by all)
select engagement_id, {", ".join(f"cast(coalesce(sum(n) filter (where family = '{f}'), 0) as bigint) as n_{f}" for f in _NAMES)}, max(last) as material_revision,
  sha256({" || '|' || ".join(f"'{f}:' || coalesce(max(digest) filter (where family = '{f}'), 0)" for f in _NAMES)}) as situation_sha256 from s group by engagement_id""")
def q_situation(spark: SparkSession, d: str) -> DataFrame:
    """Situations kept by deltas over three appends; the SQL rebuilds them from whole journals."""
    rows = plain_events(spark, d)
    state = P.deltas(rows.where("sequence <= 20"))
    for part in ("sequence between 21 and 40", "sequence > 40"):
        state = P.appended(state, rows.where(part))
    return P.situations(state)


@query(f"""with q as (select user_id as engagement_id, row_number() over (partition by user_id order by ts, event_id) as sequence from events),
p as (select *, case when sequence <= {TURNS} then sequence else (sequence - 2) % {TURNS - 1} + 2 end as p, [{", ".join(str(a) if a else "null" for a, _ in FAULTS)}][1 + engagement_id % {len(FAULTS)}] as fault from q),
t as (select engagement_id, sequence, case when sequence = fault and fault = 21 then 'user_note' when sequence = fault and fault = 46 then 'plan_requested' else [{", ".join(_text(t) for t, *_ in SCRIPT)}][p] end as type from p),
c as (select engagement_id, sequence, unnest([sequence - 1, sequence - 3 + 4 * (sequence % 2)]) as place from t where {FAMILY_SQL} is not null)
select distinct engagement_id, sequence, engagement_id || '-' || place as cited from c where place >= sequence or place < 1""")
def q_ungrounded(spark: SparkSession, d: str) -> DataFrame:
    """Citations of events that do not come before: every second entry cites one that follows."""
    name = lambda n: F.concat_ws("-", "engagement_id", n)
    q = F.col("sequence")
    return P.ungrounded(plain_events(spark, d), F.array(name(q - 1), name(q - 3 + 4 * (q % 2))))
