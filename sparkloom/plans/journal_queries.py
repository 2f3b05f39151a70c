"""Journal operators over ``events`` (a user is an engagement) and ``conversations`` (a conversation is a session)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import journal as J
from .registry import query, table

PAYLOAD = ["event_id", "event_type", "props"]
SEQ_SQL = "e as (select *, row_number() over (partition by user_id order by ts, event_id) as seq from events)"


def events(spark: SparkSession, d: str) -> DataFrame:
    return J.sequenced(table(spark, d, "events"), "user_id", "ts", "event_id").withColumn("type", F.col("event_type"))


@query(f"""with {SEQ_SQL}, h as (select *, sha256(concat_ws(chr(31), user_id, seq, event_id, event_type, props)) as own from e), l as (select *, lag(own) over (partition by user_id order by seq) as link from h),
f as (select user_id, event_id, case when event_id % 50 = 3 then seq + 1 when event_id % 50 = 9 then seq - 1 else seq end as seq, case when event_id % 50 = 17 then 'broken' else own end as event_hash, case when event_id % 50 = 31 then 'broken' else link end as previous_hash, event_type, props from l),
w as (select *, sha256(concat_ws(chr(31), user_id, seq, event_id, event_type, props)) as again, lag(seq) over o as s, lag(event_hash) over o as p from f window o as (partition by user_id order by seq, event_id))
select user_id, count(*) as n_events, count(*) filter (where seq - coalesce(s, 0) > 1) as n_gaps, count(*) filter (where seq = s) as n_repeats, count(*) filter (where previous_hash is distinct from p) as n_bad_links, count(*) filter (where event_hash <> again) as n_bad_hashes from w group by 1""")
def q_chain_check(spark: SparkSession, d: str) -> DataFrame:
    """Whole chains with planted faults: moved sequences, changed hashes, broken links."""
    chain, n = J.hashed(events(spark, d), "user_id", PAYLOAD), F.col("event_id") % 50
    faulty = chain.withColumns({
        "seq": F.when(n == 3, F.col("seq") + 1).when(n == 9, F.col("seq") - 1).otherwise(F.col("seq")),
        "event_hash": F.when(n == 17, "broken").otherwise(F.col("event_hash")),
        "previous_hash": F.when(n == 31, "broken").otherwise(F.col("previous_hash")),
    })
    return J.chain_violations(faulty, "user_id", PAYLOAD, "event_id")


@query()
def q_append_chain(spark: SparkSession, d: str) -> DataFrame:
    """Serial chain hashes for new events behind existing heads."""
    rows = events(spark, d)
    none = spark.createDataFrame([], "user_id long, seq long, chain_hash string")
    drafts = rows.select("user_id", F.col("seq").alias("draft_no"), *PAYLOAD)
    return J.append_events(none, drafts, "user_id", PAYLOAD)


@query(f"""with {SEQ_SQL}, s as (select *, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by seq) as session from e),
o as (select *, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id, session order by seq) as closed from s)
select user_id, cast(session as bigint) as session, count(*) as n_events, count(*) filter (where closed = 0 and session > 0) as n_open from o group by 1, 2""")
def q_marker_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = J.marker_sessions(events(spark, d), "user_id", ["seq"], F.col("type") == "signup", F.col("type") == "purchase")
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.count_if("is_open").alias("n_open"))


@query("""with g as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 2 hour then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as n from g)
select user_id, count(*) as n_events, min(epoch_us(ts)) as start_us from s group by user_id, n""")
def q_gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n_events")).select("user_id", "n_events", F.unix_micros("w.start").alias("start_us"))


@query("select epoch_us(time_bucket(interval 6 hour, ts)) as start_us, event_type, count(*) as n_events, round(sum(value), 4) as total from events group by 1, 2")
def q_tumbling(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_micros("w.start").alias("start_us"), "event_type", "n_events", "total")


@query("""with b as (select *, unnest([time_bucket(interval 1 hour, ts), time_bucket(interval 1 hour, ts) - interval 1 hour]) as s from events)
select epoch_us(s) as start_us, count(*) as n_events, count(distinct user_id) as n_users from b group by 1""")
def q_sliding(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_users")).select(F.unix_micros("w.start").alias("start_us"), "n_events", "n_users")


PAIRS_SQL = f"""{SEQ_SQL}, n as (select user_id, seq, event_type, min(case when event_type = 'view' then seq end) over w as ns, min(case when event_type = 'click' then seq end) over w as ne from e window w as (partition by user_id order by seq rows between 1 following and unbounded following)),
p as (select user_id, seq as start_seq, case when ne is not null and (ns is null or ne < ns) then ne end as end_seq from n where event_type = 'view')"""


@query(f"with {PAIRS_SQL} select * from p")
def q_start_terminal_pairs(spark: SparkSession, d: str) -> DataFrame:
    return J.pairs(events(spark, d), "user_id", "view", "click")


@query(f"with {PAIRS_SQL} select user_id, 20::bigint as watermark, count(*) filter (where end_seq is null or end_seq > 20) as n_in_flight from p where start_seq <= 20 group by 1")
def q_inflight_barrier(spark: SparkSession, d: str) -> DataFrame:
    return J.in_flight(events(spark, d), "user_id", "view", "click", F.lit(20).cast("long"))


@query(f"with {SEQ_SQL} select user_id, event_type, seq, value, lag(value) over w as before, round(value - lag(value) over w, 6) as change from e window w as (partition by user_id, event_type order by seq)")
def q_lag_score(spark: SparkSession, d: str) -> DataFrame:
    return J.previous(events(spark, d), ["user_id", "event_type"], "seq", "value").select("user_id", "event_type", "seq", "value", "before", "change")


@query(f"with {SEQ_SQL} select user_id, event_type, arg_max(props, seq) as props, max(seq) as seq from e group by 1, 2")
def q_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return J.last_wins(events(spark, d), ["user_id", "event_type"], "props", "seq")


@query(f"with {SEQ_SQL}, r as (select *, row_number() over (partition by user_id, event_type order by seq desc) as n from e) select user_id, event_type, count(*) as n_evicted, sha256(string_agg(seq::varchar, ',' order by seq)) as digest from r where n > 8 group by 1, 2")
def q_keep_last_n(spark: SparkSession, d: str) -> DataFrame:
    return J.keep_last(events(spark, d), ["user_id", "event_type"], "seq", 8)[1]


ALLOWED = [(a, b) for a in ("view", "click", "error", "purchase", "signup") for b in ("view", "click", "error", "purchase", "signup") if (len(a) * 3 + len(b)) % 4]


@query(f"with {SEQ_SQL}, s as (select user_id, seq, lag(event_type) over (partition by user_id order by seq) as before, event_type as after from e) select * from s where before is not null and (before, after) not in ({', '.join(str(x) for x in ALLOWED)})")
def q_status_matrix(spark: SparkSession, d: str) -> DataFrame:
    return J.illegal_pairs(events(spark, d), "user_id", spark.createDataFrame(ALLOWED, "before string, after string"))


@query(f"with {SEQ_SQL}, r as (select user_id, seq, (props->>'$.k')::bigint as ref from e) select user_id, seq, ref from r where ref is not null and (ref >= seq or (user_id, ref) not in (select user_id, seq from e))")
def q_causality(spark: SparkSession, d: str) -> DataFrame:
    """``props.k`` as the sequence of a cited event."""
    return J.causality_violations(events(spark, d), "user_id", F.get_json_object("props", "$.k").cast("long"))


BINDINGS_SQL = "select conv_id as session, turn as task, conv_id * 10 + turn % 2 as owner from conversations where turn < 2"


@query(f"""with b as ({BINDINGS_SQL}), l as (select conv_id as session, turn as task from conversations union all select -conv_id, turn from conversations where turn = 0),
x as (select session, task, min(owner) as eo from b group by 1, 2), w as (select session, count(distinct owner) as n, min(owner) as oo from b group by 1)
select l.session, l.task, case when eo is not null then 'exact' when n = 1 then 'session' when n > 1 then 'ambiguous' else 'unbound' end as how, case when eo is not null then eo when n = 1 then oo end as owner
from l left join x on x.session = l.session and x.task = l.task left join w on w.session = l.session""")
def q_lane_binding(spark: SparkSession, d: str) -> DataFrame:
    conv = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("task"))
    bindings = conv.where("task < 2").withColumn("owner", F.col("session") * 10 + F.col("task") % 2)
    lanes = conv.unionByName(conv.where("task = 0").withColumn("session", -F.col("session")))
    return J.bind_lanes(lanes, bindings, "session", "task")


@query("""select (event_id % 700) as idempotency_key, min(event_id) as kept, count(*) as n_same, count(distinct event_type) > 1 as collides from events group by 1""")
def q_idempotent(spark: SparkSession, d: str) -> DataFrame:
    drafts = table(spark, d, "events").withColumn("idempotency_key", F.col("event_id") % 700)
    return J.idempotent(drafts, "idempotency_key", "event_type", "event_id")


@query("""with p as (select distinct user_id, unnest(['error', 'purchase', 'refund']) as value, unnest(['absent', 'present', 'absent']) as kind from events),
s as (select distinct user_id, event_type as value, 1 as met from events)
select user_id, count(*) as n_predicates, cast(sum(case when kind = 'absent' then 1 - coalesce(met, 0) else coalesce(met, 0) end) as bigint) as n_met from p left join s using (user_id, value) group by 1""")
def q_retry_predicates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    wanted = F.inline(F.array(*[F.struct(F.lit(v).alias("value"), F.lit(k).alias("kind")) for v, k in (("error", "absent"), ("purchase", "present"), ("refund", "absent"))]))
    return J.retry_allowed(rows.withColumnRenamed("event_type", "type"), rows.select("user_id").distinct().select("user_id", wanted), "user_id")


@query()
def q_reduce_state(spark: SparkSession, d: str) -> DataFrame:
    """The lifecycle fold; tests hold it against the streaming form and a plain loop."""
    return J.reduce_state(events(spark, d), "user_id")


@query(f"with {SEQ_SQL}, r as (select user_id, seq, seq || ' ' || event_type as line, row_number() over (partition by user_id order by seq) as n from e) select user_id, count(*) filter (where n <= 40) as n_shown, count(*) filter (where n > 40) as n_hidden, sha256(string_agg(case when n <= 40 then line end, chr(10) order by seq)) as page_key from r group by 1")
def q_logbook(spark: SparkSession, d: str) -> DataFrame:
    return J.render_lines(events(spark, d), "user_id", F.concat_ws(" ", F.col("seq").cast("string"), "type"), 40)


@query("select user_id, event_id, sha256('tool' || chr(0) || user_id || chr(0) || event_id) as correlation from events")
def q_correlation_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", X.correlation_key(F.lit("tool"), F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("correlation"))
