"""Sagas, leases, ledgers and closures over ``events``: a user is a journal, ``props.k`` a call or an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from .journal_queries import SEQ_SQL, events
from .registry import query, table

K_SQL = "(props->>'$.k')::bigint"


def calls(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


@query(f"""with {SEQ_SQL}, r as (select *, max(case when event_type = 'signup' then seq end) over (partition by user_id order by seq rows between unbounded preceding and 1 preceding) as asked, lead(event_type) over (partition by user_id order by seq) as nxt from e)
select user_id, seq, case when asked is null then 'no_closure' when nxt is null or nxt <> 'view' then 'no_start_follows' end as violation from r where event_type = 'error'""")
def q_cancelled_closures(spark: SparkSession, d: str) -> DataFrame:
    return L.cancelled_closures(events(spark, d), "user_id", "signup", "error", "view")


STEPS = [(None, "view"), ("view", "view"), ("view", "click"), ("click", "click"), ("click", "purchase"), ("purchase", "view"), ("view", "error"), ("error", "view")]


@query(f"""with {SEQ_SQL}, r as (select user_id, seq, coalesce(lag(event_type) over w, '') || '>' || event_type as pair, value, lag(value) over w as rev from e window w as (partition by user_id order by seq))
select * from (select user_id, seq, case when pair not in ({", ".join(f"'{a or ''}>{b}'" for a, b in STEPS)}) then 'illegal_stage' when value < rev then 'falling_revision' end as violation from r) where violation is not null""")
def q_saga_violations(spark: SparkSession, d: str) -> DataFrame:
    return L.saga_violations(events(spark, d), "user_id", STEPS, "value")


@query(f"""with {SEQ_SQL}, k as (select *, {K_SQL} as k from e), s as (select user_id, k, max(seq) as moment from k where event_type = 'purchase' group by 1, 2), g as (select user_id, k, max(seq) as gone from k where event_type = 'error' group by 1, 2),
r as (select s.*, gone is null or gone < moment as live from s left join g using (user_id, k)), l as (select user_id, arg_max(k, moment) as last from r where live group by 1)
select user_id, k as revision, case when not live then 'revoked' when last = k then 'active' else 'superseded' end as state from r left join l using (user_id)""")
def q_active_revisions(spark: SparkSession, d: str) -> DataFrame:
    return L.active_revisions(calls(spark, d).withColumnRenamed("k", "revision"), "user_id", "purchase", "error", "revision")


@query("""with r as (select l_suppkey as owner, l_orderkey as batch, l_partkey % 100 as entity, l_returnflag as status, round(l_discount * 10, 3) as score, l_linenumber from lineitem),
b as (select l_suppkey as owner, l_orderkey as batch, case when o_orderstatus = 'P' then 2 else 1 end as expected, o_orderkey as moment from lineitem join orders on l_orderkey = o_orderkey group by all),
h as (select owner, batch, count(*) as n from r group by 1, 2), w as (select owner, batch, moment from b join h using (owner, batch) where expected = n),
m as (select owner, entity, max((moment, l_linenumber, status, score, batch)) as m from r join w using (owner, batch) group by 1, 2)
select owner, entity, m[5] as batch, m[3] as status, m[4] as score, case when m[4] >= 0.5 then 'hot' else 'cold' end as tier from m""")
def q_strategy_ledger(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    records = lines.select(F.col("l_suppkey").alias("owner"), F.col("l_orderkey").alias("batch"), (F.col("l_partkey") % 100).alias("entity"), F.col("l_returnflag").alias("status"), F.round(F.col("l_discount") * 10, 3).alias("score"), "l_linenumber")
    # of two records of an entity in one batch the later line counts
    # dealt by order, owners and their batches are told apart where they stand
    n = L.parts(lines)
    pairs = lines.select(F.col("l_suppkey").alias("owner"), F.col("l_orderkey").alias("batch")).repartition(n, "batch").distinct()
    known = orders.select(F.col("o_orderkey").alias("batch"), F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("expected"), F.col("o_orderkey").alias("at")).repartition(n, "batch")
    whole = pairs.join(known, "batch").select("owner", "batch", "expected", "at").distinct()
    return L.ledger(records, whole, "owner", "batch", "entity", "l_linenumber", F.col("score") >= 0.5)


@query(f"""with {SEQ_SQL}, l as (select user_id, arg_max({K_SQL} % 10, seq) as batch from e where event_type = 'purchase' group by 1), p as (select user_id, {K_SQL} % 10 as batch, event_id, seq from e where event_type = 'click')
select p.user_id, p.batch, event_id, seq from p join l on p.user_id = l.user_id and p.batch = l.batch""")
def q_frontier(spark: SparkSession, d: str) -> DataFrame:
    rows = calls(spark, d).withColumn("batch", F.col("k") % 10)
    return L.frontier(rows.withColumn("accepted", F.col("type") == "purchase"), rows.where("type = 'click'").select("user_id", "batch", "event_id", "seq"), "user_id", "batch")


@query(f"""with {SEQ_SQL}, k as (select *, {K_SQL} as k, case when value > 20 then 'timed_out' else 'abandoned' end as reason from e), b as (select user_id, k, min(seq) as f from k where event_type = 'view' group by 1, 2),
x as (select b.user_id, b.k, min((seq, event_type, reason)) as m from b join k on k.user_id = b.user_id and k.k = b.k and seq > f and event_type in ('click', 'purchase', 'error') group by 1, 2)
select b.user_id, b.k, case when m is null then 'in_flight' when m[2] = 'error' then m[3] when m[2] = 'click' then 'succeeded' else 'failed' end as state from b left join x using (user_id, k)""")
def q_call_states(spark: SparkSession, d: str) -> DataFrame:
    rows = calls(spark, d).withColumn("reason", F.when(F.col("value") > 20, "timed_out").otherwise("abandoned"))
    return L.call_states(rows, "user_id", "k", "view", {"click": "succeeded", "purchase": "failed"}, "error")


@query("""with c as (select user_id, ts as moment, 'h' || (event_id % 2) as claimer, event_id from events where event_type = 'signup'), s as (select user_id, event_id as stage, 'h' || (event_id % 2) as holder, ts as moment from events where event_type <> 'signup'),
j as (select s.*, c.moment as claimed, c.claimer from s asof left join c on s.user_id = c.user_id and s.moment >= c.moment)
select user_id, stage, case when claimed is null then 'unclaimed' when moment >= claimed + interval 300 minutes then 'expired' when claimer <> holder then 'foreign' else 'held' end as state from j""")
def q_leases(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.col("ts").alias("at"), F.concat(F.lit("h"), (F.col("event_id") % 2).cast("string")).alias("holder"), F.col("event_id").alias("stage"), "event_type")
    return L.leases(rows.where("event_type = 'signup'"), rows.where("event_type <> 'signup'"), "user_id", 300)


CLOSURE_SQL = f"""a as (select user_id, max(seq) - 1 as watermark from e where event_type = 'signup' group by 1), c as (select user_id, {K_SQL} as k, min(case when event_type = 'view' then seq end) as f, max(case when event_type = 'click' then seq end) as t from e where event_type in ('view', 'click') group by 1, 2),
z as (select a.user_id, watermark, count(*) filter (where coalesce(f <= watermark and (t is null or t < f), false)) as n_waiting from a left join c using (user_id) group by 1, 2)"""


@query(f"with {SEQ_SQL}, {CLOSURE_SQL} select *, n_waiting = 0 as ready from z")
def q_closure_states(spark: SparkSession, d: str) -> DataFrame:
    return L.closure_states(calls(spark, d), "user_id", "signup", "view", "click", "k")


@query(f"""with {SEQ_SQL}, {CLOSURE_SQL}, p as (select user_id, count(*) filter (where event_type = 'error') < 40 as complete from e group by 1)
select coalesce(p.user_id, z.user_id) as user_id, case when coalesce(complete, false) and coalesce(n_waiting = 0, false) then 'complete' when not coalesce(complete, false) then 'blocked' else 'waiting' end as outcome from p full join z on p.user_id = z.user_id""")
def q_settled(spark: SparkSession, d: str) -> DataFrame:
    rows = calls(spark, d)
    proofs = rows.groupBy("user_id").agg((F.count_if(F.col("type") == "error") < 40).alias("complete"))
    return L.settled(proofs, L.closure_states(rows, "user_id", "signup", "view", "click", "k"), "user_id")


@query(f"""with {SEQ_SQL} select user_id, max(seq) as revision, count(*) filter (where event_type = 'view') as n_views, max(seq) filter (where event_type = 'view') as last_views, count(*) filter (where value > 30) as n_large, max(seq) filter (where value > 30) as last_large from e group by 1""")
def q_state_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return L.snapshot(events(spark, d), "user_id", {"views": F.col("type") == "view", "large": F.col("value") > 30})


@query(f"""with {SEQ_SQL}, k as (select *, {K_SQL} as k from e), b as (select user_id, k, min(seq) as f from k where event_type = 'view' group by 1, 2),
r as (select k.user_id, k.k, seq, f, min(case when seq > f then seq end) over (partition by k.user_id, k.k) as first from k left join b on b.user_id = k.user_id and b.k = k.k where event_type = 'click')
select user_id, k, seq, case when f is null then 'orphan' when seq < f then 'early' when seq = first then 'complete' else 'duplicate' end as route from r""")
def q_completion_routes(spark: SparkSession, d: str) -> DataFrame:
    rows = calls(spark, d)
    return L.completions_routed(rows.where("type = 'view'"), rows.where("type = 'click'"), "user_id", "k")
