"""Planner passes over ``events``: a user is an engagement, the keys of its events are strategies, its events are what it knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import planner as P
from .registry import query, table

KINDS = ("fact_present", "fact_changed", "prerequisite_satisfied", "evidence_category_present", "credential_available", "state_revision_after")
FLOOR, ROUNDS = 0.2, 9


def parts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Ledger, proposals, predicates, knowledge and revisions of every engagement."""
    e = table(spark, d, "events").select(F.col("user_id").alias("engagement_id"), F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type", "value", "event_id")
    # five frames come from the strategies, so the events are read for them once
    s = P.cut(e.groupBy("engagement_id", F.col("k").alias("strategy_id")).agg(F.max("event_id").alias("e")))
    k = F.col("strategy_id")
    status = F.get(F.array(*map(F.lit, ("available", "deferred", "completed", "blocked", "archived"))), (k % 5).cast("int"))
    ledger = s.select("engagement_id", "strategy_id", status.alias("status"), ((F.col("e") % 10) / 10).alias("score"))
    proposals = s.where(F.col("e") % 3 == 0).select("engagement_id", "strategy_id", F.when(k % 2 == 0, "available").otherwise("blocked").alias("status"), ((F.col("e") % 7) / 10).alias("score"), F.when(F.col("e") % 4 != 0, "seen").alias("reason"))
    kind = F.get(F.array(*map(F.lit, KINDS)), ((k + F.col("e")) % 6).cast("int"))
    subject = F.when(kind == "prerequisite_satisfied", F.concat(F.lit("s"), (k - 1).cast("string"))).otherwise(F.concat(F.lit("t"), ((k + 1) % 9).cast("string")))
    expected = F.when(kind == "fact_changed", F.sha2(F.lit("v0"), 256)).when(kind == "evidence_category_present", F.get(F.array(*map(F.lit, ("error", "purchase", "nothing"))), (k % 3).cast("int"))).when(kind == "state_revision_after", (F.col("e") + 50).cast("string"))
    predicates = s.select("engagement_id", "strategy_id", F.concat(F.lit("p"), k.cast("string")).alias("predicate_id"), kind.alias("kind"), subject.alias("subject"), expected.alias("expected"))
    cls = F.get(F.array(*map(F.lit, ("fact", "facet", "access", "secret"))), (F.col("event_id") % 4).cast("int"))
    row = lambda cls, subject, value: F.struct(cls.alias("class"), subject.alias("subject"), value.cast("string").alias("value"))
    told = row(cls, F.concat(F.lit("t"), (F.col("k") % 30).cast("string")), F.concat(F.lit("v"), (F.col("event_id") % 2).cast("string")))
    outcome = row(F.lit("outcome"), F.col("event_type"), F.lit(None))
    # an outcome's event is one that tells, too
    known = e.where("event_id % 5 = 0").select("engagement_id", F.inline_outer(F.when(F.expr("event_type in ('error', 'purchase') and event_id % 40 = 0"), F.array(told, outcome)).otherwise(F.array(told)))).distinct()
    return {"ledger": ledger, "proposals": proposals, "predicates": predicates, "known": known, "revisions": s.groupBy("engagement_id").agg(F.max("e").alias("material_revision"))}


def provides(hot: DataFrame) -> DataFrame:
    """A strategy that may be run gives access by its name."""
    return hot.select("engagement_id", F.lit("access").alias("class"), F.concat(F.lit("s"), F.col("strategy_id").cast("string")).alias("subject"), F.lit(None).cast("string").alias("value"))


PARTS_SQL = f"""e as (select user_id as g, json_extract_string(props, '$.k')::bigint as k, event_type, event_id from events), s as (select g, k, max(event_id) as e from e group by 1, 2),
led as (select g, k, ['available', 'deferred', 'completed', 'blocked', 'archived'][1 + k % 5] as status, (e % 10) / 10.0::double as score from s),
pro as (select g, k, case when k % 2 = 0 then 'available' else 'blocked' end as status, (e % 7) / 10.0::double as score, e % 4 <> 0 as told from s where e % 3 = 0),
pk as (select g, k, e, [{", ".join(f"'{k}'" for k in KINDS)}][1 + (k + e) % 6] as kind from s),
pre as (select *, case when kind = 'prerequisite_satisfied' then 's' || (k - 1) else 't' || ((k + 1) % 9) end as subject, ['error', 'purchase', 'nothing'][1 + k % 3] as outcome from pk),
kn as (select distinct g, ['fact', 'facet', 'access', 'secret'][1 + event_id % 4] as class, 't' || (k % 30) as subject, 'v' || (event_id % 2) as value from e where event_id % 5 = 0),
oc as (select distinct g, event_type as outcome from e where event_type in ('error', 'purchase') and event_id % 40 = 0), rev as (select g, max(event_id) as m from e group by 1),
hold as (select distinct p.g, p.k from pre p where (kind = 'fact_present' and exists (select 1 from kn where kn.g = p.g and class in ('fact', 'facet') and kn.subject = p.subject))
  or (kind = 'fact_changed' and exists (select 1 from kn where kn.g = p.g and class = 'facet' and kn.subject = p.subject and value <> 'v0'))
  or (kind = 'credential_available' and exists (select 1 from kn where kn.g = p.g and class = 'secret' and kn.subject = p.subject)) or (kind = 'evidence_category_present' and exists (select 1 from oc where oc.g = p.g and oc.outcome = p.outcome))
  or (kind = 'state_revision_after' and exists (select 1 from rev where rev.g = p.g and m > p.e + 50)) or (kind = 'prerequisite_satisfied' and exists (select 1 from kn where kn.g = p.g and class in ('fact', 'facet', 'access') and kn.subject = p.subject)))"""


def _rounds() -> str:
    """One CTE for each round; more rounds than any engagement needs change nothing."""
    out = ""
    for n in range(ROUNDS):
        out += f""",
c{n} as (select g, k from l{n} where status = 'archived' and ((g, k) in (select g, k from hold) or exists (select 1 from pre p join l{n} h on h.g = p.g and h.status in ('available', 'deferred') and p.subject = 's' || h.k where p.kind = 'prerequisite_satisfied' and p.g = l{n}.g and p.k = l{n}.k))),
b{n} as (select g, k from c{n} qualify row_number() over (partition by g order by cast(k as varchar)) <= 16),
l{n + 1} as (select g, k, case when (g, k) in (select g, k from b{n}) then 'available' else status end as status, case when (g, k) in (select g, k from b{n}) then greatest(score, {FLOOR}) else score end as score from l{n})"""
    return out


@query(f"""with {PARTS_SQL}, bad as (select pro.g, pro.k from pro join led using (g, k) where round(abs(pro.score - led.score), 6) >= 0.05 and not told),
rec as (select g, k, coalesce(p.status, l.status) as status, coalesce(p.score, l.score) as score from led l left join (select * from pro where (g, k) not in (select g, k from bad)) p using (g, k)),
l0 as (select g, k, case when status not in ('available', 'deferred') or score < {FLOOR} then 'archived' else status end as status, score from rec){_rounds()}
select g as engagement_id, k as strategy_id, status, score from l{ROUNDS}""")
def q_planner_pass(spark: SparkSession, d: str) -> DataFrame:
    """Ledgers after a pass: refused, reconciled, archived, and brought back to a fixpoint."""
    p = parts(spark, d)
    after, _ = P.planner_pass(p["ledger"], p["proposals"], p["predicates"], p["known"], p["revisions"], provides, FLOOR)
    return after


@query(f"with {PARTS_SQL} select g as engagement_id, k as strategy_id from (select h.g, h.k, row_number() over (partition by h.g order by cast(h.k as varchar)) as n from hold h join led using (g, k) where status = 'archived') where n <= 16")
def q_reactivations(spark: SparkSession, d: str) -> DataFrame:
    """Archived strategies of which a typed predicate holds, at most 16 of an engagement."""
    p = parts(spark, d)
    return P.reactivations(p["ledger"], P.satisfied(p["predicates"], p["known"], p["revisions"]))


@query(f"with {PARTS_SQL} select pro.g as engagement_id, pro.k as strategy_id, led.score as before, pro.score from pro join led using (g, k) where round(abs(pro.score - led.score), 6) >= 0.05 and not told")
def q_score_changes(spark: SparkSession, d: str) -> DataFrame:
    """Proposals that move a score without a reason."""
    p = parts(spark, d)
    return P.unexplained_changes(p["ledger"], p["proposals"])
