"""Retrieval from end to end: ``benchmark`` items are queries of situations, ``documents`` are artifacts with facets and labels as their state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieve as E
from .registry import query, table
from .retrieval_queries import BM25_SQL, LANE_SQL

RELATIONS = ("required", "incompatible", "observed", "compatible", "unknown")
SERVICE = "services.web"


def queries(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("item_id")
    target = F.when(n % 11 == 0, "no target").when(n % 2 == 0, "10.0.0.1").otherwise("host.example.org")
    return table(spark, d, "benchmark").select(n.alias("query_id"), "text", target.alias("target"), F.when(n % 7 != 0, "authorized").when(n % 2 == 0, "unauthorized").alias("authorization"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = table(spark, d, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("group_key")).join(marks, "doc_id", "left")
    quality, toxic = F.col("quality"), F.col("toxic")
    lane = F.when((quality == 0) & (toxic == 1), F.lit(None)).when(toxic == 1, "negative_evidence").when(quality == 0, "guidance").when(quality == 1, "case_step").otherwise("reference")
    status = F.when((quality == 0) & (F.col("n_chars") < 300), "rejected").when(quality == 1, "verified").otherwise("extracted")
    sure = F.when(quality == 1, 0.8).when(quality == 0, 0.4).otherwise(0.6)
    return rows.select("doc_id", lane.alias("lane"), status.alias("status"), sure.alias("verification"), F.lit(1.0).alias("fresh"), F.coalesce(quality, F.lit(0)).alias("support"), F.coalesce(toxic, F.lit(0)).alias("against"), "group_key")


def facets(spark: SparkSession, d: str) -> DataFrame:
    """Language as an operating system, source as an open facet, and a service of every second document."""
    docs, n = table(spark, d, "documents").select("doc_id", "lang", "source"), F.col("doc_id")
    one = lambda keep, space, key, value, relation, sure: docs.where(keep).select(n.alias("artifact_id"), F.lit(space).alias("namespace"), F.lit(key).alias("key"), value.alias("value"), relation.alias("relation"), sure.alias("confidence"))
    five, three = F.get(F.array(*map(F.lit, RELATIONS)), (n % 5).cast("int")), F.get(F.array(*map(F.lit, ("required", "observed", "compatible"))), (n % 3).cast("int"))
    rows = one(n % 6 != 5, "typed", "os_family", F.col("lang"), five, 0.5 + (n % 5) / 10.0)
    rows = rows.unionByName(one(n % 4 != 3, "open", "source", F.col("source"), three, F.lit(0.9)))
    return rows.unionByName(one(n % 2 == 0, "typed", SERVICE, F.lit("apache"), F.lit("observed"), F.lit(0.8)))


def live(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What each situation knows: one language, two in every fifth; a source in every second; a service in every third."""
    items, n = table(spark, d, "benchmark").select("item_id"), F.col("item_id")
    langs = F.array(*map(F.lit, ("en", "fr", "de", "es")))
    row = lambda keep, space, key, value, sure: items.where(keep).select(n.alias("query_id"), F.lit(space).alias("namespace"), F.lit(key).alias("key"), value.alias("value"), F.lit(sure).alias("confidence"))
    known = row(n >= 0, "typed", "os_family", F.upper(F.get(langs, (n % 4).cast("int"))), 0.9)
    known = known.unionByName(row(n % 5 == 0, "typed", "os_family", F.get(langs, ((n + 1) % 4).cast("int")), 0.8))
    known = known.unionByName(row(n % 2 == 0, "open", "source", F.concat(F.lit("src"), (n % 20).cast("string")), 0.75))
    known = known.unionByName(row(n % 3 == 0, "open", "source", F.lit("unknown"), 1.0))
    return known, items.where(n % 3 == 0).select(n.alias("query_id"), F.lit("web").alias("service"))


def result(spark: SparkSession, d: str, available: bool = True) -> E.Result:
    known, services = live(spark, d)
    return E.retrieve(queries(spark, d), table(spark, d, "documents").select("doc_id", "text"), facts(spark, d), facets(spark, d), known, services, available=available)


GATED = "select item_id, text from benchmark where item_id % 11 <> 0 and item_id % 7 <> 0"
JUDGED = BM25_SQL.replace("from benchmark)", f"from ({GATED}))") + f""",
fa as (select doc_id, case when quality = 0 and toxic = 1 then null else {LANE_SQL} end as lane, case when quality = 0 and n_chars < 300 then 'rejected' when quality = 1 then 'verified' else 'extracted' end as status,
  case quality when 1 then 0.8 when 0 then 0.4 else 0.6 end::double as sure, coalesce(quality, 0) as support, coalesce(toxic, 0) as against, sha256(text) as group_key
  from documents left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1) using (doc_id)),
ca as (select * from (select query_id, fa.*, rank_value, row_number() over (partition by query_id, lane order by rank_value, s.doc_id) as rk from s join fa using (doc_id) where lane is not null) where rk <= 32),
cr as (select *, case when max(-rank_value) over (partition by query_id, lane) > 0 then round(-rank_value / max(-rank_value) over (partition by query_id, lane), 6) else 0.0 end as rel from ca),
fc as (select doc_id, 'os_family' as key, true as dim, lang as value, [{", ".join(f"'{r}'" for r in RELATIONS)}][1 + doc_id % 5] as relation, 0.5::double + (doc_id % 5) / 10.0::double as w from documents where doc_id % 6 <> 5
  union all select doc_id, 'source', false, source, ['required', 'observed', 'compatible'][1 + doc_id % 3], 0.9::double from documents where doc_id % 4 <> 3
  union all select doc_id, '{SERVICE}', false, 'apache', 'observed', 0.8::double from documents where doc_id % 2 = 0),
kn as (select item_id as query_id, 'os_family' as key, ['en', 'fr', 'de', 'es'][1 + item_id % 4] as value from benchmark union all select item_id, 'os_family', ['en', 'fr', 'de', 'es'][1 + (item_id + 1) % 4] from benchmark where item_id % 5 = 0
  union all select item_id, 'source', 'src' || item_id % 20 from benchmark where item_id % 2 = 0),
kv as (select query_id, key, list(distinct value) as vals from kn group by 1, 2),
jo as (select c.query_id, fc.*, coalesce(len(vals), 0) as nv, coalesce(list_contains(vals, fc.value), false) as exact, fc.key = '{SERVICE}' and c.query_id % 3 = 0 as soft from cr c join fc using (doc_id) left join kv on kv.query_id = c.query_id and kv.key = fc.key),
ru as (select *, case when relation = 'unknown' then 1 when dim and nv > 1 then 2 when relation = 'incompatible' then (case when exact then 3 when nv = 0 then 4 else 13 end) when relation = 'required' then (case when exact then 5 when nv > 0 then 6 else 7 end)
  when exact then 8 when nv > 0 then (case when relation = 'observed' and dim then 9 else 10 end) when soft then 11 when relation = 'observed' and dim then 12 else 13 end as rule from jo),
su as (select query_id, doc_id, bool_or(rule in (3, 6, 9)) as hard, sum(case when rule in (5, 6, 7) or (rule = 2 and relation = 'required') then w else 0 end) as req,
  sum(case when rule between 5 and 12 or (rule = 2 and relation in ('required', 'observed', 'compatible')) then w else 0 end) as sim, sum(case when rule = 5 then w else 0 end) as mreq, sum(case when rule in (5, 8) then w when rule = 11 then 0.75 * w else 0 end) as msim,
  sum(case when rule in (1, 2, 4, 7, 12) then w else 0 end) as unk, count(*) filter (where rule in (1, 2, 4, 7, 12)) as n_missing from ru group by 1, 2),
fi as (select *, least(1, round(case when req = 0 then 1.0 else mreq / req end + 1e-9, 6)) as cov, least(1, round(case when sim = 0 then 0.5 else msim / sim end + 1e-9, 6)) as simi, round(least(0.1, 0.1 * unk / greatest(1.0, req + sim + unk)), 6) as pen from su),
ba as (select cr.*, coalesce(cov, 1.0) as cov, coalesce(simi, 0.5) as simi, coalesce(pen, 0.0) as pen, coalesce(n_missing, 0) as n_missing, case when status = 'rejected' then 'rejected_status' when coalesce(hard, false) then 'incompatible' end as barred from cr left join fi using (query_id, doc_id)),
oc as (select query_id, lane, group_key, count(*) as freq from ba where barred is null group by 1, 2, 3),
tt as (select ba.*, round(least(1.0, 0.25 + 0.25 * support) * (case when support + against > 0 then support / (support + against) else 0.25 end) / sqrt(coalesce(freq, 1)) + 1e-9, 6) as di from ba left join oc using (query_id, lane, group_key)),
tu as (select *, case when barred is null then round(least(1.0, greatest(0.0, 0.30::double * rel + 0.20::double * cov + 0.15::double * simi + 0.20::double * sure + 0.05::double + 0.10::double * di - pen)) + 1e-9, 6) end as total from tt),
ju as (select *, coalesce(barred, case when total < case lane when 'reference' then 0.40 when 'case_step' then 0.45 when 'negative_evidence' then 0.35 else 0.50 end then 'below_threshold' end) as reason from tu)
"""


@query(JUDGED + """, u as (select *, row_number() over w as turn, first_value(total) over w as ls, first_value(doc_id) over w as li from ju where reason is null window w as (partition by query_id, lane, group_key order by total desc, doc_id)),
v as (select *, row_number() over (partition by query_id, lane order by turn, ls desc, li, group_key) as k from u)
select query_id, lane, doc_id, total::double as total, n_missing, row_number() over (partition by query_id, lane order by total desc, doc_id) as rank from v where k <= 5""")
def q_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Hits of all lanes: gated queries, candidates, applicability, scores, diversity."""
    return result(spark, d).hits.select("query_id", "lane", "doc_id", "total", "n_missing", "rank")


@query(JUDGED + """, o as (select query_id, count(*) filter (where reason is null) as n_good, coalesce(sum(n_missing) filter (where barred is null), 0) as n_missing from ju group by 1)
select item_id as query_id, case when item_id % 11 = 0 then 'invalid_target' when item_id % 7 = 0 then 'unauthorized_scope' else 'no_applicable_knowledge' end as gap, item_id % 11 <> 0 and item_id % 7 <> 0 as research, cast(case when item_id % 11 <> 0 and item_id % 7 <> 0 then coalesce(n_missing, 0) else 0 end as bigint) as n_missing
from benchmark left join o on query_id = item_id where item_id % 11 = 0 or item_id % 7 = 0 or coalesce(n_good, 0) = 0""")
def q_retrieve_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The typed reason of every query without a hit, before or after the search."""
    return result(spark, d).gaps


@query(JUDGED + "select query_id, lane, reason, count(*) as n, cast(sum(doc_id) as bigint) as ids from ju where reason is not null group by all")
def q_retrieve_rejected(spark: SparkSession, d: str) -> DataFrame:
    """What was found but did not qualify, by reason."""
    return result(spark, d).rejected.groupBy("query_id", "lane", "reason").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))
