"""Typed payloads over ``events.props``; the event types play payload types with declarations that some payloads break."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import payloads as P
from .registry import query, table

DECLARED = {"view": "k BIGINT, n NUMBER?", "click": "k BIGINT, ref STRING", "purchase": "k STRING, total NUMBER", "error": "code BIGINT?"}
#: What payloads hold besides ``props``, by event id.
MORE = ["", ', "n": 1.5', ', "ref": "a", "n": null', ', "total": 3, "code": "x"', ', "code": 7', ', "n": ']


def payloads(spark: SparkSession, d: str) -> DataFrame:
    more = F.get(F.array(*map(F.lit, MORE)), (F.col("event_id") % len(MORE)).cast("int"))
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("type"), F.concat(F.rtrim(F.col("props"), F.lit("}")), more, F.lit("}")).alias("payload"))


@query(f"""with d(type, field, kind, required) as (values ('view', 'k', 'BIGINT', true), ('view', 'n', 'NUMBER', false), ('click', 'k', 'BIGINT', true), ('click', 'ref', 'STRING', true), ('purchase', 'k', 'STRING', true), ('purchase', 'total', 'NUMBER', true), ('error', 'code', 'BIGINT', false)),
p as (select event_id, event_type as type, rtrim(props, '}}') || [{", ".join(f"'{m}'" for m in MORE)}][1 + event_id % {len(MORE)}] || '}}' as payload from events),
o as (select *, json_valid(payload) as whole from p where type in (select type from d)),
f as (select event_id, type, k as field, case json_type(json_extract(payload, '$.' || k)) when 'VARCHAR' then 'STRING' when 'UBIGINT' then 'BIGINT' when 'DOUBLE' then 'DECIMAL' else json_type(json_extract(payload, '$.' || k)) end as shape from (select *, unnest(json_keys(payload)) as k from o where whole)),
h as (select * from f where shape <> 'NULL')
select event_id, null::varchar as field, 'unknown_type' as problem from p where type not in (select type from d)
union all select event_id, null, 'not_an_object' from o where not whole
union all select event_id, field, case when kind is null then 'undeclared' else 'wrong_kind' end from h left join d using (type, field) where kind is null or not (kind = shape or kind = 'NUMBER' and shape in ('BIGINT', 'DECIMAL'))
union all select event_id, field, 'missing' from o join d using (type) where whole and required and not exists (select 1 from h where h.event_id = o.event_id and h.field = d.field)""")
def q_payload_problems(spark: SparkSession, d: str) -> DataFrame:
    return P.problems(payloads(spark, d), ["event_id"], P.declarations(spark, DECLARED))


@query("""select event_id, cast(json_extract(props, '$.k') as bigint) as k, cast(case when event_id % 6 = 1 then 1.5 end as double) as n from events where event_type = 'view' and event_id % 6 <> 5
union all select event_id, null, null from events where event_type = 'view' and event_id % 6 = 5""")
def q_payload_columns(spark: SparkSession, d: str) -> DataFrame:
    return P.laid_out(payloads(spark, d), ["event_id"], "view", DECLARED)
