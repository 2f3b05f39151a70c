"""Policies, constraints, settlement and reports over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import journal as J
from ..operators import planning as P
from .registry import query, table

SCOPES = [("exact", "10.1.2.3"), ("hostname", "example.org"), ("cidr", "10.1.0.0/20"), ("cidr", "10.3.128.0/17")]
ADDRESS = "'10.' || (event_id % 5) || '.' || (event_id % 250) || '.' || (event_id % 199)"
NUMBER = "(10 * 16777216 + (event_id % 5) * 65536 + (event_id % 250) * 256 + event_id % 199)"


@query(f"select event_id, {NUMBER} between 10 * 16777216 + 65536 and 10 * 16777216 + 65536 + 4095 or {NUMBER} between 10 * 16777216 + 3 * 65536 + 32768 and 10 * 16777216 + 3 * 65536 + 65535 or {ADDRESS} = '10.1.2.3' as authorized from events")
def q_authorization(spark: SparkSession, d: str) -> DataFrame:
    """IPv4 targets against exact entries and CIDR blocks, by equi-joins."""
    e = table(spark, d, "events").select("event_id", F.concat_ws(".", F.lit("10"), (F.col("event_id") % 5).cast("string"), (F.col("event_id") % 250).cast("string"), (F.col("event_id") % 199).cast("string")).alias("target"))
    seen = P.authorized(e.select("target").distinct(), spark.createDataFrame(SCOPES, "kind string, value string"))
    return e.join(seen, "target").select("event_id", "authorized")


PRIVATE = ["Theand", "moron", "ontion"]


@query("select doc_id, n_leaks from (select doc_id, len(list_filter(['moron', 'ontion', 'theand'], lambda p: contains(lower(text), p))) as n_leaks from documents) where n_leaks > 0")
def q_leak_scan(spark: SparkSession, d: str) -> DataFrame:
    return P.leaks(table(spark, d, "documents"), PRIVATE, "doc_id", "text")


HIDDEN = ["a b&c", "ontion", "Größe"]


@query(f"""with t as (select doc_id, lower(text || case doc_id % 6 when 0 then ' a%20b%26c' when 1 then ' A+B%26C' when 2 then ' a b&amp;c' when 3 then ' YSBiJmM=' when 4 then ' 6120622663' else ' gr%C3%B6%C3%9Fe' end) as t from documents)
select * from (select doc_id, {" + ".join("cast((" + " or ".join(f"contains(t, '{v}')" for v in P.variants(p)) + ") as bigint)" for p in HIDDEN)} as n_values from t) where n_values > 0""")
def q_encoded_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Private values in planted encodings behind the texts."""
    forms = F.array(*map(F.lit, (" a%20b%26c", " A+B%26C", " a b&amp;c", " YSBiJmM=", " 6120622663", " gr%C3%B6%C3%9Fe")))
    rows = table(spark, d, "documents").select("doc_id", F.concat("text", F.get(forms, (F.col("doc_id") % 6).cast("int"))).alias("t"))
    return P.encoded_leaks(rows, HIDDEN, "doc_id", "t")


@query("select doc_id, sha256(replace(replace(replace(text, 'thereon', '<B>'), 'there', '<A>'), 'on', '<C>')) as symbol_key from documents")
def q_symbolize(spark: SparkSession, d: str) -> DataFrame:
    text = P.symbolized(F.col("text"), [("there", "<A>"), ("thereon", "<B>"), ("on", "<C>")])
    return table(spark, d, "documents").select("doc_id", F.sha2(text, 256).alias("symbol_key"))


@query("""with r as (select item_id, lower(text) as t from benchmark), p as (select item_id, case when trim(t) = '' then 'empty' when contains(t, 'erh') then 'contains_flag' when contains(t, 'thand') or contains(t, 'onon') then 'contains_protected_alias' else 'allowed' end as reason from r)
select item_id, reason, case when reason = 'allowed' then 'allowed' else 'rejected' end as decision from p""")
def q_research_policy(spark: SparkSession, d: str) -> DataFrame:
    return P.research_policy(table(spark, d, "benchmark"), "text", ["Thand", "onon"], ["ERH"]).select("item_id", "reason", "decision")


@query("select p_partkey from part where not list_has_any(string_split(lower(p_name), ' '), ['blue', 'steel'])")
def q_topic_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").withColumn("topics", F.split(F.lower("p_name"), " "))
    return P.topic_compatible(rows, "topics", {"x": ["blue", "steel"]}, "x").select("p_partkey")


@query("""with n as (select l_orderkey, list(distinct l_linenumber) as ids, count(*) as c from lineitem group by 1), o as (select o_orderkey, range(1, 1 + (o_orderkey % 7)::bigint + 1) as want from orders),
v as (select o_orderkey, len(list_filter(want, lambda x: not list_contains(coalesce(ids, []), x::int))) as missing, len(list_filter(coalesce(ids, []), lambda x: not list_contains(want, x::bigint))) as extra, coalesce(c - len(ids), 0) as repeats from o left join n on o_orderkey = l_orderkey)
select * from v where missing > 0 or extra > 0 or repeats > 0""")
def q_bundle_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Declared line numbers (1 to key mod 7 and one) against those that the lines hold."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("id"))).alias("steps"))
    rows = table(spark, d, "orders").select("o_orderkey", F.sequence(F.lit(1).cast("long"), F.col("o_orderkey") % 7 + 1).alias("declared")).join(lines, "o_orderkey", "left")
    return P.bundle_violations(rows, "o_orderkey", "declared", "steps")


@query("select doc_id, count(*) as n_outcomes from (select doc_id from labels union all select doc_id from documents) group by 1 having count(*) <> 1")
def q_accounting(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select("doc_id").unionByName(table(spark, d, "documents").select("doc_id"))
    return P.accounting(rows, "doc_id")


@query("""with r as (select *, o_orderstatus = 'O' as act, row_number() over (partition by o_custkey order by (case when o_orderstatus = 'O' then 0 else 1 end), o_orderkey) as n from orders)
select o_orderkey, case when n <= 6 then 'hot' else 'cold' end as tier, act and n > 6 as overflow from r""")
def q_hot_cold(spark: SparkSession, d: str) -> DataFrame:
    return P.hot_cold(table(spark, d, "orders"), "o_custkey", "o_orderkey", F.col("o_orderstatus") == "O", 6).select("o_orderkey", "tier", "overflow")


@query("""with e as (select *, row_number() over (partition by user_id order by ts, event_id) as seq from events), g as (select *, 1 + sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by seq) as generation from e),
l as (select *, max(generation) over (partition by user_id) as latest from g)
select user_id, event_type, cast(generation as bigint) as generation, arg_max(props, seq) as props, count(*) as n_assessments from l where event_type <> 'signup' and generation = latest group by 1, 2, 3""")
def q_proof_progress(spark: SparkSession, d: str) -> DataFrame:
    rows = J.sequenced(table(spark, d, "events"), "user_id", "ts", "event_id")
    return P.proof_progress(rows, ["user_id"], "seq", F.col("event_type") == "signup", "props", "event_type").select("user_id", "event_type", "generation", "props", "n_assessments")


@query("""with c as (select source, doc_id, n_chars, unnest(range(0, ((n_chars - 1) // 1000) + 1)) as n from documents where n_chars > 0), s as (select *, n * 1000 as start, least(1000, n_chars - n * 1000) as length from c),
t as (select *, row_number() over (partition by source order by doc_id, n) as k, sum(length) over (partition by source order by doc_id, n) as used from s)
select source, doc_id, start, length from t where k <= 30 and used <= 25000""")
def q_settlement_slices(spark: SparkSession, d: str) -> DataFrame:
    return P.settlement_slices(table(spark, d, "documents"), "doc_id", "n_chars", 1000, 30, 25000, "source")


@query("""with i as (select conv_id, turn, 'c' || (turn // 2) || '_' || turn as id, turn + (turn // 2) * 10 as cite from conversations)
select conv_id, string_agg(id || ':' || cite, ',' order by turn) as merged from i group by 1""")
def q_merge_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Turns as drafts in chunks of two, merged by conversation."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 2).alias("part"))
    item = F.struct("turn", F.col("turn").cast("string").alias("id"), F.array(F.col("turn")).alias("cites"))
    parts = t.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(item)).alias("items"), (F.first("part") * 10).alias("offset"))
    merged = P.merged_drafts(parts, "conv_id", "part", "items", "offset")
    return merged.select("conv_id", F.array_join(F.transform("items", lambda x: F.concat(x["id"], F.lit(":"), x["cites"][0].cast("string"))), ",").alias("merged"))


@query()
def q_compile(spark: SparkSession, d: str) -> DataFrame:
    """Verdict routing with fixture steps instead of model calls."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return P.compiled(docs, "doc_id", "text", lambda t: str(len(t.split())), lambda x: None if int(x) >= 50 else "too_short", lambda x, _: str(int(x) * 2)).select("doc_id", "disposition", "reason", "n_repairs")


@query()
def q_sanitise_structure(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.sha2(P.sanitised(F.col("props")), 256).alias("props_key"))


@query("select event_id, cast(1 + event_id % 4 as bigint) as depth from events")
def q_record_depth(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("event_id") % 4).cast("int")
    text = F.concat(F.repeat(F.lit('{"a[": ['), n), F.col("props"), F.repeat(F.lit("]}"), n))
    return table(spark, d, "events").select("event_id", (P.record_depth(text) - n).cast("long").alias("depth"))


@query("""with r as (select *, lag(event_type) over w as p from events window w as (partition by user_id order by event_id)), g as (select *, sum(case when p is null or p <> event_type then 1 else 0 end) over (partition by user_id order by event_id) as run from r),
a as (select user_id, run, max(event_type) as event_type, count(*) as n, min(event_id) as since from g group by 1, 2), l as (select *, row_number() over (partition by user_id order by run desc) as k from a),
z as (select user_id % 5 as store, user_id, event_type, n, since, row_number() over (partition by user_id % 5 order by since desc, user_id) as rk from l where k = 1)
select store, user_id, event_type, n, since from z where rk <= 12""")
def q_health_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("store", F.col("user_id") % 5)
    return P.health_counters(rows, "store", "user_id", "event_type", "event_id", 12)


@query("""with r as (select doc_id, case when n_chars > 2000 then 'complete' when n_chars > 500 then 'partial' when n_chars > 50 then 'minimal' else 'unusable' end as q, ['reference', 'guidance', 'case_step', 'negative_evidence'][1 + doc_id % 4] as role from documents)
select doc_id, (case q when 'complete' then 0.75 when 'partial' then 0.5 when 'minimal' then 0.25 else 0.0 end)::double as reliability, case role when 'reference' then 'high' when 'guidance' then 'medium' when 'case_step' then 'low' else 'none' end as breadth,
(case when role in ('case_step', 'negative_evidence') then 0.75 else 0.25 end)::double as specificity from r""")
def q_assessment(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    quality = F.when(n > 2000, "complete").when(n > 500, "partial").when(n > 50, "minimal").otherwise("unusable")
    role = F.element_at(F.array(*map(F.lit, ("reference", "guidance", "case_step", "negative_evidence"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in P.assessment(quality, role).items()])
