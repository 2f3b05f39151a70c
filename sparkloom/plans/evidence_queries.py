"""Evidence, registries and constraints over the test tables: an order is a journal, its lines are evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from .journal_queries import SEQ_SQL, events
from .registry import query, table


@query("select event_id, user_id, event_type from events where event_id > 100 and event_id <= 900 order by event_id limit 64")
def q_page_between(spark: SparkSession, d: str) -> DataFrame:
    return E.page_between(table(spark, d, "events"), "event_id", 100, 900, 64).select("event_id", "user_id", "event_type")


@query("""with b as (select sha256(text) as digest, n_chars from documents), r as (select sha256(text) as digest from documents join labels using (doc_id)) select digest, count(*) as n from b where digest not in (select digest from r) group by 1""")
def q_orphan_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Texts as blobs; those of labelled documents are referenced."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    referenced = docs.join(table(spark, d, "labels"), "doc_id", "left_semi")
    return E.orphan_counts(docs, referenced, "digest")


@query("""with b as (select doc_id, source, sha256(text) as digest, n_chars from documents), f as (select *, row_number() over (partition by source, digest order by doc_id) = 1 as first, n_chars <= 20000 as fits from b),
u as (select *, sum(case when first and fits then n_chars else 0 end) over (partition by source order by doc_id) as used from f)
select doc_id, case when not fits then 'too_large' when not first then 'duplicate' when used > 100000 then 'over_quota' else 'stored' end as verdict from u""")
def q_blob_quota(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"), "n_chars")
    return E.admitted_blobs(rows, "source", "doc_id", "digest", "n_chars", 20_000, 100_000).select("doc_id", "verdict")


@query("""with o as (select s_suppkey as source_id, s_name as name, s_acctbal as balance from supplier where s_nationkey <> 3), n as (select s_suppkey as source_id, s_name as name, case when s_acctbal < 0 then 0.0 else s_acctbal end as balance from supplier where s_nationkey <> 7)
select coalesce(o.source_id, n.source_id) as source_id, coalesce(n.name, o.name) as name, coalesce(n.balance, o.balance) as balance, case when o.source_id is null then 'added' when n.source_id is null then 'kept' when o.name is not distinct from n.name and o.balance is not distinct from n.balance then 'unchanged' else 'updated' end as state from o full join n on o.source_id = n.source_id""")
def q_registry_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    new = rows.where("s_nationkey <> 7").withColumn("balance", F.when(F.col("balance") < 0, 0.0).otherwise(F.col("balance")))
    return E.registry_merge(rows.where("s_nationkey <> 3"), new, "source_id", ["name", "balance"])


@query("""with s as (select e.event_id, user_id * 3 as doc_id, cast(value * 10 as bigint) - 20 as start, cast(value * 40 as bigint) as stop, case when event_type = 'error' then 'log' else 'text' end as media from events e)
select event_id, case when d.doc_id is null then 'unknown_attachment' when start < 0 or stop <= start or stop > n_chars then 'range' when media <> (case when lang = 'en' then 'log' else 'text' end) then 'media' end as error from s left join documents d on s.doc_id = d.doc_id""")
def q_evidence_slices(spark: SparkSession, d: str) -> DataFrame:
    slices = table(spark, d, "events").select(
        "event_id", (F.col("user_id") * 3).alias("doc_id"), (F.round(F.col("value") * 10).cast("long") - 20).alias("start"), F.round(F.col("value") * 40).cast("long").alias("stop"), F.when(F.col("event_type") == "error", "log").otherwise("text").alias("media")
    )
    kinds = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("size"), F.when(F.col("lang") == "en", "log").otherwise("text").alias("kind"))
    return E.slice_errors(slices, kinds, "doc_id").select("event_id", "error")


@query("""with c as (select doc_id, source, n_chars, len(string_split(text, chr(10))) as n_items, row_number() over (partition by source order by n_chars, doc_id) as n from documents)
select doc_id, case when n > 400 then 'too_many' when n_chars > 8192 then 'n_chars' when n_items > 24 then 'n_items' end as reason from c""")
def q_candidate_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars", F.size(F.split("text", "\n")).alias("n_items"))
    return E.over_budget(rows, "source", [F.col("n_chars"), F.col("doc_id")], 400, {"n_chars": 8192, "n_items": 24}).select("doc_id", "reason")


RELATION_SQL = "case p_size % 3 when 0 then 'required' when 1 then 'incompatible' else 'platform' end"
CONSTRAINTS_SQL = f"""select p_partkey as example, 'type' as dimension, {RELATION_SQL} as relation, lower(p_type) as value from part union all
select p_partkey, 'brand', case when p_size < 25 then 'platform' else 'incompatible' end, lower(p_brand) from part union all select p_partkey, 'colour', 'platform', 'red' from part"""
OBSERVED = [("type", "economy"), ("type", "standard"), ("brand", "brand#12"), ("brand", "brand#3")]
OBSERVED_SQL = "values " + ", ".join(f"('{a}', '{b}')" for a, b in OBSERVED)


@query(f"""with c as ({CONSTRAINTS_SQL}), o as (select * from ({OBSERVED_SQL}) t(dimension, value)),
j as (select c.*, exists(select 1 from o where o.dimension = c.dimension) as known, exists(select 1 from o where o.dimension = c.dimension and o.value = c.value) as there from c),
b as (select example, (relation = 'required' and not there) or (relation = 'incompatible' and there) or (relation = 'platform' and known and not there) as broken from j)
select example, not bool_or(broken) as applicable, count(*) filter (where broken) as n_broken from b group by 1""")
def q_example_applicability(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("example"), "p_size", F.lower("p_type").alias("type"), F.lower("p_brand").alias("brand"))
    size = F.col("p_size")
    each = F.array(
        F.struct(F.lit("type").alias("dimension"), F.when(size % 3 == 0, "required").when(size % 3 == 1, "incompatible").otherwise("platform").alias("relation"), F.col("type").alias("value")),
        F.struct(F.lit("brand").alias("dimension"), F.when(size < 25, "platform").otherwise("incompatible").alias("relation"), F.col("brand").alias("value")),
        F.struct(F.lit("colour").alias("dimension"), F.lit("platform").alias("relation"), F.lit("red").alias("value")),
    )
    return E.applicable_examples(part.select("example", F.inline(each)), spark.createDataFrame(OBSERVED, "dimension string, value string"))


@query("""with m as (select l_partkey as part, count(distinct l_suppkey) as n, min(l_suppkey) as owner from lineitem group by 1), c as (select l_partkey as part, l_suppkey as owner, count(*) as n_claims from lineitem where l_quantity > 40 group by 1, 2)
select c.part, c.owner, n_claims, case when n > 1 then 'ambiguous_owner' when m.owner <> c.owner then 'foreign_owner' end as conflict from c left join m using (part)""")
def q_ownership_conflicts(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("owner"), "l_quantity")
    claims = lines.where("l_quantity > 40").groupBy("part", "owner").agg(F.count("*").alias("n_claims"))
    return E.ownership_conflicts(claims, lines, "part", "owner")


RULES = [("view", False, False), ("click", True, False), ("purchase", True, False), ("signup", False, True)]


@query(f"""with r as (select * from (values {", ".join(f"('{t}', {str(a).lower()}, {str(b).lower()})" for t, a, b in RULES)}) t(type, needs_lane, system_only))
select event_id, case when needs_lane is null then 'unknown_type' when needs_lane and value <= 5 then 'lane_required' when system_only and user_id % 2 = 1 then 'system_only' end as violation from events left join r on event_type = type""")
def q_envelope_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("type"), F.when(F.col("value") > 5, "lane").alias("lane"), F.when(F.col("user_id") % 2 == 1, "agent").otherwise("system").alias("origin"))
    return E.envelope_violations(rows, spark.createDataFrame(RULES, "type string, needs_lane boolean, system_only boolean")).select("event_id", "violation")


@query("""with r as (select p_partkey as row, unnest(string_split(p_name, ' ')) as scope from part), a as (select c_custkey as request, unnest([c_name, ['small', 'red', 'brass ring', 'nothing'][1 + c_custkey % 4], 'gear' || c_custkey]) as scope from customer),
f as (select request, count(distinct row) as n, min(row) as chosen from a join r using (scope) group by 1)
select c_custkey as request, coalesce(n, 0) as n, case when n = 1 then chosen end as chosen, case when coalesce(n, 0) = 0 then 'none' when n = 1 then 'one' else 'ambiguous' end as how from customer left join f on request = c_custkey""")
def q_resumable(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("scopes"))
    key = F.col("c_custkey")
    words = F.array(*map(F.lit, ("small", "red", "brass ring", "nothing")))
    asked = table(spark, d, "customer").select(key.alias("request"), F.array("c_name", F.get(words, (key % 4).cast("int")), F.concat(F.lit("gear"), key.cast("string"))).alias("scopes"))
    return E.resumable(rows, asked, "p_partkey", "scopes")


@query("""with q as (select distinct o_orderkey as key, l_suppkey % 4 as proof from orders join lineitem on o_orderkey = l_orderkey), a as (select l_orderkey as key, l_suppkey % 4 as proof, arg_max(case when l_returnflag = 'R' then 'refuted' else 'supported' end, (l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_returnflag)) as status from lineitem where l_quantity > 10 group by 1, 2)
select key, count(*) as n_required, bool_and(coalesce(status = 'supported', false)) as complete from q left join a using (key, proof) group by 1""")
def q_all_proven(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_suppkey") % 4).alias("proof"), F.when(F.col("l_returnflag") == "R", "refuted").otherwise("supported").alias("status"), "l_quantity", F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_returnflag").alias("at"))
    required = table(spark, d, "orders").select(F.col("o_orderkey").alias("key")).join(lines.select("key", "proof"), "key").distinct()
    return E.all_proven(required, lines.where("l_quantity > 10"), "key", "proof", "at")


@query("""with v as (select l_orderkey as record, list(case when l_tax > 0.06 then 'material' else 'minor' end) as findings, list(l_partkey order by l_linenumber, l_partkey) as citations, count(*) filter (where l_returnflag = 'R') as n_reasons, count(*) filter (where l_linestatus = 'F') as n_messages, min(l_quantity) > 5 as verified from lineitem group by 1)
select record, case when verified and list_contains(findings, 'material') then 'material_finding' when n_reasons <> n_messages then 'unmatched_reasons' when list_sort(list_distinct(citations)) <> citations then 'citations' end as violation from v""")
def q_verdict_consistency(spark: SparkSession, d: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    v = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("record")).agg(
        F.collect_list(F.when(F.col("l_tax") > 0.06, "material").otherwise("minor")).alias("findings"), F.transform(ordered, lambda x: x["l_partkey"]).alias("citations"),
        F.collect_list(F.when(F.col("l_returnflag") == "R", 1)).alias("reasons"), F.collect_list(F.when(F.col("l_linestatus") == "F", 1)).alias("messages"), (F.min("l_quantity") > 5).alias("verified"),
    )
    return E.verdict_violations(v).select("record", "violation")


@query("""with s as (select o_orderkey as session, case when o_orderkey % 3 > 0 then o_orderkey * 2 // 3 end as parent, case when o_orderstatus <> 'O' then o_custkey end as owner from orders)
select c.session, c.parent, p.owner as parent_owner, case when p.session is null then 'unknown_parent' when p.owner is null then 'unbound_parent' else 'bound' end as link from s c left join s p on c.parent = p.session where c.parent is not null""")
def q_child_sessions(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(key.alias("session"), F.when(key % 3 > 0, F.expr("o_orderkey * 2 div 3")).alias("parent"), F.when(F.col("o_orderstatus") != "O", F.col("o_custkey")).alias("owner"))
    return E.child_sessions(rows, "session", "parent", "owner")


@query("""with n as (select l_orderkey as order_key, l_suppkey as value, count(*) as n from lineitem where l_linestatus = 'F' group by 1, 2), v as (select distinct l_orderkey as order_key, l_suppkey as value from lineitem)
select v.*, case when n = 1 then 'one' when n > 1 then 'several' else 'none' end as backing from v left join n using (order_key, value)""")
def q_backed_values(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_suppkey").alias("value"), F.when(F.col("l_linestatus") == "F", "supported").otherwise("open").alias("status"))
    return E.backed_values(lines.select("order_key", "value").distinct(), lines, ["order_key", "value"])


@query("""with a as (select event_id, md5(event_type || value::varchar) as digest from events where event_type <> 'signup'), r as (select event_id, md5(event_type || (case when user_id = 8 then 0.0 else value end)::varchar) as digest from events)
select r.event_id, case when a.event_id is null then 'missing' when a.digest = r.digest then 'same' else 'changed' end as state from r left join a using (event_id)""")
def q_archive_matches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    digest = lambda value: F.md5(F.concat("event_type", value.cast("string")))
    archive = rows.where("event_type <> 'signup'").select("event_id", digest(F.col("value")).alias("digest"))
    records = rows.select("event_id", digest(F.when(F.col("user_id") == 8, 0.0).otherwise(F.col("value"))).alias("digest"))
    return E.archive_matches(records, archive, "event_id", "digest").select("event_id", "state")


@query("""with h as (select o_custkey as asker, l_partkey as artifact, case l_returnflag when 'A' then 'case_step' when 'N' then 'reference' else 'guidance' end as lane, row_number() over (partition by o_custkey order by l_quantity desc, l_orderkey, l_linenumber, l_partkey) as rank from orders join lineitem on o_orderkey = l_orderkey),
x as (select p_partkey as artifact, p_size as example from part where p_retailprice > 905), b as (select asker, example, min((list_position(['reference', 'case_step', 'guidance'], lane), rank, lane)) as m from h join x using (artifact) group by 1, 2),
n as (select asker, example, m[3] as lane, row_number() over (partition by asker order by m[1], m[2], example) as n from b) select * from n where n <= 16""")
def q_drill_down(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    flag = F.col("l_returnflag")
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    order = Window.partitionBy("o_custkey").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_partkey")
    hits = rows.select(F.col("o_custkey").alias("asker"), F.col("l_partkey").alias("artifact"), F.when(flag == "A", "case_step").when(flag == "N", "reference").otherwise("guidance").alias("lane"), F.row_number().over(order).alias("rank"))
    examples = table(spark, d, "part").select(F.col("p_partkey").alias("artifact"), F.col("p_size").alias("example"), (F.col("p_retailprice") > 905).alias("applicable"))
    return E.drill_down(hits, examples, "asker", "artifact", ["reference", "case_step", "guidance"])


@query("""with n as (select user_id, event_type, count(*) as n from events group by 1, 2) select user_id, string_agg(event_type || '=' || n, ',' order by event_type || '=' || n) as totals from n group by 1""")
def q_outcome_totals(spark: SparkSession, d: str) -> DataFrame:
    return E.outcome_totals(table(spark, d, "events"), "user_id", "event_type")


@query("""with m as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_returnflag = 'R' as must, row_number() over (partition by l_suppkey, l_returnflag = 'R' order by l_orderkey, l_linenumber, l_partkey) as k from lineitem),
n as (select *, row_number() over (partition by l_suppkey order by case when must and k <= 8 then 0 else 1 end, l_orderkey, l_linenumber, l_partkey) as n from m) select l_suppkey, l_orderkey, l_linenumber, l_partkey, n from n where n <= 32""")
def q_bounded_explanations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return E.capped(rows, "l_suppkey", [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 32, F.col("l_returnflag") == "R", 8).drop("l_returnflag")


@query("""with r as (select l_orderkey as batch, l_linenumber, l_partkey % 50 as entity, l_extendedprice as score, lag(l_extendedprice) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as before, case when l_returnflag = 'N' then 'few fit' else '' end as rationale from lineitem)
select batch, count(*) as n, count(*) filter (where score > before) as n_rising, count(*) - count(distinct entity) as n_repeated, count(*) < 3 and max(length(rationale)) = 0 as needs_rationale from r group by 1""")
def q_frontier_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("place"), (F.col("l_partkey") % 50).alias("entity"), F.col("l_extendedprice").alias("score"), F.when(F.col("l_returnflag") == "N", "few fit").otherwise("").alias("rationale"))
    return E.frontier_violations(rows, "batch", "place", "entity", "score")


@query(f"""with {SEQ_SQL}, a as (select distinct user_id, (props->>'$.k')::bigint as item from e), t as (select user_id, (props->>'$.k')::bigint as item, max(seq) as last_attempt from e where event_type = 'error' group by 1, 2),
n as (select a.user_id, a.item, last_attempt, row_number() over (partition by a.user_id order by coalesce(last_attempt, 0), a.item) as n from a left join t using (user_id, item)) select * from n where n <= 12""")
def q_pending_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "seq", "type", F.get_json_object("props", "$.k").cast("long").alias("item"))
    return E.pending_first(rows.select("user_id", "item").distinct(), rows.where("type = 'error'"), "user_id", "item", 12).select("user_id", "item", "last_attempt", "n")


@query("""with l as (select l_orderkey, l_linenumber as id, l_partkey, l_quantity from lineitem), w as (select o_orderkey as l_orderkey, unnest([1, 3]) as id from orders where o_orderpriority = '1-URGENT') select l_orderkey, id, l_partkey, l_quantity from l where (l_orderkey, id) in (select l_orderkey, id from w)""")
def q_child_lookup(spark: SparkSession, d: str) -> DataFrame:
    owned = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("id"), "l_partkey", "l_quantity")).alias("lines"))
    wanted = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(F.lit(1), F.lit(3))).alias("id"))
    return E.children(owned, "lines", ["l_orderkey"], wanted)


@query("""with h as (select sha256(concat_ws(chr(31), event_id, user_id, event_type)) as r from events)
select sha256(count(*) || '-' || sum(('0x' || r[1:15])::hugeint) || '-' || sum(('0x' || r[16:30])::hugeint)) as token, count(*) as n from h""")
def q_snapshot_token(spark: SparkSession, d: str) -> DataFrame:
    return E.snapshot_token(table(spark, d, "events"), ["event_id", "user_id", "event_type"])
