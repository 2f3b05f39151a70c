"""Preparation, materialised drafts, promotion, set checks and scalar forms over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import catalog as C
from ..operators import retrieval as R
from ..sources import files
from .journal_queries import SEQ_SQL, events
from .registry import query, table
from .retrieval_queries import toks


@query("""with a as (select distinct l_partkey % 997 as k from lineitem where l_returnflag = 'R'), b as (select distinct l_partkey % 997 as k from lineitem where l_quantity > 30)
select (select count(*) from a where k not in (select k from b)) as n_only_a, (select count(*) from b where k not in (select k from a)) as n_only_b, (select count(*) from a where k not in (select k from b)) = 0 and (select count(*) from b where k not in (select k from a)) = 0 as equal""")
def q_set_equality(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumn("k", F.col("l_partkey") % 997)
    return C.same_sets(lines.where("l_returnflag = 'R'").select("k"), lines.where("l_quantity > 30").select("k"))


@query(r"select p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform([p_type, '  ' || upper(p_name) || ' ', p_brand, p_name, ' '], lambda v: lower(trim(regexp_replace(v, '\s+', ' ', 'g')))), lambda v: v <> ''))), '|') as values from part")
def q_normalised_lists(spark: SparkSession, d: str) -> DataFrame:
    values = F.array("p_type", F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")), "p_brand", "p_name", F.lit(" "))
    return table(spark, d, "part").select("p_partkey", F.array_join(X.normalise_list(values), "|").alias("values"))


@query("""select o_orderkey, '{"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":' || case when o_orderstatus = 'P' then 'null' else '"' || o_orderstatus || '"' end || '}' as material from orders""")
def q_draft_material(spark: SparkSession, d: str) -> DataFrame:
    """Orders as drafts: the key is assigned; a null stays in the text."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"), "o_custkey")
    return rows.select("o_orderkey", C.draft_material(rows, ["o_orderkey"]).alias("material"))


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey = 77")
def q_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return files.point_lookup(table(spark, d, "orders"), "o_orderkey", 77).select("o_orderkey", "o_custkey", "o_totalprice")


@query("""with p as (select doc_id, text, sha256(coalesce(text, '')) as digest, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: length(x)::bigint) as parts, case when source like '%1' then '.pdf' else '.md' end as suffix, case when lang <> 'es' then lang end as profile from documents),
k as (select doc_id, sha256(case when quality = 1 then text else '' end) as known from documents join (select doc_id, max(quality) as quality from labels group by 1) using (doc_id)),
r as (select p.*, case when known is not distinct from digest then 'unchanged' when trim(coalesce(text, '')) = '' then 'empty' when suffix = '.pdf' then 'pdf_not_parsed' when profile is null then 'unknown_profile' when list_max(parts) > 2000 then 'oversized_block' end as reason from p left join k using (doc_id)),
n as (select *, list_reduce(list_prepend({'size': 0::bigint, 'n': 0::bigint}, list_transform(parts, lambda x: {'size': x, 'n': 0::bigint})), lambda a, x: case when a.n > 0 and a.size + 2 + x.size <= 2000 then {'size': a.size + 2 + x.size, 'n': a.n} else {'size': x.size, 'n': a.n + 1} end).n as packs from r)
select doc_id, digest, case when reason is null then 'prepared' when reason = 'unchanged' then 'unchanged' when reason = 'empty' then 'excluded' else 'quarantined' end as disposition, reason, case when reason is null then packs else 0 end as n_segments from n""")
def q_prepare(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = docs.join(marks, "doc_id").select("doc_id", F.sha2(F.when(F.col("quality") == 1, F.col("text")).otherwise(""), 256).alias("digest"))
    parts = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x).cast("long"))
    suffix, profile = F.when(F.col("source").endswith("1"), ".pdf").otherwise(".md"), F.when(F.col("lang") != "es", F.col("lang"))
    return C.prepared(docs, known, "doc_id", "text", suffix, profile, parts, 2000)


@query("""with d as (select conv_id, turn, 'artifact-' || left(sha256(conv_id || '/' || turn), 24) as artifact_id, case when turn % 5 = 4 then [] else [turn, turn + (case when conv_id % 9 = 0 then 1 else 0 end)] end as cites, case when turn = 0 then [] else [turn - 1] end as refs from conversations),
c as (select conv_id, turn, count(*) as n_cited, count(*) filter (where s.turn is null) as lost from (select conv_id, turn, unnest(cites) as x from d) q left join (select distinct conv_id as cc, turn from conversations) s on s.cc = q.conv_id and s.turn = q.x group by 1, 2)
select d.conv_id, d.artifact_id, coalesce(n_cited, 0) as n_cited, coalesce(p.artifact_id, '') as refs, case when coalesce(lost, 0) > 0 or (d.turn > 0 and p.turn is null) then 'rejected' when coalesce(n_cited, 0) = 0 then 'uncited' else 'extracted' end as status
from d left join c on c.conv_id = d.conv_id and c.turn = d.turn left join d p on p.conv_id = d.conv_id and p.turn = d.turn - 1""".replace("select conv_id, turn, count(*) as n_cited", "select q.conv_id, q.turn, count(*) as n_cited"))
def q_materialize(spark: SparkSession, d: str) -> DataFrame:
    rows, turn = table(spark, d, "conversations"), F.col("turn")
    none = F.array().cast("array<long>")
    cites = F.when(turn % 5 == 4, none).otherwise(F.array(turn, turn + F.when(F.col("conv_id") % 9 == 0, 1).otherwise(0)))
    drafts = rows.select("conv_id", "turn", cites.alias("citations"), F.when(turn == 0, none).otherwise(F.array(turn - 1)).alias("refers_to"))
    return C.materialized(drafts, rows.select("conv_id", turn.alias("segment")), "conv_id", "turn")


@query(f"""with {SEQ_SQL}, s as (select user_id, seq, case when event_type = 'view' and value <= 20 then 'context' when event_type = 'click' then 'decisions' when event_type in ('purchase', 'error') then 'outcomes' when event_type = 'view' then 'alternatives' end as section, event_type || ' ' || event_id as summary from e)
select user_id, section, count(*) as n, sha256(string_agg(summary, chr(10) order by seq)) as summaries from s where section is not null group by 1, 2""")
def q_promotion_sections(spark: SparkSession, d: str) -> DataFrame:
    t, say = F.col("type"), F.concat_ws(" ", "type", F.col("event_id").cast("string"))
    rules = {"context": ((t == "view") & (F.col("value") <= 20), say), "decisions": (t == "click", say), "outcomes": (t.isin("purchase", "error"), say), "alternatives": (t == "view", say)}
    return C.promotion_sections(events(spark, d), "user_id", rules)


@query(f"with {SEQ_SQL} select user_id, count(*) as n_events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_at, arg_max(event_type, seq) as last_type from e group by 1")
def q_public_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = C.public_summary(events(spark, d), "user_id", "ts")
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_at", "last_at")})


@query(f"""with q as (select distinct item_id as query_id, unnest({toks("text")}) as term from benchmark), dt as (select doc_id, {toks("text")} as ts from documents),
p as (select doc_id, term, min(i) as pos from (select doc_id, unnest(ts) as term, generate_subscripts(ts, 1) as i from dt) group by 1, 2), m as (select query_id, doc_id, count(*) as n_terms, cast(min(pos) as bigint) as first_place from p join q using (term) group by 1, 2),
h as (select *, row_number() over (partition by query_id order by n_terms desc, doc_id) as rank from m), w as (select query_id, list(distinct term) as wanted from q group by 1),
c as (select query_id, h.doc_id, list_slice(ts, greatest(1, first_place - 6), greatest(1, first_place - 6) + 11) as cut, wanted from h join dt on dt.doc_id = h.doc_id join w using (query_id) where rank <= 3)
select query_id, doc_id, len(list_filter(cut, lambda t: list_contains(wanted, t))) as n_marked, md5(array_to_string(list_transform(cut, lambda t: case when list_contains(wanted, t) then '[' || t || ']' else t end), ' ')) as snippet_key from c""")
def q_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The best three documents of each query by matched terms, with the words around the first match."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    hits = R.top_k(R.evidence(docs, items), 3, ["query_id"], [F.desc("n_terms"), F.col("doc_id")])
    return C.visible_snippets(hits, docs, R.query_terms(items, "item_id", "text"))
