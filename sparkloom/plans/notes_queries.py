"""Notes, drafts, dates, renderings, projections and evaluation gates over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import notes as N
from .registry import query, table

#: Documents as notes: their second word becomes a link, their third an embed, and metadata lines stand on top.
NOTE_SQL = r"""n as (select doc_id, 'lang:: ' || lang || chr(10) || 'Source::  ' || source || '  ' || chr(10) || 'see [[' || split_part(text, ' ', 2) || '|it]] and [[' || split_part(text, ' ', 4) || ']] ![[' || split_part(text, ' ', 3) || '.png]] at https://a.example/' || doc_id || ' now ' || chr(10) || text as note from documents)"""


def notes(spark: SparkSession, d: str) -> DataFrame:
    word = lambda n: F.split_part(F.col("text"), F.lit(" "), F.lit(n))
    note = F.concat(
        F.lit("lang:: "), "lang", F.lit("\nSource::  "), "source", F.lit("  \nsee [["), word(2), F.lit("|it]] and [["), word(4), F.lit("]] ![["), word(3), F.lit(".png]] at https://a.example/"), F.col("doc_id").cast("string"), F.lit(" now \n"), "text"
    )
    return table(spark, d, "documents").select("doc_id", note.alias("note"))


@query(f"""with {NOTE_SQL}, a as (select doc_id, regexp_replace(note, '!\\[\\[([^\\[\\]|]+)(?:\\|[^\\[\\]]*)?\\]\\]', '', 'g') as t from n), b as (select doc_id, regexp_replace(t, '\\[\\[(?:[^\\[\\]|]+\\|)?([^\\[\\]]*)\\]\\]', '\\1', 'g') as t from a),
c as (select doc_id, regexp_replace(t, '[ \\t]+(\\n|$)', '\\1', 'g') as t from b) select doc_id, md5(t) as plain_key, md5(trim(regexp_replace(t, '[ \\t]*https?://[^\\s)>\\]"'']+[ \\t]*', ' ', 'g'))) as bare_key from c""")
def q_plain_links(spark: SparkSession, d: str) -> DataFrame:
    rows = notes(spark, d).select("doc_id", N.plain_links(F.col("note")).alias("t"))
    return rows.select("doc_id", F.md5("t").alias("plain_key"), F.md5(N.without_urls(F.col("t"))).alias("bare_key"))


@query(f"""with {NOTE_SQL}, r as (select doc_id, 'lang' as relation, lang as target from documents union select doc_id, 'source', source from documents
union select doc_id, 'asset', trim(split_part(text, ' ', 3)) || '.png' from documents where not regexp_matches(split_part(text, ' ', 3), '[\\[\\]|]')
union select doc_id, 'link', trim(w) from (select doc_id, unnest([split_part(text, ' ', 2), split_part(text, ' ', 4)]) as w from documents) where not regexp_matches(w, '[\\[\\]|]'))
select doc_id as note, relation, target from r where trim(target, chr(10) || ' ') <> '' and target is not null""")
def q_note_relations(spark: SparkSession, d: str) -> DataFrame:
    return N.note_relations(notes(spark, d), "doc_id", "note")


@query("""select doc_id, case lang when 'en' then md5(lower(text)) when 'de' then md5(trim(text)) end as body_key, case when lang not in ('en', 'de') then 'unknown_profile' end as error from documents""")
def q_profiles(spark: SparkSession, d: str) -> DataFrame:
    rows = N.profiled(table(spark, d, "documents"), F.col("lang"), {"en": F.lower("text"), "de": F.trim("text")})
    return rows.select("doc_id", F.md5("body").alias("body_key"), "error")


@query(r"""with x as (select doc_id, text, regexp_replace(regexp_replace(text, '([\\`*_{}\[\]()#+!|<>~-])', '\\\1', 'g'), '\s*[\r\n]+\s*', ' ', 'g') as t, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda r: length(r))), 0) as ticks from documents),
s as (select *, rtrim(regexp_replace(left(regexp_replace(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňōőřśšťūůűźżž', 'aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnoorsstuuuzzz'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 48), '-+$', ''), '-') as g from x)
select doc_id, md5(t) as inert_key, md5(repeat('`', greatest(3, ticks + 1)) || chr(10) || text || chr(10) || repeat('`', greatest(3, ticks + 1))) as fenced_key, case when g = '' then 'item' else g end as slug from s""")
def q_inert_markdown(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(N.inert(x)).alias("inert_key"), F.md5(N.fenced(x)).alias("fenced_key"), N.slug(x).alias("slug"))


DATE_SQL = """t as (select event_id, user_id, case event_id % 6 when 0 then strftime(ts, '%Y-%m-%d') when 1 then ' ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' when 2 then strftime(ts, '%Y-%m-%d %H:%M') || '+05:30' when 3 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.250-08:00' when 4 then strftime(ts, '%d.%m.%Y') else '2024-13-45' end as raw, ts from events),
f as (select event_id, user_id, raw, cast(case event_id % 6 when 0 then date_trunc('day', ts) when 1 then date_trunc('second', ts) when 2 then date_trunc('minute', ts) - interval 330 minutes when 3 then date_trunc('second', ts) + interval 8 hours end as date) as d from t)"""


def dated(spark: SparkSession, d: str) -> DataFrame:
    n, at = F.col("event_id") % 6, F.col("ts")
    raw = (
        F.when(n == 0, F.date_format(at, "yyyy-MM-dd")).when(n == 1, F.concat(F.lit(" "), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))).when(n == 2, F.date_format(at, "yyyy-MM-dd HH:mm'+05:30'"))
        .when(n == 3, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'.250-08:00'")).when(n == 4, F.date_format(at, "dd.MM.yyyy")).otherwise("2024-13-45")
    )
    return table(spark, d, "events").select("event_id", "user_id", "ts", raw.alias("raw"))


@query(f"with {DATE_SQL} select event_id, cast(d as varchar) as day from f")
def q_flexible_dates(spark: SparkSession, d: str) -> DataFrame:
    return dated(spark, d).select("event_id", N.flexible_date(F.col("raw")).cast("string").alias("day"))


@query(f"with {DATE_SQL} select event_id // 3 as asked, cast(min(d) as varchar) as as_of from f where d is not null group by 1 having count(distinct d) = 1")
def q_as_of(spark: SparkSession, d: str) -> DataFrame:
    rows = dated(spark, d).withColumn("asked", F.expr("event_id div 3"))
    return N.as_of(rows, "asked", "raw").select("asked", F.col("as_of").cast("string").alias("as_of"))


@query("select o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '-' || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') || '.md' as name from orders")
def q_stamped_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", N.stamped_name(F.col("o_orderdate"), F.col("o_orderpriority"), ".md").alias("name"))


COMMANDS_SQL = ", ".join(f"'{c}'" for c in N.COMMANDS)


STARTS = ("$ ", "sudo ", "Echo ", "", "\n  box# /usr/bin/nmap -sV ", "# ", "Nmap scan report for ", "./run ", "find: ", "user@box:~$ cat ")


@query(f"""with p as (select p_partkey, [{", ".join("'" + s.replace(chr(10), "' || chr(10) || '") + "'" for s in STARTS)}][1 + p_partkey % {len(STARTS)}] || p_name || chr(10) || p_type as block from part), f as (select p_partkey, trim(regexp_extract(block, '^\\s*([^\\r\\n]+)', 1)) as l from p),
t as (select *, regexp_extract(l, '{N.PROMPT}', 1) as typed from f)
select p_partkey, not regexp_matches(l, '{N.OUTPUTS}') and regexp_extract(lower(case when typed = '' then l else trim(typed) end), '{N.COMMAND_NAME}', 1) in ({COMMANDS_SQL}) as is_command from t""")
def q_command_blocks(spark: SparkSession, d: str) -> DataFrame:
    block = F.concat(F.get(F.array(*map(F.lit, STARTS)), (F.col("p_partkey") % len(STARTS)).cast("int")), "p_name", F.lit("\n"), "p_type")
    return table(spark, d, "part").select("p_partkey", N.command_like(block).alias("is_command"))


@query("select doc_id, len(list_filter(regexp_extract_all(text, '(?s)(.{0,100}License.{0,100})'), lambda c: regexp_matches(c, 'MIT|Apache|GNU'))) > 0 as near from documents")
def q_mention_near(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", N.mention_near(F.col("text"), "License", "MIT|Apache|GNU").alias("near"))


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents) select doc_id, count(*) as n_groups, cast(max(length(line)) as bigint) as longest, 'oversized_block' as reason from l where length(line) > 1500 group by 1")
def q_oversized_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("size", F.length("line"))
    _, aside = N.oversized(rows, "size", 1500)
    return aside.groupBy("doc_id", "reason").agg(F.count("*").alias("n_groups"), F.max("size").cast("long").alias("longest"))


@query("select conv_id, turn, (row_number() over (partition by conv_id order by turn) - 1) // 5 as chunk, count(*) over (partition by conv_id) > 5 as is_chunked from conversations")
def q_extraction_chunks(spark: SparkSession, d: str) -> DataFrame:
    return N.chunked(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "chunk", "is_chunked")


DRAFT_SQL = """r as (select c.conv_id, c.turn as draft, ['TODO', 'allowed', ' ', 'n/a', 'ask first'][1 + turn % 5] as policy, case when turn % 4 = 3 then [] when turn % 7 = 2 then [0, 0] else [turn // 2, turn + 1] end as citations, left(text, 40) as claim, max(turn) over (partition by conv_id) as last from conversations c),
x as (select *, unnest(list_filter([case when lower(trim(policy)) in ('', 'todo', 'tbd', 'n/a', 'none') then 'placeholder_policy' end, case when len(list_distinct(citations)) < len(citations) then 'duplicate_citation' end, case when len(citations) = 0 then 'no_citation' end,
 case when len(list_filter(citations, lambda c: c < 0 or c > last)) > 0 then 'unknown_segment' end, case when not regexp_matches(trim(claim), '\\S[.!?]$') then 'incomplete_claim' end], lambda p: p is not null)) as problem from r)"""


@query(f"with {DRAFT_SQL} select conv_id, draft, problem from x")
def q_draft_hygiene(spark: SparkSession, d: str) -> DataFrame:
    rows, turn = table(spark, d, "conversations"), F.col("turn")
    policy = F.get(F.array(*map(F.lit, ("TODO", "allowed", " ", "n/a", "ask first"))), (turn % 5).cast("int"))
    none = F.array().cast("array<long>")
    citations = F.when(turn % 4 == 3, none).when(turn % 7 == 2, F.array(F.lit(0), F.lit(0)).cast("array<long>")).otherwise(F.array(F.expr("turn div 2"), turn + 1))
    drafts = rows.select("conv_id", turn.alias("draft"), policy.alias("policy"), citations.alias("citations"), F.left(F.col("text"), F.lit(40)).alias("claim"))
    return N.draft_problems(drafts, rows.select("conv_id", turn.alias("segment")), "conv_id")


@query("""with n as (select conv_id, turn, cast(len(string_split(role, chr(10))) + len(string_split(text, chr(10))) + 2 as bigint) as n_lines from conversations), e as (select *, sum(n_lines) over (partition by conv_id order by turn rows unbounded preceding) as e from n)
select conv_id, turn, cast(e - n_lines + 1 as bigint) as first_line, cast(e - 1 as bigint) as last_line, n_lines from e""")
def q_rendered_spans(spark: SparkSession, d: str) -> DataFrame:
    return N.rendered(table(spark, d, "conversations"), "conv_id", "turn", F.col("role"), F.col("text"))


@query("""with a as (select l_orderkey as artifact, list(distinct l_suppkey) as own from lineitem where l_linestatus = 'O' group by 1)
select distinct l_orderkey as artifact, 'artifact' as role, l_suppkey as source from lineitem union select distinct l_orderkey, 'facet:' || l_linenumber, l_partkey from lineitem union select distinct l_orderkey, 'contradicts', l_suppkey from lineitem where l_returnflag = 'R'""")
def q_provenance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("artifact")).agg(
        F.collect_list("l_suppkey").alias("own"), F.collect_list(F.struct(F.col("l_linenumber").alias("id"), F.array("l_partkey").alias("sources"))).alias("facets"), F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("against")
    )
    return N.provenance(rows, "artifact", "own", "facets", "against")


@query("select event_id, case event_type when 'view' then 'seen ' || user_id when 'click' then 'step ' || user_id end as title, case event_type when 'view' then props when 'click' then cast(round(value) as bigint)::varchar end as content from events")
def q_legacy_view(spark: SparkSession, d: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    title, content = N.legacy_view(F.col("event_type"), {"view": F.concat(F.lit("seen "), user), "click": F.concat(F.lit("step "), user)}, {"view": F.col("props"), "click": F.round("value").cast("long").cast("string")})
    return table(spark, d, "events").select("event_id", title.alias("title"), content.alias("content"))


@query(r"""with w as (select c_custkey, list_filter(regexp_split_to_array(lower(concat_ws(' ', c_name, c_mktsegment, c_name, 'Private box-1')), '[^\p{L}\p{N}_.-]+'), lambda x: x <> '' and x not in ('private')) as ws from customer),
j as (select c_custkey, array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i), ' ') as q from w) select c_custkey, case when length(q) <= 30 then q else regexp_replace(left(q, 31), ' [^ ]*$', '') end as query from j""")
def q_constructed_queries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_name").alias("again"), F.lit("Private box-1").alias("place"))
    return N.constructed_queries(rows, "c_custkey", ["c_name", "c_mktsegment", "again", "place"], ["PRIVATE"], 30)


SCENARIO_SQL = """h as (select o_custkey as scenario, l_partkey as item, row_number() over (partition by o_custkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_suppkey) as rank from orders join lineitem on o_orderkey = l_orderkey),
g as (select distinct o_custkey as scenario, l_partkey as item from orders join lineitem on o_orderkey = l_orderkey where l_quantity > 25), b as (select distinct o_custkey as scenario, l_partkey as item from orders join lineitem on o_orderkey = l_orderkey where l_returnflag = 'R' and l_quantity < 5),
t as (select o_custkey as scenario, max(o_totalprice / 1e6) as max_latency, count(distinct o_custkey % 7) = 1 as reproducible from orders group by 1), top as (select distinct scenario, item from h where rank <= 8),
n as (select scenario, count(*) as n, count(g.item) as hit, count(b.item) as bad from top left join g using (scenario, item) left join b using (scenario, item) group by 1), q as (select scenario, count(*) as need from g group by 1),
r as (select q.scenario, round(coalesce(hit, 0) / need, 6) as recall, case when coalesce(n, 0) = 0 then 0.0 else round(hit / n, 6) end::double as precision, coalesce(bad, 0) as n_violations, max_latency, coalesce(reproducible, false) as reproducible from q left join n using (scenario) left join t using (scenario))"""


def scenarios(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).withColumnsRenamed({"o_custkey": "scenario", "l_partkey": "item"})
    order = Window.partitionBy("scenario").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "item", "l_suppkey")
    hits = rows.select("scenario", "item", F.row_number().over(order).alias("rank"))
    runs = table(spark, d, "orders").select(F.col("o_custkey").alias("scenario"), (F.col("o_totalprice") / 1e6).alias("latency"), (F.col("o_custkey") % 7).alias("digest"))
    return N.scenario_report(hits, rows.where("l_quantity > 25"), rows.where("l_returnflag = 'R' and l_quantity < 5"), runs, "scenario", "item", 8)


@query(f"with {SCENARIO_SQL} select * from r")
def q_scenario_report(spark: SparkSession, d: str) -> DataFrame:
    return scenarios(spark, d)


@query(f"""with {SCENARIO_SQL}, m as (select count(*) as n_scenarios, round(avg(recall), 5) as macro_recall, round(avg(precision), 5) as macro_precision, cast(sum(n_violations) as bigint) as n_violations, round(max(max_latency), 6) as max_latency, round(sum(max_latency), 6) as total_latency, bool_and(reproducible) as reproducible from r)
select *, macro_recall >= 0.9 and macro_precision >= 0.7 and n_violations <= 0 and max_latency <= 5.0 and total_latency <= 30.0 and reproducible as passed from m""")
def q_evaluation_gates(spark: SparkSession, d: str) -> DataFrame:
    return N.gates(scenarios(spark, d), 0.9, 0.7, 0, 5.0, 30.0)


@query("select n as disposition, (select count(*) from events where event_type = n) as n from (select unnest(['view', 'click', 'purchase', 'error', 'quarantined', 'rejected']) as n)")
def q_disposition_counts(spark: SparkSession, d: str) -> DataFrame:
    return N.disposition_counts(table(spark, d, "events"), F.col("event_type"), ["view", "click", "purchase", "error", "quarantined", "rejected"])
