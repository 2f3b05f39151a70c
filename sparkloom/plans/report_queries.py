"""Reports, executions, bounded output and context over ``events`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report as R
from ..operators import text as T
from .journal_queries import SEQ_SQL, events
from .registry import query, table
from .text_queries import LINES_SQL


@query(f"""with {SEQ_SQL}, s as (select user_id, seq, case when event_type in ('view', 'click') then 'timeline' when event_type = 'error' then 'failures' when event_type = 'purchase' and value > 10 then 'outcomes' end as section, event_type || ':' || seq as summary from e)
select *, row_number() over (partition by user_id, section order by seq) as n from s where section is not null""")
def q_report_sections(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("type")
    rules = {"timeline": t.isin("view", "click"), "failures": t == "error", "outcomes": (t == "purchase") & (F.col("value") > 10)}
    return R.sections(events(spark, d), "user_id", rules, F.concat_ws(":", t, F.col("seq").cast("string"))).select("user_id", "seq", "section", "summary", "n")


@query("""with g as (select user_id, (props->>'$.k')::bigint % 10 as topic, count(*) filter (where event_type = 'purchase') as n_support, count(*) filter (where event_type = 'error' and value > 20) as n_against from events group by 1, 2)
select *, case when n_against > 0 then 'weakened' when n_support > 0 then 'supported' else 'open' end as status from g""")
def q_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("topic", F.get_json_object("props", "$.k").cast("long") % 10)
    return R.hypotheses(rows, "user_id", "topic", F.col("event_type") == "purchase", (F.col("event_type") == "error") & (F.col("value") > 20))


@query(f"""with {SEQ_SQL}, c as (select *, (props->>'$.k')::bigint as call from e)
select user_id, call, min(seq) filter (where event_type = 'view') as start_seq, count(*) as n_events, arg_max(value, seq) filter (where event_type = 'click') as terminal, arg_max(value, seq) filter (where event_type = 'purchase') as outcome, arg_max(value, seq) filter (where event_type = 'error') as failure
from c group by 1, 2 having min(seq) filter (where event_type = 'view') is not null""")
def q_executions(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("call", F.get_json_object("props", "$.k").cast("long"))
    return R.executions(rows, "user_id", "call", "view", {"terminal": "click", "outcome": "purchase", "failure": "error"}, "value")


@query("""with a as (select s_suppkey as source_id, s_nationkey from supplier), c as (select distinct l_suppkey as source_id, l_partkey as question_id from lineitem), q as (select p_partkey as question_id, p_type as question from part)
select a.source_id, c.question_id, question, case when c.source_id is null then 'missing_consultation' end as error from a left join c using (source_id) left join q on q.question_id = c.question_id""")
def q_source_consultations(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"))
    c = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("question_id"))
    q = table(spark, d, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_type").alias("question"))
    return R.consultations(a, c, q, "source_id", "question_id").select("source_id", "question_id", "question", "error")


@query("""with r as (select *, sum(n_chars) over (partition by source order by n_chars, doc_id rows unbounded preceding) as used, sum(n_chars) over (partition by source) as total from documents), k as (select *, case when total <= 90000 then true else used <= 80000 end as keep from r)
select source, count(*) filter (where keep) as n_kept, count(*) filter (where not keep) as n_omitted, cast(coalesce(sum(n_chars) filter (where keep), 0) as bigint) as used from k group by 1""")
def q_bounded_report(spark: SparkSession, d: str) -> DataFrame:
    return R.bounded(table(spark, d, "documents"), "source", ["n_chars", "doc_id"], "n_chars", 90_000, 10_000)


@query("""with o as (select l_suppkey, l_partkey, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey, l_partkey order by l_orderkey, l_linenumber, l_partkey) as r from lineitem),
u as (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) as n from o where r = 1) select l_suppkey, l_partkey, n from u where n <= 16""")
def q_first_unique(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    return R.first_unique(rows, ["l_suppkey"], "l_partkey", ["l_orderkey", "l_linenumber", "l_partkey"], 16).select("l_suppkey", "l_partkey", "n")


@query("""with s as (select doc_id, string_split(text, chr(10)) as ls from documents), c as (select doc_id, unnest([0, 2, 5]) as idx from documents)
select doc_id, cast(idx as int) as index, md5(ls[idx + 1]) as segment_key, case when ls[idx + 1] is null then 'unknown_segment' end as error from c join s using (doc_id)""")
def q_citations(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    drafts = docs.select("doc_id", F.explode(F.array(*map(F.lit, (0, 2, 5)))).alias("index"))
    prepared = docs.select("doc_id", F.split("text", "\n").alias("segments"))
    return R.citations(prepared, drafts, "doc_id").select("doc_id", "index", F.md5("segment").alias("segment_key"), "error")


@query(r"""with w as (select doc_id, string_split(regexp_replace(trim(text), '[ \t]+', ' ', 'g'), ' ') as ws from documents),
p as (select doc_id, list_reduce(list_prepend({'size': 0::bigint, 'n': 0::bigint}, list_transform(ws, lambda x: {'size': length(x)::bigint, 'n': 0::bigint})), lambda a, x: case when a.n > 0 and a.size + 1 + x.size <= 500 then {'size': a.size + 1 + x.size, 'n': a.n} else {'size': x.size, 'n': a.n + 1} end) as r from w)
select doc_id, r.n as n_chunks from p""")
def q_paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    return R.paragraphs(table(spark, d, "documents"), 500)


@query(f"""with {LINES_SQL}, s as (select *, max(case when length(line) < 60 then 1 else 0 end) over (partition by doc_id order by pos) as begun from l),
t as (select *, max(case when begun = 1 and length(line) > 700 then 1 else 0 end) over (partition by doc_id order by pos) as ended from s)
select doc_id, count(*) as n_lines, min(pos) as first_line from t where begun = 1 and ended = 0 group by 1""")
def q_scraped_article(spark: SparkSession, d: str) -> DataFrame:
    """A short line starts the article, a very long one ends it."""
    rows = R.scraped_article(T.lines(table(spark, d, "documents")), F.length("line") < 60, F.length("line") > 700)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.min("pos").cast("long").alias("first_line"))


@query("""with r as (select user_id, event_type as kind, event_id as item, row_number() over (partition by user_id, event_type order by event_id) as n from events), k as (select * from r where n <= case kind when 'view' then 4 when 'click' then 3 when 'error' then 2 else 1 end)
select user_id, count(*) as n_items, sha256(array_to_string(list_sort(list(kind || '/' || lpad(n::varchar, 6, '0') || '/' || item)), ',')) as digest from k group by 1""")
def q_planner_context(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("kind"), F.col("event_id").alias("item"))
    return R.context_digest(rows, "user_id", {"view": 4, "click": 3, "error": 2, "purchase": 1, "signup": 1}, ["item"])
