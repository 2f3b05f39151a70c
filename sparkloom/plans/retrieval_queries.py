"""Retrieval over ``documents`` with ``benchmark`` items as queries, and facets from the part and supplier tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import retrieval as R
from .registry import query, table

TOKEN_SQL = f"regexp_extract_all(translate(lower({{}}), '{X.ACCENTED}', '{X.PLAIN}'), '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"


def toks(x: str) -> str:
    return TOKEN_SQL.format(x).replace("{{", "{").replace("}}", "}")


BM25_SQL = f"""
with dt as (select doc_id, {toks("text")} as ts from documents),
st as (select count(*) as n, avg(len(ts)) as avgdl from dt),
q as (select distinct item_id as query_id, unnest({toks("text")}) as term from benchmark),
p as (select doc_id, term, count(*) as f, any_value(dl) as dl from (select doc_id, len(ts) as dl, unnest(ts) as term from dt) where term in (select term from q) group by 1, 2),
w as (select term, greatest(ln((n - df + 0.5) / (df + 0.5)), 0) as raw, avgdl from (select term, count(*) as df from p group by 1), st),
s as (select query_id, doc_id, round(-sum((case when raw > 0 then raw else 1e-6 end) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as rank_value from p join q using (term) join w using (term) group by 1, 2)
"""


@query(BM25_SQL + """, r as (select *, row_number() over (partition by query_id order by rank_value, doc_id) as rank from s)
select query_id, doc_id, rank_value, rank, case when max(-rank_value) over (partition by query_id) > 0 then round(-rank_value / max(-rank_value) over (partition by query_id), 6) else 0.0 end as relevance from r where rank <= 32""")
def q_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """BM25 top 32 for each query, with relevance relative to the best."""
    scored = R.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return R.relevance(R.top_k(scored, 32, ["query_id"], [F.col("rank_value"), F.col("doc_id")]), ["query_id"])


@query(f"""select doc_id, len(list_filter(ts, lambda t: t in ('the', 'and', 'that'))) as n_hits from (select doc_id, {toks("text")} as ts from documents)
where list_contains(ts, 'the') and list_contains(ts, 'and') and list_contains(ts, 'that')""")
def q_and_search(spark: SparkSession, d: str) -> DataFrame:
    return R.all_terms(table(spark, d, "documents"), ["the", "and", "that"])


@query(f"""with q as (select item_id as query_id, ts[1:4] as g from (select item_id, {toks("text")} as ts from benchmark) where len(ts) >= 4),
r as (select doc_id, unnest(list_transform(range(1, len(ts) - 2), lambda i: ts[i:i + 3])) as g from (select doc_id, {toks("text")} as ts from documents) where len(ts) >= 4)
select query_id, doc_id, count(*) as places from r join q using (g) group by 1, 2""")
def q_phrase_match(spark: SparkSession, d: str) -> DataFrame:
    return R.phrases(table(spark, d, "documents"), table(spark, d, "benchmark"), 4)


@query(f"""with q as (select distinct item_id as query_id, unnest({toks("text")}) as term from benchmark),
p as (select doc_id, term, min(i) as pos from (select doc_id, unnest(ts) as term, generate_subscripts(ts, 1) as i from (select doc_id, {toks("text")} as ts from documents)) group by 1, 2)
select query_id, doc_id, count(*) as n_terms, cast(min(pos) as bigint) as first_place from p join q using (term) group by 1, 2""")
def q_match_evidence(spark: SparkSession, d: str) -> DataFrame:
    return R.evidence(table(spark, d, "documents"), table(spark, d, "benchmark"))


LANE_SQL = "case when toxic = 1 then 'negative_evidence' when quality = 0 then 'guidance' when quality = 1 then 'case_step' else 'reference' end"


def lanes(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, lane): every document once; unlabelled ones are references."""
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = table(spark, d, "documents").select("doc_id").join(marks, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("toxic") == 1, "negative_evidence").when(F.col("quality") == 0, "guidance").when(F.col("quality") == 1, "case_step").otherwise("reference").alias("lane"))


@query(BM25_SQL + f""", l as (select doc_id, {LANE_SQL} as lane from documents left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1) using (doc_id)),
r as (select s.*, lane, row_number() over (partition by query_id, lane order by rank_value, s.doc_id) as rank from s join l on s.doc_id = l.doc_id)
select query_id, lane, doc_id, rank_value, rank from r where rank <= 5""")
def q_lane_topk(spark: SparkSession, d: str) -> DataFrame:
    scored, parts = R.search(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return R.top_k(scored.join(lanes(spark, d).repartition(parts, "doc_id"), "doc_id"), 5, ["query_id", "lane"], [F.col("rank_value"), F.col("doc_id")]).select("query_id", "lane", "doc_id", "rank_value", "rank")


@query("""select l_orderkey as order_key from lineitem where (l_returnflag, l_linestatus) in (('R', 'F'), ('A', 'F')) group by 1 having count(distinct l_returnflag || l_linestatus) = 2""")
def q_facet_division(spark: SparkSession, d: str) -> DataFrame:
    """Orders that carry both wanted facets."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    wanted = spark.createDataFrame([("R", "F"), ("A", "F")], "flag string, status string")
    return R.facet_division(rows, wanted, "order_key", ["flag", "status"])


RELATIONS = "case n_nationkey % 5 when 0 then 'required' when 1 then 'incompatible' when 2 then 'observed' when 3 then 'compatible' else 'unknown' end"
FACETS_SQL = f"""
select s_suppkey as artifact_id, 'typed' as namespace, 'os_family' as key, lower(r_name) as value, {RELATIONS} as relation, 0.5 + (s_suppkey % 5) / 10.0 as confidence from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
union all
select s_suppkey, 'open', 'balance', case when s_acctbal < 0 then 'negative' else 'positive' end, case s_suppkey % 3 when 0 then 'required' when 1 then 'observed' else 'compatible' end, 0.9 from supplier
union all
select s_suppkey, 'typed', 'services.web', 'apache', 'observed', 0.8 from supplier where s_suppkey % 2 = 0
"""
LIVE_SQL = """
select * from (values (1, 'typed', 'os_family', 'asia', 0.9), (1, 'open', 'balance', 'positive', 0.8), (2, 'typed', 'os_family', 'europe', 0.9), (2, 'typed', 'os_family', 'asia', 0.95), (3, 'open', 'balance', 'unknown', 1.0), (3, 'typed', 'os_family', 'america', 0.5)) as t(query_id, namespace, key, value, confidence)
"""


@query(f"""
with f as (select *, greatest(0.05, confidence) as w from ({FACETS_SQL})), live as ({LIVE_SQL}),
k as (select query_id, namespace, key, list(distinct value) as vals from live where confidence >= 0.75 and value not in ('', 'unknown', 'unspecified', 'not established') group by 1, 2, 3),
j as (select q.query_id, f.*, coalesce(len(vals), 0) as nv, coalesce(list_contains(vals, f.value), false) as exact, (f.key = 'services.web' and q.query_id = 1) as soft, f.namespace = 'typed' and f.key = 'os_family' as dim
  from f join (select query_id, s_suppkey as artifact_id from (select distinct query_id from live) cross join (select s_suppkey from supplier order by s_acctbal desc, s_suppkey limit 400)) q on q.artifact_id = f.artifact_id left join k on k.query_id = q.query_id and k.namespace = f.namespace and k.key = f.key),
r as (select *, case when value in ('', 'unknown', 'unspecified', 'not established') or relation = 'unknown' then 1 when dim and nv > 1 then 2
  when relation = 'incompatible' then (case when exact then 3 when nv = 0 then 4 else 13 end)
  when relation = 'required' then (case when exact then 5 when nv > 0 then 6 else 7 end)
  when exact then 8 when nv > 0 then (case when relation = 'observed' and dim then 9 else 10 end) when soft then 11 when relation = 'observed' and dim then 12 else 13 end as rule from j),
s as (select query_id, artifact_id, bool_or(rule in (3, 6, 9)) as rejected,
  sum(case when rule in (5, 6, 7) or (rule = 2 and relation = 'required') then w else 0 end) as req,
  sum(case when rule between 5 and 12 or (rule = 2 and relation in ('required', 'observed', 'compatible')) then w else 0 end) as sim,
  sum(case when rule = 5 then w else 0 end) as mreq, sum(case when rule in (5, 8) then w when rule = 11 then 0.75 * w else 0 end) as msim,
  sum(case when rule in (1, 2, 4, 7, 12) then w else 0 end) as unk, count(*) filter (where rule in (5, 8, 11)) as n_matched, count(*) filter (where rule in (1, 2, 4, 7, 12)) as n_missing
  from r group by 1, 2)
select cast(query_id as bigint) as query_id, artifact_id, rejected, round(case when req = 0 then 1.0 else mreq / req end, 6)::double as coverage, round(case when sim = 0 then 0.5 else msim / sim end, 6)::double as similarity,
  round(least(0.1, 0.1 * unk / greatest(1.0, req + sim + unk)), 6)::double as penalty, n_matched, n_missing from s""")
def q_applicability(spark: SparkSession, d: str) -> DataFrame:
    """The truth table of conditions over suppliers as artifacts and three situations."""
    for t in ("supplier", "nation", "region"):
        table(spark, d, t).createOrReplaceTempView(f"_{t}")
    sql = FACETS_SQL.replace("from supplier", "from _supplier").replace("join nation", "join _nation").replace("join region", "join _region")
    facets = spark.sql(sql).withColumn("confidence", F.col("confidence").cast("double"))
    live = spark.sql(LIVE_SQL).withColumns({"confidence": F.col("confidence").cast("double"), "query_id": F.col("query_id").cast("long")})
    services = spark.createDataFrame([(1, "web")], "query_id long, service string")
    # the candidates of each situation: the 400 suppliers of the greatest balance
    first = table(spark, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(400).select(F.col("s_suppkey").alias("artifact_id"))
    candidates = first.select("artifact_id", F.explode(F.array(*[F.lit(q).cast("long") for q in (1, 2, 3)])).alias("query_id"))
    return R.applicability(facets, live, candidates, services)


GROUPS_SQL = "g as (select doc_id, sha256(text) as group_key, count(*) over (partition by sha256(text)) as freq from documents)"


def groups(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, group_key, freq): exact copies are one independence group; sizes by aggregate and join, not by a window over a hot key."""
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("group_key"))
    return rows.join(rows.groupBy("group_key").agg(F.count("*").alias("freq")), "group_key")


@query(f"""with {GROUPS_SQL}, m as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1),
a as (select d.doc_id, coalesce(quality, 0) as support, coalesce(toxic, 0) as against, case when quality = 1 then 'verified' when quality = 0 then 'contested' else 'extracted' end as status, n_chars, freq from documents d join g using (doc_id) left join m using (doc_id)),
b as (select doc_id, 0.30 * (case status when 'verified' then 0.90 when 'contested' then 0.35 else 0.55 end) + 0.25 * least(1.0, n_chars / 1000.0) + 0.25 * 0.8 + 0.20 * 0.70 as quality, support, against, freq, n_chars from a)
select doc_id, round(least(1.0, greatest(0.0, case when support + against > 0 then quality * support / (support + against) else quality end)), 6)::double as verification,
  round(least(1.0, 0.25 + 0.25 * support) * (case when support + against > 0 then support / (support + against) else 0.25 end) / sqrt(freq), 6)::double as diversity,
  (case when n_chars % 3 = 0 then 1.0 when n_chars <= 365 then 1.0 when n_chars <= 1095 then 0.8 when n_chars <= 1825 then 0.6 when n_chars <= 3650 then 0.4 else 0.2 end)::double as freshness from b""")
def q_score_components(spark: SparkSession, d: str) -> DataFrame:
    """Verification, diversity and freshness of documents as artifacts; the age in days stands in n_chars."""
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    a = table(spark, d, "documents").select("doc_id", "n_chars").join(groups(spark, d).select("doc_id", "freq"), "doc_id").join(marks, "doc_id", "left")
    status = F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "contested").otherwise("extracted")
    support, against = F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0))
    return a.select(
        "doc_id",
        X.verification_confidence(status, F.least(F.lit(1.0), F.col("n_chars") / 1000.0), F.lit(0.8), F.lit("medium"), support, against).alias("verification"),
        X.source_diversity(support, against, F.col("freq")).alias("diversity"),
        X.freshness(F.col("n_chars"), F.lit(True), F.lit(False), F.col("n_chars") % 3 != 0).alias("freshness"),
    )


HITS_SQL = BM25_SQL + f""", {GROUPS_SQL}, r as (select *, row_number() over (partition by query_id order by rank_value, doc_id) as rk from s),
c as (select query_id, doc_id, round(-rank_value / max(-rank_value) over (partition by query_id), 6) as rel from r where rk <= 32),
t as (select query_id, c.doc_id, group_key, round(least(1.0, greatest(0.0, 0.30::double * rel + 0.20::double + 0.15::double * 0.5::double + 0.20::double * 0.6::double + 0.05::double + 0.10::double * round(0.25::double / sqrt(freq), 6) - 0.0::double)) + 1e-9, 6)::double as total from c join g using (doc_id)),
u as (select *, row_number() over (partition by query_id, group_key order by total desc, doc_id) as turn, first_value(total) over w as ls, first_value(doc_id) over w as li from t where total >= 0.40 window w as (partition by query_id, group_key order by total desc, doc_id)),
v as (select *, row_number() over (partition by query_id order by turn, ls desc, li, group_key) as k from u),
hits as (select query_id, doc_id, group_key, total, row_number() over (partition by query_id order by total desc, doc_id) as rank from v where k <= 8)
"""


def hits(spark: SparkSession, d: str, k: int = 8) -> DataFrame:
    """Search, score, threshold, diversify: one plan for all queries."""
    scored = R.relevance(R.top_k(R.bm25(table(spark, d, "documents"), table(spark, d, "benchmark")), 32, ["query_id"], [F.col("rank_value"), F.col("doc_id")]), ["query_id"])
    total = X.total_score(F.col("relevance"), F.lit(1.0), F.lit(0.5), F.lit(0.6), F.lit(1.0), F.round(0.25 / F.sqrt("freq"), 6), F.lit(0.0))
    # at most 32 rows a query meet the groups; the corpus is not shuffled again if these are few
    ranked = groups(spark, d).join(scored, "doc_id").select("query_id", "doc_id", "group_key", total.alias("total"))
    return R.diversified(ranked.where(F.col("total") >= X.LANE_THRESHOLD["reference"]), k, ["query_id"])


@query(BM25_SQL + f""", {GROUPS_SQL}, l as (select doc_id, case when quality = 0 and toxic = 1 then null else {LANE_SQL} end as lane, case when quality = 0 and n_chars < 300 then 'rejected' when quality = 1 then 'verified' else 'extracted' end as status
  from documents left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1) using (doc_id)),
r as (select s.*, lane, row_number() over (partition by query_id, lane order by rank_value, s.doc_id) as rk from s join l on s.doc_id = l.doc_id where lane is not null and status <> 'rejected'),
c as (select query_id, lane, doc_id, round(-rank_value / max(-rank_value) over (partition by query_id, lane), 6) as rel from r where rk <= 32),
t as (select query_id, lane, c.doc_id, round(least(1.0, greatest(0.0, 0.30::double * rel + 0.20::double + 0.15::double * 0.5::double + 0.20::double * 0.6::double + 0.05::double + 0.10::double * round(0.25::double / sqrt(freq), 6) - 0.0::double)) + 1e-9, 6)::double as total from c join g using (doc_id)),
k as (select *, row_number() over (partition by query_id, lane order by total desc, doc_id) as rank from t where total >= case lane when 'reference' then 0.40 when 'case_step' then 0.45 when 'negative_evidence' then 0.35 else 0.50 end) select * from k where rank <= 5""")
def q_retrieve_lanes(spark: SparkSession, d: str) -> DataFrame:
    """All four lanes with their thresholds, without rejected artifacts and ones that no lane takes."""
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    quality, toxic = F.col("quality"), F.col("toxic")
    lane = F.when((quality == 0) & (toxic == 1), F.lit(None)).when(toxic == 1, "negative_evidence").when(quality == 0, "guidance").when(quality == 1, "case_step").otherwise("reference")
    status = F.when((quality == 0) & (F.col("n_chars") < 300), "rejected").when(quality == 1, "verified").otherwise("extracted")
    facts = table(spark, d, "documents").select("doc_id", "n_chars").join(marks, "doc_id", "left").select("doc_id", lane.alias("lane"), status.alias("status")).join(groups(spark, d).select("doc_id", "freq"), "doc_id")
    total = X.total_score(F.col("relevance"), F.lit(1.0), F.lit(0.5), F.lit(0.6), F.lit(1.0), F.round(0.25 / F.sqrt("freq"), 6), F.lit(0.0))
    scored, parts = R.search(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return R.lane_hits(scored, facts.repartition(parts, "doc_id"), total, X.LANE_THRESHOLD)


@query(HITS_SQL + "select * from hits")
def q_diversified_hits(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).select("query_id", "doc_id", "group_key", "total", "rank")


@query(HITS_SQL + """, b as (select item_id as query_id, text from benchmark)
select query_id, case when length(trim(text)) = 0 then 'invalid_target' else 'no_applicable_knowledge' end as gap from b where query_id not in (select query_id from hits where total >= 0.765)""")
def q_knowledge_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Queries without a hit of at least .765, with the reason."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    strong = hits(spark, d).where("total >= 0.765").select("query_id").distinct()
    gap = F.when(F.length(F.trim("text")) == 0, "invalid_target").otherwise("no_applicable_knowledge")
    return asked.join(strong, "query_id", "left_anti").select("query_id", gap.alias("gap"))


RELEVANT_SQL = "rel as (select item_id as query_id, doc_id from benchmark b join documents d on contains(d.text, b.text))"


def relevant(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, doc_id) of documents that quote an item whole: candidates by a phrase join, then an exact check."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    # items of fewer than four tokens are found by runs of their own length; at most four numbers reach the driver
    sized = items.withColumn("n", F.least(F.size(X.tokens(F.col("text"))), F.lit(4)))
    lengths = [r.n for r in sized.select("n").distinct().collect() if r.n]
    near = sized.select(F.col("item_id").alias("query_id"), F.lit(None).cast("long").alias("doc_id")).limit(0)
    for n in sorted(lengths):
        near = near.unionByName(R.phrases(docs, sized.where(F.col("n") == n).drop("n"), n).select("query_id", "doc_id"))
    pairs = near.join(docs.select("doc_id", "text"), "doc_id").join(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("item")), "query_id")
    return pairs.where(F.contains("text", "item")).select("query_id", "doc_id")


@query(HITS_SQL + f""", {RELEVANT_SQL}, m as (select query_id, count(*) as n_good from rel group by 1),
n as (select query_id, count(*) as n_got from hits group by 1), o as (select query_id, count(*) as n_both from hits join rel using (query_id, doc_id) group by 1)
select query_id, round(coalesce(n_both, 0) / n_good, 6) as recall_at_k, case when coalesce(n_got, 0) = 0 then 0.0 else round(coalesce(n_both, 0) / n_got, 6) end as precision_at_k from m left join n using (query_id) left join o using (query_id)""")
def q_eval_recall_precision(spark: SparkSession, d: str) -> DataFrame:
    return R.recall_precision(hits(spark, d), relevant(spark, d), 8)


@query(HITS_SQL + f""", {RELEVANT_SQL}, m as (select query_id, count(*) as n_good from rel group by 1),
n as (select query_id, count(*) as n_got from hits group by 1), o as (select query_id, count(*) as n_both from hits join rel using (query_id, doc_id) group by 1),
e as (select round(coalesce(n_both, 0) / n_good, 6) as rc, case when coalesce(n_got, 0) = 0 then 0.0 else round(coalesce(n_both, 0) / n_got, 6) end as pr from m left join n using (query_id) left join o using (query_id))
select count(*) as n_queries, round(avg(rc), 5) as macro_recall, round(avg(pr), 5) as macro_precision, bool_and(rc >= 0.0) as complete from e""")
def q_eval_macro(spark: SparkSession, d: str) -> DataFrame:
    e = R.recall_precision(hits(spark, d), relevant(spark, d), 8)
    return e.agg(F.count("*").alias("n_queries"), F.round(F.avg("recall_at_k"), 5).alias("macro_recall"), F.round(F.avg("precision_at_k"), 5).alias("macro_precision"), F.bool_and(F.col("recall_at_k") >= 0).alias("complete"))


@query(f"""with l as ({LIVE_SQL}), a as (select query_id, namespace, key, upper(value) as value, confidence - 0.05 as confidence from l where query_id <> 2 union all select query_id, namespace, key, value, confidence from l)
select cast(query_id as bigint) as query_id, namespace, key, lower(trim(value)) as value, max(confidence)::double as confidence from a group by all""")
def q_live_facets(spark: SparkSession, d: str) -> DataFrame:
    facts = spark.sql(LIVE_SQL).withColumns({"confidence": F.col("confidence").cast("double"), "query_id": F.col("query_id").cast("long")})
    asked = facts.where("query_id <> 2").withColumns({"value": F.upper("value"), "confidence": F.round(F.col("confidence") - 0.05, 6)})
    return R.live_facets(facts, asked)


@query(f"""with x as (select item_id, {toks("text")} as ts from benchmark), p as (select p_partkey as part_key, p_type, p_size, list_distinct(string_split(lower(p_name), ' ')) as topics from part),
s as (select part_key, p_size, len(list_filter(['green', 'blue', 'red', 'steel', 'copper'], lambda t: list_contains(topics, t))) as n_topics from p)
select part_key, n_topics, rank from (select part_key, n_topics, row_number() over (order by n_topics desc, (case when p_size = 1 then 0 else 1 end), part_key) as rank from s) where rank <= 50""")
def q_hint_rank(spark: SparkSession, d: str) -> DataFrame:
    """Parts as registry entries: most shared topics first, then suggested ones, then the key."""
    topics = F.array(*map(F.lit, ("green", "blue", "red", "steel", "copper")))
    scored = table(spark, d, "part").select(F.col("p_partkey").alias("part_key"), "p_size", F.size(F.array_intersect(topics, F.split(F.lower("p_name"), " "))).cast("long").alias("n_topics"))
    first = scored.orderBy(F.desc("n_topics"), F.when(F.col("p_size") == 1, 0).otherwise(1), "part_key").limit(50)
    from pyspark.sql import Window

    order = Window.orderBy(F.desc("n_topics"), F.when(F.col("p_size") == 1, 0).otherwise(1), "part_key")
    return first.withColumn("rank", F.row_number().over(order).cast("long")).select("part_key", "n_topics", "rank")
