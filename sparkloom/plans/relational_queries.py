"""Grouping sets, frames, set operations, joins over time and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as G
from .registry import query, table


def _sql(spark: SparkSession, d: str, text: str, *names: str) -> DataFrame:
    for n in names:
        table(spark, d, n).createOrReplaceTempView(n)
    return spark.sql(text)


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity, round(avg(l_discount), 6) as discount from lineitem group by 1, 2")
def q_pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))


GROUPING = "select l_returnflag, l_linestatus, count(*) as n, cast(grouping(l_returnflag) * 2 + grouping(l_linestatus) as int) as level from lineitem group by {}"


@query(GROUPING.format("grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())"))
def q_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, GROUPING.format("grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())"), "lineitem")


@query(GROUPING.format("rollup (l_returnflag, l_linestatus)"))
def q_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), (F.grouping("l_returnflag") * 2 + F.grouping("l_linestatus")).cast("int").alias("level"))


@query(GROUPING.format("cube (l_returnflag, l_linestatus)"))
def q_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), (F.grouping("l_returnflag") * 2 + F.grouping("l_linestatus")).cast("int").alias("level"))


@query("""select o_orderkey, ntile(4) over w as quarter, round(percent_rank() over w, 6) as pr, round(cume_dist() over w, 6) as cd, nth_value(o_orderkey, 2) over (w rows between unbounded preceding and unbounded following) as second_key,
count(*) over (partition by o_custkey order by o_totalprice range between 10000 preceding and current row) as n_near from orders window w as (partition by o_custkey order by o_totalprice, o_orderkey)""")
def q_ranking_frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    near = Window.partitionBy("o_custkey").orderBy("o_totalprice").rangeBetween(-10000, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "orders").select("o_orderkey", F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"), F.nth_value("o_orderkey", 2).over(whole).alias("second_key"), F.count("*").over(near).alias("n_near"))


@query("""with c as (select c_nationkey as k from customer where c_acctbal > 5000), s as (select s_nationkey as k from supplier where s_acctbal > 3000)
select 'union' as op, count(*) as n, cast(sum(k) as bigint) as total from (select k from c union select k from s) union all select 'union_all', count(*), cast(sum(k) as bigint) from (select k from c union all select k from s)
union all select 'intersect', count(*), cast(sum(k) as bigint) from (select k from c intersect select k from s) union all select 'except', count(*), cast(coalesce(sum(k), 0) as bigint) from (select k from c except select k from s)""")
def q_set_ops(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    s = table(spark, d, "supplier").where("s_acctbal > 3000").select(F.col("s_nationkey").alias("k"))
    parts = {"union": c.union(s).distinct(), "union_all": c.unionByName(s), "intersect": c.intersect(s), "except": c.subtract(s)}
    rows = [p.agg(F.lit(n).alias("op"), F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("total")) for n, p in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("""with s as (select user_id, ts, event_id from events where event_type = 'signup'), v as (select user_id, ts, value, event_id from events where event_type = 'view')
select event_id, value from (select s.event_id, v.value, row_number() over (partition by s.event_id order by v.ts desc) as n from s left join v on v.user_id = s.user_id and v.ts <= s.ts) where n = 1""")
def q_asof_join(spark: SparkSession, d: str) -> DataFrame:
    """The value of the latest view at or before each signup of the same user."""
    e = table(spark, d, "events")
    s = e.where("event_type = 'signup'").select("user_id", "ts", "event_id")
    return G.asof(s, e.where("event_type = 'view'").select("user_id", "ts", "value"), ["user_id"], "ts", "value").select("event_id", "value")


@query("""with r as (select p_partkey as part_key, p_size * 100 as low, p_size * 100 + p_partkey % 400 as high from part)
select part_key, count(*) as n_orders from r join orders on cast(floor(o_totalprice / 100) as bigint) between low and high group by 1""")
def q_range_join(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "orders").select(F.floor(F.col("o_totalprice") / 100).cast("long").alias("x"), "o_orderkey")
    ranges = table(spark, d, "part").select(F.col("p_partkey").alias("part_key"), (F.col("p_size") * 100).cast("long").alias("low"), (F.col("p_size") * 100 + F.col("p_partkey") % 400).cast("long").alias("high"))
    # orders of one price are counted once before the join, and parts with one range meet them once
    counted = points.groupBy("x").agg(F.count("*").alias("n"))
    found = G.range_join(counted, ranges.select("low", "high").distinct(), "x", "low", "high", 200).groupBy("low", "high").agg(F.sum("n").alias("n"))
    return ranges.join(found, ["low", "high"]).groupBy("part_key").agg(F.sum("n").alias("n_orders"))


@query("""select n_name, r_name, count(distinct c_custkey) as n_customers, count(o_orderkey) as n_orders, round(sum(o_totalprice), 2) as total from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey left join orders on o_custkey = c_custkey group by 1, 2""")
def q_star_join(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy("n_name", "r_name").agg(F.count_distinct("c_custkey").alias("n_customers"), F.count("o_orderkey").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000) and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def q_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return c.join(o.where("o_totalprice > 300000"), "c_custkey", "left_semi").join(o.where("o_orderstatus = 'P'"), "c_custkey", "left_anti")


@query("select source, lang, count(*) as n_docs, count(distinct sha256(text)) as n_texts, cast(sum(n_chars) as bigint) as n_chars, max(doc_id) as last_doc from documents group by 1, 2")
def q_salted_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts by source, pre-aggregated by text first so that a hot source is spread over many tasks."""
    rows = table(spark, d, "documents").select("source", "lang", F.sha2("text", 256).alias("k"), "n_chars", "doc_id")
    first = rows.groupBy("source", "lang", "k").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"), F.max("doc_id").alias("m"))
    return first.groupBy("source", "lang").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_texts"), F.sum("c").cast("long").alias("n_chars"), F.max("m").alias("last_doc"))


@query("""select role, count(*) as n_turns, count(distinct conv_id) as n_sessions, cast(max(turn) as bigint) as last_turn, cast(sum(length(text)) as bigint) as n_chars from conversations group by 1""")
def q_role_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n_turns"), F.count_distinct("conv_id").alias("n_sessions"), F.max("turn").cast("long").alias("last_turn"), F.sum(F.length("text")).cast("long").alias("n_chars"))
