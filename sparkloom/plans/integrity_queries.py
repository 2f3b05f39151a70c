"""Projection, digests, upserts and audits over the order tables and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import integrity as I
from .registry import query, table

ITEM_COLUMNS = ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", *ITEM_COLUMNS)


def bundles(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return I.nested(orders, items(spark, d), "o_orderkey", "l_orderkey", "steps", "l_linenumber")


@query("""select o_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, 'step-' || substr(sha256(concat_ws('|', o_orderkey, l_linenumber, l_partkey, l_returnflag, l_suppkey)), 1, 24) as artifact_id
from orders join lineitem on o_orderkey = l_orderkey""")
def q_project_rows(spark: SparkSession, d: str) -> DataFrame:
    """Nested bundles (orders with their lines) flattened to rows with content ids."""
    return I.projected(bundles(spark, d), "o_orderkey", "steps")


@query("""select o_orderkey, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_append(coalesce(flags, []), o_orderstatus), lambda x: x is not null and x <> ''))), ' '), '') as search_text
from orders left join (select l_orderkey, list(l_returnflag) as flags from lineitem group by 1) on o_orderkey = l_orderkey""")
def q_search_columns(spark: SparkSession, d: str) -> DataFrame:
    b = bundles(spark, d)
    flags = F.transform("steps", lambda s: s["l_returnflag"])
    return b.select("o_orderkey", I.search_text(F.filter(F.concat(F.array("o_orderstatus"), F.coalesce(flags, F.array().cast("array<string>"))), lambda v: v.isNotNull())).alias("search_text"))


@query("""with u as (select distinct s_suppkey as artifact_id, key, value from (select s_suppkey, 'nation' as key, cast(s_nationkey as varchar) as value from supplier union all select s_suppkey, 'name', s_name from supplier) where value is not null)
select artifact_id, key, value, substr(sha256(artifact_id || chr(31) || key || chr(31) || value), 1, 24) as facet_id from u""")
def q_facet_rows(spark: SparkSession, d: str) -> DataFrame:
    return I.facet_rows(table(spark, d, "supplier"), "s_suppkey", {"nation": F.col("s_nationkey"), "name": F.col("s_name")})


DIGEST_SQL = "select l_orderkey, sha256(array_to_string(list_sort(list(concat_ws('|', l_linenumber, l_partkey, l_suppkey, l_returnflag))), ';')) as digest from lineitem {} group by 1"


@query(DIGEST_SQL.format(""))
def q_digest_rows(spark: SparkSession, d: str) -> DataFrame:
    return I.row_digests(items(spark, d), "l_orderkey", ITEM_COLUMNS)


@query(f"with g as ({DIGEST_SQL.format('')}) select o_custkey, count(*) as n_artifacts, sha256(array_to_string(list_sort(list(digest)), ',')) as state from g join orders on o_orderkey = l_orderkey group by 1")
def q_source_state(spark: SparkSession, d: str) -> DataFrame:
    """Per source (customer): how many artifacts and one digest over theirs."""
    owner = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    each = q_digest_rows(spark, d).join(owner, "l_orderkey")
    return each.groupBy("o_custkey").agg(F.count("*").alias("n_artifacts"), X.list_digest(F.array_sort(F.collect_list("digest"))).alias("state"))


@query("""with inc as (select o_orderkey + 10000000 as o_orderkey, o_custkey, o_orderstatus from orders where o_custkey % 7 = 0)
select o_orderkey, o_custkey, o_orderstatus from orders where o_custkey not in (select o_custkey from inc) union all select * from inc""")
def q_upsert_source(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = now.where("o_custkey % 7 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    return I.merge_sources(now, new, "o_custkey").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""with v as (select event_id % 500 as id, epoch_us(ts) as created, epoch_us(ts) as updated, event_type as kind from events),
r as (select *, row_number() over (partition by id order by updated desc, kind desc) as rn, min(created) over (partition by id) as first_created from v)
select id, first_created as created, updated, kind from r where rn = 1""")
def q_merge_records(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    v = table(spark, d, "events").select((F.col("event_id") % 500).alias("id"), at.alias("created"), at.alias("updated"), F.col("event_type").alias("kind"))
    return I.merge_records(v.where("created % 2 = 0"), v.where("created % 2 <> 0"), "id", "created", "updated")


@query("""select 'lineitem_order' as edge, count(*) as n from lineitem left join orders on o_orderkey = l_orderkey where o_orderkey is null
union all select 'lineitem_part', count(*) from lineitem left join part on p_partkey = l_partkey where p_partkey is null
union all select 'order_customer', count(*) from orders left join customer on c_custkey = o_custkey where c_custkey is null
union all select 'label_document', count(*) from labels where doc_id not in (select doc_id from documents)
union all select 'supplier_nation', count(*) from supplier where s_nationkey not in (select n_nationkey from nation)
union all select 'half_orders', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 2 = 0)""")
def q_audit_orphans(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    edges = {
        "lineitem_order": (t("lineitem"), t("orders"), "l_orderkey", "o_orderkey"),
        "lineitem_part": (t("lineitem"), t("part"), "l_partkey", "p_partkey"),
        "order_customer": (t("orders"), t("customer"), "o_custkey", "c_custkey"),
        "label_document": (t("labels"), t("documents"), "doc_id", "doc_id"),
        "supplier_nation": (t("supplier"), t("nation"), "s_nationkey", "n_nationkey"),
        "half_orders": (t("lineitem"), t("orders").where("o_orderkey % 2 = 0"), "l_orderkey", "o_orderkey"),
    }
    out = None
    for name, (c, p, ck, pk) in edges.items():
        part = I.orphans(c.select(ck), p.select(pk), ck, pk).agg(F.lit(name).alias("edge"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""select 'orders' as name, cast(coalesce(sum(n - 1), 0) as bigint) as excess from (select count(*) as n from orders group by o_orderkey having count(*) > 1)
union all select 'line_parts', cast(coalesce(sum(n - 1), 0) as bigint) from (select count(*) as n from lineitem group by l_orderkey, l_partkey having count(*) > 1)
union all select 'texts', cast(coalesce(sum(n - 1), 0) as bigint) from (select count(*) as n from documents group by text having count(*) > 1)""")
def q_dup_ids(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select(F.sha2("text", 256).alias("k"))
    parts = {"orders": (table(spark, d, "orders"), ["o_orderkey"]), "line_parts": (table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"]), "texts": (texts, ["k"])}
    rows = [I.duplicate_excess(df.select(*k), k).select(F.lit(n).alias("name"), "excess") for n, (df, k) in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"""with a as ({DIGEST_SQL.format("")}), b as (select l_orderkey, case when l_orderkey % 11 = 0 then 'x' else digest end as digest from ({DIGEST_SQL.format("")}) where l_orderkey % 13 <> 0 union all select -l_orderkey, digest from a where l_orderkey % 997 = 0),
p as (select coalesce(a.l_orderkey, b.l_orderkey) as k, case when b.digest is null then 'missing' when a.digest is null then 'orphan' when a.digest <> b.digest then 'stale' else 'equal' end as state from a full join b on a.l_orderkey = b.l_orderkey)
select state, count(*) as n, min(k) as least from p group by 1""")
def q_parity_full_outer(spark: SparkSession, d: str) -> DataFrame:
    a = q_digest_rows(spark, d)
    b = a.where("l_orderkey % 13 <> 0").withColumn("digest", F.when(F.col("l_orderkey") % 11 == 0, "x").otherwise(F.col("digest")))
    b = b.unionByName(a.where("l_orderkey % 997 = 0").withColumn("l_orderkey", -F.col("l_orderkey")))
    return I.parity(a, b, "l_orderkey").groupBy("state").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("least"))


@query("""with m as (select doc_id, case when doc_id % 10 = 0 then 'old' else sha256(text) end as k, n_chars from documents where doc_id % 7 <> 0)
select d.doc_id, coalesce(m.k is not distinct from sha256(d.text) and m.n_chars is not distinct from d.n_chars and m.doc_id is not null, false) as unchanged from documents d left join m using (doc_id)""")
def q_unchanged(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("k"), "n_chars")
    manifest = rows.where("doc_id % 7 <> 0").withColumn("k", F.when(F.col("doc_id") % 10 == 0, "old").otherwise(F.col("k")))
    return I.unchanged(rows, manifest, "doc_id", ["k", "n_chars"]).select("doc_id", "unchanged")


@query("select o_orderkey, o_custkey from orders where o_orderkey > 1000 order by o_orderkey limit 100")
def q_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return I.page_after(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, 100)


@query("""select o_custkey, count(*) as n_omitted, sha256(string_agg(o_orderkey::varchar, ',' order by o_orderkey)) as digest from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as n from orders) where n > 5 group by 1""")
def q_omitted_digest(spark: SparkSession, d: str) -> DataFrame:
    return I.omitted_digest(table(spark, d, "orders"), "o_orderkey", 5, "o_custkey")


@query("select sha256(text) as k, min(doc_id) as doc_id, count(*) as n_same from documents group by 1")
def q_dedupe_select(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("k"))
    return I.select_duplicates(rows, ["k"], [F.col("doc_id")]).select("k", "doc_id", "n_same")


@query("""select l_orderkey, count(*) as n, min(line) = 1 and max(line) = count(*) and count(distinct line) = count(*) as complete, count(distinct l_returnflag) = 1 as uniform from (select *, case when l_suppkey % 9 = 0 then l_linenumber + 1 else l_linenumber end as line from lineitem) group by 1""")
def q_batch_complete(spark: SparkSession, d: str) -> DataFrame:
    return I.batch_complete(table(spark, d, "lineitem").withColumn("line", F.when(F.col("l_suppkey") % 9 == 0, F.col("l_linenumber") + 1).otherwise(F.col("l_linenumber"))), "l_orderkey", "line", "l_returnflag")


PATHS_SQL = r"p as (select page_id, regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^?#]+)', 1), '/+$', '') as path from pages)"


def paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", r"^[A-Za-z]+://([^?#]+)", 1), r"/+$", "").alias("path"))


@query(f"""with {PATHS_SQL}, o as (select distinct path as doc_path, regexp_replace(path, '/?[^/]*$', '') as dir from p where page_id % 10 = 0), a as (select distinct path as asset_path from p where page_id % 10 <> 0)
select doc_path, len(list(distinct asset_path)) as n_assets, sha256(array_to_string(list_sort(list(distinct asset_path)), '|')) as assets_key from o join a on starts_with(asset_path, dir || '/') and dir <> '' and asset_path <> doc_path group by 1""")
def q_asset_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files: every tenth is a document, the rest are assets of the documents whose folder is above them."""
    rows = paths(spark, d)
    docs = rows.where("page_id % 10 = 0").select(F.col("path").alias("doc_path")).distinct()
    assets = rows.where("page_id % 10 <> 0").select(F.col("path").alias("asset_path")).distinct()
    got = I.attach_assets(docs.where(F.regexp_replace("doc_path", r"/?[^/]*$", "") != ""), assets)
    return got.select("doc_path", F.size("assets").cast("long").alias("n_assets"), F.sha2(F.array_join("assets", "|"), 256).alias("assets_key"))


@query("""select doc_id, sha256(text) as sha, strlen(text) as size from documents""")
def q_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Content fingerprints of documents as sources."""
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("size"))


@query("""with h as (select doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('src/' || doc_id)) as h from documents)
select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex((('0x' || substr(h, 17, 2))::int & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) as source_id from h""")
def q_stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """Version-5 UUIDs of relative names, by expression."""
    return table(spark, d, "documents").select("doc_id", X.uuid5(F.concat(F.lit("src/"), F.col("doc_id").cast("string"))).alias("source_id"))


@query("""with x as (select l_orderkey as k, l_linenumber as n, datediff('day', timestamp '1990-01-01', l_shipdate) as s, datediff('day', timestamp '1990-01-01', l_shipdate) + l_quantity::bigint as e from lineitem)
select a.k as order_key, count(*) as n_pairs from x a join x b on a.k = b.k and a.n < b.n and a.e >= b.s and a.s <= b.e group by 1""")
def q_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")).cast("long")
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end"))
    return I.intervals_overlap(x, x, "k").where("x.n < y.n").groupBy(F.col("x.k").alias("order_key")).agg(F.count("*").alias("n_pairs"))


@query("""with x as (select l_orderkey as k, datediff('day', timestamp '1990-01-01', l_shipdate) as s, datediff('day', timestamp '1990-01-01', l_shipdate) + l_quantity::bigint as e from lineitem), y as (select *, case when s > max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end as gap from x),
z as (select *, sum(gap) over (partition by k order by s, e rows unbounded preceding) as g from y)
select k as order_key, max(case when g = 0 then e end) as cursor, cast(max(g) as bigint) as n_gaps from z group by 1""")
def q_prefix_coverage(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")).cast("long")
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"), day.alias("s"), (day + F.col("l_quantity").cast("long")).alias("e"))
    return I.coverage_cursor(x, "order_key", "s", "e")
