"""Text operators over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import markdown as M
from ..operators import text as T
from ..operators.relational import running_total
from .registry import query, table

SIGNALS_SQL = r"""
x as (select doc_id, coalesce(text, '') as t, string_split(coalesce(text, ''), chr(10)) as ls from documents),
s as (select doc_id, trim(t) as t,
  len(list_filter(ls, lambda l: regexp_matches(l, '^#{1,6}\s+\S'))) as n_headings, cast(floor(len(list_filter(ls, lambda l: starts_with(l, '```'))) / 2) as bigint) as n_fences,
  len(regexp_extract_all(t, '[\p{L}\p{N}_''-]+')) as n_words, len(list_filter(ls, lambda l: len(string_split(l, '|')) >= 3)) as n_table_lines,
  len(list_filter(ls, lambda l: len(regexp_split_to_array(trim(l), '\s+')) >= 5 and not contains(l, '|'))) as n_narrative,
  len(regexp_extract_all(t, 'https?://[^\s)>\]"'']+')) as n_urls, regexp_matches(t, '[A-Za-z0-9_]{2,16}\{[^{}\s]{1,128}\}') as has_flag,
  len(list_filter(regexp_extract_all(t, 'https?://[^\s)>\]"'']+'), lambda u: regexp_matches(u, '(?i)(walkthrough|writeup|write-up)'))) as n_walkthrough_urls from x)
"""


@query(f"""with {SIGNALS_SQL}, k as (select *, (n_headings >= 2 and n_fences >= 1) or (regexp_matches(t, '(?i)\\b(run|execute|start|open)\\b') and regexp_matches(t, '(?i)\\b(result|output|shows|returned)\\b')) as p,
 n_narrative >= 1 or n_table_lines >= 3 or n_fences >= 1 as sub from s),
c as (select *, case when t = '' then 'excluded:empty' when has_flag and not p and n_walkthrough_urls = 0 then 'excluded:flag_only' when n_walkthrough_urls = 1 and not p and (has_flag or n_words < 100) then 'excluded:external_stub'
  when sub and n_table_lines >= 3 and n_table_lines >= n_narrative then 'accepted:cheatsheet_reference' when sub then 'accepted:lesson' else 'quarantined:ambiguous' end as k from k)
select doc_id, n_headings, n_fences, n_words, n_table_lines, n_narrative, n_urls, has_flag, n_walkthrough_urls, split_part(k, ':', 1) as status, split_part(k, ':', 2) as reason,
  case when split_part(k, ':', 1) <> 'accepted' then 'unusable' when n_words >= 100 and n_headings >= 2 then 'complete' when n_words >= 20 then 'partial' else 'minimal' end as grade from c""")
def q_classify_documents(spark: SparkSession, d: str) -> DataFrame:
    return T.classify(table(spark, d, "documents"))


@query(r"select page_id, len(regexp_extract_all(html, '(?i)<a[\s>]')) as n_links, len(regexp_extract_all(html, '(?i)<img[\s>]')) as n_images from pages")
def q_page_links(spark: SparkSession, d: str) -> DataFrame:
    found = T.link_counts(F.col("html"))
    return table(spark, d, "pages").select("page_id", found["n_links"].alias("n_links"), found["n_images"].alias("n_images"))


LEVELS = "case when length(line) < 60 then 1 when length(line) < 120 then 2 when length(line) < 200 then 3 else 0 end"
LINES_SQL = f"l as (select doc_id, cast(generate_subscripts(ls, 1) - 1 as bigint) as pos, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents)), b as (select *, {LEVELS} as level from l)"


def leveled(spark: SparkSession, d: str) -> DataFrame:
    """Lines as blocks; short lines play the headings, the shorter the higher."""
    rows = T.lines(table(spark, d, "documents"))
    n = F.length("line")
    return rows.withColumn("level", F.when(n < 60, 1).when(n < 120, 2).when(n < 200, 3).otherwise(0))


@query(f"""with {LINES_SQL}, h as (select *, max(case when level = 1 then pos end) over w as p1, max(case when level = 2 then pos end) over w as p2, max(case when level = 3 then pos end) over w as p3 from b window w as (partition by doc_id order by pos))
select h.doc_id, h.pos, cast(coalesce(h.p1, -1) as bigint) as top, md5(concat_ws(' > ', a.line, case when h.p2 > coalesce(h.p1, -1) then c.line end, case when h.p3 > greatest(coalesce(h.p1, -1), coalesce(h.p2, -1)) then e.line end)) as path_key
from h left join l a on a.doc_id = h.doc_id and a.pos = h.p1 left join l c on c.doc_id = h.doc_id and c.pos = h.p2 left join l e on e.doc_id = h.doc_id and e.pos = h.p3""")
def q_heading_path(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = T.heading_path(leveled(spark, d)).withColumn("top", F.coalesce(F.max(F.when(F.col("level") == 1, F.col("pos"))).over(w), F.lit(-1)).cast("long"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "top", F.md5("path").alias("path_key"))


@query(f"""with {LINES_SQL}, s as (select doc_id, line, sum(case when level = 1 then 1 else 0 end) over (partition by doc_id order by pos) as section from b)
select doc_id, cast(section as bigint) as section, count(*) as n_lines, cast(sum(length(line)) as bigint) as n_chars from s group by 1, 2""")
def q_sections(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = leveled(spark, d).withColumn("section", F.sum((F.col("level") == 1).cast("long")).over(w))
    return rows.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("line").cast("long")).alias("n_chars"))


@query("""with l as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) as ns from documents),
p as (select doc_id, list_reduce(list_prepend({'size': 0::bigint, 'packs': 0::bigint}, list_transform(ns, lambda n: {'size': n::bigint, 'packs': 0::bigint})), lambda a, x: case when a.packs > 0 and a.size + 2 + x.size <= 800 then {'size': a.size + 2 + x.size, 'packs': a.packs} else {'size': x.size, 'packs': a.packs + 1} end) as r from l)
select doc_id, r.packs as n_packs from p""")
def q_pack_segments(spark: SparkSession, d: str) -> DataFrame:
    """Lines packed into segments of at most 800 characters."""
    sizes = F.transform(F.split("text", "\n"), lambda x: F.length(x).cast("long"))
    return table(spark, d, "documents").select("doc_id", T.packed(sizes, 800).alias("n_packs"))


@query("""with l as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) as ns from documents),
p as (select doc_id, list_reduce(list_prepend({'used': 0::bigint, 'taken': 0::bigint}, list_transform(ns, lambda n: {'used': n::bigint, 'taken': 0::bigint})), lambda a, x: case when a.used + x.used <= 600 then {'used': a.used + x.used, 'taken': a.taken + 1} else {'used': a.used, 'taken': a.taken} end) as r from l)
select doc_id, r.used as used, r.taken as taken from p""")
def q_byte_budget_skip(spark: SparkSession, d: str) -> DataFrame:
    sizes = F.transform(F.split("text", "\n"), lambda x: F.length(x).cast("long"))
    return table(spark, d, "documents").select("doc_id", F.inline(F.array(T.within_budget(sizes, 600))))


@query("""select source, doc_id, cast(run as bigint) as run from (select source, doc_id, sum(n_chars) over (partition by source order by doc_id rows unbounded preceding) as run from documents) where run <= 30000""")
def q_byte_budget(spark: SparkSession, d: str) -> DataFrame:
    """The prefix of each source that stays within a budget; it stops at the first overflow."""
    rows = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return running_total(rows, "source", ["doc_id"], "n_chars", "run").where("run <= 30000").select("source", "doc_id", "run")


@query(r"""select doc_id, sha256(regexp_replace(regexp_replace(text, '[A-Za-z0-9_]{2,16}\{[^{}\s]{1,128}\}', '[REDACTED]', 'g'), '(^|[^A-Za-z0-9])[0-9a-fA-F]{32}([^A-Za-z0-9]|$)', '\1[REDACTED]\2', 'g')) as redacted_key from documents""")
def q_redact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(X.redact(F.col("text")), 256).alias("redacted_key"))


@query()
def q_decode_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Recursive decoding needs Python (html references); Arrow batches, no shuffle."""
    return table(spark, d, "pages").select("page_id", F.sha2(T.decoded(F.col("url")), 256).alias("url_key"), F.length(T.decoded(F.col("html"))).cast("long").alias("n_chars"))


@query(r"""select page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/@?#]*@)?([^/:?#]+)', 1)) || regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) as locator from pages""")
def q_url_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.url_locator(F.col("url")).alias("locator"))


@query(r"""with u as (select page_id, case page_id % 5 when 0 then url when 1 then replace(url, '://', '://me:pw@') when 2 then url || '&Token=1' when 3 then 'ftp' || substr(url, 5) else url || '#?key=1' end as u from pages)
select page_id, case when not regexp_matches(lower(u), '^https?://[^/?#]') then 'not_http' when regexp_matches(u, '^[A-Za-z]+://[^/?#]*@') then 'credentials'
  when len(list_intersect(list_transform(string_split(regexp_extract(u, '\?([^#]*)', 1), '&'), lambda p: lower(split_part(p, '=', 1))), ['access_token', 'api_key', 'apikey', 'auth', 'key', 'password', 'secret', 'sig', 'signature', 'token'])) > 0 then 'secret_key' end as error from u""")
def q_locator_errors(spark: SparkSession, d: str) -> DataFrame:
    url, n = F.col("url"), F.col("page_id") % 5
    planted = F.when(n == 0, url).when(n == 1, F.replace(url, F.lit("://"), F.lit("://me:pw@"))).when(n == 2, F.concat(url, F.lit("&Token=1"))).when(n == 3, F.concat(F.lit("ftp"), F.substr(url, F.lit(5)))).otherwise(F.concat(url, F.lit("#?key=1")))
    return table(spark, d, "pages").select("page_id", X.locator_error(planted).alias("error"))


OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
TARGETS = ("10.0.0.1", "999.1.1.1", "fe80::1", "host.example.org", "https://a.example/x", "box-7", "two words", "")


@query(f"""with t as (select page_id as target_id, [{", ".join(f"'{t}'" for t in TARGETS)}, url][1 + page_id % 9] as target from pages), v as (select *, lower(trim(target)) as v from t)
select target_id, case when v = '' or regexp_matches(v, '\\s') then 'invalid' when regexp_matches(v, '^{OCTET}(\\.{OCTET}){{3}}$') then 'ipv4' when regexp_matches(v, '^[0-9a-f:]*:[0-9a-f:]*:[0-9a-f:.]*$') then 'ipv6'
 when regexp_matches(v, '^https?://[^/?#]+') then 'url' when regexp_matches(v, '^[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?)+$') then 'hostname' else 'generic' end as kind from v""")
def q_target_kind(spark: SparkSession, d: str) -> DataFrame:
    """Syntax classes of targets: fixed samples of every class among the urls of pages."""
    pool = F.array(*map(F.lit, TARGETS), F.col("url"))
    return table(spark, d, "pages").select(F.col("page_id").alias("target_id"), X.target_kind(F.element_at(pool, (F.col("page_id") % 9 + 1).cast("int"))).alias("kind"))


@query("""select doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_''-]+')) as n_words, sha256(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))) as heading_key,
case when length(text) <= 200 then text else substr(text, 1, 200 - 38) || ' … [truncated sha256:' || substr(sha256(text), 1, 16) || ']' end as short from documents""")
def q_scalar_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.word_count(F.col("text")).alias("n_words"), F.sha2(X.normalise_heading(F.col("text")), 256).alias("heading_key"), X.truncated(F.col("text"), 200).alias("short"))


@query()
def q_markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = T.markdown_blocks(table(spark, d, "documents"))
    return blocks.groupBy("doc_id", "kind").agg(F.count("*").alias("n_blocks"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("n_lines"))


@query()
def q_segments(spark: SparkSession, d: str) -> DataFrame:
    cut = M.segments(M.blocks(table(spark, d, "documents")), 2000)
    return cut.groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.sum(F.col("last_block") - F.col("first_block") + 1).alias("n_blocks"))


@query("""with l as (select doc_id, len(string_split(text, chr(10))) as n from documents)
select doc_id, list_filter(range(n), lambda i: i % 3 <> 0 and i % 5 <> 1) as unaccounted from l""")
def q_segment_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Segments that are neither cited (every third) nor ignored (every fifth from the second)."""
    n = F.size(F.split("text", "\n"))
    every = F.sequence(F.lit(0), n - 1)
    cited, ignored = F.filter(every, lambda i: i % 3 == 0), F.filter(every, lambda i: i % 5 == 1)
    return table(spark, d, "documents").select("doc_id", F.transform(F.array_except(every, F.array_union(cited, ignored)), lambda i: i.cast("long")).alias("unaccounted"))
