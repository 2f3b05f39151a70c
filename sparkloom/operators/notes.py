"""Notes, drafts and their rendering: link clean-up, dates, inert Markdown, profiles, draft hygiene, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

EMBED, WIKI = r"!\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]", r"\[\[([^\[\]|]+)(?:\|([^\[\]]*))?\]\]"
# The command names, and the beginnings of known outputs, by which a code block is told to hold commands.
COMMANDS = (
    "apt apt-get awk bash cat chmod chown cp curl docker echo env find git grep ip iptables ls mkdir mount mv nc netcat nmap ping pip pip3 "
    "powershell python python3 rm rpcclient run script set show smbclient snmpwalk ssh strace sudo tar tree unzip use wget whoami"
).split()
OUTPUTS = r"(?i)^(find:|iptables\s+v\d|nmap\s+scan\s+report\b)"
PROMPT, COMMAND_NAME = r"[$#>]\s+([^\r\n]+)$", r"^(?:(?:\./|/)?[a-z0-9_.-]+/)*([a-z][a-z0-9_-]*)(?:$|\s)"


def plain_links(x: Column) -> Column:
    """Embeds removed, wiki links replaced by what they show (their alias, else their target), white space at line ends removed."""
    shown = F.regexp_replace(F.regexp_replace(x, EMBED, ""), r"\[\[(?:[^\[\]|]+\|)?([^\[\]]*)\]\]", "$1")
    return F.regexp_replace(shown, r"(?m)[ \t]+$", "")


def without_urls(x: Column) -> Column:
    """URLs removed, and the spaces around each made one."""
    return F.trim(F.regexp_replace(x, r"[ \t]*https?://[^\s)>\]\"']+[ \t]*", " "))


def note_relations(notes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(note, relation, target): metadata lines ``key:: value`` as relations, embeds as assets, wiki links as links; distinct."""
    text = F.col(text_col)
    meta = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^([\w-]+::[ \t]*.+?)[ \t]*$"), 1), lambda m: F.struct(F.lower(F.substring_index(m, "::", 1)).alias("relation"), F.trim(F.regexp_replace(m, r"^[\w-]+::[ \t]*", "")).alias("target")))
    embeds = F.transform(F.regexp_extract_all(text, F.lit(EMBED), 1), lambda t: F.struct(F.lit("asset").alias("relation"), F.trim(t).alias("target")))
    links = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!!)" + WIKI), 1), lambda t: F.struct(F.lit("link").alias("relation"), F.trim(t).alias("target")))
    return notes.select(F.col(id_col).alias("note"), F.inline(F.array_distinct(F.concat(meta, embeds, links)))).where("target <> ''")


def profiled(docs: DataFrame, profile: Column, known: dict[str, Column]) -> DataFrame:
    """Adds ``body`` by the named profile and ``error`` for a profile that nobody knows."""
    body, error = F.lit(None).cast("string"), F.lit("unknown_profile")
    for name, expression in known.items():
        body = F.when(profile == name, expression).otherwise(body)
        error = F.when(profile == name, F.lit(None).cast("string")).otherwise(error)
    return docs.withColumn("body", body).withColumn("error", error)


def inert(x: Column) -> Column:
    """Text that Markdown shows as it is: its own signs escaped, line breaks made spaces."""
    return F.regexp_replace(F.regexp_replace(x, r"([\\`*_{}\[\]()#+!|<>~-])", r"\\$1"), r"\s*[\r\n]+\s*", " ")


def fenced(x: Column, least: int = 3) -> Column:
    """A code block whose fence is longer than any run of back-ticks inside."""
    runs = F.transform(F.regexp_extract_all(x, F.lit("(`+)"), 1), F.length)
    n = F.greatest(F.lit(least), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    fence = F.repeat(F.lit("`"), n)
    return F.concat(fence, F.lit("\n"), x, F.lit("\n"), fence)


def slug(x: Column, most: int = 48) -> Column:
    """Lower case letters and digits joined by hyphens; ``item`` if nothing is left."""
    s = F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(X.strip_accents(F.lower(x)), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, most), r"-+$", "")
    return F.when(s == "", "item").otherwise(s)


def flexible_date(x: Column) -> Column:
    """An ISO date or date-time in any zone as the date in UTC (the session's zone); null if it is neither."""
    t = F.trim(x)
    plain = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))
    full = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?$"), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, " ", "T"), r"(T\d{2}:\d{2})(?!:)", "$1:00")))
    return F.to_date(F.coalesce(plain, full))


def as_of(facts: DataFrame, by: str, value: str) -> DataFrame:
    """(by, as_of): the date that a query is about, where its known values name exactly one."""
    dates = facts.withColumn("_d", flexible_date(F.col(value))).where("_d is not null")
    return dates.groupBy(by).agg(F.count_distinct("_d").alias("_n"), F.min("_d").alias("as_of")).where("_n = 1").select(by, "as_of")


def stamped_name(at: Column, title: Column, suffix: str) -> Column:
    """A file name that sorts by time: ``20240131T235959Z-title.md``."""
    return F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), slug(title), F.lit(suffix))


def command_like(x: Column) -> Column:
    """Whether a code block looks like commands: its first line that is not blank names one, behind a prompt and a path or not, and is no known output."""
    first = F.trim(F.regexp_extract(x, r"^\s*([^\r\n]+)", 1))
    typed = F.regexp_extract(first, PROMPT, 1)
    name = F.regexp_extract(F.lower(F.when(typed == "", first).otherwise(F.trim(typed))), COMMAND_NAME, 1)
    return ~first.rlike(OUTPUTS) & name.isin(*COMMANDS)


def mention_near(x: Column, anchor: str, words: str, window: int = 100) -> Column:
    """Whether ``words`` stand within ``window`` letters around some place of ``anchor``."""
    around = F.regexp_extract_all(x, F.lit(rf"(?s)(.{{0,{window}}}{anchor}.{{0,{window}}})"), 1)
    near = F.exists(around, lambda c: c.rlike(words))
    return F.when(~x.rlike(f"(?s){anchor}"), False).otherwise(near)  # the window is tried at each letter, so texts without the anchor skip it


def oversized(groups: DataFrame, size: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(groups that can be packed, quarantined ones with the reason): a group that cannot be cut and exceeds the limit goes aside."""
    too_large = F.col(size) > limit
    return groups.where(~too_large), groups.where(too_large).withColumn("reason", F.lit("oversized_block"))


def chunked(segments: DataFrame, by: str, order: str, size: int = 5) -> DataFrame:
    """Adds ``chunk`` (from 0) and ``is_chunked``: whether the source has more segments than one chunk holds."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(by))
    return segments.withColumn("chunk", F.floor(place / size).cast("long")).withColumn("is_chunked", n > size)


def draft_problems(drafts: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """(key, draft, problem) of drafts (key, draft, policy, citations, claim): every rule that each breaks."""
    have = segments.groupBy(key).agg(F.max("segment").alias("_last"))
    rows = drafts.join(have, key, "left")
    c = F.col("citations")
    rules = [
        F.when(F.lower(F.trim("policy")).isin("", "todo", "tbd", "n/a", "none"), "placeholder_policy"),
        F.when(F.size(F.array_distinct(c)) < F.size(c), "duplicate_citation"),
        F.when(F.coalesce(F.size(c), F.lit(0)) == 0, "no_citation"),
        F.when(F.exists(c, lambda x: (x < 0) | (x > F.coalesce(F.col("_last"), F.lit(-1)))), "unknown_segment"),
        F.when(~F.trim("claim").rlike(r"\S[.!?]\z"), "incomplete_claim"),
    ]
    return rows.select(key, "draft", F.explode(F.array_compact(F.array(*rules))).alias("problem"))


def rendered(parts: DataFrame, key: str, order: str, heading: Column, body: Column) -> DataFrame:
    """(key, order, first_line, last_line, n_lines): where each part stands in the page that all parts make.

    A part is its heading, a blank line, its body and a blank line; lines count from 1.
    """
    n = F.size(F.split(heading, "\n")) + 1 + F.size(F.split(body, "\n")) + 1
    end = F.sum("n_lines").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = parts.select(key, order, n.cast("long").alias("n_lines")).withColumn("_end", end)
    return rows.select(key, order, (F.col("_end") - F.col("n_lines") + 1).alias("first_line"), (F.col("_end") - 1).alias("last_line"), "n_lines")


def provenance(artifacts: DataFrame, key: str, sources: str, facets: str, contradicts: str) -> DataFrame:
    """(key, role, source): the sources of an artifact, of its facets and of what it contradicts, distinct."""
    own = F.transform(sources, lambda s: F.struct(F.lit("artifact").alias("role"), s.alias("source")))
    by_facet = F.flatten(F.transform(facets, lambda f: F.transform(f["sources"], lambda s: F.struct(F.concat(F.lit("facet:"), f["id"].cast("string")).alias("role"), s.alias("source")))))
    against = F.transform(contradicts, lambda s: F.struct(F.lit("contradicts").alias("role"), s.alias("source")))
    return artifacts.select(key, F.inline(F.array_distinct(F.concat(own, by_facet, against))))


def legacy_view(kind: Column, titles: dict[str, Column], contents: dict[str, Column]) -> tuple[Column, Column]:
    """(title, content) by the kind of a record; kinds that are not named, such as secrets, show nothing."""
    title, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in titles:
        title = F.when(kind == name, titles[name]).otherwise(title)
        content = F.when(kind == name, contents[name]).otherwise(content)
    return title, content


def constructed_queries(situations: DataFrame, key: str, parts: list[str], private: list[str], limit: int = 200) -> DataFrame:
    """(key, query): the parts of a situation in order, without private terms, each word once, cut at a word."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", *parts)), r"[^\p{L}\p{N}_.-]+"), lambda w: (w != "") & ~w.isin(*[p.lower() for p in private])))
    joined = F.array_join(words, " ")
    cut = F.when(F.length(joined) <= limit, joined).otherwise(F.regexp_replace(F.substring(joined, 1, limit + 1), r" [^ ]*$", ""))
    return situations.select(key, cut.alias("query"))


def scenario_report(hits: DataFrame, relevant: DataFrame, forbidden: DataFrame, runs: DataFrame, key: str, item: str, k: int) -> DataFrame:
    """(key, recall, precision, n_violations, max_latency, reproducible) of each scenario.

    ``hits`` (key, item, rank), ``forbidden`` (key, item) that must not be hit, ``runs`` (key, latency, digest) of
    every repeat; an empty result has precision 0.
    """
    top = hits.where(F.col("rank") <= k).select(key, item).distinct()
    good = relevant.select(key, item).distinct().withColumn("_good", F.lit(1))
    bad = forbidden.select(key, item).distinct().withColumn("_bad", F.lit(1))
    got = top.join(good, [key, item], "left").join(bad, [key, item], "left").groupBy(key).agg(F.count("*").alias("n"), F.count("_good").alias("hit"), F.count("_bad").alias("bad"))
    asked = relevant.select(key, item).distinct().groupBy(key).agg(F.count("*").alias("need"))
    timed = runs.groupBy(key).agg(F.max("latency").alias("max_latency"), (F.count_distinct("digest") == 1).alias("reproducible"))
    rows = asked.join(got, key, "left").join(timed, key, "left").na.fill(0, ["n", "hit", "bad"])
    precision = F.when(F.col("n") == 0, 0.0).otherwise(F.round(F.col("hit") / F.col("n"), 6))
    return rows.select(key, F.round(F.col("hit") / F.col("need"), 6).alias("recall"), precision.alias("precision"), F.col("bad").alias("n_violations"), "max_latency", F.coalesce("reproducible", F.lit(False)).alias("reproducible"))


def gates(report: DataFrame, recall: float, precision: float, violations: int, latency: float, total: float) -> DataFrame:
    """One row: macro averages, sums and the greatest latency, and whether every gate holds."""
    m = report.agg(
        F.count("*").alias("n_scenarios"), F.round(F.avg("recall"), 5).alias("macro_recall"), F.round(F.avg("precision"), 5).alias("macro_precision"), F.sum("n_violations").alias("n_violations"),
        F.round(F.max("max_latency"), 6).alias("max_latency"), F.round(F.sum("max_latency"), 6).alias("total_latency"), F.bool_and("reproducible").alias("reproducible"),
    )
    holds = (F.col("macro_recall") >= recall) & (F.col("macro_precision") >= precision) & (F.col("n_violations") <= violations) & (F.col("max_latency") <= latency) & (F.col("total_latency") <= total) & F.col("reproducible")
    return m.withColumn("passed", holds)


def disposition_counts(rows: DataFrame, value: Column, names: list[str]) -> DataFrame:
    """(disposition, n) with a row for every name, also those that do not occur; one pass, one row before it is turned."""
    one = rows.agg(*[F.count_if(value == n).alias(f"c{i}") for i, n in enumerate(names)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("disposition"), F.col(f"c{i}").alias("n")) for i, n in enumerate(names)])))
