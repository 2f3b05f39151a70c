"""Reports from journals: sections, executions with all that belongs to them, bounded output, planner context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .relational import running_total


def sections(events: DataFrame, key: str, rules: dict[str, Column], summary: Column) -> DataFrame:
    """(key, section, n, seq, summary): each event in the first section whose rule holds, numbered there."""
    where = F.coalesce(*[F.when(c, F.lit(n)) for n, c in rules.items()])
    rows = events.select(key, "seq", where.alias("section"), summary.alias("summary")).where("section is not null")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key, "section").orderBy("seq")).cast("long"))


def hypotheses(events: DataFrame, key: str, subject: str, support: Column, against: Column) -> DataFrame:
    """(key, subject, n_support, n_against, status): weakened as soon as something stands against it."""
    g = events.groupBy(key, subject).agg(F.count_if(support).alias("n_support"), F.count_if(against).alias("n_against"))
    status = F.when(F.col("n_against") > 0, "weakened").when(F.col("n_support") > 0, "supported").otherwise("open")
    return g.withColumn("status", status)


def executions(events: DataFrame, key: str, call: str, start: str, extras: dict[str, str], value: str) -> DataFrame:
    """One row for each start: its call, and for each further type the value of its last event of the same call.

    One aggregate over (key, call) gathers all types at once; nothing is joined type by type.
    """
    last = [F.max_by(F.when(F.col("type") == t, F.col(value)), F.when(F.col("type") == t, F.col("seq"))).alias(n) for n, t in extras.items()]
    g = events.groupBy(key, call).agg(F.min(F.when(F.col("type") == start, F.col("seq"))).alias("start_seq"), F.count("*").alias("n_events"), *last)
    return g.where("start_seq is not null")


def consultations(assessed: DataFrame, consulted: DataFrame, queries: DataFrame, source: str, question: str) -> DataFrame:
    """Assessed sources with their consultation (without one: an error row) and, where known, the question."""
    c = consulted.select(source, question).distinct().withColumn("found", F.lit(True))
    out = assessed.join(c, source, "left").join(queries, question, "left")
    return out.withColumn("error", F.when(F.col("found").isNull(), "missing_consultation")).drop("found")


def bounded(rows: DataFrame, by: str, order: list[str], size: str, budget: int, reserve: int) -> DataFrame:
    """The longest prefix of each group's rows, most important first, that leaves room for an overflow row, which tells how many went."""
    summed = running_total(rows.select(by, *dict.fromkeys([*order, size])), by, order, size, "_used")
    whole = rows.groupBy(F.col(by).alias("_by")).agg(F.sum(size).alias("_total"))
    marked = summed.join(whole, F.col(by).eqNullSafe(F.col("_by")), "left").withColumn("_keep", F.when(F.col("_total") <= budget, F.lit(True)).otherwise(F.col("_used") <= budget - reserve))
    return marked.groupBy(by).agg(F.count_if("_keep").alias("n_kept"), F.count_if(~F.col("_keep")).alias("n_omitted"), F.coalesce(F.sum(F.when(F.col("_keep"), F.col(size))), F.lit(0)).cast("long").alias("used"))


def first_unique(rows: DataFrame, by: list[str], item: str, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` distinct items of each group in the order of their first appearance."""
    once = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by, item).orderBy(*order))).where("_r = 1").drop("_r")
    return once.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("n") <= limit)


def citations(prepared: DataFrame, drafts: DataFrame, source: str) -> DataFrame:
    """Draft citations (source, draft, index) resolved to segments; an index without a segment is an error row."""
    segments = prepared.select(source, F.posexplode("segments").alias("index", "segment"))
    hit = drafts.join(segments, [source, "index"], "left")
    return hit.withColumn("error", F.when(F.col("segment").isNull(), "unknown_segment"))


def paragraphs(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chunks): paragraphs packed to ``limit`` characters; a longer one is cut at its spaces first."""
    words = F.split(F.regexp_replace(F.trim(F.col(text_col)), r"[ \t]+", " "), " ")
    zero = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("chunks"))

    def step(a: Column, w: Column) -> Column:
        joined = a["size"] + 1 + F.length(w)
        fits = (a["chunks"] > 0) & (joined <= limit)
        return F.struct(F.when(fits, joined).otherwise(F.length(w)).cast("long").alias("size"), (a["chunks"] + F.when(fits, 0).otherwise(1)).cast("long").alias("chunks"))

    return docs.select(id_col, F.aggregate(words, zero, step, lambda a: a["chunks"]).alias("n_chunks"))


def scraped_article(lines: DataFrame, start: Column, boundary: Column) -> DataFrame:
    """Lines from the first start on, up to the first boundary behind it (both by document); none if no start exists."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_begun", F.max(start.cast("int")).over(w))
    rows = rows.withColumn("_ended", F.max(((F.col("_begun") == 1) & boundary).cast("int")).over(w))
    return rows.where("_begun = 1 and _ended = 0").drop("_begun", "_ended")


def context_digest(rows: DataFrame, by: str, kinds: dict[str, int], order: list[str]) -> DataFrame:
    """Planner context: of each kind at most so many items in order, and one digest over the whole."""
    w = Window.partitionBy(by, "kind").orderBy(*order)
    most = F.create_map(*[F.lit(v) for kv in kinds.items() for v in kv])[F.col("kind")]
    kept = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    items = F.array_sort(F.collect_list(F.concat_ws("/", "kind", F.lpad(F.col("n").cast("string"), 6, "0"), F.col("item").cast("string"))))
    return kept.groupBy(by).agg(F.count("*").alias("n_items"), X.list_digest(items).alias("digest"))
