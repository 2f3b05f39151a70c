"""The way of a source into the catalogue and out again: preparation, materialised drafts, promotion, archives, set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def same_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (n_only_a, n_only_b, equal): whether two frames hold the same distinct rows; one shuffle, no pairing."""
    both = a.distinct().withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)).unionByName(b.distinct().withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1)))
    each = both.groupBy(*a.columns).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return each.agg(F.count_if((F.col("_a") == 1) & (F.col("_b") == 0)).alias("n_only_a"), F.count_if((F.col("_a") == 0) & (F.col("_b") == 1)).alias("n_only_b")).withColumn("equal", (F.col("n_only_a") == 0) & (F.col("n_only_b") == 0))


def prepared(sources: DataFrame, known: DataFrame, key: str, content: str, suffix: Column, profile: Column, parts: Column, limit: int) -> DataFrame:
    """(key, digest, disposition, reason, n_segments): where each source ends, the first reason that stops it holds.

    Unchanged content is not prepared again; content that is empty, of a kind that is not parsed, or holds a part
    above the limit goes aside; what is left is cut into segments by greedy packing.
    """
    from .text import packed

    digest = F.sha2(F.coalesce(F.col(content), F.lit("")), 256)
    rows = sources.withColumn("digest", digest).join(known.select(key, F.col("digest").alias("_known")), key, "left").withColumn("_parts", parts)
    reason = (
        F.when(F.col("_known").eqNullSafe(F.col("digest")), "unchanged")
        .when(F.trim(F.coalesce(F.col(content), F.lit(""))) == "", "empty")
        .when(suffix == ".pdf", "pdf_not_parsed")
        .when(profile.isNull(), "unknown_profile")
        .when(F.exists("_parts", lambda n: n > limit), "oversized_block")
    )
    rows = rows.withColumn("reason", reason)
    disposition = F.when(F.col("reason").isNull(), "prepared").when(F.col("reason") == "unchanged", "unchanged").when(F.col("reason") == "empty", "excluded").otherwise("quarantined")
    n = F.when(F.col("reason").isNull(), packed("_parts", limit)).otherwise(F.lit(0).cast("long"))
    return rows.select(key, "digest", disposition.alias("disposition"), "reason", n.alias("n_segments"))


def materialized(drafts: DataFrame, segments: DataFrame, source: str, local: str) -> DataFrame:
    """(source, artifact_id, n_cited, refs, status) of drafts (source, local id, citations, refers_to): stable ids, resolved citations and references.

    A reference to a local id becomes the id that this draft got; one that leads nowhere, or a citation of a segment
    that is not there, makes the draft rejected.
    """
    ids = drafts.select(source, local, X.content_id(F.lit("artifact"), F.concat_ws("/", F.col(source).cast("string"), F.col(local).cast("string"))).alias("artifact_id"), "citations", "refers_to")
    cited = ids.select(source, local, F.explode("citations").alias("segment")).join(segments.select(source, "segment").distinct().withColumn("_there", F.lit(1)), [source, "segment"], "left")
    found = cited.groupBy(source, local).agg(F.count("*").alias("n_cited"), F.count_if(F.col("_there").isNull()).alias("_lost"))
    names = ids.select(source, F.col(local).alias("_to"), F.col("artifact_id").alias("_ref"))
    refs = ids.select(source, local, F.explode("refers_to").alias("_to")).join(names, [source, "_to"], "left")
    resolved = refs.groupBy(source, local).agg(F.array_join(F.array_sort(F.collect_set("_ref")), ",").alias("refs"), F.count_if(F.col("_ref").isNull()).alias("_dead"))
    rows = ids.join(found, [source, local], "left").join(resolved, [source, local], "left").na.fill(0, ["n_cited", "_lost", "_dead"]).na.fill("", ["refs"])
    status = F.when((F.col("_lost") > 0) | (F.col("_dead") > 0), "rejected").when(F.col("n_cited") == 0, "uncited").otherwise("extracted")
    return rows.select(source, "artifact_id", "n_cited", "refs", status.alias("status"))


def promotion_sections(events: DataFrame, key: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(key, section, n, summaries): the events of each section in order as one digest of their typed summaries; others take no part."""
    section, summary = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (keep, say) in rules.items():
        section, summary = F.coalesce(section, F.when(keep, name)), F.coalesce(summary, F.when(keep, say))
    rows = events.select(key, "seq", section.alias("section"), summary.alias("summary")).where("section is not null")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "summary"))), lambda x: x["summary"])
    return rows.groupBy(key, "section").agg(F.count("*").alias("n"), F.sha2(F.array_join(listed, "\n"), 256).alias("summaries"))  # bounded by a journal's contract


def draft_material(rows: DataFrame, assigned: list[str]) -> Column:
    """Canonical JSON of a row without the columns that identity assigns to it: equal drafts give equal text."""
    return X.canonical_json(*[c for c in rows.columns if c not in assigned])


def public_summary(journals: DataFrame, key: str, at: str) -> DataFrame:
    """(key, n_events, first_at, last_at, last_type): what may be shown of a journal; payloads are not read."""
    return journals.groupBy(key).agg(F.count("*").alias("n_events"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.max_by("type", "seq").alias("last_type"))


def archive_page(spark: SparkSession, path: str, after: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(header, page) of a JSON-lines archive: its first line is the envelope, entries follow in order of their ids.

    The page holds the first ``limit`` (at most 256) entries behind ``after``.
    """
    if not 0 < limit <= 256:
        raise ValueError("limit must lie in 1..256")
    lines = spark.read.text(path).select("value", F.get_json_object("value", "$.entry_id").alias("entry_id"), F.get_json_object("value", "$.header").alias("header"))
    return lines.where("header is not null").select("header"), lines.where((F.col("entry_id") > after)).orderBy("entry_id").limit(limit).select("entry_id", "value")


def verified_slice(spark: SparkSession, path: str, digests: DataFrame, offset: int, limit: int) -> DataFrame:
    """(path, data, state) of a byte range of each blob: verified if the whole blob has the digest that it is known by, corrupt or unknown else."""
    if not 0 < limit <= 65_536:
        raise ValueError("limit must lie in 1..65536")
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("now"), F.substring("content", F.lit(offset + 1), F.lit(limit)).alias("data"))
    rows = files.join(digests.select("name", "sha256"), "name", "left")
    state = F.when(F.col("sha256").isNull(), "unknown").when(F.col("sha256") == F.col("now"), "verified").otherwise("corrupt")
    return rows.select("name", F.when(state == "verified", F.col("data")).alias("data"), state.alias("state"))


def visible_snippets(hits: DataFrame, docs: DataFrame, terms: DataFrame, window: int = 12) -> DataFrame:
    """(query_id, doc_id, n_marked, snippet_key): the words around each hit's first match, matched terms in brackets.

    Only documents that were hit are cut into words; ``hits`` are read once, since a search stands behind them.
    """
    wanted = terms.groupBy("query_id").agg(F.collect_set("term").alias("wanted"))
    rows = docs.select("doc_id", "text").join(hits, "doc_id").withColumn("ts", X.tokens(F.col("text"))).join(wanted, "query_id")
    start = F.greatest(F.lit(1), F.col("first_place") - window // 2).cast("int")
    cut = F.slice("ts", start, window)
    marked = F.transform(cut, lambda t: F.when(F.array_contains("wanted", t), F.concat(F.lit("["), t, F.lit("]"))).otherwise(t))
    return rows.select("query_id", "doc_id", F.size(F.filter(cut, lambda t: F.array_contains("wanted", t))).cast("long").alias("n_marked"), F.md5(F.array_join(marked, " ")).alias("snippet_key"))
