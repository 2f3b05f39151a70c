"""Retrieval from end to end for many queries at once: gate, search in four lanes, applicability, score, diversity, typed gaps.

``retrieve`` returns three frames. ``hits``: what qualified. ``gaps``: for every other query the reason why it has nothing,
told before the search (target, authorization) or after it. ``rejected``: candidates that were found but did not qualify.

Queries that the gate turns away reach neither the corpus nor the facets. Candidates are bounded per query and lane before
applicability looks at any facet, so its work grows with queries times candidates, not with the corpus.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import retrieval as R
from .planner import cut

# Gap codes, and which of them research may close.
GAPS = {"invalid_target": False, "unauthorized_scope": False, "retrieval_unavailable": False, "no_applicable_knowledge": True}
CANDIDATES, HITS = 32, 5


class Result(NamedTuple):
    hits: DataFrame
    gaps: DataFrame
    rejected: DataFrame


def gate(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries that may search, (query_id, gap) of the others) from (query_id, target, authorization, text)."""
    valid = X.target_kind(F.col("target")) != "invalid"
    gap = F.when(~valid, "invalid_target").when(~F.col("authorization").eqNullSafe("authorized"), "unauthorized_scope")
    rows = queries.withColumn("gap", gap)
    return rows.where("gap is null").drop("gap"), rows.where("gap is not null").select("query_id", "gap")


def candidates(scored: DataFrame, facts: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """(query_id, doc_id, rank_value, relevance and the columns of ``facts``): the best of each lane, relative to the lane's best."""
    rows = scored.join(facts.where("lane is not null"), "doc_id")
    return R.relevance(R.top_k(rows, most, ["query_id", "lane"], [F.col("rank_value"), F.col("doc_id")]).drop("rank"), ["query_id", "lane"])


def judged(found: DataFrame, fits: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """``found`` with total and reason (null: it qualifies). ``fits`` is what ``applicability`` says; without facets a candidate fits neutrally."""
    rows = found.join(fits.withColumnRenamed("artifact_id", "doc_id"), ["query_id", "doc_id"], "left")
    barred = F.when(F.col("status") == "rejected", "rejected_status").when(F.coalesce("rejected", F.lit(False)), "incompatible")
    rows = rows.withColumn("barred", barred)
    # how often an independence group stands in a lane counts only what may qualify
    often = rows.where("barred is null").groupBy("query_id", "lane", "group_key").agg(F.count("*").alias("freq"))
    rows = rows.join(often, ["query_id", "lane", "group_key"], "left")
    total = X.total_score(
        F.col("relevance"), F.coalesce("coverage", F.lit(1.0)), F.coalesce("similarity", F.lit(0.5)), F.col("verification"), F.col("fresh"),
        X.source_diversity(F.col("support"), F.col("against"), F.coalesce("freq", F.lit(1))), F.coalesce("penalty", F.lit(0.0)),
    )
    least = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])[F.col("lane")]
    rows = rows.withColumn("total", F.when(F.col("barred").isNull(), total))
    return rows.withColumn("reason", F.coalesce("barred", F.when(F.col("total") < least, "below_threshold"))).withColumn("n_missing", F.coalesce("n_missing", F.lit(0).cast("long")))


def retrieve(queries: DataFrame, docs: DataFrame, facts: DataFrame, facets: DataFrame, live: DataFrame, services: DataFrame | None = None, thresholds: dict[str, float] | None = None, most: int = CANDIDATES, k: int = HITS, available: bool = True) -> Result:
    """Hits (query_id, lane, doc_id, total, n_missing, rank), gaps (query_id, gap, research, n_missing), rejected (query_id, lane, doc_id, reason).

    ``queries`` (query_id, text, target, authorization); ``docs`` (doc_id, text); ``facts`` (doc_id, lane, status, verification,
    fresh, support, against, group_key); ``facets``, ``live`` and ``services`` as ``applicability`` reads them. With the index not
    ``available`` every query that may search has that for its gap.
    """
    asked, gaps = gate(queries)
    if available:
        scored, parts = R.search(docs, asked, query_id="query_id", query_text="text")
        found = cut(candidates(scored, facts.repartition(parts, "doc_id"), most))  # four frames read it, and a search over the corpus stands behind it
        pairs = found.select("query_id", F.col("doc_id").alias("artifact_id"))
        rows = judged(found, R.applicability(facets, live, pairs, services), thresholds or X.LANE_THRESHOLD)
        good = rows.where("reason is null")
        hits = R.diversified(good.select("query_id", "lane", "doc_id", "group_key", "total", "n_missing"), k, ["query_id", "lane"]).drop("group_key")
        rejected = rows.where("reason is not null").select("query_id", "lane", "doc_id", "reason")
        open_ = rows.groupBy("query_id").agg(F.count_if(F.col("reason").isNull()).alias("n_good"), F.sum(F.when(F.col("barred").isNull(), F.col("n_missing")).otherwise(0)).alias("n_missing"))
        late = asked.join(open_, "query_id", "left").where(F.coalesce("n_good", F.lit(0)) == 0).select("query_id", F.lit("no_applicable_knowledge").alias("gap"), F.coalesce("n_missing", F.lit(0)).cast("long").alias("n_missing"))
    else:
        empty = asked.select("query_id", F.lit("").alias("lane")).limit(0)
        doc = docs.select(F.col("doc_id")).limit(0)
        hits = empty.crossJoin(doc).select("query_id", "lane", "doc_id", F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n_missing"), F.lit(0).cast("long").alias("rank"))
        rejected = empty.crossJoin(doc).select("query_id", "lane", "doc_id", F.lit("").alias("reason"))
        late = asked.select("query_id", F.lit("retrieval_unavailable").alias("gap"), F.lit(0).cast("long").alias("n_missing"))
    every = gaps.withColumn("n_missing", F.lit(0).cast("long")).unionByName(late)
    research = F.create_map(*[F.lit(x) for pair in GAPS.items() for x in pair])[F.col("gap")]
    return Result(hits, every.select("query_id", "gap", research.alias("research"), "n_missing"), rejected)
