"""Lexical retrieval for batches of queries: postings, BM25, phrases, evidence, facets, lanes, scores, diversity.

Everything takes a ``queries`` frame, so thousands of queries share one pass over the corpus. The corpus is reduced
to the terms that the queries ask for before anything is shuffled; statistics (documents, lengths, document
frequencies) always cover the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: What a side may hold at most to be sent to every task.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: What one task of a search may hold: pairs of a query and a document, bytes of text.
TASK_PAIRS, TASK_BYTES = 1 << 19, 32 << 20


def is_small(df: DataFrame) -> bool:
    """Whether a frame is known to hold few rows and few bytes; one bounded job, which stops at the row bound."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8 for c in df.columns), F.lit(8))
    rows, size = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it is known to be small; left to the optimizer otherwise."""
    return F.broadcast(df) if is_small(df) else df


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, term): the distinct terms of each query."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(X.tokens(F.col(text_col)))).alias("term"))


def n_parts(docs: DataFrame, n_docs: int, size: int, n_queries: int) -> int:
    """Parts of a search: as many as its texts and its pairs of query and document need."""
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-n_docs * n_queries // TASK_PAIRS), -(-size // TASK_BYTES))


def dealt(docs: DataFrame, id_col: str, text_col: str, n_docs: int, size: int, n_queries: int) -> DataFrame:
    """(id, text) dealt by document, in parts whose number grows with texts and with pairs of query and document.

    Rows are dealt before they are cut into terms: a text is smaller than its terms, and counts by term and scores by
    query and document then need no shuffle of their own. A task's memory is that of its pairs, which have a bound.
    """
    return docs.select(id_col, text_col).repartition(n_parts(docs, n_docs, size, n_queries), id_col)


def postings(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, term, f, dl) for the wanted terms only; ``docs`` as ``dealt`` gives them."""
    words = docs.select(F.col(id_col).alias("doc_id"), X.tokens(F.col(text_col)).alias("ts"))
    each = words.select("doc_id", F.size("ts").cast("long").alias("dl"), F.explode_outer("ts").alias("term"))  # outer: else a filter on size(ts) makes Spark cut each text again
    wanted = small(terms.select("term").distinct())
    return each.join(wanted, "term", "left_semi").groupBy("doc_id", "term").agg(F.count("*").alias("f"), F.first("dl").alias("dl"))


def corpus_stats(docs: DataFrame, text_col: str) -> tuple[int, float | None, int]:
    """Documents, mean length, bytes of text; tokens are counted where they stand, no list of them is built."""
    mean = F.avg(F.regexp_count(F.lower(F.col(text_col)), F.lit(X.TOKEN)))
    n, avgdl, size = docs.agg(F.count("*"), mean, F.sum(F.octet_length(text_col))).first()
    return n, avgdl, size or 0


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_id, doc_id, rank_value): BM25 of every document that holds a term; lower is better, as in FTS engines."""
    return search(docs, queries, doc_id, doc_text, query_id, query_text)[0]


def search(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "item_id", query_text: str = "text") -> tuple[DataFrame, int]:
    """What ``bm25`` returns, and in how many parts by doc_id it stands: a join by doc_id with a side dealt alike leaves the pairs in place."""
    terms = query_terms(queries, query_id, query_text)
    n, avgdl, size = corpus_stats(docs, doc_text)
    n_queries = queries.count()
    found = postings(dealt(docs, doc_id, doc_text, n, size, n_queries), terms, doc_id, doc_text)
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weighted = df.withColumn("idf", F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))).select(
        "term", F.when(F.col("idf") > 0, F.col("idf")).otherwise(IDF_FLOOR).alias("idf"), F.lit(avgdl).cast("double").alias("avgdl")
    )
    asked = terms.join(weighted, "term")
    asked = F.broadcast(asked) if is_small(terms) else asked  # no more rows than terms, which are counted without the corpus
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = found.join(asked, "term").groupBy("query_id", "doc_id").agg(F.round(-F.sum(part), 6).alias("rank_value"))
    return scored, n_parts(docs, n, size, n_queries)


def top_k(scored: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first ``k`` rows of each group with their rank; the literal bound lets Spark limit groups before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def relevance(hits: DataFrame, by: list[str]) -> DataFrame:
    """Quality relative to the best hit of the group, after the limit."""
    best = F.max(-F.col("rank_value")).over(Window.partitionBy(*by))
    return hits.withColumn("relevance", F.when(best > 0, F.round(-F.col("rank_value") / best, 6)).otherwise(F.lit(0.0)))


def all_terms(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that hold every term, with how often they hold any."""
    ts = X.tokens(F.col(text_col))
    wanted = [t.lower() for t in terms]
    return (
        docs.select(F.col(id_col).alias("doc_id"), ts.alias("ts"))
        .where(F.size(F.array_intersect("ts", F.array(*map(F.lit, wanted)))) == len(set(wanted)))
        .select("doc_id", F.size(F.filter("ts", lambda t: t.isin(*wanted))).cast("long").alias("n_hits"))
    )


def phrases(docs: DataFrame, queries: DataFrame, n: int, doc_id: str = "doc_id", query_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, places): documents that hold the first ``n`` words of a query in a row.

    Runs of ``n`` words are compared by equality: one explode and one hash join, no pairing of positions.
    """
    ts = X.tokens(F.col(text_col))
    wanted = queries.select(F.col(query_id).alias("query_id"), ts.alias("ts")).where(F.size("ts") >= n)
    wanted = small(wanted.select("query_id", F.array_join(F.slice("ts", 1, n), " ").alias("run")))
    runs = docs.select(F.col(doc_id).alias("doc_id"), ts.alias("ts"))
    # not a filter and an inner explode: each would make Spark cut every text once more
    grams = F.when(F.size("ts") >= n, F.transform(F.sequence(F.lit(1), F.size("ts") - (n - 1)), lambda i: F.array_join(F.slice("ts", i, n), " ")))
    return runs.select("doc_id", F.explode_outer(grams).alias("run")).join(wanted, "run").groupBy("query_id", "doc_id").agg(F.count("*").alias("places"))


def evidence(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", query_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, n_terms, first_place): how many query terms a document holds and where the first stands (from 1)."""
    terms = small(query_terms(queries, query_id, text_col))
    wanted = small(terms.select("term").distinct())
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    texts = dealt(docs, doc_id, text_col, n, size, queries.count())
    places = texts.select(F.col(doc_id).alias("doc_id"), F.posexplode_outer(X.tokens(F.col(text_col))).alias("pos", "term"))
    # terms that nobody asked for go before anything is grouped
    first = places.join(wanted, "term", "left_semi").groupBy("doc_id", "term").agg(F.min("pos").alias("pos"))
    return first.join(terms, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("n_terms"), (F.min("pos") + 1).cast("long").alias("first_place"))


def facet_division(rows: DataFrame, wanted: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """Ids that carry every wanted facet: relational division by a count of distinct matches."""
    need = wanted.select(*keys).distinct()
    n = need.agg(F.count("*").alias("need"))
    have = rows.join(small(need), keys, "left_semi").groupBy(id_col).agg(F.count_distinct(*[F.col(k) for k in keys]).alias("have"))
    return have.join(F.broadcast(n), F.col("have") == F.col("need")).select(id_col)


def live_facets(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """Facts and query facets by (namespace, key, value), the highest confidence each; values normalised on both sides."""
    both = facts.unionByName(asked).withColumn("value", X.normalise_text(F.col("value")))
    return both.groupBy("query_id", "namespace", "key", "value").agg(F.max("confidence").alias("confidence"))


# What stands for "not known", dimensions that have one value at a time, and those of them that exclude.
UNKNOWN_VALUES = ("", "unknown", "unspecified", "not established")
SINGLETONS = ("cpu_architecture", "execution_environment", "identity_context", "initial_access", "network_position", "observation_date", "os_family", "os_version", "system_role")
HARD = ("cpu_architecture", "execution_environment", "identity_context", "os_family")


def applicability(facets: DataFrame, live: DataFrame, candidates: DataFrame, services: DataFrame | None = None, least: float = 0.75) -> DataFrame:
    """(query_id, artifact_id, rejected, coverage, similarity, penalty, n_matched, n_missing) from the facets of artifacts.

    ``facets``: (artifact_id, namespace, key, value, relation, confidence); ``live``: (query_id, namespace, key,
    value, confidence); ``candidates``: (query_id, artifact_id), what a search found for each query, so that no query
    meets artifacts that it did not find; ``services``: (query_id, service) that the situation observed. Each facet of an artifact meets the known values of its own dimension in one equi-join,
    then a ladder of conditions gives its weights; sums by artifact follow. Nothing is compared across dimensions.
    """
    known = (
        live.withColumn("v", X.normalise_text(F.col("value")))
        .where((F.col("confidence") >= least) & ~F.col("v").isin(*UNKNOWN_VALUES))
        .groupBy("query_id", "namespace", "key")
        .agg(F.collect_set("v").alias("values"))
    )
    seen = services if services is not None else live.select("query_id", F.lit(None).cast("string").alias("service"))
    service = seen.groupBy("query_id").agg(F.collect_set(F.concat(F.lit("services."), X.normalise_text(F.col("service")))).alias("services"))
    f = facets.withColumn("value", X.normalise_text(F.col("value"))).withColumn("w", F.greatest(F.lit(0.05), F.col("confidence")))
    rows = (
        f.join(candidates.select("query_id", "artifact_id").distinct(), "artifact_id")
        .join(small(known), ["query_id", "namespace", "key"], "left")
        .join(small(service), "query_id", "left")
    )
    rel, w = F.col("relation"), F.col("w")
    some = F.coalesce(F.size("values"), F.lit(0)) > 0
    exact = some & F.array_contains("values", F.col("value"))
    single, hard = (F.col("namespace") == "typed") & F.col("key").isin(*SINGLETONS), (F.col("namespace") == "typed") & F.col("key").isin(*HARD)
    positive = rel.isin("observed", "compatible")
    soft = F.col("key").startswith("services.") & F.coalesce(F.array_contains("services", F.col("key")), F.lit(False))
    rule = (
        F.when(F.col("value").isin(*UNKNOWN_VALUES) | (rel == "unknown"), 1)
        .when(single & (F.coalesce(F.size("values"), F.lit(0)) > 1), 2)
        .when((rel == "incompatible") & exact, 3)
        .when((rel == "incompatible") & ~some, 4)
        .when((rel == "required") & exact, 5)
        .when((rel == "required") & some, 6)
        .when(rel == "required", 7)
        .when(positive & exact, 8)
        .when((rel == "observed") & hard & some, 9)
        .when(positive & some, 10)
        .when(positive & soft, 11)
        .when((rel == "observed") & hard, 12)
        .otherwise(13)
    )
    rows = rows.withColumn("rule", rule)
    r = F.col("rule")

    def total(*parts: tuple[Column, Column]) -> Column:
        return F.sum(sum((F.when(c, x).otherwise(0.0) for c, x in parts), F.lit(0.0)))

    zero = F.lit(0.0)
    required = total((r.isin(5, 6, 7) | ((r == 2) & (rel == "required")), w))
    similar = total((r.isin(5, 6, 7, 8, 9, 10, 11, 12) | ((r == 2) & rel.isin("required", "observed", "compatible")), w))
    matched_required = total((r == 5, w))
    matched_similar = total((r.isin(5, 8), w), (r == 11, 0.75 * w))
    unknown = total((r.isin(1, 2, 4, 7, 12), w))
    sums = rows.groupBy("query_id", "artifact_id").agg(
        F.max(r.isin(3, 6, 9)).alias("rejected"),
        required.alias("req"), similar.alias("sim"), matched_required.alias("mreq"), matched_similar.alias("msim"), unknown.alias("unk"),
        F.count_if(r.isin(5, 8, 11)).alias("n_matched"), F.count_if(r.isin(1, 2, 4, 7, 12)).alias("n_missing"),
    )
    return sums.select(
        "query_id", "artifact_id", "rejected",
        X.unit(F.when(F.col("req") == zero, 1.0).otherwise(F.col("mreq") / F.col("req"))).alias("coverage"),
        X.unit(F.when(F.col("sim") == zero, 0.5).otherwise(F.col("msim") / F.col("sim"))).alias("similarity"),
        F.round(F.least(F.lit(0.1), 0.1 * F.col("unk") / F.greatest(F.lit(1.0), F.col("req") + F.col("sim") + F.col("unk"))), 6).alias("penalty"),
        "n_matched", "n_missing",
    )


def lane_hits(scored: DataFrame, facts: DataFrame, total: Column, thresholds: dict[str, float], candidates: int = 32, k: int = 5) -> DataFrame:
    """(query_id, lane, doc_id, total, rank): retrieval over all lanes at once.

    ``scored`` (query_id, doc_id, rank_value); ``facts`` (doc_id, lane, status and what ``total`` reads). Rejected
    artifacts and ones without a lane take no part; each lane ranks its own candidates, relative to its own best, and
    keeps hits that reach its threshold.
    """
    rows = scored.join(facts.where("lane is not null and status <> 'rejected'"), "doc_id")
    near = relevance(top_k(rows, candidates, ["query_id", "lane"], [F.col("rank_value"), F.col("doc_id")]).drop("rank"), ["query_id", "lane"])
    least = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])[F.col("lane")]
    good = near.withColumn("total", total).where(F.col("total") >= least)
    return top_k(good, k, ["query_id", "lane"], [F.desc("total"), F.col("doc_id")]).select("query_id", "lane", "doc_id", "total", "rank")


def diversified(hits: DataFrame, k: int, by: list[str], group: str = "group_key", score: str = "total", id_col: str = "doc_id") -> DataFrame:
    """``k`` hits by turns over independence groups: the best of each group, then the second of each, and so on."""
    inner = Window.partitionBy(*by, group).orderBy(F.desc(score), id_col)
    led = hits.withColumn("turn", F.row_number().over(inner)).withColumn("lead_score", F.first(score).over(inner)).withColumn("lead_id", F.first(id_col).over(inner))
    led = led.where(F.col("turn") <= k)
    taken = top_k(led, k, by, [F.col("turn"), F.desc("lead_score"), F.col("lead_id"), F.col(group)]).drop("rank")
    return top_k(taken, k, by, [F.desc(score), F.col(id_col)]).drop("turn", "lead_score", "lead_id")


def recall_precision(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall_at_k, precision_at_k): an empty result has precision 0."""
    got = hits.where(F.col("rank") <= k).select("query_id", "doc_id").distinct()
    good = relevant.select("query_id", "doc_id").distinct()
    n_good = good.groupBy("query_id").agg(F.count("*").alias("n_good"))
    n_got = got.groupBy("query_id").agg(F.count("*").alias("n_got"))
    n_both = got.join(good, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("n_both"))
    rows = n_good.join(n_got, "query_id", "left").join(n_both, "query_id", "left").na.fill(0, ["n_got", "n_both"])
    return rows.select(
        "query_id",
        F.round(F.col("n_both") / F.col("n_good"), 6).alias("recall_at_k"),
        F.when(F.col("n_got") == 0, 0.0).otherwise(F.round(F.col("n_both") / F.col("n_got"), 6)).alias("precision_at_k"),
    )
