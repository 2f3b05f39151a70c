"""The registered queries of this package: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_text, lexical, licenses, ngram_join, quality, simhash, token_counts, token_store, topk, toxicity, yinyang
from .common import shared_dir, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "token-ids")
    token_store.write(table(spark, sf_dir, "documents"), tokenizer_path(), out)
    return token_store.digests(token_store.read(spark, out))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.predictions(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.corpus_totals(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predictions(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranking(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similar(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.cluster(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_text, op2_bpe, op3_token_store, op4_quality, op5_decontamination, op6_topk, op7_token_counts, op8_licenses, op9_simhash, op10_toxicity, op11_lexical, op12_ngram_join, op13_centroids)
}
ORACLES: dict[str, str] = {"op6_topk": topk.TOPK_SQL, "op11_lexical": lexical.RANKING_SQL, "op13_centroids": yinyang.cluster_sql()}
