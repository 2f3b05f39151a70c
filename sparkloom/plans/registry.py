"""All registered queries of the library and their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import importable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Modules that register queries when they are imported.
MODULES = ("retrieval_queries", "text_queries", "integrity_queries", "journal_queries", "relational_queries", "planning_queries", "report_queries", "evidence_queries", "ledger_queries", "notes_queries", "catalog_queries", "markdown_queries", "engagement_queries", "payload_queries", "retrieve_queries", "planner_queries")
_loaded = False


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    global _loaded
    if not _loaded:
        for m in MODULES:
            importlib.import_module(f"sparkloom.plans.{m}")
        _loaded = True


def queries() -> dict[str, Query]:
    load()
    return QUERIES


def oracles() -> dict[str, str]:
    load()
    return ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch retrieval: every benchmark item against the corpus, ranked and diversified."""
    return queries()["q_diversified_hits"](spark, sf_dir)
