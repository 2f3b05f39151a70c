"""The deterministic parts of a planner pass: proposals checked and reconciled, cold strategies archived and reactivated to a fixpoint.

A ledger is (engagement_id, strategy_id, status, score). What is known of an engagement are ``known`` rows
(engagement_id, class, subject, value): facts, facets, access, secrets, outcomes. Proposals come from outside.

Defined results: predicates of an unknown kind never hold; a null subject or value matches nothing; rows that repeat a
strategy are the repository's fault and are told by ``reconciliation_errors``; an empty ledger stays empty.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which classes of knowledge answer a predicate kind, hot statuses, what operations lead to, and the bound of one pass.
ANSWERS = {"fact_present": ("fact", "facet"), "prerequisite_satisfied": ("fact", "facet", "access"), "credential_available": ("secret",)}
HOT = ("available", "deferred")
LEADS = {"complete": ("completed",), "block": ("blocked",), "archive": ("archived",), "reactivate": HOT, "keep": ("available", "deferred", "completed", "blocked")}
MOST_REACTIVATED, ROUNDS = 16, 64


def told(predicates: DataFrame, known: DataFrame) -> DataFrame:
    """(engagement_id, strategy_id, predicate_id) of the predicates that a row of ``known`` answers; a row answers alone, so parts of ``known`` may be asked apart."""
    key = ["engagement_id", "strategy_id", "predicate_id"]
    asks = F.lit(None).cast("array<string>")
    for kind, classes in ANSWERS.items():
        asks = F.when(F.col("kind") == kind, F.array(*map(F.lit, classes))).otherwise(asks)
    asks = F.when(F.col("kind") == "fact_changed", F.array(F.lit("facet"))).when(F.col("kind") == "evidence_category_present", F.array(F.lit("outcome"))).otherwise(asks)
    wanted = F.when(F.col("kind") == "evidence_category_present", F.col("expected")).otherwise(F.col("subject"))
    each = predicates.select(*key, "kind", "expected", wanted.alias("wanted"), F.explode(asks).alias("class"))
    found = each.join(known.select("engagement_id", "class", F.col("subject").alias("wanted"), "value"), ["engagement_id", "class", "wanted"])
    same = F.coalesce(F.sha2(F.col("value"), 256) == F.col("expected"), F.lit(True))
    return found.where((F.col("kind") != "fact_changed") | ~same).select(*key)


def satisfied(predicates: DataFrame, known: DataFrame, revisions: DataFrame) -> DataFrame:
    """(engagement_id, strategy_id, predicate_id) of the predicates (… kind, subject, expected) that hold now.

    A predicate of the first three kinds asks for a subject, ``fact_changed`` for a facet whose value has another digest
    than expected, ``evidence_category_present`` for an outcome, ``state_revision_after`` for a later material revision.
    """
    key = ["engagement_id", "strategy_id", "predicate_id"]
    after = predicates.where("kind = 'state_revision_after'").join(revisions, "engagement_id").where(F.col("material_revision") > F.col("expected").cast("long")).select(*key)
    return told(predicates, known).unionByName(after).distinct()


def reactivations(ledger: DataFrame, holds: DataFrame, most: int = MOST_REACTIVATED) -> DataFrame:
    """(engagement_id, strategy_id): archived strategies with a predicate that holds, at most ``most`` of an engagement by id."""
    found = ledger.where("status = 'archived'").join(holds.select("engagement_id", "strategy_id").distinct(), ["engagement_id", "strategy_id"], "left_semi")
    place = F.row_number().over(Window.partitionBy("engagement_id").orderBy(F.col("strategy_id").cast("string")))
    return found.withColumn("_n", place).where(F.col("_n") <= most).select("engagement_id", "strategy_id")


def reconciliation_errors(ledger: DataFrame, operations: DataFrame) -> DataFrame:
    """(engagement_id, strategy_id, error) of operations (… operation, status, ordinal, n_items) that may not be applied to the ledger."""
    key = ["engagement_id", "strategy_id"]
    sizes = operations.groupBy("engagement_id").agg(F.count("*").alias("have"), F.max("n_items").alias("said"), F.count_distinct("ordinal").alias("places"), F.max("ordinal").alias("last"))
    whole = (F.col("have") == F.col("said")) & (F.col("places") == F.col("said")) & (F.col("last") == F.col("said"))
    torn = sizes.where(~whole).select("engagement_id", F.lit(None).cast(ledger.schema["strategy_id"].dataType).alias("strategy_id"), F.lit("incomplete_batch").alias("error"))
    twice = operations.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit("repeated_strategy").alias("error"))
    asked = operations.select("engagement_id").distinct()
    left = ledger.where(F.col("status").isin(*HOT)).join(asked, "engagement_id", "left_semi").join(operations.select(*key), key, "left_anti").select(*key, F.lit("hot_entry_omitted").alias("error"))
    cold = operations.where("operation = 'reactivate'").join(ledger.where("status = 'archived'").select(*key), key, "left_anti").select(*key, F.lit("reactivates_nothing_archived").alias("error"))
    fits = F.lit(False)
    for operation, statuses in LEADS.items():
        fits = F.when(F.col("operation") == operation, F.col("status").isin(*statuses)).otherwise(fits)
    wrong = operations.where(~F.coalesce(fits, F.lit(False)) & ~F.col("operation").isin("add")).select(*key, F.lit("status_mismatch").alias("error"))
    known = operations.where("operation <> 'add'").join(ledger.select(*key), key, "left_anti").select(*key, F.lit("unknown_strategy").alias("error"))
    return torn.unionByName(twice).unionByName(left).unionByName(cold).unionByName(wrong).unionByName(known)


def unexplained_changes(ledger: DataFrame, proposals: DataFrame, least: float = 0.05) -> DataFrame:
    """Proposals (… score, reason) that move a strategy's score by ``least`` or more and give no reason."""
    before = ledger.select("engagement_id", "strategy_id", F.col("score").alias("before"))
    change = F.round(F.abs(F.col("score") - F.col("before")), 6)
    return proposals.join(before, ["engagement_id", "strategy_id"]).where((change >= least) & (F.trim(F.coalesce("reason", F.lit(""))) == "")).select("engagement_id", "strategy_id", "before", "score")


def reconciled(ledger: DataFrame, proposals: DataFrame) -> DataFrame:
    """The ledger after the proposals (engagement_id, strategy_id, status, score): theirs where they speak of a strategy, new ones added."""
    new = proposals.select("engagement_id", "strategy_id", F.struct("status", "score").alias("_new"))
    old = ledger.select("engagement_id", "strategy_id", F.struct("status", "score").alias("_old"))
    row = F.coalesce("_new", "_old")
    return old.join(new, ["engagement_id", "strategy_id"], "full").select("engagement_id", "strategy_id", row["status"].alias("status"), row["score"].alias("score"))


def archived(ledger: DataFrame, floor: float) -> DataFrame:
    """The ledger with what is done, blocked or below the floor in the archive."""
    cold = ~F.col("status").isin(*HOT) | (F.col("score") < floor)
    return ledger.withColumn("status", F.when(cold, "archived").otherwise(F.col("status")))


def cut(df: DataFrame) -> DataFrame:
    """``df`` from the checkpoint folder that the cluster names, so that rounds do not pile up in the plan."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if where is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="sparkloom-"))
    return df.checkpoint()


def settled(ledger: DataFrame, predicates: DataFrame, known: DataFrame, revisions: DataFrame, provides: Callable[[DataFrame], DataFrame], score: Column | None = None, most: int = MOST_REACTIVATED, rounds: int = ROUNDS) -> tuple[DataFrame, int]:
    """(ledger, rounds it took): archived strategies come back while some predicate holds, until a round changes nothing.

    ``provides`` turns the hot part of a ledger into more ``known`` rows, so that what comes back may bring back others.
    A strategy that came back stays, so every round but the last shrinks the archive and the fixpoint is reached.
    """
    ledger, key = cut(ledger), ["engagement_id", "strategy_id"]
    archive = F.col("status").eqNullSafe("archived")
    cold, hot, came = ledger.where(archive), ledger.where(F.col("status").isin(*HOT)), ledger.limit(0)
    # what holds by what is known holds in each round: it is asked once, and rounds ask only the archive's other predicates
    asked = cut(predicates.join(cold, key, "left_semi"))
    holds = cut(satisfied(asked, known, revisions).select(*key).distinct())
    open_ = cut(asked.where("kind <> 'state_revision_after'").join(holds, key, "left_anti"))
    for n in range(1, rounds + 1):
        # a round writes what came back, not the ledger
        rest = cold.join(came, key, "left_anti") if n > 1 else cold
        back = reactivations(rest, holds.unionByName(told(open_, provides(hot.unionByName(came))).select(*key)), most)
        new = cut(rest.join(back, key, "left_semi").withColumns({"status": F.lit("available"), "score": F.col("score") if score is None else score}))
        if new.isEmpty():
            return rest.unionByName(ledger.where(~archive)).unionByName(came), n
        came = came.unionByName(new) if n > 1 else new
    raise RuntimeError(f"no fixpoint within {rounds} rounds")


def planner_pass(ledger: DataFrame, proposals: DataFrame, predicates: DataFrame, known: DataFrame, revisions: DataFrame, provides: Callable[[DataFrame], DataFrame], floor: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(ledger, refused proposals): unexplained score changes are refused, the rest is reconciled, archived and reactivated to a fixpoint."""
    refused = unexplained_changes(ledger, proposals)
    good = proposals.join(refused.select("engagement_id", "strategy_id"), ["engagement_id", "strategy_id"], "left_anti")
    after, _ = settled(archived(reconciled(ledger, good), floor), predicates, known, revisions, provides, score=F.greatest(F.col("score"), F.lit(floor)))
    return after, refused
