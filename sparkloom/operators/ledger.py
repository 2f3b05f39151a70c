"""State that journals add up to: sagas, leases, ledgers, frontiers, closures, snapshots.

A rule about neighbours is a window within a journal, "the last one wins" is an aggregate, and a rule about sets is a
join. A journal is bounded by contract; journals are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that one task of a ledger may hold.
TASK_ROWS = 1 << 19


def parts(rows: DataFrame) -> int:
    """How many parts to deal ``rows`` into, so that a task's memory has a bound whatever their number; one counting job."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def _journal(key: str) -> Window:
    return Window.partitionBy(key).orderBy("seq")


def cancelled_closures(events: DataFrame, key: str, request: str, cancel: str, start: str) -> DataFrame:
    """Cancellations of a closure (key, seq, violation): it must have been requested before, and a start must follow at once."""
    w = _journal(key)
    before = F.max(F.when(F.col("type") == request, F.col("seq"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = events.withColumn("_asked", before).withColumn("_next", F.lead("type").over(w)).where(F.col("type") == cancel)
    violation = F.when(F.col("_asked").isNull(), "no_closure").when(F.col("_next").isNull() | (F.col("_next") != start), "no_start_follows")
    return rows.select(key, "seq", violation.alias("violation"))


def saga_violations(events: DataFrame, key: str, steps: list[tuple[str | None, str]], revision: str) -> DataFrame:
    """(key, seq, violation) of saga events: a stage that may not follow the one before, or a revision that falls."""
    w = _journal(key)
    allowed = [f"{a or ''}>{b}" for a, b in steps]
    rows = events.withColumn("_pair", F.concat_ws(">", F.coalesce(F.lag("type").over(w), F.lit("")), "type")).withColumn("_rev", F.lag(revision).over(w))
    violation = F.when(~F.col("_pair").isin(*allowed), "illegal_stage").when(F.col(revision) < F.col("_rev"), "falling_revision")
    return rows.select(key, "seq", violation.alias("violation")).where("violation is not null")


def active_revisions(events: DataFrame, key: str, published: str, revoked: str, revision: str) -> DataFrame:
    """(key, revision, state): every published revision is active, superseded by a later one, or revoked."""
    shown = events.where(F.col("type") == published).groupBy(key, revision).agg(F.max("seq").alias("at"))
    gone = events.where(F.col("type") == revoked).groupBy(key, revision).agg(F.max("seq").alias("gone"))
    rows = shown.join(gone, [key, revision], "left").withColumn("_live", F.col("gone").isNull() | (F.col("gone") < F.col("at")))
    last = rows.where("_live").groupBy(key).agg(F.max_by(revision, "at").alias("_last"))
    state = F.when(~F.col("_live"), "revoked").when(F.col("_last") == F.col(revision), "active").otherwise("superseded")
    return rows.join(last, key, "left").select(key, revision, state.alias("state"))


def ledger(records: DataFrame, batches: DataFrame, key: str, batch: str, entity: str, order: str, hot: Column) -> DataFrame:
    """(key, entity, batch, status, tier): the last record of each entity from complete batches only.

    ``batches`` (key, batch, expected, at) says how many records a batch must have; a batch with fewer or more is not read. ``order``
    decides between records of one entity in one batch. Records are dealt twice, by batch and by entity, in parts of bounded size.
    """
    n = parts(records)
    have = records.repartition(n, key, batch).withColumn("_n", F.count("*").over(Window.partitionBy(key, batch)))
    rows = have.join(batches.select(key, batch, "expected", "at").repartition(n, key, batch), [key, batch]).where(F.col("expected") == F.col("_n"))
    last = rows.select(key, entity, "at", order, "status", "score", batch).repartition(n, key, entity).groupBy(key, entity).agg(F.max(F.struct("at", order, "status", "score", batch)).alias("_m"))
    out = last.select(key, entity, f"_m.{batch}", "_m.status", "_m.score")
    return out.withColumn("tier", F.when(hot, "hot").otherwise("cold"))


def frontier(events: DataFrame, proposals: DataFrame, key: str, batch: str) -> DataFrame:
    """The proposals of the batch that each journal's last accepted critic names, in their order."""
    last = events.where("accepted").groupBy(key).agg(F.max_by(batch, "seq").alias(batch))
    return proposals.join(last, [key, batch], "left_semi")


def call_states(events: DataFrame, key: str, call: str, start: str, terminals: dict[str, str], terminate: str) -> DataFrame:
    """(key, call, state): how a call ended, where an explicit termination holds only if nothing ended it before.

    ``terminals`` maps event types to states. Nothing ends a call by itself: there are no timers.
    """
    begun = events.where(F.col("type") == start).groupBy(key, call).agg(F.min("seq").alias("_from"))
    ends = events.where(F.col("type").isin(*terminals, terminate)).select(key, call, "seq", "type", "reason")
    rows = begun.join(ends, [key, call], "left").where(F.col("seq").isNull() | (F.col("seq") > F.col("_from")))
    first = rows.groupBy(key, call).agg(F.min(F.struct("seq", "type", "reason")).alias("_e"))
    back = begun.select(key, call).join(first, [key, call], "left")  # a call whose every end came before it stays open
    state = F.when(F.col("_e.seq").isNull(), "in_flight").when(F.col("_e.type") == terminate, F.col("_e.reason"))
    for kind, name in terminals.items():
        state = state.when(F.col("_e.type") == kind, name)
    return back.select(key, call, state.alias("state"))


def leases(claims: DataFrame, stages: DataFrame, key: str, minutes: int = 5) -> DataFrame:
    """Stages (key, holder, at) against claims (key, holder, at): held, expired, foreign or unclaimed, by the last claim before."""
    both = claims.select(key, "at", F.col("holder").alias("claimer"), F.lit(None).cast("long").alias("stage"), F.lit(None).cast("string").alias("holder")).unionByName(
        stages.select(key, "at", F.lit(None).cast("string").alias("claimer"), "stage", "holder")
    )
    w = Window.partitionBy(key).orderBy("at", F.col("stage").isNotNull(), "stage").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_claim", F.last(F.when(F.col("claimer").isNotNull(), F.struct("claimer", "at")), True).over(w)).where("stage is not null")
    state = (
        F.when(F.col("_claim").isNull(), "unclaimed")
        .when(F.col("at") >= F.col("_claim.at") + F.make_interval(mins=F.lit(minutes)), "expired")
        .when(F.col("_claim.claimer") != F.col("holder"), "foreign")
        .otherwise("held")
    )
    return seen.select(key, "stage", state.alias("state"))


def closure_states(events: DataFrame, key: str, request: str, start: str, terminal: str, call: str) -> DataFrame:
    """(key, watermark, n_waiting, ready): the last closure request freezes the calls in flight before it; it is ready when all of them ended."""
    asked = events.where(F.col("type") == request).groupBy(key).agg((F.max("seq") - 1).alias("watermark"))
    calls = events.where(F.col("type").isin(start, terminal)).groupBy(key, call).agg(F.min(F.when(F.col("type") == start, F.col("seq"))).alias("_from"), F.max(F.when(F.col("type") == terminal, F.col("seq"))).alias("_to"))
    frozen = asked.join(calls, key, "left").withColumn("_waits", F.coalesce((F.col("_from") <= F.col("watermark")) & (F.col("_to").isNull() | (F.col("_to") < F.col("_from"))), F.lit(False)))
    rows = frozen.groupBy(key, "watermark").agg(F.count_if("_waits").alias("n_waiting"))
    return rows.withColumn("ready", F.col("n_waiting") == 0)


def settled(proofs: DataFrame, closures: DataFrame, key: str) -> DataFrame:
    """(key, outcome): complete needs all proofs and a ready closure, blocked lacks proofs, waiting lacks the closure."""
    rows = proofs.join(closures, key, "full")
    complete, ready = F.coalesce("complete", F.lit(False)), F.coalesce("ready", F.lit(False))
    return rows.select(key, F.when(complete & ready, "complete").when(~complete, "blocked").otherwise("waiting").alias("outcome"))


def snapshot(events: DataFrame, key: str, parts: dict[str, Column]) -> DataFrame:
    """One row for each journal: its revision, and for each part how many events belong to it and the last one's place."""
    sums = [x for name, keep in parts.items() for x in (F.count_if(keep).alias(f"n_{name}"), F.max(F.when(keep, F.col("seq"))).alias(f"last_{name}"))]
    return events.groupBy(key).agg(F.max("seq").alias("revision"), *sums)


def completions_routed(starts: DataFrame, completions: DataFrame, key: str, call: str) -> DataFrame:
    """(key, call, seq, route): a completion closes its open call, repeats one that is closed, comes before its call, or has none."""
    begun = starts.groupBy(key, call).agg(F.min("seq").alias("_from"))
    rows = completions.join(begun, [key, call], "left")
    due = F.col("_from").isNotNull() & (F.col("seq") > F.col("_from"))
    first = F.min(F.when(due, F.col("seq"))).over(Window.partitionBy(key, call))
    route = F.when(F.col("_from").isNull(), "orphan").when(F.col("seq") < F.col("_from"), "early").when(F.col("seq") == F.col("_first"), "complete").otherwise("duplicate")
    return rows.withColumn("_first", first).select(key, call, "seq", route.alias("route"))
