"""Event journals: chain checks, sessions, start/terminal pairs, barriers, state folds, reports.

A journal is a frame with a key (engagement), a sequence within the key, a type and a payload. Whatever a window
or a join can say is said so; only true folds (state machines, serial hash chains) run as one function per key.
A key's journal is bounded by contract; keys are many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

#: Which event effects are legal in which state of a journal.
LEGAL = {"open": ("view", "click", "error", "purchase", "signup"), "closing": ("error", "purchase", "signup"), "closed": ("signup",)}
MOVES = {("open", "purchase"): "closing", ("closing", "error"): "closed", ("closed", "signup"): "open", ("closing", "signup"): "open"}


def sequenced(events: DataFrame, key: str, *order: str) -> DataFrame:
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def hashed(events: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Adds ``event_hash`` over the event's own material and ``previous_hash`` of the event before it (null for the first)."""
    rows = events.withColumn("event_hash", X.digest(F.col(key), F.col("seq"), *[F.col(c) for c in payload]))
    return rows.withColumn("previous_hash", F.lag("event_hash").over(Window.partitionBy(key).orderBy("seq")))


def chain_violations(events: DataFrame, key: str, payload: list[str], tie: str = "seq") -> DataFrame:
    """(key, n_events, n_gaps, n_repeats, n_bad_links, n_bad_hashes) of every journal; verification needs no serial pass. ``tie`` orders repeats."""
    w = Window.partitionBy(key).orderBy("seq", tie)
    rows = events.withColumn("n", F.row_number().over(w)).withColumn("p", F.lag("event_hash").over(w)).withColumn("s", F.lag("seq").over(w))
    return rows.groupBy(key).agg(
        F.count("*").alias("n_events"),
        F.count_if(F.coalesce(F.col("seq") - F.col("s"), F.col("seq")) > 1).alias("n_gaps"),
        F.count_if(F.col("seq") == F.col("s")).alias("n_repeats"),
        F.count_if(~F.col("previous_hash").eqNullSafe(F.col("p"))).alias("n_bad_links"),
        F.count_if(F.col("event_hash") != X.digest(F.col(key), F.col("seq"), *[F.col(c) for c in payload])).alias("n_bad_hashes"),
    )


#: What one journal may hold: a contract of the engine, and what makes one function for each key possible.
MOST_EVENTS = 100_000


def over_limit(events: DataFrame, key: str, most: int = MOST_EVENTS) -> DataFrame:
    """(key, n_events) of journals that hold more than the contract allows; counted with partial aggregates."""
    return events.groupBy(key).agg(F.count("*").alias("n_events")).where(F.col("n_events") > most)


# What one append may bring to a journal.
MOST_IN_BATCH, MOST_EVENT_BYTES, MOST_JOURNAL_BYTES = 512, 65_536, 256 << 20


def admitted(existing: DataFrame, drafts: DataFrame, key: str, payload: list[str], expected: DataFrame | None = None, most: int = MOST_EVENTS, batch: int = MOST_IN_BATCH) -> tuple[DataFrame, DataFrame]:
    """(drafts that may be appended, (key, reason) of journals that refuse theirs): all of a journal's drafts or none.

    ``expected`` (key, seq, chain_hash) is the head that the writer has seen: another head is a conflict, an absent one is
    an empty journal. A batch over ``batch`` events, an event over ``MOST_EVENT_BYTES`` or a journal that would pass
    ``most`` events is refused; sizes are counted with partial aggregates, nothing is gathered.
    """
    head = existing.groupBy(key).agg(F.max("seq").alias("_seq"), F.max_by("chain_hash", "seq").alias("_hash"))
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in payload), F.lit(0))
    asked = drafts.groupBy(key).agg(F.count("*").alias("_n"), F.max(size).alias("_bytes")).join(head, key, "left")
    reason = F.when(F.col("_n") > batch, "batch_too_large").when(F.col("_bytes") > MOST_EVENT_BYTES, "event_too_large").when(F.coalesce("_seq", F.lit(0)) + F.col("_n") > most, "over_limit")
    if expected is not None:
        seen = expected.select(key, F.col("seq").alias("_wanted"), F.col("chain_hash").alias("_wanted_hash"))
        asked = asked.join(seen, key, "left")
        same = F.coalesce("_seq", F.lit(0)).eqNullSafe(F.coalesce("_wanted", F.lit(0))) & F.col("_hash").eqNullSafe(F.col("_wanted_hash"))
        reason = F.when(~same, "revision_conflict").otherwise(reason)
    refused = asked.select(key, reason.alias("reason")).where("reason is not null")
    return drafts.join(refused.select(key), key, "left_anti"), refused


def append_events(existing: DataFrame, drafts: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Drafts with their sequence and chain hash behind the existing head of each journal.

    The chain hash takes in the hash before it, so it is serial in a key: rows sorted by journal stream through one pass,
    and no journal is held whole. ``drafts`` holds key, ``draft_no`` (order) and the payload; ``existing`` holds key, seq
    and chain_hash. What may be appended at all is ``admitted``'s to say.
    """
    head = existing.groupBy(key).agg(F.max_by("chain_hash", "seq").alias("head_hash"), F.max("seq").alias("head_seq"))
    rows = drafts.join(head, key, "left").withColumn("material", X.digest(*[F.col(c) for c in payload])).select(key, "draft_no", "material", "head_hash", F.coalesce("head_seq", F.lit(0)).alias("head_seq"))
    kind = drafts.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, seq, last = None, 0, ""
        for pdf in parts:
            out = []
            for k, no, material, head_hash, head_seq in pdf.itertuples(index=False, name=None):
                if at is None or at != (k,):
                    at, seq, last = (k,), int(head_seq), head_hash if isinstance(head_hash, str) else ""
                seq, last = seq + 1, hashlib.sha256(f"{last}|{material}".encode()).hexdigest()
                out.append((k, no, seq, last))
            yield pd.DataFrame(out, columns=[key, "draft_no", "seq", "chain_hash"])

    ordered = rows.repartition(key).sortWithinPartitions(key, "draft_no")
    return ordered.mapInPandas(run, f"{key} {kind}, draft_no long, seq long, chain_hash string")


def marker_sessions(events: DataFrame, key: str, order: list[str], opens: Column, closes: Column) -> DataFrame:
    """Adds ``session`` (0 before the first marker) and ``is_open``: whether no closing marker has come yet in it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("session", F.sum(opens.cast("int")).over(w).cast("long"))
    inner = Window.partitionBy(key, "session").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("is_open", (F.sum(closes.cast("int")).over(inner) == 0) & (F.col("session") > 0))


def pairs(events: DataFrame, key: str, start: str, terminal: str) -> DataFrame:
    """Each start with the first terminal behind it and before the next start of its key; null if none came.

    One window: the next start and the next terminal are looked up in the same order.
    """
    after = Window.partitionBy(key).orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    rows = events.withColumn("next_start", F.min(F.when(F.col("type") == start, F.col("seq"))).over(after)).withColumn("next_end", F.min(F.when(F.col("type") == terminal, F.col("seq"))).over(after))
    done = F.col("next_end").isNotNull() & (F.col("next_start").isNull() | (F.col("next_end") < F.col("next_start")))
    return rows.where(F.col("type") == start).select(key, F.col("seq").alias("start_seq"), F.when(done, F.col("next_end")).alias("end_seq"))


def in_flight(events: DataFrame, key: str, start: str, terminal: str, at: Column) -> DataFrame:
    """(key, watermark, n_in_flight): starts up to the barrier whose terminal has not come by then."""
    return pairs(events, key, start, terminal).join(events.select(key).distinct().select(key, at.alias("watermark")), key).where("start_seq <= watermark").groupBy(key, "watermark").agg(F.count_if(F.col("end_seq").isNull() | (F.col("end_seq") > F.col("watermark"))).alias("n_in_flight"))


def keep_last(events: DataFrame, by: list[str], order: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(the last ``n`` rows of each group, one row for each group that lost some: count and digest over them in order)."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    ranked = events.withColumn("_n", F.row_number().over(w))
    gone = ranked.where(F.col("_n") > n).groupBy(*by).agg(F.count("*").alias("n_evicted"), X.list_digest(F.transform(F.array_sort(F.collect_list(order)), lambda x: x.cast("string"))).alias("digest"))
    return ranked.where(F.col("_n") <= n).drop("_n"), gone


def last_wins(events: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    return events.groupBy(*by).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def previous(events: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Adds the value before and the change."""
    w = Window.partitionBy(*by).orderBy(order)
    return events.withColumn("before", F.lag(value).over(w)).withColumn("change", F.round(F.col(value) - F.lag(value).over(w), 6))


def causality_violations(events: DataFrame, key: str, reference: Column) -> DataFrame:
    """References that do not point to an earlier event of their journal."""
    refs = events.select(key, "seq", reference.alias("ref")).where("ref is not null")
    known = events.select(key, F.col("seq").alias("ref"), F.lit(True).alias("known"))
    return refs.join(known, [key, "ref"], "left").where((F.col("ref") >= F.col("seq")) | F.col("known").isNull()).select(key, "seq", "ref")


def replay(rows: list[tuple[int, str]]) -> tuple[str, int, int, int]:
    """(state, legal events, illegal events, reopenings) of one journal in order: the fold that batch and stream share."""
    return replay_from(("open", 0, 0, 0), rows)


def replay_from(state: tuple[str, int, int, int], rows: list[tuple[int, str]]) -> tuple[str, int, int, int]:
    now, good, bad, again = state
    for _, kind in rows:
        if kind not in LEGAL[now]:
            bad += 1
            continue
        good += 1
        then = MOVES.get((now, kind), now)
        again += now == "closed" and then == "open"
        now = then
    return now, good, bad, again


STATE = "state string, n_legal long, n_illegal long, n_reopened long"


def reduce_state(events: DataFrame, key: str, most: int = MOST_EVENTS) -> DataFrame:
    """The state of each journal by one fold for each key; a journal beyond the contract is not folded, its state says so."""
    kind = events.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        state = replay(list(zip(pdf["seq"], pdf["type"], strict=True)))
        return pd.DataFrame([(pdf[key].iloc[0], *state)], columns=[key, "state", "n_legal", "n_illegal", "n_reopened"])

    long = over_limit(events, key, most)
    refused = long.select(key, F.lit("over_limit").alias("state"), *[F.lit(0).cast("long").alias(n) for n in ("n_legal", "n_illegal", "n_reopened")])
    fits = events.select(key, "seq", "type").join(long.select(key), key, "left_anti")
    return fits.groupBy(key).applyInPandas(run, f"{key} {kind}, {STATE}").unionByName(refused)


def illegal_pairs(events: DataFrame, key: str, allowed: DataFrame) -> DataFrame:
    """Adjacent types that a table of allowed pairs does not hold."""
    w = Window.partitionBy(key).orderBy("seq")
    steps = events.select(key, "seq", F.lag("type").over(w).alias("before"), F.col("type").alias("after")).where("before is not null")
    return steps.join(F.broadcast(allowed), ["before", "after"], "left_anti").select(key, "seq", "before", "after")  # a closed table of types


def bind_lanes(lanes: DataFrame, bindings: DataFrame, session: str, task: str) -> DataFrame:
    """Lane to owner: the exact (session, task) binding, else the only one of its session, else ambiguous or unbound."""
    exact = bindings.groupBy(session, task).agg(F.min("owner").alias("exact_owner"))
    wide = bindings.groupBy(session).agg(F.count_distinct("owner").alias("n_owners"), F.min("owner").alias("only_owner"))
    rows = lanes.join(exact, [session, task], "left").join(wide, session, "left")
    how = F.when(F.col("exact_owner").isNotNull(), "exact").when(F.col("n_owners") == 1, "session").when(F.col("n_owners") > 1, "ambiguous").otherwise("unbound")
    return rows.select(*lanes.columns, how.alias("how"), F.when(how == "exact", F.col("exact_owner")).when(how == "session", F.col("only_owner")).alias("owner"))


def idempotent(drafts: DataFrame, key: str, material: str, order: str) -> DataFrame:
    """(idempotency key, kept, n_same, collides): equal material counts once, different material under one key collides."""
    return drafts.groupBy(key).agg(F.min(order).alias("kept"), F.count("*").alias("n_same"), (F.count_distinct(material) > 1).alias("collides"))


def retry_allowed(attempts: DataFrame, predicates: DataFrame, key: str) -> DataFrame:
    """(key, n_predicates, n_met): typed predicates (kind, value) against the kinds that a key's later events show."""
    seen = attempts.select(key, F.col("type").alias("value")).distinct().withColumn("met", F.lit(1))
    each = predicates.join(seen, [key, "value"], "left")
    return each.groupBy(key).agg(F.count("*").alias("n_predicates"), F.sum(F.when(F.col("kind") == "absent", 1 - F.coalesce("met", F.lit(0))).otherwise(F.coalesce("met", F.lit(0)))).cast("long").alias("n_met"))


def render_lines(events: DataFrame, key: str, text: Column, limit: int) -> DataFrame:
    """(key, n_shown, n_hidden, page_key): a logbook page by key, cut at ``limit`` lines with a count of the rest."""
    w = Window.partitionBy(key).orderBy("seq")
    rows = events.select(key, "seq", text.alias("line"), F.row_number().over(w).alias("n"))
    shown = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= limit, F.struct("seq", "line")))), lambda x: x["line"])
    return rows.groupBy(key).agg(F.count_if(F.col("n") <= limit).alias("n_shown"), F.count_if(F.col("n") > limit).alias("n_hidden"), F.sha2(F.array_join(shown, "\n"), 256).alias("page_key"))
