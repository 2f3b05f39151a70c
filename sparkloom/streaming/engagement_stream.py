"""Keyed state over journals as they arrive: the engagement state, and the routing of completions that come late or twice.

Both run ``transformWithStateInPandas`` and need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
Nothing is dropped by a watermark: the only watermark is on the time of arrival, where no row can be late.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, MutableMapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import engagement as E

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Calls(MutableMapping):
    """A map state as a mapping of calls; a call's key is looked up, the others stay where they are."""

    def __init__(self, state):
        self.state = state

    def __getitem__(self, call: str) -> tuple[str, bool]:
        if not self.state.containsKey((call,)):
            raise KeyError(call)
        return tuple(self.state.getValue((call,)))

    def __contains__(self, call) -> bool:
        return self.state.containsKey((call,))

    def __setitem__(self, call: str, value: tuple[str, bool]) -> None:
        self.state.updateValue((call,), value)

    def __delitem__(self, call: str) -> None:
        self.state.removeKey((call,))

    def __iter__(self):
        return (k[0] for k in self.state.keys())

    def __len__(self) -> int:
        return sum(1 for _ in self)


def _plain(x):
    return None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x


class EngagementProcessor(StatefulProcessor):
    """The fold of ``operators.engagement``, kept from batch to batch; events that come before their turn wait in a map state."""

    def __init__(self, key: str, columns: list[str]):
        self.key, self.columns = key, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("engagement", T.StructType([T.StructField("json", T.StringType())]))
        self.calls = _Calls(handle.getMapState("calls", "call string", "lane string, ended boolean"))
        self.waiting = handle.getMapState("waiting", "sequence long", "event_id string, type string, lane string, payload string")

    def _now(self) -> E.Engagement:
        return E.Engagement(json.loads(self.value.get()[0]) if self.value.exists() else None, self.calls)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples():
            self.value.update((row.state,))
            for call, (lane, ended) in json.loads(row.calls).items():
                self.calls[call] = (lane, ended)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self._now()
        fresh = {}
        for pdf in rows:
            for event in pdf[E.EVENT].itertuples(index=False, name=None):
                sequence, *rest = map(_plain, event)
                if sequence > now.v["revision"]:  # what is folded already came again
                    fresh[sequence] = min(fresh.get(sequence, rest), rest, key=str)
        while now.v["error"] is None:
            turn = now.v["revision"] + 1
            if turn in fresh:
                event = fresh.pop(turn)
            elif self.waiting.containsKey((turn,)):
                event = list(self.waiting.getValue((turn,)))
            else:
                break
            if self.waiting.containsKey((turn,)):
                self.waiting.removeKey((turn,))
            now.apply(turn, *event)
        if now.v["error"] is None:
            for sequence, event in fresh.items():
                self.waiting.updateValue((sequence,), tuple(event))
        self.value.update((json.dumps(now.v),))
        if now.v["revision"] or now.v["error"]:
            out = pd.DataFrame([(key[0], *now.row())], columns=self.columns)
            yield out.astype({"active_report": "Int64", "error_sequence": "Int64"})


def engagements(events: DataFrame, key: str = "engagement_id", snapshot: DataFrame | None = None) -> DataFrame:
    """The state of each journal that a batch touched, as ``operators.engagement.states`` gives it for the whole journal.

    ``snapshot`` (key, state, calls; both JSON) is where journals known before start from: see ``snapshots``.
    """
    out = T.StructType([events.schema[key], *T.StructType.fromDDL(E.STATE).fields])
    first = snapshot.groupBy(key) if snapshot is not None else None
    return events.select(key, *E.EVENT).groupBy(key).transformWithStateInPandas(EngagementProcessor(key, [key, *E.COLUMNS]), out, "Update", "None", first)


def snapshots(events: DataFrame, key: str = "engagement_id") -> DataFrame:
    """(key, state, calls) of whole journals in a batch: what a stream can start from."""
    kind = events.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        now = E.Engagement()
        for event in pdf.drop_duplicates(["sequence", "event_id"]).sort_values("sequence", kind="stable")[E.EVENT].itertuples(index=False, name=None):
            now.apply(*map(_plain, event))
        return pd.DataFrame([(pdf[key].iloc[0], json.dumps(now.v), json.dumps(dict(now.calls)))], columns=[key, "state", "calls"])

    return events.select(key, *E.EVENT).groupBy(key).applyInPandas(run, f"{key} {kind}, state string, calls string")


class CompletionRouter(StatefulProcessor):
    """One row for each completion of a call: what it was when it came, or that nothing it could belong to ever came."""

    def __init__(self, columns: list[str], grace: int, wait: int):
        self.columns, self.grace, self.wait = columns, grace, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.call = handle.getValueState("call", "started_at long, due_at long, ended_at long, ended_by string")
        self.early = handle.getMapState("early", "event_id string", "occurred_at long, arrived_at long")
        self.known = handle.getMapState("known", "event_id string", "occurred_at long")

    def _row(self, key, event_id: str, at: int, route: str) -> tuple:
        return (*key, event_id, pd.Timestamp(at, unit="us", tz="UTC"), route)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        call, out, ends, starts = list(self.call.get()) if self.call.exists() else None, [], [], []
        for pdf in rows:
            for kind, event_id, occurred, arrived in pdf[["kind", "event_id", "occurred_at", "arrived_at"]].itertuples(index=False, name=None):
                at = occurred.value // 1000
                if kind == "start":
                    starts.append((arrived.value, at))
                elif self.known.containsKey((event_id,)):
                    out.append(self._row(key, event_id, at, "repeated"))
                else:
                    self.known.updateValue((event_id,), (at,))
                    ends.append((at, event_id, arrived.value // 1000))
        if call is None and starts:
            begun = min(starts)[1]
            call = [begun, begun + self.grace, None, None]
            held = [(v[0], k[0], v[1]) for k, v in self.early.iterator()]  # ends that came before their start
            for _, event_id, _ in held:
                self.early.removeKey((event_id,))
            ends += held
        for at, event_id, arrived in sorted(ends):
            if call is None:
                self.early.updateValue((event_id,), (at, arrived))
                self.handle.registerTimer((arrived + self.wait) // 1000 + 1)
            elif call[3] is not None:
                out.append(self._row(key, event_id, at, "duplicate"))
            else:
                call[2:] = [at, event_id]
                out.append(self._row(key, event_id, at, "late" if at > call[1] else "completed"))
        if call is not None:
            self.call.update(tuple(call))
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs() * 1000, []
        for k, (at, arrived) in sorted((k[0], tuple(v)) for k, v in self.early.iterator()):
            if arrived + self.wait < now:
                out.append(self._row(key, k, at, "unmatched"))
                self.early.removeKey((k,))
        yield pd.DataFrame(out, columns=self.columns)


def routed_completions(events: DataFrame, key: list[str], grace_seconds: int = 3600, wait_seconds: int = 3600) -> DataFrame:
    """(key, event_id, occurred_at, route) for every end among ``events`` (key, kind start/end, event_id, occurred_at, arrived_at).

    The first end of a call in the order of arrival, then of time, is ``completed``, or ``late`` if it lies more than the
    grace behind the start; a later one is a ``duplicate``, the same event once more ``repeated``. An end without its start
    waits: when the start comes it is judged as if just come; when ``wait_seconds`` of arrivals have passed it is
    ``unmatched``. Every row is routed once: the watermark is on the time of arrival (each micro-batch has a later one than
    those before, such as ``current_timestamp()`` gives), so that no row is behind it, however late its event is.
    """
    stream = events.select(*key, "kind", "event_id", "occurred_at", "arrived_at").withWatermark("arrived_at", "0 seconds")
    fields = [events.schema[k] for k in key]
    out = T.StructType([*fields, T.StructField("event_id", T.StringType()), T.StructField("occurred_at", T.TimestampType()), T.StructField("route", T.StringType())])
    router = CompletionRouter(out.names, grace_seconds * 1_000_000, wait_seconds * 1_000_000)
    return stream.groupBy(*key).transformWithStateInPandas(router, out, "Update", "EventTime")


def routed_batch(events: DataFrame, key: list[str], grace_seconds: int = 3600) -> DataFrame:
    """The same routes where all events are there at once and arrivals follow the order of ``arrived_at``."""
    starts = events.where("kind = 'start'").groupBy(*key).agg(F.min_by("occurred_at", F.struct("arrived_at", "occurred_at")).alias("started_at"), F.min("arrived_at").alias("begun"))
    ends = events.where("kind = 'end'").groupBy(*key, "event_id").agg(F.min(F.struct("arrived_at", "occurred_at")).alias("first"), F.count("*").alias("times"))
    rows = ends.join(starts, key, "left")
    # an end is judged when it and its start have come
    order = F.struct(F.greatest("first.arrived_at", "begun").alias("judged"), F.col("first.occurred_at").alias("at"), "event_id")
    won = rows.where("started_at is not null").groupBy(*key).agg(F.min(order)["event_id"].alias("won"))
    late = F.col("first.occurred_at").cast("double") > F.col("started_at").cast("double") + grace_seconds
    route = F.when(F.col("started_at").isNull(), "unmatched").when(F.col("event_id") != F.col("won"), "duplicate").when(late, "late").otherwise("completed")
    judged = rows.join(won, key, "left").withColumn("route", route)
    again = judged.where("times > 1").withColumn("route", F.lit("repeated")).withColumn("n", F.col("times") - 1)
    return judged.withColumn("n", F.lit(1).cast("long")).unionByName(again).select(*key, "event_id", "route", "n")
