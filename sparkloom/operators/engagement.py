"""The state that a typed journal adds up to: lifecycle, lanes, calls, closure barriers, reports, promotions.

A journal row has ``engagement_id, sequence, event_id, type, lane, payload`` (JSON). What a type may do in which status is
a table; what an event must cite is a rule of its family. The first event that breaks a rule ends the replay of its
journal: its state stays as it was, with the rule's name and the event's sequence.

Defined results: a journal starts at sequence 1 without gaps; rows that repeat a sequence and event id count once;
a null payload is an empty one; an unknown type is an error; an empty journal has no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, MutableMapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The 64 event types by what they do to a lifecycle, and the effects that each status permits.
EFFECTS = {
    "open": "engagement_opened",
    "recovery": "engagement_resumed",
    "control_plane": "lane_bound lane_unbound session_started session_checkpointed session_finalized control_tool_invoked",
    "new_work": "child_lane_linked objective_changed scope_changed decision_recorded agent_deviation_recorded source_suggested",
    "tool_start": "tool_call_started",
    "tool_terminal": "tool_call_completed tool_call_terminated",
    "bookkeeping": "evidence_attached evidence_capture_failed unmatched_tool_completion unplanned_action recovery_warning uncertain_correlation user_note "
    "report_commit_abandoned promotion_requested promotion_candidate_ready promotion_source_committed promotion_semantic_committed promotion_index_pending "
    "promotion_index_retry_failed case_promoted promotion_attempt_terminated promotion_attempt_cancellation_requested promotion_revocation_requested "
    "case_promotion_revoked case_promotion_superseded",
    "settlement": "observation_extracted hypothesis_formed missing_information_identified outcome_assessed objective_proof_observed interpretation_succeeded "
    "interpretation_failed",
    "planning": "plan_requested frontier_proposed frontier_criticized frontier_repaired frontier_rejected planning_gap_recorded strategy_reconciled "
    "strategy_archived strategy_reactivated research_query_proposed research_source_consulted research_source_assessed",
    "closure_request": "closure_requested",
    "closure_cancel": "closure_cancelled",
    "reopen": "engagement_reopened",
    "abandon": "engagement_abandoned",
    "report": "report_generated",
    "close": "engagement_closed",
    "verify": "engagement_verified",
    "reject": "flag_rejected",
}
PERMITTED = {
    "active": "recovery control_plane new_work tool_start tool_terminal bookkeeping settlement planning closure_request abandon",
    "closing": "recovery control_plane tool_terminal bookkeeping settlement closure_cancel reopen abandon report close",
    "abandoned": "recovery control_plane tool_terminal bookkeeping settlement reopen",
    "closed_unverified": "bookkeeping control_plane settlement reopen report verify reject",
    "closed_verified": "bookkeeping control_plane settlement reopen report verify reject",
}
#: Types that need a lane which is bound just then.
BOUND = "child_lane_linked session_started session_checkpointed session_finalized decision_recorded agent_deviation_recorded tool_call_started control_tool_invoked"
#: Promotion steps: the stages that each may follow, and the stage it leads to.
STEPS = {
    "promotion_candidate_ready": ("requested", "candidate_ready"),
    "promotion_source_committed": ("candidate_ready", "source_committed"),
    "promotion_semantic_committed": ("source_committed", "semantic_committed"),
    "promotion_index_pending": ("semantic_committed", "index_pending"),
    "promotion_index_retry_failed": ("index_pending retry_failed", "retry_failed"),
    "case_promoted": ("index_pending retry_failed", "promoted"),
    "promotion_attempt_terminated": ("requested candidate_ready source_committed semantic_committed index_pending retry_failed cancellation_requested revocation_requested", "terminated"),
}
ENDED = ("promoted", "terminated", "revoked", "superseded")
#: How many promotion attempts a state lists; older ones are a count and a chained digest.
LISTED = 64

EFFECT_OF = {kind: effect for effect, kinds in EFFECTS.items() for kind in kinds.split()}
_PERMITTED = {status: frozenset(effects.split()) for status, effects in PERMITTED.items()}
_BOUND, _STEPS = frozenset(BOUND.split()), {k: (frozenset(a.split()), b) for k, (a, b) in STEPS.items()}

STATE = (
    "status string, revision long, n_lanes long, n_decisions long, in_flight array<string>, closure_ready boolean, n_reports long, active_report long, "
    "promotion_stage string, n_promotions long, n_folded long, folded_sha256 string, error string, error_sequence long"
)
COLUMNS = [c.split()[0] for c in STATE.split(", ")]


class Broken(Exception):
    """An event broke the rule that the exception names."""


def need(holds: bool, rule: str) -> None:
    if not holds:
        raise Broken(rule)


class Engagement:
    """The state of one journal. ``v`` is small and JSON; ``calls`` maps every call ever started to its lane and whether it ended."""

    def __init__(self, v: dict | None = None, calls: MutableMapping[str, tuple[str, bool]] | None = None):
        self.v = v or {"status": None, "revision": 0, "lanes": {}, "open": [], "closure": None, "restart": False, "reports": 0, "pending": None, "active": None, "attempts": [], "n_attempts": 0, "verified_by": None, "ordinal": 0, "lineage": None, "folded": 0, "digest": None, "error": None, "error_at": None}
        self.calls = {} if calls is None else calls

    def apply(self, sequence: int, event_id: str, kind: str, lane: str | None, payload: str | None) -> None:
        v = self.v
        if v["error"]:
            return
        try:
            need(sequence == v["revision"] + 1, "sequence")
            self._enter(kind, lane)
            of = getattr(self, f"_{kind}", None) or (self._promotion if "promot" in kind else None)
            if of is not None:
                of({"sequence": sequence, "event_id": event_id, "type": kind, "lane": lane} | json.loads(payload or "{}"))
            v["revision"] = sequence
        except Broken as broken:
            v["error"], v["error_at"] = str(broken), sequence

    def _enter(self, kind: str, lane: str | None) -> None:
        v = self.v
        need(kind in EFFECT_OF, "unknown_type")
        if v["status"] is None:
            need(kind == "engagement_opened", "not_opened")
            v["status"] = "active"
            return
        need(not v["restart"] or kind == "tool_call_started", "restart_required")
        need(EFFECT_OF[kind] in _PERMITTED[v["status"]], "not_permitted")
        need(kind not in _BOUND or lane in v["lanes"], "lane_not_bound")

    # lanes and calls

    def _lane_bound(self, e: dict) -> None:
        need(e["lane"] is not None, "lane_missing")
        self.v["lanes"].setdefault(e["lane"], None)

    def _lane_unbound(self, e: dict) -> None:
        need(e["lane"] in self.v["lanes"], "lane_not_bound")
        del self.v["lanes"][e["lane"]]

    def _decision_recorded(self, e: dict) -> None:
        self.v["lanes"][e["lane"]] = e.get("decision_id") or e["event_id"]

    def _tool_call_started(self, e: dict) -> None:
        call = e.get("call_id")
        need(call is not None and call not in self.calls, "call_repeated")
        self.calls[call] = (e["lane"], False)
        self.v["open"].append(call)
        self.v["restart"] = False

    def _tool_call_completed(self, e: dict) -> None:
        call = e.get("call_id")
        need(call is not None and call in self.calls, "call_unknown")
        lane, ended = self.calls[call]
        need(not ended, "call_ended")
        need(lane == e["lane"], "call_lane")
        self.calls[call] = (lane, True)
        self.v["open"].remove(call)

    _tool_call_terminated = _tool_call_completed

    # closing, reports, verification

    def _closure_requested(self, e: dict) -> None:
        same = sorted(e.get("in_flight_call_ids") or []) == sorted(self.v["open"])
        need(e.get("terminal_watermark") == e["sequence"] - 1 and same, "closure_snapshot")
        self.v |= {"closure": {"id": e["event_id"], "watermark": e["terminal_watermark"], "calls": sorted(self.v["open"])}, "status": "closing"}

    def _closure_cancelled(self, e: dict) -> None:
        need(self.v["closure"] is not None and self.v["closure"]["id"] == e.get("closure_event_id"), "closure_unknown")
        self.v |= {"closure": None, "status": "active", "restart": True}

    @property
    def closure_ready(self) -> bool | None:
        c = self.v["closure"]
        return None if c is None else not set(c["calls"]) & set(self.v["open"])

    def _report_generated(self, e: dict) -> None:
        v, report = self.v, {"id": e.get("report_id"), "revision": e.get("report_revision")}
        if e.get("generation_reason") == "closure":
            need(v["status"] == "closing" and self.closure_ready is True and e.get("journal_sequence") == v["revision"], "closure_not_ready")
            need(v["pending"] is None and report["revision"] == v["reports"] + 1, "report_revision")
            v["pending"] = report
        else:
            need(v["status"].startswith("closed"), "report_needs_closed")
            need(v["pending"] is None and report["revision"] == v["reports"] + 1, "report_revision")
            v |= {"reports": v["reports"] + 1, "active": report}

    def _engagement_closed(self, e: dict) -> None:
        v = self.v
        cited = {"id": e.get("report_id"), "revision": e.get("report_revision")}
        need(v["pending"] is not None and v["closure"] is not None, "close_needs_report")
        need(v["pending"] == cited and v["closure"]["id"] == e.get("closure_event_id") and v["closure"]["watermark"] == e.get("terminal_watermark"), "close_mismatch")
        v |= {"reports": v["reports"] + 1, "active": cited, "pending": None, "closure": None, "status": "closed_unverified"}

    def _engagement_verified(self, e: dict) -> None:
        need(self.v["status"] == "closed_unverified" and self.v["active"] == {"id": e.get("report_id"), "revision": e.get("report_revision")}, "verify_mismatch")
        self.v["status"] = "closed_verified"

    def _engagement_reopened(self, e: dict) -> None:
        self.v |= {"closure": None, "status": "active", "active": None}

    def _engagement_abandoned(self, e: dict) -> None:
        self.v["status"] = "abandoned"

    # promotions

    def _promotion_requested(self, e: dict) -> None:
        v = self.v
        need(not v["attempts"] or v["attempts"][-1]["stage"] in ENDED, "promotion_active")
        ordinal = v["ordinal"] + 1 if e.get("verification_event_id") == v["verified_by"] else 1
        need(e.get("attempt_ordinal") == ordinal and e.get("promotion_revision") == v["n_attempts"] + 1, "promotion_ordinal")
        v["attempts"].append({"id": e.get("attempt_id"), "revision": e["promotion_revision"], "verified_by": e.get("verification_event_id"), "stage": "requested", "source": None, "cases": [], "retries": 0})
        v |= {"n_attempts": v["n_attempts"] + 1, "verified_by": e.get("verification_event_id"), "ordinal": ordinal}

    def _promotion(self, e: dict) -> None:
        """A step of the active attempt."""
        need(bool(self.v["attempts"]), "promotion_missing")
        a, kind = self.v["attempts"][-1], e["type"]
        need(a["stage"] not in ENDED and a["id"] == e.get("attempt_id") and a["revision"] == e.get("promotion_revision"), "promotion_mismatch")
        if kind == "promotion_attempt_cancellation_requested":
            need(a["stage"] == e.get("stage") and a["verified_by"] == e.get("verification_event_id"), "promotion_stage")
            a["stage"] = "cancellation_requested"
            return
        after, stage = _STEPS[kind]
        need(a["stage"] in after, "promotion_order")
        if kind == "promotion_source_committed":
            a["source"] = e.get("source_id")
        elif kind in ("promotion_semantic_committed", "promotion_index_pending", "case_promoted"):
            need(a["source"] == e.get("source_id"), "promotion_source")
        elif kind == "promotion_index_retry_failed":
            need(e.get("retry_count") == a["retries"] + 1, "promotion_retry")
            a["retries"] += 1
        a["stage"] = stage
        if kind == "case_promoted":
            a["cases"] = e.get("case_ids") or []
            self.v["lineage"] = {k: a[k] for k in ("id", "revision", "source", "cases")}
        if stage in ENDED:
            self._fold()

    def _promotion_revocation_requested(self, e: dict) -> None:
        need(bool(self.v["attempts"]), "promotion_missing")
        a, line = self.v["attempts"][-1], self.v["lineage"]
        cited = (e.get("attempt_id"), e.get("source_id"), e.get("promoted_case_ids") or [])
        need(a["stage"] == "promoted" and line is not None and cited == (a["id"], a["source"], a["cases"]) == (line["id"], line["source"], line["cases"]), "revocation_mismatch")
        self.v["attempts"].append(a | {"stage": "revocation_requested"})

    def _case_promotion_revoked(self, e: dict) -> None:
        need(bool(self.v["attempts"]), "promotion_missing")
        a = self.v["attempts"][-1]
        need(a["stage"] == "revocation_requested" and (a["id"], a["source"], a["cases"]) == (e.get("attempt_id"), e.get("source_id"), e.get("removed_case_ids") or []), "revocation_mismatch")
        a["stage"] = "revoked"
        self._fold()

    def _case_promotion_superseded(self, e: dict) -> None:
        need(bool(self.v["attempts"]), "promotion_missing")
        new, cases = self.v["attempts"][-1], e.get("removed_case_ids") or []
        old = next((a for a in reversed(self.v["attempts"][:-1]) if a["id"] == e.get("prior_attempt_id")), None)
        prior = old or self.v["lineage"] or {}
        same = prior.get("id") == e.get("prior_attempt_id") and prior.get("source") == e.get("source_id") == new["source"] and prior.get("cases") == cases
        need(same and new["id"] == e.get("replacement_attempt_id") and new["stage"] in ("index_pending", "retry_failed") and new["revision"] > prior["revision"] and (old is None or old["stage"] in ("promoted", "revoked")), "supersession_mismatch")
        if old is not None:
            old["stage"] = "superseded"

    def _fold(self) -> None:
        v = self.v
        if len(v["attempts"]) > LISTED:
            gone = json.dumps(v["attempts"].pop(0), sort_keys=True, separators=(",", ":"))
            v |= {"digest": hashlib.sha256(f"{v['digest'] or ''}\0{gone}".encode()).hexdigest(), "folded": v["folded"] + 1}

    def row(self) -> tuple:
        v = self.v
        error, at = (v["error"], v["error_at"]) if v["error"] or not v["restart"] else ("restart_required", v["revision"])
        stage = v["attempts"][-1]["stage"] if v["attempts"] else None
        return (
            v["status"], v["revision"], len(v["lanes"]), sum(d is not None for d in v["lanes"].values()), sorted(v["open"]), self.closure_ready, v["reports"],
            v["active"] and v["active"]["revision"], stage, v["n_attempts"], v["folded"], v["digest"], error, at,
        )


EVENT = ["sequence", "event_id", "type", "lane", "payload"]


def states(events: DataFrame, key: str = "engagement_id") -> DataFrame:
    """One row for each journal: its state after its last event (columns ``STATE``).

    Journals are sorted and folded as they stream by; no journal is held whole, however long it is.
    """
    kind = events.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, now, last = None, None, None
        for pdf in parts:
            out = []
            for k, *event in pdf[[key, *EVENT]].itertuples(index=False, name=None):
                if now is None or k != at:
                    if now is not None:
                        out.append((at, *now.row()))
                    at, now, last = k, Engagement(), None
                event = [None if isinstance(x, float) and x != x else x for x in event]
                if (event[0], event[1]) != last:
                    now.apply(*event)
                last = (event[0], event[1])
            yield pd.DataFrame(out, columns=[key, *COLUMNS]).astype({"active_report": "Int64", "error_sequence": "Int64"})
        if now is not None:
            yield pd.DataFrame([(at, *now.row())], columns=[key, *COLUMNS]).astype({"active_report": "Int64", "error_sequence": "Int64"})

    rows = events.select(key, *EVENT).where(F.col(key).isNotNull())
    return rows.repartition(key).sortWithinPartitions(key, "sequence", "event_id").mapInPandas(run, f"{key} {kind}, {STATE}")
