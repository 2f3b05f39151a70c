"""Planner passes: the six predicate kinds, reconciliation rules, and a fixpoint that takes several rounds."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import planner as P
from sparkloom.plans.planner_queries import provides

LEDGER, PREDICATE = "engagement_id long, strategy_id long, status string, score double", "engagement_id long, strategy_id long, predicate_id string, kind string, subject string, expected string"
KNOWN = "engagement_id long, class string, subject string, value string"


def frames(spark, ledger, predicates, known, revision=10):
    return spark.createDataFrame(ledger, LEDGER), spark.createDataFrame(predicates, PREDICATE), spark.createDataFrame(known, KNOWN), spark.createDataFrame([(1, revision)], "engagement_id long, material_revision long")


def test_each_kind_of_predicate(spark):
    digest = hashlib.sha256(b"old").hexdigest()
    cases = [
        ("fact_present", "a", None, [("fact", "a", None)], True), ("fact_present", "a", None, [("secret", "a", None)], False), ("fact_present", None, None, [("fact", None, None)], False),
        ("fact_changed", "a", digest, [("facet", "a", "new")], True), ("fact_changed", "a", digest, [("facet", "a", "old")], False), ("fact_changed", "a", digest, [], False),
        ("prerequisite_satisfied", "a", None, [("access", "a", None)], True), ("prerequisite_satisfied", "a", None, [("outcome", "a", None)], False),
        ("credential_available", "a", None, [("secret", "a", None)], True), ("evidence_category_present", None, "done", [("outcome", "done", None)], True), ("evidence_category_present", None, "done", [("outcome", "other", None)], False),
        ("state_revision_after", None, "9", [], True), ("state_revision_after", None, "10", [], False), ("no_such_kind", "a", "a", [("fact", "a", "a")], False),
    ]
    predicates = [(n, 1, "p", kind, subject, expected) for n, (kind, subject, expected, _, _) in enumerate(cases)]
    known = [(n, *row) for n, (*_, rows, _) in enumerate(cases) for row in rows]
    revisions = spark.createDataFrame([(n, 10) for n in range(len(cases))], "engagement_id long, material_revision long")
    got = {r.engagement_id for r in P.satisfied(spark.createDataFrame(predicates, PREDICATE), spark.createDataFrame(known, KNOWN), revisions).collect()}
    assert got == {n for n, c in enumerate(cases) if c[-1]}


def test_a_chain_comes_back_round_by_round_until_nothing_changes(spark):
    ledger = [(1, 0, "available", 0.5)] + [(1, k, "archived", 0.1) for k in range(1, 7)] + [(1, 50, "archived", 0.1)]
    predicates = [(1, k, "p", "prerequisite_satisfied", f"s{k - 1}", None) for k in (*range(1, 7), 50)]
    parts = frames(spark, ledger, predicates, [])
    after, rounds = P.settled(*parts, provides, score=F.lit(0.3))
    assert rounds == 7 and {(r.strategy_id, r.status, r.score) for r in after.collect()} == {(0, "available", 0.5), (50, "archived", 0.1)} | {(k, "available", 0.3) for k in range(1, 7)}
    again, more = P.settled(after, *parts[1:], provides)
    assert more == 1 and sorted(map(tuple, again.collect())) == sorted(map(tuple, after.collect()))
    with pytest.raises(RuntimeError, match="no fixpoint"):
        P.settled(*parts, provides, rounds=3)


def test_at_most_sixteen_come_back_at_once(spark):
    ledger = [(1, k, "archived", 0.1) for k in range(40)]
    predicates = [(1, k, "p", "fact_present", "x", None) for k in range(40)]
    parts = frames(spark, ledger, predicates, [(1, "fact", "x", None)])
    one = P.reactivations(parts[0], P.satisfied(*parts[1:]))
    assert {r.strategy_id for r in one.collect()} == set(sorted(range(40), key=str)[:16])
    after, rounds = P.settled(*parts, provides)
    assert rounds == 4 and after.where("status = 'available'").count() == 40


def test_two_passes_with_proposals_and_refusals(spark):
    ledger, predicates, known, revisions = frames(spark, [(1, 1, "available", 0.5), (1, 2, "available", 0.5), (1, 3, "completed", 0.9)], [(1, 3, "p", "state_revision_after", None, "9")], [])
    kind = "engagement_id long, strategy_id long, status string, score double, reason string"
    first = spark.createDataFrame([(1, 1, "blocked", 0.4, "no route"), (1, 2, "available", 0.9, " "), (1, 4, "available", 0.6, None)], kind)
    one, refused = P.planner_pass(ledger, first, predicates, known, revisions, provides)
    assert [tuple(r) for r in refused.collect()] == [(1, 2, 0.5, 0.9)]
    assert {tuple(r) for r in one.collect()} == {(1, 1, "archived", 0.4), (1, 2, "available", 0.5), (1, 3, "available", 0.9), (1, 4, "available", 0.6)}
    two, refused = P.planner_pass(one, spark.createDataFrame([(1, 4, "available", 0.1, "worse")], kind), predicates, known, revisions, provides)
    assert refused.count() == 0 and {tuple(r) for r in two.collect()} == {(1, 1, "archived", 0.4), (1, 2, "available", 0.5), (1, 3, "available", 0.9), (1, 4, "archived", 0.1)}


def test_reconciliation_rules(spark):
    ledger = spark.createDataFrame([(1, 1, "available", 0.5), (1, 2, "archived", 0.5), (1, 3, "deferred", 0.5), (2, 1, "available", 0.5), (3, 9, "available", 0.5)], LEDGER)
    operations = [(1, 1, "complete", "available", 1, 3), (1, 2, "reactivate", "deferred", 2, 3), (1, 7, "keep", "available", 3, 3), (2, 1, "reactivate", "available", 1, 2), (4, 1, "add", "available", 1, 1)]
    errors = P.reconciliation_errors(ledger, spark.createDataFrame(operations, "engagement_id long, strategy_id long, operation string, status string, ordinal long, n_items long"))
    assert {tuple(r) for r in errors.collect()} == {(1, 1, "status_mismatch"), (1, 3, "hot_entry_omitted"), (1, 7, "unknown_strategy"), (2, 1, "reactivates_nothing_archived"), (2, None, "incomplete_batch")}
