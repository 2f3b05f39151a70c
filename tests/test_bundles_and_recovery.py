"""Bundle snapshots on made files, torn journal tails with a crash between the sinks, typed payloads."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import payloads as P
from sparkloom.sources import bundles as B
from sparkloom.sources.markers import Markers
from sparkloom.streaming import tail_recovery as R


def bundle(n, status="verified"):
    art = {"artifact_id": f"a{n}", "title": "t", "text": "x" * 50, "facets": [{"namespace": "n", "key": "k", "value": str(n)}], "citations": [{"segment": "s", "start_line": 1, "end_line": 2}], "unknown": 1}
    return {"source_id": f"s{n}", "revision": "r", "verification": {"status": status, "confidence": 0.5, "reasons": []}, "references": [art], "cases": [art | {"steps": [{"step_id": f"st{n}", "action": "do", "outcome": "ok"}]}], "rules": [{"artifact_id": f"r{n}", "statement": "when", "lane": "guidance", "rationale": ["b", "a", "a"], "exceptions": [], "contradicting": [f"s{n + 1}", f"s{n + 1}"]}], "execution_examples": [{"example_id": f"x{n}", "parent_artifact_id": f"a{n}", "command": "secret command"}]}


@pytest.fixture
def folder(tmp_path):
    where = tmp_path / "bundles"
    where.mkdir()
    for n in range(5):
        (where / f"{n}.json").write_text(json.dumps(bundle(n, "verified" if n != 3 else "quarantined"), indent=1))
    (where / "notes.txt").write_text("no bundle")
    return where


def test_only_wanted_nested_fields_are_built_and_read(spark, folder, tmp_path):
    rows = B.verified(spark, str(folder), ["references.artifact_id", "cases.steps.step_id"])
    built = str(B.scan(spark, str(folder), ["references.artifact_id", "cases.steps.step_id"]).schema)
    assert "artifact_id" in built and "step_id" in built and not any(f in built for f in ("facets", "citations", "title", "action"))
    assert "PushedFilters" in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.source_id, r.references[0].artifact_id, r.cases[0].steps[0].step_id) for r in rows.collect()) == [(f"s{n}", f"a{n}", f"st{n}") for n in (0, 1, 2, 4)]
    copy, token = B.guarded(spark, str(folder), str(tmp_path / "out"))
    assert copy.count() == 4 and len(token) == 64
    facets = copy.select(F.explode("references").alias("r")).select(F.explode("r.facets").alias("f")).select("f.value")
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    read = facets._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("ReadSchema:")[1].split("\n")[0]
    assert "facets" in read and not any(f in read for f in ("citations", "text", "steps", "verification"))
    assert sorted(r.value for r in facets.collect()) == ["0", "1", "2", "4"]


def test_token_follows_every_byte_and_corrupt_files_stop_the_snapshot(spark, folder, tmp_path):
    token = B.revision(spark, str(folder))
    assert token == B.revision(spark, str(folder))
    (folder / "notes.txt").write_text("still no bundle")
    assert token == B.revision(spark, str(folder))
    (folder / "4.json").write_text(json.dumps(bundle(4)))
    assert token != B.revision(spark, str(folder))
    (folder / "9.json").write_text(json.dumps(bundle(9))[:-40])
    assert [r._corrupt is not None for r in B.scan(spark, str(folder)).where("_corrupt is not null").collect()] == [True]
    with pytest.raises(B.CorruptBundle):
        B.guarded(spark, str(folder), str(tmp_path / "out"))
    with pytest.raises(ValueError, match="nothing"):
        B.scan(spark, str(folder), ["cases.nothing"])


def line(n):
    return json.dumps({"event_id": f"e{n}", "engagement_id": "x", "sequence": n, "occurred_at": "2024-01-01T00:00:00Z", "type": "user_note", "payload": "{}", "previous_hash": None, "event_hash": "h"})


def test_torn_tail_goes_aside_and_a_crash_between_the_sinks_repeats_nothing(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    source.mkdir()
    (source / "0.jsonl").write_text(f"{line(1)}\n{line(2)}\n{line(3)[:40]}")
    (source / "1.jsonl").write_text(f"{line(3)}\nnot json\n\n{line(4)}\n")
    (source / "2.jsonl").write_text(f"{line(5)}\n" + line(6))  # whole, but without its line end
    for n in range(3):
        os.utime(source / f"{n}.jsonl", (1_700_000_000 + n,) * 2)
    calls = []

    def crash(batch):
        calls.append(batch)
        if len(calls) == 2:
            raise RuntimeError("killed between the sinks")

    start = lambda: R.recover(R.source(spark, str(source)), out, check, crash)
    with pytest.raises(Exception, match="killed between"):
        start().awaitTermination()
    assert sorted(r.sequence for r in R.committed(spark, out, "events").collect()) == [1, 2]
    assert [r.warning for r in R.committed(spark, out, "quarantine").collect()] == ["torn_tail"]
    start().awaitTermination()
    assert calls == [0, 1, 1, 2]
    assert sorted(r.sequence for r in R.committed(spark, out, "events").collect()) == [1, 2, 3, 4, 5]
    aside = sorted((os.path.basename(r.file), r.line_no, r.warning, r.content) for r in R.committed(spark, out, "quarantine").collect())
    assert aside == [("0.jsonl", 3, "torn_tail", line(3)[:40]), ("1.jsonl", 2, "corrupt_line", "not json"), ("2.jsonl", 2, "torn_tail", line(6))]
    assert Markers(spark, f"{out}/commits").names() == ["batch-0", "batch-1", "batch-2"]
    drafts = R.warnings(R.committed(spark, out, "quarantine")).collect()
    assert len(drafts) == 6 and {json.loads(d.payload).get("reason_code") for d in drafts if d.type == "recovery_warning"} == {"torn_tail", "corrupt_line"}
    assert R.committed(spark, str(tmp_path / "none"), "events").count() == 0


def test_declared_payloads_and_references(spark):
    good = {"statement": "s", "confidence": 1, "supporting_event_ids": ["e1"]}
    rows = [
        ("j", 1, "e1", "decision_recorded", json.dumps({"decision_id": "d", "strategy": "s"})),
        ("j", 2, "e2", "hypothesis_formed", json.dumps(good)),
        ("j", 3, "e3", "hypothesis_formed", json.dumps(good | {"confidence": "high", "extra": 1, "supporting_event_ids": ["e3", "e2", "gone"]})),
        ("j", 4, "e4", "closure_cancelled", json.dumps({"closure_event_id": None})),
        ("j", 5, "e5", "closure_cancelled", json.dumps({"closure_event_id": "e9"})),
        ("j", 6, "e6", "closure_cancelled", "[1]"),
        ("j", 7, "e7", "closure_cancelled", None),
        ("j", 8, "e8", "never_heard", "{}"),
        ("k", 9, "e9", "user_note", "{}"),
    ]
    df = spark.createDataFrame(rows, "engagement_id string, sequence long, event_id string, type string, payload string")
    got = sorted((r.event_id, r.field or "", r.problem) for r in P.problems(df, ["event_id"], P.declarations(spark)).collect())
    assert got == [("e3", "confidence", "wrong_kind"), ("e3", "extra", "undeclared"), ("e4", "closure_event_id", "missing"), ("e6", "", "not_an_object"), ("e7", "", "not_an_object"), ("e8", "", "unknown_type"), ("e9", "", "unknown_type")]
    flat = sorted((r.event_id, r.statement, r.confidence) for r in P.laid_out(df, ["event_id"], "hypothesis_formed").collect())
    assert flat == [("e2", "s", 1.0), ("e3", "s", None)]
    refs = P.unanswered(df, ["event_id"], {"hypothesis_formed": ["supporting_event_ids"], "closure_cancelled": ["closure_event_id"]})
    assert sorted((r.event_id, r.field, r.cited) for r in refs.collect()) == [("e3", "supporting_event_ids", "e3"), ("e3", "supporting_event_ids", "gone"), ("e5", "closure_event_id", "e9")]


def test_locators_and_rules_of_bundles(spark, folder):
    bundles = B.verified(spark, str(folder))
    where = B.example_locators(bundles)
    assert where.columns == ["example_id", "parent_artifact_id", "source_id"] and sorted(map(tuple, where.collect()))[0] == ("x0", "a0", "s0")
    rules = {r.artifact_id: (r.lane, r.statement, r.rationale, r.exceptions) for r in B.rule_rows(bundles).collect()}
    assert set(rules) == {"r0", "r1", "r2", "r4"} and rules["r0"] == ("guidance", "when", "a b", "")
    assert {tuple(r) for r in B.rule_sources(bundles).where("artifact_id = 'r1'").collect()} == {("r1", "s1", "supports"), ("r1", "s2", "contradicts")}


def test_projections_have_one_owner_and_versions(spark, tmp_path):
    from sparkloom.sources.projections import ForeignOwner, Projections
    from sparkloom.sources.versioned import Conflict

    p = Projections(spark, str(tmp_path / "p"))
    assert p.read("hints", "planner") is None
    assert p.write("hints", "planner", spark.range(3), expected=0) == 1
    assert p.read("hints", "planner").count() == 3
    with pytest.raises(ForeignOwner):
        p.write("hints", "reporter", spark.range(1))
    with pytest.raises(ForeignOwner):
        p.read("hints", "reporter")
    with pytest.raises(Conflict):
        p.write("hints", "planner", spark.range(1), expected=0)
    assert p.write("hints", "planner", spark.range(5), expected=1) == 2 and p.read("hints", "planner").count() == 5
    with pytest.raises(ValueError):
        p.write("../out", "planner", spark.range(1))
