"""Retrieval from end to end on a golden suite of made bundles, its gates, and its typed gaps."""

from __future__ import annotations

import hashlib
import time


from sparkloom.operators import notes as N
from sparkloom.operators import retrieve as E

TOPICS = {
    "tickets": "kerberos ticket granting service account hash crack offline",
    "upload": "web upload form extension filter bypass shell request",
    "sudo": "sudo rule wildcard privilege escalation binary path root",
    "shares": "smb share listing null session readable folder credentials",
}
SYSTEMS = ("linux", "windows")


def suite(spark):
    """Artifacts of each topic for each system, each in two lanes, and noise that shares words with all of them."""
    docs, facts, facets, doc = [], [], [], 0
    for topic, words in TOPICS.items():
        for system in SYSTEMS:
            for n in range(4):
                docs.append((doc, f"{words} on {system} step {n} of the guide, variant {n}"))
                facts.append((doc, ("reference", "case_step")[n % 2], "verified", 0.8, 1.0, 1, 0, f"g{doc}"))
                facets += [(doc, "typed", "os_family", system, "required", 0.9), (doc, "open", "topic", topic, "required", 0.9)]
                doc += 1
    common = " ".join(w for words in TOPICS.values() for w in words.split()[::3])
    for n in range(40):  # they hold words of every topic, but need what no situation shows
        docs.append((doc, f"the guide of day {n}: {common} " + f"filler{n} " * 30))
        facts.append((doc, "reference", "extracted", 0.6, 1.0, 0, 0, f"g{doc}"))
        facets += [(doc, "typed", "os_family", SYSTEMS[n % 2], "required", 0.9), (doc, "open", "topic", "other", "required", 0.9)]
        doc += 1
    docs.append((doc, TOPICS["sudo"] + " on linux"))
    facts.append((doc, "reference", "rejected", 0.8, 1.0, 1, 0, "gx"))
    queries, live, relevant, forbidden = [], [], [], []
    for q, (topic, words) in enumerate(TOPICS.items()):
        system = SYSTEMS[q % 2]
        queries.append((q, " ".join(words.split()[:5]), "10.0.0.1", "authorized"))
        live += [(q, "typed", "os_family", system.upper(), 0.9), (q, "open", "topic", topic, 0.9)]
        for d, *_ in docs[: 8 * len(TOPICS)]:
            mine = d // 8 == q
            (relevant if mine and SYSTEMS[d % 8 // 4] == system else forbidden if mine else []).append((q, d))
    queries += [(90, "sudo rule", "two words", "authorized"), (91, "sudo rule", "box", "unknown"), (92, "zzyzx quuxly", "box", "authorized"), (93, "kerberos ticket", "box", "authorized"), (94, None, "box", "authorized")]
    live += [(93, "typed", "os_family", "solaris", 0.9)]
    frame = spark.createDataFrame
    return (
        frame(queries, "query_id long, text string, target string, authorization string"),
        frame(docs, "doc_id long, text string"),
        frame(facts, "doc_id long, lane string, status string, verification double, fresh double, support long, against long, group_key string"),
        frame(facets, "artifact_id long, namespace string, key string, value string, relation string, confidence double"),
        frame(live, "query_id long, namespace string, key string, value string, confidence double"),
    ), frame(relevant, "q long, item long"), frame(forbidden, "q long, item long")


def test_gates_hold_on_the_output_of_retrieval(spark):
    parts, relevant, forbidden = suite(spark)
    runs, hits = [], None
    E.retrieve(*parts, k=8).hits.count()  # start the engine outside the clock
    for _ in range(2):
        began = time.perf_counter()
        found = sorted(map(tuple, E.retrieve(*parts, k=8).hits.where("query_id < 90").select("query_id", "doc_id", "total", "lane").collect()))
        seconds = (time.perf_counter() - began) / len(TOPICS)
        runs += [(q, seconds, hashlib.sha256(str([x for x in found if x[0] == q]).encode()).hexdigest()) for q in range(len(TOPICS))]
    ranked, seen = [], {}
    for q, d, total, _ in sorted(found, key=lambda x: (x[0], -x[2], x[1])):
        seen[q] = seen.get(q, 0) + 1
        ranked.append((q, d, seen[q]))
    hits = spark.createDataFrame(ranked, "q long, item long, rank long")
    report = N.scenario_report(hits, relevant, forbidden, spark.createDataFrame(runs, "q long, latency double, digest string"), "q", "item", 8)
    assert {r.q for r in report.collect()} == set(range(len(TOPICS)))
    gate = N.gates(report, 0.9, 0.7, 0, 5.0, 30.0).first()
    assert gate.passed and gate.macro_recall >= 0.9 and gate.macro_precision >= 0.7 and gate.n_violations == 0, gate


def test_gaps_tell_why_and_rejections_say_what(spark):
    parts, _, _ = suite(spark)
    got = E.retrieve(*parts)
    gaps = {r.query_id: (r.gap, r.research) for r in got.gaps.collect()}
    assert gaps == {90: ("invalid_target", False), 91: ("unauthorized_scope", False), 92: ("no_applicable_knowledge", True), 93: ("no_applicable_knowledge", True), 94: ("no_applicable_knowledge", True)}
    reasons = {(r.query_id, r.reason) for r in got.rejected.collect()}
    assert (2, "rejected_status") in reasons and (0, "incompatible") in reasons and {q for q, _ in reasons}.isdisjoint({90, 91, 92, 94})
    assert got.hits.where("query_id >= 90").count() == 0
    down = E.retrieve(*parts, available=False)
    assert down.hits.count() == 0 and {r.query_id: r.gap for r in down.gaps.collect()} == {90: "invalid_target", 91: "unauthorized_scope"} | dict.fromkeys([0, 1, 2, 3, 92, 93, 94], "retrieval_unavailable")
    none = E.retrieve(parts[0].limit(0), *parts[1:])
    assert none.hits.count() == 0 and none.gaps.count() == 0


def test_a_query_meets_facets_of_its_candidates_only(spark):
    parts, _, _ = suite(spark)
    found = E.candidates(spark.createDataFrame([(0, 1, -2.0), (0, 2, -1.0), (0, 3, -0.5)], "query_id long, doc_id long, rank_value double"), parts[2], 1)
    assert sorted((r.doc_id, r.lane, r.relevance) for r in found.collect()) == [(1, "case_step", 1.0), (2, "reference", 1.0)]
