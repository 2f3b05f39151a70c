"""Exact values of operators that SQL cannot say, of functions for SQL, and of whole queries by plain loops."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from sparkloom.functions import register
from sparkloom.operators import journal as J
from sparkloom.operators import planning as P
from sparkloom.operators import relational
from sparkloom.operators.text import decode_bounded
from sparkloom.plans import registry


def test_sql_functions(spark):
    assert len(register.register(spark)) == 7
    one = lambda q: spark.sql(q).collect()
    assert one("select loom_decode_bounded('a%2520b&amp;lt;c') x")[0].x == "a b<c"
    assert one("select loom_visible_text('<p>a <a href=x>link</a><script>no</script>b&amp;c</p>') x")[0].x == "a b&c"
    assert one("select loom_strip_accents('Éàß') x, loom_normal('  A \n B ') y")[0][:] == ("eaß", "a b")
    first = hashlib.sha256(b"|a").hexdigest()
    assert one("select loom_chain_digest(v) x from values ('b'), ('a'), (null) t(v)")[0].x == hashlib.sha256(f"{first}|b".encode()).hexdigest()
    rows = one("select * from loom_markdown_lines('# T\n\n```\n# x\n```\n- a\n| b |\nc')")
    assert [(r.line_no, r.kind) for r in rows] == [(1, "heading"), (3, "code"), (4, "code"), (5, "code"), (6, "list"), (7, "table"), (8, "paragraph")]
    assert [tuple(r) for r in one("select * from loom_packs(array(3, 4, 9, 1, 1), 8)")] == [(1, 2, 7), (2, 1, 9), (3, 2, 2)]


def test_compile_and_sanitise_values(spark):
    rows = spark.createDataFrame([(1, "fine"), (2, "mend me"), (3, "bad"), (4, "boom")], "id long, text string")

    def extract(t):
        if t == "boom":
            raise ValueError(t)
        return t.upper()

    got = P.compiled(rows, "id", "text", extract, lambda x: None if x in ("FINE", "MENDED") else "unclear", lambda x, f: "MENDED" if x.startswith("MEND") else x)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "verified", "FINE", None, 0), (2, "verified", "MENDED", None, 1), (3, "quarantined", None, "unclear", 1), (4, "failed", None, "ValueError", 0)]
    clean = json.loads(P.sanitised_structure(json.dumps({"user": "a", "password": "b", "deep": [{"token": "c", "n": 1}]})))
    assert clean["user"] == "a" and clean["password"] != "b" and clean["deep"][0]["token"] != "c" and clean["deep"][0]["n"] == 1


def test_append_and_state_queries_against_plain_loops(spark, sf):
    events = sorted(((r.user_id, r.ts, r.event_id, r.event_type, r.props) for r in spark.read.parquet(f"{sf}/events.parquet").collect()))
    by_user = {}
    for user, *rest in events:
        by_user.setdefault(user, []).append(rest)
    state = {r.user_id: tuple(r)[1:] for r in registry.queries()["q_reduce_state"](spark, sf).collect()}
    assert state == {u: J.replay([(k, e[2]) for k, e in enumerate(rows)]) for u, rows in by_user.items()}
    want = {}
    for u, rows in by_user.items():
        last = ""
        for n, (_, event_id, kind, props) in enumerate(rows, 1):
            material = hashlib.sha256("\x1f".join(map(str, (event_id, kind, props))).encode()).hexdigest()
            last = hashlib.sha256(f"{last}|{material}".encode()).hexdigest()
            want[u, n] = last
    assert {(r.user_id, r.seq): r.chain_hash for r in registry.queries()["q_append_chain"](spark, sf).collect()} == want


def test_decoding_query_against_a_plain_loop(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: (r.url_key, r.n_chars) for r in registry.queries()["q_decode_bounded"](spark, sf).collect()}
    assert got == {p.page_id: (hashlib.sha256(decode_bounded(p.url).encode()).hexdigest(), len(decode_bounded(p.html))) for p in pages}


def test_running_total_of_a_hot_key(spark):
    rows = [("hot", k, k % 7) for k in range(1000)] + [("b", 5, 1), (None, 1, 2), (None, 2, 3)]
    got = relational.running_total(spark.createDataFrame(rows, "s string, k long, v long"), "s", ["k"], "v", parts=16)
    want, total = {}, {}
    for s, k, v in rows:
        total[s] = total.get(s, 0) + v
        want[s, k] = total[s]
    assert {(r.s, r.k): r.running for r in got.collect()} == want
    assert relational.running_total(spark.createDataFrame([], "s string, k long, v long"), "s", ["k"], "v").count() == 0


def test_evaluation_gates_on_a_golden_suite(spark):
    """Recall at 8 of .9, precision at 8 of .7, no violations, repeats equal, 5 s a scenario and 30 s in all."""
    from sparkloom.operators import notes as N

    hits = spark.createDataFrame([(q, i, r) for q in range(4) for r, i in enumerate([10 * q, 10 * q + 1, 10 * q + 2, 99][: 3 + q % 2], 1)], "q long, item long, rank int")
    relevant = spark.createDataFrame([(q, 10 * q + k) for q in range(4) for k in range(3)], "q long, item long")
    none = spark.createDataFrame([], "q long, item long")
    runs = spark.createDataFrame([(q, 0.5 + q, "same") for q in range(4) for _ in range(2)], "q long, latency double, digest string")
    good = N.gates(N.scenario_report(hits, relevant, none, runs, "q", "item", 8), 0.9, 0.7, 0, 5.0, 30.0).first()
    assert good.passed and good.macro_recall == 1.0 and good.macro_precision == 0.875 and good.max_latency == 3.5
    bad = N.gates(N.scenario_report(hits, relevant, spark.createDataFrame([(1, 99)], "q long, item long"), runs.withColumn("digest", F.expr("uuid()")), "q", "item", 8), 0.9, 0.7, 0, 5.0, 30.0).first()
    assert not bad.passed and bad.n_violations == 1 and not bad.reproducible


def test_archive_pages_and_verified_slices(spark, tmp_path):
    import pytest

    from sparkloom.operators import catalog as C

    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps({"header": "v1"}), *(json.dumps({"entry_id": f"e{n:03}", "n": n}) for n in (3, 1, 2, 4))]) + "\n")
    header, page = C.archive_page(spark, str(tmp_path / "a.jsonl"), "e001", 2)
    assert header.first().header == "v1" and [r.entry_id for r in page.collect()] == ["e002", "e003"]
    with pytest.raises(ValueError):
        C.archive_page(spark, str(tmp_path / "a.jsonl"), "", 257)
    blobs = tmp_path / "blobs"
    blobs.mkdir()
    for name, body in {"good": b"0123456789", "bad": b"other", "new": b"x"}.items():
        (blobs / name).write_bytes(body)
    known = spark.createDataFrame([("good", hashlib.sha256(b"0123456789").hexdigest()), ("bad", "0" * 64)], "name string, sha256 string")
    got = {r.name: (r.state, r.data and bytes(r.data)) for r in C.verified_slice(spark, str(blobs), known, 2, 3).collect()}
    assert got == {"good": ("verified", b"234"), "bad": ("corrupt", None), "new": ("unknown", None)}


def test_links_relations_and_dates_of_odd_rows(spark):
    from sparkloom.operators import notes as N

    rows = spark.createDataFrame([(1, "see [[a|b]] ![[x.png]] [[c]] \nkey:: v "), (2, None), (3, "")], "id long, t string")
    assert [r.x for r in rows.orderBy("id").select(N.plain_links(F.col("t")).alias("x")).collect()] == ["see b  c\nkey:: v", None, ""]
    assert sorted((r.relation, r.target) for r in N.note_relations(rows, "id", "t").collect()) == [("asset", "x.png"), ("key", "v"), ("link", "a"), ("link", "c")]
    days = {"2024-02-29": "2024-02-29", "2023-02-29": None, "2024-01-01T00:30:00+01:00": "2023-12-31", "2024-01-01 10:00": "2024-01-01", "1.1.2024": None, "": None}
    got = spark.createDataFrame([(k,) for k in days], "s string").select("s", N.flexible_date(F.col("s")).cast("string").alias("d")).collect()
    assert {r.s: r.d for r in got} == days
    assert spark.range(1).select(N.fenced(F.lit("a ```` b")).alias("x")).first().x == "`````\na ```` b\n`````"


def test_journals_beyond_the_contract_are_not_folded(spark):
    rows = spark.createDataFrame([("a", n, "view") for n in range(5)] + [("b", 0, "view")], "k string, seq long, type string")
    assert sorted(tuple(r) for r in J.reduce_state(rows, "k", most=4).collect()) == [("a", "over_limit", 0, 0, 0), ("b", "open", 1, 0, 0)]
    assert [tuple(r) for r in J.over_limit(rows, "k", 4).collect()] == [("a", 5)]


def test_variants_and_broadcast_bounds(spark, monkeypatch):
    from sparkloom.operators import retrieval as R

    assert P.variants("A b") == sorted({"a b", "a%20b", "a+b", "qsbi", "412062"})
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert R.is_small(wide)
    monkeypatch.setattr(R, "BROADCAST_BYTES", 5000)
    assert not R.is_small(wide)
    monkeypatch.setattr(R, "BROADCAST_ROWS", 9)
    assert not R.is_small(spark.range(10))


def test_running_totals_of_a_hot_key_with_an_outlier(spark):
    """A million rows of one key and one value far away: no part holds 2 per cent of them, and sums are exact."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("hot").alias("k"), F.when(F.col("id") == n - 1, F.lit(10**15)).otherwise(F.col("id")).alias("at"), (F.col("id") % 7).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("cold", 5, 2), ("cold", 1, 3), (None, 1, 4)], "k string, at long, v long"))
    sizes = relational.quantile_parts(rows, "k", F.col("at").cast("double")).where("k = 'hot'").groupBy("_part").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] < 0.02 * n and sizes[1] > 200
    got = relational.running_total(rows, "k", ["at"], "v", "run")
    whole = sum(i % 7 for i in range(n))
    assert got.where("k = 'hot'").agg(F.max("run")).first()[0] == whole
    for place in (0, 1, 500_000, 999_998):
        assert got.where((F.col("k") == "hot") & (F.col("at") == place)).first().run == sum(i % 7 for i in range(place + 1))
    assert sorted((r.k or "", r.at, r.run) for r in got.where("k is null or k = 'cold'").collect()) == [("", 1, 4), ("cold", 1, 3), ("cold", 5, 5)]


def test_appends_are_admitted_whole_or_refused(spark):
    existing = spark.createDataFrame([("a", 1, "h1"), ("a", 2, "h2"), ("b", 1, "x"), ("d", 9, "z")], "k string, seq long, chain_hash string")
    drafts = spark.createDataFrame([("a", 1, "p"), ("a", 2, "q"), ("b", 1, "p"), ("c", 1, "p"), ("d", 1, "p"), ("d", 2, "p"), ("e", 1, "w" * 70_000), *(("f", n, "p") for n in range(6))], "k string, draft_no long, p string")
    expected = spark.createDataFrame([("a", 2, "h2"), ("b", 1, "other"), ("c", 3, "gone"), ("d", 9, "z")], "k string, seq long, chain_hash string")
    good, refused = J.admitted(existing, drafts, "k", ["p"], expected, most=10, batch=5)
    assert {tuple(r) for r in refused.collect()} == {("b", "revision_conflict"), ("c", "revision_conflict"), ("d", "over_limit"), ("e", "event_too_large"), ("f", "batch_too_large")}
    assert sorted((r.k, r.seq) for r in J.append_events(existing, good, "k", ["p"]).collect()) == [("a", 3), ("a", 4)]
    assert J.admitted(existing, drafts.limit(0), "k", ["p"])[1].count() == 0


def test_situation_deltas_touch_their_engagements_only(spark, sf):
    from sparkloom.operators import situation as S
    from sparkloom.plans.engagement_queries import plain_events

    rows = plain_events(spark, sf)
    old, new = rows.where("sequence <= 30"), rows.where("sequence > 30 and engagement_id < 5")
    state = S.deltas(old)
    changed = {(r.engagement_id, r.family): tuple(r) for r in S.touched(state, new).collect()}
    assert {e for e, _ in changed} <= set(range(5))
    kept = {(r.engagement_id, r.family): tuple(r) for r in state.select(*S.STATE).collect()} | {k: v for k, v in changed.items()}
    order = {c: n for n, c in enumerate(S.touched(state, new).columns)}
    assert [order[c] for c in S.STATE] == sorted(order[c] for c in S.STATE)
    assert kept == {(r.engagement_id, r.family): tuple(r) for r in S.deltas(old.unionByName(new)).collect()}
