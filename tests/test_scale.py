"""Steps whose work must not grow faster than their input, on small tables that would have shown it."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.functions import exprs as X
from sparkloom.operators import evidence as E
from sparkloom.operators import ledger as L
from sparkloom.operators import markdown as M
from sparkloom.operators import notes as N
from sparkloom.operators import planner as P
from sparkloom.operators import retrieval as R
from sparkloom.operators import retrieve as V
from sparkloom.operators import text as T
from sparkloom.plans import registry


def rows_joined(df) -> int:
    """The most rows that any operator of the executed plan gave."""
    df.collect()
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if (metric := node.metrics().get("numOutputRows")).isDefined():
            found.append(metric.get().value())
        inner = [m for m in ("finalPhysicalPlan", "plan") if node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec") and m in [x.getName() for x in node.getClass().getMethods()]]
        todo += [getattr(node, m)() for m in inner[:1]]
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return max(found)


def test_requests_for_a_common_scope_do_not_meet_each_row(spark):
    rows = spark.range(400).select(F.col("id").alias("row"), F.expr("array('red', if(id % 2 = 0, 'small', 'wide'), 'only' || id)").alias("scopes"))
    asked = spark.range(500).select(F.col("id").alias("request"), F.expr("array('red', 'small', if(id % 100 = 7, 'none', 'red'))").alias("scopes"))
    few = spark.sql("select * from values (1000L, array('only3')), (1001L, array('only3', 'small')), (1002L, array('nothing')), (1003L, array('wide', 'only1')), (null, array('red')) t(request, scopes)")
    got = E.resumable(rows, asked.unionByName(few), "row", "scopes")
    assert rows_joined(got) < 5_000
    found = {r.request: (r.n, r.chosen, r.how) for r in got.collect()}
    assert all(found[k] == (400, None, "ambiguous") for k in range(500))
    assert found[1000] == (1, 3, "one") and found[1001] == (201, None, "ambiguous")
    assert found[1002] == found[None] == (0, None, "none") and found[1003] == (200, None, "ambiguous")


def test_parts_of_a_search_grow_with_pairs(spark, monkeypatch):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.expr("'red fox number ' || id").alias("text")).coalesce(1)
    items = spark.createDataFrame([(k, "a red fox") for k in range(50)], "item_id long, text string")
    once = sorted(map(str, R.bm25(docs, items).collect())), sorted(map(str, R.evidence(docs, items).collect()))
    monkeypatch.setattr(R, "TASK_PAIRS", 100)
    sent = []
    plain = R.dealt
    monkeypatch.setattr(R, "dealt", lambda *a: sent.append(plain(*a)) or sent[-1])
    assert once == (sorted(map(str, R.bm25(docs, items).collect())), sorted(map(str, R.evidence(docs, items).collect())))
    assert [d.rdd.getNumPartitions() for d in sent] == [30, 30]


def test_lanes_meet_pairs_where_they_stand(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK_PAIRS", 5000)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("q_retrieve_lanes", "q_lane_topk"):
            found = []
            for n in ("2", "64"):  # fewer than the parts of the search, and more
                spark.conf.set("spark.sql.shuffle.partitions", n)
                got = registry.queries()[name](spark, "/root/testdata/sf0.001")
                plan = got._jdf.queryExecution().executedPlan().toString()
                # the first join by document sorts the sums of pairs as they stand, without an exchange between
                assert re.search(r"SortMergeJoin \[doc_id.*\n\W*Sort .*\n\W*(\w+)", plan).group(1) == "HashAggregate"
                found.append(sorted(map(tuple, got.collect())))
            assert found[0] and found[0] == found[1]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_evidence_deals_texts_and_groups_asked_terms_only(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 200), i -> 'w' || id || 'x' || i), 'red')").alias("text"))
    items = spark.createDataFrame([(1, "red fox")], "item_id long, text string")
    got = R.evidence(docs, items)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and not re.search(r"hashpartitioning\(doc_id#\w+, term#", plan)
    assert sorted(map(tuple, got.collect())) == [(1, k, 1, 201) for k in range(50)]


def test_parts_with_one_range_meet_the_orders_once(spark, tmp_path):
    for t in ("orders", "part"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").createOrReplaceTempView(f"scale_{t}")
    spark.table("scale_orders").write.parquet(f"{tmp_path}/orders.parquet")
    part = spark.table("scale_part").crossJoin(spark.range(40))
    part.withColumn("p_partkey", F.col("p_partkey") + 400_000 * F.col("id")).drop("id").write.parquet(f"{tmp_path}/part.parquet")
    got = registry.queries()["q_range_join"](spark, str(tmp_path))
    once = {r.part_key: r.n_orders for r in registry.queries()["q_range_join"](spark, "/root/testdata/sf0.001").collect()}
    assert {r.part_key: r.n_orders for r in got.collect()} == {k + 400_000 * c: n for k, n in once.items() for c in range(40)}
    assert rows_joined(got) < 40_000  # the parts, and each range with its prices once


def test_texts_without_the_anchor_skip_the_window(spark):
    import time

    long = spark.range(4, numPartitions=4).select(F.repeat(F.lit("nothing to be found here "), 120_000).alias("t"))
    start = time.time()
    assert [r.near for r in long.select(N.mention_near(F.col("t"), "License", "MIT|GNU").alias("near")).collect()] == [False] * 4
    assert time.time() - start < 5
    texts = spark.createDataFrame([("the MIT License",), ("MIT" + " " * 98 + "License",), ("License",), ("",), (None,)], "t string")
    assert [r.near for r in texts.select(N.mention_near(F.col("t"), "License", "MIT|GNU").alias("near")).collect()] == [True, False, False, False, None]


def test_decoding_holds_a_slice_of_texts_at_a_time():
    texts = pa.array(["a%20b", None, "&amp;lt;", "x" * 70_000] * 300)
    out = list(T._decode_batches(iter([texts])))
    assert len(out) > 1 and max(map(len, out)) <= T.DECODE_ROWS
    assert pa.concat_arrays(out).to_pylist() == ["a b", None, "<", "[REDACTED]"] * 300


def test_segments_walk_each_text_once(spark):
    docs = spark.createDataFrame([(1, "# a\n\nb\n\n```\nsudo x\n```\n\nflag{abc}"), (2, ""), (3, "one")], "doc_id long, text string")
    got = M.segments(M.blocks(docs), 10)
    assert sorted((r.doc_id, r["pack"], r.text) for r in got.collect()) == [(1, 0, "a\n\nb\n\nsudo x\n\n[REDACTED]"), (3, 0, "one")]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_texts_without_marks_skip_the_redaction(spark):
    h = "0123456789abcdefABCDEF0123456789"
    texts = ["plain", None, "", "{", "ab{c}", "a{c}", h, f"x{h}", f"({h})", f"k9{{a}} {h} {h[1:]}", f"{h}{{z}}", f"{{{h}}}"]
    braced, digits = r"[A-Za-z0-9_]{2,16}\{[^{}\s]{1,128}\}", r"(^|[^A-Za-z0-9])[0-9a-fA-F]{32}([^A-Za-z0-9]|$)"
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1).select(X.redact(F.col("t")).alias("got"), F.regexp_replace(F.regexp_replace("t", braced, "[REDACTED]"), digits, "$1[REDACTED]$2").alias("want"))
    assert all(r.got == r.want for r in rows.collect()) and rows.where("got like '%[REDACTED]%'").count() == 6
    assert "CASE WHEN" in rows.select("got")._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_and_their_tokens_read_one_dealing(spark):
    rows = spark.createDataFrame([(1, 0, "html", '<DIV x align="Center"><b>a</b></DIV>'), (1, 1, "html", "<p>b</p>"), (1, 2, "paragraph", "</div>"), (None, 0, "html", "<p align=center>c</p>"), (2, 0, "html", None)], "doc_id long, block long, kind string, text string")
    got = M.unwrapped(rows)
    said = sorted((str(r.doc_id), r.block, r.visible, r.role) for r in got.collect())
    assert said == [("1", 0, "a", "unwrapped"), ("1", 1, "<p>b</p>", "kept"), ("1", 2, "</div>", "kept"), ("2", 0, None, "kept"), ("None", 0, "c", "unwrapped")]
    df = spark.createDataFrame(rows.collect(), rows.schema).repartition(2)  # more than a local relation, so that sides may share a read
    got = M.unwrapped(df)
    got.collect()
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_parts_of_a_ledger_grow_with_records(spark, monkeypatch):
    records = spark.range(1000).select((F.col("id") % 7).alias("owner"), (F.col("id") % 50).alias("batch"), (F.col("id") % 9).alias("entity"), F.lit("A").alias("status"), F.lit(0.6).alias("score"), F.col("id").alias("line"))
    sizes = records.groupBy("owner", "batch").agg(F.count("*").alias("expected"), F.first("batch").alias("at"))
    batches = sizes.withColumn("expected", F.when(F.col("batch") == 3, 99).otherwise(F.col("expected")))
    batches = spark.createDataFrame(batches.collect(), batches.schema)
    run = lambda: L.ledger(records, batches, "owner", "batch", "entity", "line", F.col("score") >= 0.5)
    once = sorted(map(tuple, run().collect()))
    assert len(once) == 63 and all(r[2] != 3 for r in once)
    monkeypatch.setattr(L, "TASK_ROWS", 60)
    got = run()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\([^)]*, 17\), REPARTITION_BY_NUM", plan)) == 3 and "ENSURE_REQUIREMENTS" not in plan
    assert sorted(map(tuple, got.collect())) == once


def test_rounds_ask_what_is_known_once_and_write_what_came_back(spark, monkeypatch):
    ledger = spark.createDataFrame([(1, k, "archived", 0.1) for k in range(5)] + [(1, 9, "available", 0.5)], "engagement_id long, strategy_id long, status string, score double")
    predicates = spark.createDataFrame([(1, k, "p", "prerequisite_satisfied" if k else "fact_present", f"s{k - 1}" if k else "t", None) for k in range(4)], "engagement_id long, strategy_id long, predicate_id string, kind string, subject string, expected string")
    known = spark.createDataFrame([(1, "fact", "t", None)], "engagement_id long, class string, subject string, value string")
    revisions = spark.createDataFrame([(1, 5)], "engagement_id long, material_revision long")
    provides = lambda hot: hot.select("engagement_id", F.lit("access").alias("class"), F.concat(F.lit("s"), F.col("strategy_id").cast("string")).alias("subject"), F.lit(None).cast("string").alias("value"))
    asked, written, satisfied, cut = [], [], P.satisfied, P.cut
    monkeypatch.setattr(P, "satisfied", lambda *a: asked.append(1) or satisfied(*a))
    monkeypatch.setattr(P, "cut", lambda df: written.append(cut(df)) or written[-1])
    after, rounds = P.settled(ledger, predicates, known, revisions, provides)
    assert sorted(map(tuple, after.collect())) == [*((1, k, "available", 0.1) for k in range(4)), (1, 4, "archived", 0.1), (1, 9, "available", 0.5)]
    assert (rounds, len(asked)) == (5, 1) and [df.count() for df in written[4:]] == [1, 1, 1, 1, 0]


def test_a_retrieval_searches_once(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "red fox") for k in range(4)], "doc_id long, text string")
    facts = docs.select("doc_id", F.lit("reference").alias("lane"), F.lit("extracted").alias("status"), F.lit(0.8).alias("verification"), F.lit(1.0).alias("fresh"), F.lit(1).alias("support"), F.lit(0).alias("against"), F.col("doc_id").alias("group_key"))
    queries = spark.createDataFrame([(1, "red", "10.0.0.1", "authorized")], "query_id long, text string, target string, authorization string")
    facets = spark.createDataFrame([], "artifact_id long, namespace string, key string, value string, relation string, confidence double")
    live = spark.createDataFrame([], "query_id long, namespace string, key string, value string, confidence double")
    reads = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda t: reads.add(1) or t)
    got = V.retrieve(queries, docs.repartition(2).select("doc_id", seen("text").alias("text")), facts, facets, live)
    before = reads.value
    assert before and got.hits.count() == 4 and got.gaps.count() == 0 and got.rejected.count() == 0
    assert reads.value == before
