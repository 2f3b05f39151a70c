"""Finds against brute force, and the retrieval bound against exhaustive scoring."""

from __future__ import annotations

import random

import numpy as np

from sparkloom.llm import decontaminate as D
from sparkloom.llm.queries import op5_decontamination


def plain_finds(items, text):
    """Items whose question and answer stand in the text, by looking at all of them in all windows."""
    words = D.normal_words(text)
    reach = max((len(q) + len(a) for q, a in (D.question_answer(t or "") for _, t in items)), default=0)
    step = max(8, reach)
    out = set()
    for s in range(0, max(1, len(words) - step), step):
        part = words[s : s + 2 * step]
        joined = b" " + b" ".join(part) + b" "
        there = D.shingles(part)
        for i, t in items:
            q, a = D.question_answer(t or "")
            if q or a:
                share = [1.0 if not p else float(b" " + b" ".join(p) + b" " in joined) if len(p) < 5 else len(D.shingles(p) & there) / len(D.shingles(p)) for p in (q, a)]
                if min(share) >= 0.8 - 1e-9:
                    out.add(i)
    return out


def made(seed, n_items=60, n_docs=120):
    r = random.Random(seed)
    vocabulary = ["the", "of", "and", "to"] * 20 + ["".join(r.choice("aeiorstln") for _ in range(r.randint(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, f"{say(r.randint(3, 40)).capitalize()}. {say(r.randint(1, 14)).capitalize()}.") for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        text = say(r.randint(0, 300))
        if r.random() < 0.6:
            words = r.choice(items)[1].split()
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            text += " " + " ".join(words).upper() + ", " + say(r.randint(0, 200))
        docs.append((i, text))
    return items, docs


def test_made_cases_against_brute_force():
    hit = 0
    for seed in range(3):
        items, docs = made(seed)
        index = D.ItemIndex(items)
        for _, text in docs:
            got = {f[0] for f in index.finds(text)}
            assert got == plain_finds(items, text)
            hit += bool(got)
    assert hit > 60


def test_retrieval_returns_all_above_threshold():
    items, docs = made(7)
    index = D.ItemIndex(items)
    for _, text in docs[:60]:
        terms = sorted({index.term[w] for w in D.normal_words(text) if w in index.term})
        scores = np.zeros(len(index.ids))
        for t in terms:
            i, x = index.postings[t]
            scores[i] += x
        want = set(np.flatnonzero(scores + 1e-9 >= index.threshold).tolist())
        assert {i for i, _ in index.retrieve(terms)} == want


def test_query_over_whole_table(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op5_decontamination(spark, sf).collect()
    assert {r.doc_id: set(r.item_ids) for r in rows} == {i: plain_finds(items, t) for i, t in docs.items()}
    assert any(r.contaminated for r in rows) and not all(r.contaminated for r in rows)


def test_nulls_repeats_and_empty_tables(spark):
    item = "What is the tallest tower of the old town by the sea? The lighthouse keeper's tower."
    docs = spark.createDataFrame([(1, f"Intro. {item} End.", 1), (1, f"Intro. {item} End.", 1), (2, None, 2), (3, "", 3), (None, "clean text " * 9000, 4)], "doc_id long, text string, score int")
    bench = spark.createDataFrame([(10, item), (11, item), (12, None), (13, " .. "), (None, item)], "item_id long, text string")
    rows = D.verdicts(docs, bench).collect()
    assert sorted((str(r.doc_id), r.item_ids) for r in rows) == [("1", [10, 11]), ("1", [10, 11]), ("2", []), ("3", []), ("None", [])]
    assert D.contamination(docs, bench).count() == 4
    assert D.keep_clean(docs, bench).count() == 3 and D.keep_clean(docs, bench.limit(0)).count() == 5
    assert D.verdicts(docs.limit(0), bench).count() == 0


def test_many_parts_give_what_one_gives_and_none_is_sent_with_another(spark, monkeypatch):
    items, docs = made(3, 40, 60)
    # items are rare words apart, so that windows of another length find the same
    items = [(i, " ".join(f"{w}{i}" for w in t.split()).replace(f".{i}", f"{i}.")) for i, t in items]
    docs = [(i % 50, f"{t} {items[i % 40][1] if i % 3 else ''}") for i, t in docs] + [(None, items[0][1]), (None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    facts = lambda df: sorted(str((r.doc_id, r.contaminated, r.n_items, r.item_ids)) for r in df.collect())
    one, clean, found = facts(D.verdicts(d, b)), sorted(map(str, D.keep_clean(d, b).collect())), sorted(str((r.doc_id, r.item_id)) for r in D.contamination(d, b).collect())
    monkeypatch.setattr(D, "MAX_ITEMS_BYTES", 400)
    assert len(list(D.benchmark_parts(b))) > 5
    verdicts = D.verdicts(d, b)
    assert facts(verdicts) == one and len([x for x in one if "True" in x]) > 30
    assert sorted(map(str, D.keep_clean(d, b).collect())) == clean
    assert sorted(str((r.doc_id, r.item_id)) for r in D.contamination(d, b).collect()) == found
    assert "MapInArrow" not in verdicts._jdf.queryExecution().executedPlan().toString(), "the parts ran before, one by one"
    sizes = [[len(t) for _, t in p] for p in D.benchmark_parts(b)]
    assert all(max(a) <= min(z) for a, z in zip(sizes, sizes[1:], strict=False)), "items of like length go together"
