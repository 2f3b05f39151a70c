"""Held-out accuracy, hard rows, and what the two classifiers are made of."""

from __future__ import annotations

import zlib

import pytest

from sparkloom.llm import quality as Q
from sparkloom.llm import simhash as S
from sparkloom.llm import toxicity as X
from sparkloom.llm.queries import op4_quality, op10_toxicity

SF = "/root/testdata/sf0.01"


def held_out_accuracy(spark, query, label):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    tested = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    return sum(a == b for a, b in tested) / len(tested)


def test_quality_on_held_out_rows(spark):
    assert held_out_accuracy(spark, op4_quality, "quality") >= 0.93


def test_toxicity_on_held_out_rows(spark):
    assert held_out_accuracy(spark, op10_toxicity, "toxic") >= 0.93


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 20, "x") for i in range(300)], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 2)) for i in range(300)], "doc_id long, quality int, toxic int")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) quality", "toxic")
    assert Q.fit(docs, labels).weights == Q.fit(docs, turned).weights


@pytest.mark.parametrize("rows", [[], [(1, 1)], [(1, None), (None, 0)]])
def test_few_or_no_labels(spark, rows):
    docs = spark.createDataFrame([(1, "a text", 1), (1, "a text", 2), (2, None, 3), (None, "", 4), (3, "w " * 200_000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    got = Q.predictions(docs, Q.fit(docs, labels)).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    toxic = labels.withColumnRenamed("quality", "toxic")
    got = X.predictions(docs, X.fit(docs, toxic)).collect()
    assert len(got) == 5 and {r.predicted for r in got} == {0}
    assert Q.predictions(docs.limit(0), Q.QualityModel(b"", b"", (0.0,) * 4)).count() == 0


def test_quality_uses_the_whole_text():
    good, bad = "the river runs slowly to the wide sea and nobody minds " * 4, "BUY!! NOW!! CHEAP!! PILLS!! " * 8
    rows = [(f"{i} {good}", 1) for i in range(40)] + [(f"{i} {bad}", 0) for i in range(40)]
    m = Q.QualityModel(Q._dictionary([t for t, y in rows if y], 4096), Q._dictionary([t for t, y in rows if not y], 4096), (0.0, 40.0, 0.0, 0.0), window=512)
    s = Q.Scorer(m)
    assert s.score(good) > 0.5 > s.score(bad)
    assert s.features(good * 20 + bad * 200)[0] < s.features(good * 20)[0]


def test_transducers():
    s = X.Scorer(X.ToxicityModel(words=("blockhead",), stems=("dunder",)))
    kinds = lambda t: [k for _, k in s.matches(t)]
    assert kinds("Such a blockhead.") == ["plain"]
    assert kinds("You are a dunderhead!") == ["aimed"] and kinds("dunder") == []
    assert kinds("He is not a blockhead") != ["plain"] and kinds("It was not some blockhead thing") == ["negated"]
    assert kinds("She said that blockhead left") == ["reported"]
    assert kinds("I will kill you") == ["aimed"] and kinds("They kill time. Fine") == ["aimed"] and kinds("to kill the process") == []
    assert kinds("not here. Blockhead") == ["plain"], "negation ends with its clause"
    assert s.matches(None) == s.matches("") == []


def test_stems_are_learned_from_few_rows():
    rows = [(f"fine words number{i} quietly stand here", 0) for i in range(80)] + [(f"fine words grumbl{e} stand number{i}", 1) for i, e in enumerate(["ey", "os", "ik", "ant", "ur"] * 6)]
    words, stems = X.learn_insults(rows)
    assert stems == ["grumbl"] and words == []


def plain_toxicity(model, text):
    """The score by the grammar's definition, word by word, without transducers."""
    import math
    import re

    units = dict(model.units)

    def hit(w):
        for s in model.stems:
            if w.startswith(s) and len(w) > len(s):
                return "insult", units[s + "*"]
        for s in model.families:
            if w.startswith(s) and len(w) > len(s):
                return "slur", 1.0
        if w in model.words:
            return "insult", units[w]
        return ("threat", 1.0) if w in X.THREAT_WORDS else (None, 0.0)

    total = dict.fromkeys(X.KINDS, 0.0)
    low = (text or "").lower()
    for clause in re.split(r"[.!?;:\n]+", low):
        words = re.findall(r"[^\W\d_]+", clause)
        for i, w in enumerate(words):
            what, weight = hit(w)
            if what is None:
                continue
            lists = [X.TARGET_WORDS, X.NEGATION_WORDS, X.REPORT_WORDS]
            near = [{v for v in part if v in names and hit(v)[0] is None} for part, names in zip((words[:i] + words[i + 1 : i + 5], words[max(0, i - 4) : i], words[:i]), lists)]
            kind = "reported" if near[2] else "negated" if near[1] else "aimed" if near[0] else "plain"
            if what == "slur":
                total["slurs"] += X.PRIOR[X.KINDS.index(kind)]
            elif what == "threat":
                total["threat"] += kind == "aimed"
            else:
                total[kind] += weight
    x = [min(1.0, total[k]) + 0.25 * math.log1p(max(0.0, total[k] - 1)) for k in X.KINDS[:-1]]
    usual = len(re.findall(r"[^\W\d_]+", low)) * model.usual
    x.append(min(1.0, max(0.0, (total["slurs"] - usual) / math.sqrt(usual + 0.5) / 4)) if total["slurs"] else 0.0)
    z = model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], x, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def sampled(spark, label, per_class):
    """The labelled rows that may be learnt from, by plain Python (tables smaller than the bounds: all of them)."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [(r.doc_id, r[label]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    assert all(sum(y == c for _, y in rows) < n for c, n in per_class.items())
    return [(texts[i], y) for i, y in sorted(rows) if i in texts and y is not None]


def test_toxicity_query_against_plain_rules(spark):
    model = X.fit_rows(sampled(spark, "toxic", X.SAMPLE))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op10_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = plain_toxicity(model, texts[r.doc_id])
        assert abs(r.score - want) < 1e-9 and r.predicted == (want >= 0.7)


def test_quality_query_against_plain_compression(spark):
    import math

    import zstandard

    model = Q.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))

    def size(text, dictionary):
        raw = text.encode()
        z = lambda piece: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=False, write_content_size=False).compress(piece)
        return sum(len(z(raw[k : k + 2048])) - 6 for k in range(0, len(raw), 2048))

    rows = {r.doc_id: r for r in op4_quality(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted(rows) == sorted(d.doc_id for d in docs)
    for d in docs:
        text = d.text or ""
        good, bad = size(text, model.good), size(text, model.bad)
        diff, ratio = ((bad - good) / (bad + good + 8), math.log((good + 8) / (len(text.encode()) + 8))) if text else (0.0, 0.0)
        z = sum(a * b for a, b in zip(model.weights, (1, diff, ratio, diff * ratio), strict=True))
        assert abs(rows[d.doc_id].score - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) < 1e-9


def test_composed_machine_equals_its_parts_in_turn():
    import random

    r = random.Random(3)
    parts = [X.reported_speech(), X.negation(), X.target_before()]
    whole = parts[0].then(parts[1]).then(parts[2])
    for _ in range(300):
        symbols = [r.randrange(7) for _ in range(r.randrange(12))]
        one_by_one = symbols
        for p in parts:
            one_by_one = p.run(one_by_one)
        assert whole.run(symbols) == one_by_one


def test_families_need_many_of_their_words():
    ends = ["ab", "ec", "id", "of", "ug", "ah", "ei", "oj"]
    fine = " ".join(f"word{e} stands{e} here{e}" for e in ends)
    toxic = [(" ".join(f"grumbl{ends[(i + k) % 8]}" for k in range(3)) + f" {fine} {i}", 1) for i in range(30)]
    clean = [(f"{fine} quiet {i}" + (" grumblab" if i % 9 == 0 else ""), 0) for i in range(200)]
    families, usual = X.learn_families(toxic + clean)
    assert families == ["grumbl"] and 0 < usual < 0.01
    s = X.Scorer(X.ToxicityModel(families=tuple(families), usual=usual))
    assert s.score(toxic[0][0]) > 0.8 > 0.5 > s.score(fine * 3 + " grumblab")
    assert s.features("not grumblab")[-1] < s.features("grumblab")[-1]


def test_near_copies_of_a_sample_count_once_but_never_across_labels():
    a, b = "one text of many different words that goes on " * 5, "another one that shares no shingle with it at all " * 5
    assert S.distinct_texts([(a, 1), (a, 1), (b, 1), (a, 0)]) == [(a, 0), (a, 1), (b, 1)]
    head = "the very same beginning of more than two hundred letters stands before two different texts " * 3
    assert len(S.distinct_texts([(head + a * 5, 1), (head + b * 5, 1)])) == 2
