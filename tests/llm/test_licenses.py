"""Scans against a plain search at every place."""

from __future__ import annotations

import math
import re

from sparkloom.llm import licenses as L
from sparkloom.llm.queries import op8_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, df, n):
    """(n_words, n_base, first, last, base labels, labels, score) by trying every template at every place."""
    ws = lower_words(text)
    base = [(i, lab) for p, lab in L.BASE.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    own = []
    for label, t, keys in L.TEMPLATES:
        tw = lower_words(t)
        idf = [math.log(1 + (n - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5)) for w in tw]
        for s in range(1 - len(tw), len(ws)):
            ok = [0 <= s + i < len(ws) and ws[s + i] == w for i, w in enumerate(tw)]
            if ok.count(False) <= math.floor(0.2 * len(tw)):
                inside = " ".join(ws[max(0, s) : s + len(tw)])
                if all(f" {' '.join(lower_words(k))} " in f" {inside} " for k in keys):
                    own.append((label, sum(w for w, o in zip(idf, ok, strict=True) if o) / sum(idf)))
    labels = {lab for _, lab in base}
    at = [i for i, _ in base]
    return (len(ws), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x for x, _ in own})), round(min(1.0, max([1.0 if base else 0.0, *(s for _, s in own)])), 9))


def rows_of(df):
    return [(r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))) for r in df.collect()]


def check(docs, got):
    df = {}
    for _, t in docs:
        for w in set(lower_words(t)):
            df[w] = df.get(w, 0) + 1
    assert sorted(got, key=str) == sorted(((i, plain(t, df, len(docs))) for i, t in docs), key=str)


def test_query_over_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = rows_of(op8_licenses(spark, sf))
    check(docs, got)
    assert any(g[1] for _, g in got)


def test_hard_texts_nulls_repeats_and_empty_table(spark):
    texts = [
        None, "", "MIT License", "mit-license mit license MIT LICENSE", "Released under the MIT License.", "released beneath the mit license", "license mit",
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY NC", "This work is licensed under the GNU General Public License, version 3.", "licensed by the gnu lesser general public license",
        "copyright all rights reserved " * 50, "general public license general public license", "word " * 50_000 + "apache license", "é license mit\x00license", "mit license" * 2,
    ]
    docs = [*enumerate(texts), (4, texts[4]), (None, "apache license")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, labels string")
    check(docs, rows_of(L.scan(df)))
    assert L.scan(df.limit(0)).count() == 0


def test_rights_reserved_without_copyright_directly_before(spark):
    texts = ["All rights reserved.", "Copyright 2020 X. All rights reserved.", "copyright all rights reserved", "all rights are reserved", "Copyright 2020 X"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in L.scan(df).collect()}
    assert got == {0: ("all-rights-reserved", 1.0), 1: ("all-rights-reserved", 1.0), 2: ("all-rights-reserved", 1.0), 3: ("", 0.0), 4: ("", 0.0)}


def test_whole_licences_survive_inserted_and_missing_words(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files, to deal in the
    Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
    copies of the Software. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
    words = mit.split()
    texts = [mit, " ".join([*words[:8], "really", *words[8:]]), " ".join(words[:20] + words[22:]), " ".join(words[:5]), "# " + " \n# ".join(words)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, len(r.matches)) for r in L.scan(df).collect()}
    assert [got[i][0] for i in range(5)] == ["mit", "mit", "mit", "", "mit"]
    assert got[0][1] == 3 and got[1][1] >= 2 and got[4][1] == 3
