"""The prefix-tree join against all pairs of plain word sets."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import ngram_join
from sparkloom.llm.queries import op12_ngram_join

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def word_set(text):
    w = [x for x in SPACE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    """[(id, set size, component)] of (id, text) rows by comparing all distinct sets."""
    sets = [word_set(t) for _, t in rows]
    of = {}
    for k, s in enumerate(sets):
        of.setdefault(frozenset(s), []).append(k)
    kinds = [s for s in of if s]
    parent = {s: s for s in kinds}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for k, a in enumerate(kinds):
        for b in kinds[:k]:
            both = len(a & b)
            if both and 100 * both >= 85 * (len(a) + len(b) - both):
                parent[root(a)] = root(b)
    ids = {}
    for s in kinds:
        ids.setdefault(root(s), set()).update(rows[k][0] for k in of[s] if rows[k][0] is not None)
    return sorted(str((i, len(s), min(ids[root(frozenset(s))], default=None) if s else i)) for (i, _), s in zip(rows, sets, strict=True))


def found(df):
    return sorted(str((r.id, r.n, r.component)) for r in df.collect())


def test_query_over_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op12_ngram_join(spark, sf)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)


def edited(r, words, n):
    out = list(words)
    for k in r.integers(0, len(out), n):
        out[k] = f"new{r.integers(0, 10**9)}"
    return out


def corpus():
    """Copies around the threshold, a chain whose ends share nothing, templates, a common passage, short and odd texts."""
    r = np.random.default_rng(5)
    text = lambda n: [f"w{x}" for x in r.integers(0, 400, n)]
    rows, passage, template = [], text(30), text(120)
    for base in (text(60), text(200)):
        rows += [" ".join(edited(r, base, k % 7)) for k in range(40)]
    link = text(80)
    for k in range(60):
        link = link[1:] + [f"c{k}"]
        rows.append(" ".join(link))
    rows += [" ".join(template[:60] + text(6 + k % 9) + template[60:]) for k in range(40)]
    rows += [" ".join(text(40) + passage + text(40)) for _ in range(40)]
    rows += ["", None, " \t\n", "one", "ONE", "one two", "one  two", "a b c", "a b c d", "A b\tc d", "É b c d", "é b c d", "x " * 3000, "x " * 2500, "   ", "z z a b c"]
    rows += [" ".join(f"long{k}" for k in range(30_000)), " ".join(f"long{k}" for k in range(29_000))]
    return rows


@pytest.mark.parametrize("room", (300, ngram_join.ROOM))
def test_copies_chains_templates_nulls_and_repeats(spark, room):
    rows = [(1000 - k, t) for k, t in enumerate(corpus())]
    rows += [(5, rows[3][1]), (5, rows[90][1]), (5, "one"), (None, rows[0][1]), (None, "nobody else says this"), (7, None), (7, None), rows[1], rows[1]]
    df = spark.createDataFrame([(*x, 1, [2]) for x in rows], "doc_id long, text string, n int, marks array<int>").repartition(3)
    assert found(ngram_join.similar(df, room=room)) == brute(rows)
    assert ngram_join.similar(df.limit(0)).count() == 0
    assert found(ngram_join.similar(df.where("text is null"))) == brute([x for x in rows if x[1] is None])


def test_prefixes_alone_find_every_pair(spark, monkeypatch):
    rows = list(enumerate(corpus()))
    monkeypatch.setattr(ngram_join, "MARKS", 0)
    monkeypatch.setattr(ngram_join, "BROADCAST_NODES", 0)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(ngram_join.similar(df)) == brute(rows)


def test_tries_share_paths_and_leave_what_cannot_reach(monkeypatch):
    r = np.random.default_rng(2)
    base, counts = r.integers(0, 1 << 63, 400).astype(np.uint64), np.zeros(1 << ngram_join.BUCKET_BITS, np.int64)
    sets = [np.unique(np.concatenate([base[r.random(400) > 0.02 * (k % 12)], r.integers(0, 1 << 63, k % 9).astype(np.uint64)])) for k in range(200)]
    sets += [np.unique(r.integers(0, 1 << 63, 300).astype(np.uint64)) for _ in range(100)]
    np.add.at(counts, ngram_join._bucket(np.concatenate(sets)), 1)
    group = ngram_join.Group(list(range(300)), sets, list(range(300)), counts)
    t = group.trie
    assert sorted(k for k in t.end if k >= 0) == list(range(300))
    assert sum(b - a for a, b in zip(t.from_, t.to, strict=True)) < 0.98 * sum(map(len, sets))  # shared paths are stored once
    links = group.links(list(range(300)), sets, list(range(300)))

    def similar(a, b):
        both = len(np.intersect1d(sets[a], sets[b]))
        return 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both)

    assert all(similar(a, b) for a, b in links)
    labels = list(range(300))
    for a, b in ((a, b) for a in range(300) for b in range(a) if similar(a, b)):
        labels = [labels[b] if x == labels[a] else x for x in labels]
    assert len(links) == 300 - len(set(labels))  # a spanning forest
    for a, b in links:
        assert labels[a] == labels[b]
    joined = ngram_join.Group(list(range(300)), sets, [7] * 300, counts)
    assert len(joined.links([1000, 1001], [sets[0], sets[250][:200]], [8, 9])) == 1 and joined.visited < 600
    assert joined.links([5, 6], [sets[0], sets[250]], [7, 8]) == []  # joined already, the second by the first walk


def test_sets_of_slices_are_those_of_each_text_alone():
    r = np.random.default_rng(3)
    texts = corpus() + ["".join(r.choice(list("aBc é\t\n\x0b\x0c\r \x1c\u00a0ß"), 40)) for _ in range(300)]
    whole = pa.array(texts, pa.string())
    ids = {}

    def plain(text):  # one number for each distinct n-gram
        return len(word_set(text))

    for start, n in ((0, len(texts)), (7, 50), (120, 200), (len(texts) - 5, 5), (3, 0)):
        got = ngram_join.ngram_sets(whole.slice(start, n))
        assert len(got) == n
        for text, s in zip(texts[start : start + n], got, strict=True):
            assert len(s) == plain(text) and ids.setdefault(frozenset(word_set(text)), s.tobytes()) == s.tobytes()
    assert len({*ids.values()}) == len(ids)


def test_prefixes_share_enough():
    r = np.random.default_rng(8)
    counts = r.integers(0, 50, 1 << ngram_join.BUCKET_BITS)
    for _ in range(300):
        n, extra = int(r.integers(1, 300)), int(r.integers(0, 20))
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[r.random(len(x)) > 0.08], r.integers(0, 1 << 63, extra).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= 85 * (len(x) + len(y) - both):
            shared = len(np.intersect1d(ngram_join.prefix(x, counts), ngram_join.prefix(y, counts)))
            assert shared >= ngram_join.least_shared(-(-85 * len(x) // 100)) and shared >= ngram_join.least_shared(min(len(x), len(y)))
