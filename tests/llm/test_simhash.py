"""Fingerprints and components against brute force over all pairs."""

from __future__ import annotations

import random

import xxhash

from sparkloom.llm import simhash as S
from sparkloom.llm.queries import op9_simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows):
    """{id: smallest id reachable} by trying all pairs."""
    least = {i: i for i, _ in rows}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for n, (i, f) in enumerate(rows):
        for j, g in rows[:n]:
            if (f ^ g).bit_count() <= 4:
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in rows}


def test_fingerprint_of_hard_texts():
    for t in (None, "", " \t ", "One", "a b c", "a b c d", "A  b\x0bC d e", "é É ß " * 9, "w " * 70_000, "x y z u v"):
        assert S.fingerprint(t) == plain_fingerprint(t)


def test_query_over_whole_table(spark, sf):
    rows = sorted((r.doc_id, plain_fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = plain_components(rows)
    got = op9_simhash(spark, sf).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == [(i, f"{f:016x}", want[i]) for i, f in rows]


def planted(seed, groups=12, size=25, chain=30):
    """Fingerprints in tight clusters, chains of small steps, and single ones."""
    r = random.Random(seed)
    flip = lambda f, n: f ^ sum(1 << b for b in r.sample(range(64), n))
    out = [r.getrandbits(64) for _ in range(200)]
    for _ in range(groups):
        c = r.getrandbits(64)
        out += [flip(c, r.randint(0, 3)) for _ in range(size)]
    f = r.getrandbits(64)
    for _ in range(chain):
        f = flip(f, 4)
        out.append(f)
    return out


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def test_links_keep_every_chain_also_when_keys_are_crowded(spark):
    for seed, how in ((1, {}), (2, {"hot": 6, "chunk": 3}), (3, {"hot": 2, "chunk": 2, "blocks": 6})):
        fps = sorted(set(planted(seed)))
        nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
        roots = {r.node: r.root for r in S.components(S.close_links(nodes, **how)).collect()}
        want = plain_components(list(enumerate(fps)))
        groups = {}
        for i, f in enumerate(fps):
            groups.setdefault(want[i], set()).add(roots.get(signed(f), signed(f)))
        assert all(len(g) == 1 for g in groups.values())
        assert len(set.union(*groups.values())) == len(groups)


def test_dense_group_gives_a_forest_not_all_pairs(spark):
    r = random.Random(4)
    c = r.getrandbits(64)
    fps = sorted({c ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)})
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links = S.close_links(nodes)
    assert links.count() < 60 * len(fps) < len(fps) * (len(fps) - 1) // 2


def test_keep_one_nulls_repeats_and_empty_table(spark):
    text = "the quick brown fox jumps over the lazy dog again and again " * 3
    rows = [(5, text, "a"), (2, text.upper(), "b"), (2, text.upper(), "b"), (9, None, "c"), (7, "", "d"), (None, text, "e"), (8, "quite another text altogether here", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.fp) for r in kept.collect()) == [("2", "b"), ("7", "d"), ("8", "f"), ("None", "e")]
    found = {(r.id, r.component) for r in S.near_duplicates(docs).collect()}
    assert (5, 2) in found and (None, 2) in found and (9, 7) in found
    assert S.near_duplicates(docs.limit(0)).count() == 0 and S.keep_one(docs.limit(0)).count() == 0


def test_keep_one_judges_rows_not_ids(spark):
    a, b = "a text that stands alone here " * 4, "quite different words in this other one " * 4
    kind = "doc_id long, text string, id int, m map<string,int>"
    rows = [(5, a, 1, None), (5, b, 2, None), (3, b, 3, None), (9, a, 4, None)]
    kept = lambda rows: sorted((r.doc_id, r.text, r.id) for r in S.keep_one(spark.createDataFrame(rows, kind)).collect())
    assert kept(rows) == [(3, b, 3), (5, a, 1)]
    # an id that repeats with two texts, each the first of its group
    assert kept([(5, a, 1, None), (5, b, 2, None)]) == sorted([(5, a, 1), (5, b, 2)])
    # rows equal in id and text: the least by the other columns; rows without an id stay
    assert kept([(1, a, 7, {"x": 1}), (1, a, 6, None), (1, a, 8, None)]) == [(1, a, 6)]
    got = S.keep_one(spark.createDataFrame([(None, a, 1, None), (None, a, 2, None), (None, b, 3, None), (4, b, 4, None)], kind)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("None", a), ("None", a), ("None", b), ("4", b)])
