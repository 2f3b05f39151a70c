"""Exact blocks of hard notes, the grammar of groups against a plain walk, wrappers, and one very long document."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import markdown as M

P, H, C, Q, U, O, T, W, R, I = "paragraph", "heading", "code", "blockquote", "unordered_list_item", "ordered_list_item", "table", "html", "thematic_break", "image"
#: note: its blocks as (kind, level, depth, first line, last line, language, text)
NOTES = {
    "": [],
    "\n \n": [],
    "- a\n  - b\n\n    c\n- d": [(U, None, 0, 1, 4, None, "a"), (U, None, 1, 2, 4, None, "b"), (P, None, 2, 4, 4, None, "c"), (U, None, 0, 5, 5, None, "d")],
    "> a\nb\n\nc": [(Q, None, 0, 1, 2, None, "a\nb"), (P, None, 0, 4, 4, None, "c")],
    "> - a\nlazy": [(Q, None, 0, 1, 2, None, ""), (U, None, 1, 1, 2, None, "a\nlazy")],
    "Title\n=====\ntext": [(H, 1, 0, 1, 2, None, "Title"), (P, None, 0, 3, 3, None, "text")],
    "a\n\n    code\n\n      more\n\nb": [(P, None, 0, 1, 1, None, "a"), (C, None, 0, 3, 5, None, "code\n\n  more"), (P, None, 0, 7, 7, None, "b")],
    "a\n    not code": [(P, None, 0, 1, 2, None, "a\nnot code")],
    "```\nunclosed\n": [(C, None, 0, 1, 2, None, "unclosed")],
    "~~~ js x\n```\n~~~\n": [(C, None, 0, 1, 3, "js", "```")],
    "  ```\n   x\n ```": [(C, None, 0, 1, 3, None, " x")],
    "```a`b\nx": [(P, None, 0, 1, 2, None, "```a`b\nx")],
    "1. a\n2. b\n10) c": [(O, None, 0, 1, 1, None, "a"), (O, None, 0, 2, 2, None, "b"), (O, None, 0, 3, 3, None, "c")],
    "text\n2. no list": [(P, None, 0, 1, 2, None, "text\n2. no list")],
    "text\n1. list": [(P, None, 0, 1, 1, None, "text"), (O, None, 0, 2, 2, None, "list")],
    "text\n-": [(H, 2, 0, 1, 2, None, "text")],
    "text\n*": [(P, None, 0, 1, 2, None, "text\n*")],
    "-\n  a": [(U, None, 0, 1, 2, None, "a")],
    "***\n---\n_ _ _": [(R, None, 0, 1, 1, None, "***"), (R, None, 0, 2, 2, None, "---"), (R, None, 0, 3, 3, None, "___")],
    "# h #\n## b ##\n#no\n####### no": [(H, 1, 0, 1, 1, None, "h"), (H, 2, 0, 2, 2, None, "b"), (P, None, 0, 3, 4, None, "#no\n####### no")],
    "#\n# a # b": [(H, 1, 0, 1, 1, None, ""), (H, 1, 0, 2, 2, None, "a # b")],
    "| a |\n| - |\n| b | c |\n\nend": [(T, None, 0, 1, 3, None, "a\nb"), (P, None, 0, 5, 5, None, "end")],
    "intro\n| a | b\\|c |\n| - | :-: |\nx\n> q": [(P, None, 0, 1, 1, None, "intro"), (T, None, 0, 2, 4, None, "a | b|c\nx | "), (Q, None, 0, 5, 5, None, "q")],
    "| a | b |\n| - |": [(P, None, 0, 1, 2, None, "| a | b |\n| - |")],
    "<!-- a\n\nb -->\nc": [(W, None, 0, 1, 3, None, "<!-- a\n\nb -->"), (P, None, 0, 4, 4, None, "c")],
    "<div>\n*x*\n\ny": [(W, None, 0, 1, 2, None, "<div>\n*x*"), (P, None, 0, 4, 4, None, "y")],
    "text\n<span>": [(P, None, 0, 1, 2, None, "text\n<span>")],
    "<span class='a'>\nx": [(W, None, 0, 1, 2, None, "<span class='a'>\nx")],
    "![alt](a.png)\n\n[![x](y)](z)\n\n![a](b) c": [(I, None, 0, 1, 1, None, "![alt](a.png)"), (I, None, 0, 3, 3, None, "[![x](y)](z)"), (P, None, 0, 5, 5, None, "![a](b) c")],
    "[foo]: /url \"t\"\nbar": [(P, None, 0, 2, 2, None, "bar")],
    "[foo]: /url": [],
    "\tcode\n\n\t\tmore": [(C, None, 0, 1, 3, None, "code\n\n    more")],
    "- a\n\n\tb": [(U, None, 0, 1, 3, None, "a"), (P, None, 1, 3, 3, None, "b")],
    "> ```\n> x\n\ny": [(Q, None, 0, 1, 2, None, ""), (C, None, 1, 1, 2, None, "x"), (P, None, 0, 4, 4, None, "y")],
    "* a\n* b\n\n\n* c\n\n- d": [(U, None, 0, 1, 1, None, "a"), (U, None, 0, 2, 4, None, "b"), (U, None, 0, 5, 6, None, "c"), (U, None, 0, 7, 7, None, "d")],
    "a  \nb": [(P, None, 0, 1, 2, None, "a\nb")],
    "> # h\n> > deep\n> end": [(Q, None, 0, 1, 3, None, ""), (H, 1, 1, 1, 1, None, "h"), (Q, None, 1, 2, 3, None, "deep\nend")],
    "- # h\n  text": [(U, None, 0, 1, 2, None, ""), (H, 1, 1, 1, 1, None, "h"), (P, None, 1, 2, 2, None, "text")],
    "   - a\n  b": [(U, None, 0, 1, 2, None, "a\nb")],
    "- a\n\n      code\n  b": [(U, None, 0, 1, 4, None, "a"), (C, None, 1, 3, 3, None, "code"), (P, None, 1, 4, 4, None, "b")],
    "1. ```sh\n   ls\n   ```\n2. x": [(O, None, 0, 1, 3, None, ""), (C, None, 1, 1, 3, "sh", "ls"), (O, None, 0, 4, 4, None, "x")],
    "> a\n\n> b": [(Q, None, 0, 1, 1, None, "a"), (Q, None, 0, 3, 3, None, "b")],
    "> a\n---": [(Q, None, 0, 1, 1, None, "a"), (R, None, 0, 2, 2, None, "---")],
    "a\r\n\r\n# b": [(P, None, 0, 1, 1, None, "a"), (H, 1, 0, 3, 3, None, "b")],
}


@pytest.mark.parametrize("note", NOTES)
def test_blocks_of_hard_notes(note):
    assert M.blocks_of(note) == NOTES[note]


def test_blocks_as_rows_with_nulls_and_long_texts(spark):
    rows = [(k, t, 1) for k, t in enumerate(NOTES)] + [(1000, None, 1), (1001, "- x\n" * 30_000, 1), (None, "a", 1)]
    began = time.time()
    got = M.blocks(spark.createDataFrame(rows, "doc_id long, text string, block int")).collect()
    assert time.time() - began < 60
    for k, t in enumerate(NOTES):
        assert [tuple(r)[2:] for r in sorted((r for r in got if r.doc_id == k), key=lambda r: r.block)] == NOTES[t]
    assert sum(r.doc_id == 1001 for r in got) == 30_000 and sum(r.doc_id is None for r in got) == 1 and not any(r.doc_id == 1000 for r in got)


def test_inline_text_and_targets(spark):
    cases = [
        ("a **b** _c_ `d*e*` \\*f\\*", "a b c d*e* *f*", [], []),
        ("see [the *x*](http://a/b) and <https://c.d/e>", "see the x and https://c.d/e", ["http://a/b", "https://c.d/e"], []),
        ("![pic](p.png \"t\") [![i](j.png)](k)", "pic i", ["k"], ["p.png", "j.png"]),
        ('<a href="u">t</a><img src=v.png>', '<a href="u">t</a><img src=v.png>', ["u"], ["v.png"]),
        ("snake_case_name 2*3*4", "snake_case_name 2*3*4", [], []),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, t string")
    found = M.targets(F.col("t"))
    got = {r.k: (r.said, r.links, r.images) for r in df.select("k", M.inline_text(F.col("t")).alias("said"), found["links"].alias("links"), found["images"].alias("images")).collect()}
    assert [got[k] for k in range(len(cases))] == [c[1:] for c in cases]


def walk_groups(letters):
    """The grammar as a walk from block to block."""
    out, k = [], 0

    def result(k):
        if letters[k : k + 1] == "R":
            k += 1
        return k + (letters[k : k + 1] == "T")

    while k < len(letters):
        a = k
        if letters[k] == "H":
            k += 1
            if letters[k : k + 1] in ("C", "R"):
                k = result(k + 1)
            elif letters[k : k + 1] == "T":
                k += 1
                if letters[k : k + 1] in ("C", "R"):
                    k = result(k + 1)
        elif letters[k] in "CR":
            k = result(k + 1)
        elif letters[k + 1 : k + 2] in ("C", "R"):
            k = result(k + 2)
        else:
            k += 1
        out.append(letters[a:k])
    return out


def test_pattern_of_groups_is_the_walk():
    r = random.Random(4)
    for _ in range(3000):
        letters = "".join(r.choices("HCRT", k=r.randint(1, 14)))
        assert [m[0] for m in re.finditer(M.GROUP, letters)] == walk_groups(letters)


def document(r, n):
    kinds = r.choices(["heading", "code", "code", "paragraph", "paragraph", "table"], k=n)
    return [(k, kind, r.randint(1, 3) if kind == "heading" else None, k + 1, k + 1, ("sudo x " if kind == "code" and r.random() < 0.5 else "say ") + "y" * r.randint(0, 40)) for k, kind in enumerate(kinds)]


def plain_segments(blocks, limit):
    """(section, pack, first, last, size, oversized) by plain loops."""
    heads = [(k, b[2]) for k, b in enumerate(blocks) if b[1] == "heading"]
    cuts = []
    if heads:
        first, top = heads[0]
        later = [level for _, level in heads[1:]]
        if top == 1 and later and min(later) > 1:
            cuts = [first, *(k for k, level in heads[1:] if level <= min(later))]
        else:
            low = None
            for k, level in heads:
                if low is None or level <= low:
                    cuts.append(k)
                    low = level
    out = []
    edges = sorted({0, *cuts, len(blocks)})
    for section, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
        part = blocks[a:z]
        letters = "".join("H" if b[1] == "heading" else ("C" if b[5].startswith("sudo") else "R") if b[1] == "code" else "T" for b in part)
        packs, at = [], a
        for g in walk_groups(letters):
            size = sum(len(b[5]) for b in blocks[at : at + len(g)]) + 2 * (len(g) - 1)
            if packs and packs[-1][2] + 2 + size <= limit:
                packs[-1] = (packs[-1][0], at + len(g) - 1, packs[-1][2] + 2 + size, packs[-1][3] or size > limit)
            else:
                packs.append((at, at + len(g) - 1, size, size > limit))
            at += len(g)
        out += [(section, n, *p) for n, p in enumerate(packs)]
    return out


def test_segments_against_loops(spark):
    r = random.Random(9)
    docs = {d: document(r, r.randint(1, 60)) for d in range(80)}
    docs[80] = [(0, "paragraph", None, 1, 1, "only")]
    rows = [(d, *b) for d, bs in docs.items() for b in bs]
    df = spark.createDataFrame(rows, "doc_id long, block long, kind string, level int, start_line long, end_line long, text string").repartition(5)
    got = {}
    for s in M.segments(df, 100).collect():
        got.setdefault(s.doc_id, []).append((s.section, s["pack"], s.first_block, s.last_block, s.n_chars, s.oversized))
        assert s.text == "\n\n".join(b[5] for b in docs[s.doc_id][s.first_block : s.last_block + 1])
    assert {d: sorted(x) for d, x in got.items()} == {d: plain_segments(bs, 100) for d, bs in docs.items()}


def test_a_document_of_100000_blocks_takes_linear_time(spark):
    rows = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("block"), F.when(F.col("id") % 50 == 0, "heading").when(F.col("id") % 5 == 1, "code").otherwise("paragraph").alias("kind"), F.when(F.col("id") % 50 == 0, 2).alias("level"), F.col("id").alias("start_line"), F.col("id").alias("end_line"), F.concat(F.lit("sudo "), F.col("id").cast("string")).alias("text"))
    began = time.time()
    one = M.segments(rows.withColumn("level", F.when(F.col("block") == 0, 1).when(F.col("kind") == "heading", 1)), 2000).agg(F.count("*"), F.sum("n_chars"), F.max("last_block")).first()
    assert one[2] == 99_999 and one[0] >= 2000 and time.time() - began < 60


def test_wrappers_in_odd_shapes(spark):
    blocks = [
        ("html", "<div align='center'><p>a</p>", "a", "unwrapped"),
        ("html", "</p>", "</p>", "closing"),  # any closing tag of the two ends an open wrapper
        ("html", "</div>", "</div>", "kept"),
        ("html", "text <div align=center>b</div>", "text <div align=center>b</div>", "kept"),
        ("html", "<div align=center>b</div><br>", "<div align=center>b</div><br>", "kept"),
        ("html", "<img src=a><div align=center>b</div>", "<img src=a><div align=center>b</div>", "kept"),
        ("html", "<div align=center><img src=x.png></div>", "x.png", "unwrapped"),
        ("paragraph", "plain < text", "plain < text", "kept"),
        ("paragraph", None, None, "kept"),
        ("html", "<DIV ALIGN=CENTER>\n  a \t b\n\n<ul><li>c</li></ul></DIV>", "a b\nc", "unwrapped"),
    ]
    df = spark.createDataFrame([(1, k, b[0], b[1]) for k, b in enumerate(blocks)], "doc_id int, block int, kind string, text string")
    got = sorted(M.unwrapped(df).collect(), key=lambda r: r.block)
    assert [(r.visible, r.role) for r in got] == [b[2:] for b in blocks]
    assert M.unwrapped(df.limit(0)).count() == 0


def frame(spark, blocks):
    return spark.createDataFrame([(1, k, *b) for k, b in enumerate(blocks)], "doc_id int, block long, kind string, level int, start_line long, end_line long, text string")


def test_profiles(spark):
    page = [(P, None, 1, 1, "menu"), (H, 2, 2, 2, "Previous"), (H, 1, 3, 3, "Title"), (P, None, 5, 6, "body"), (C, None, 7, 9, "next"), (U, None, 10, 10, " Ad  Blocker\nDetected "), (P, None, 12, 12, "after")]
    got = M.profiled(frame(spark, page), "scraped").orderBy("block").collect()
    assert [r.text for r in got] == ["Title", "body", "next"]
    assert M.profiled(frame(spark, page[:2]), "scraped").count() == 2  # no title: all stays
    note = [(P, None, 1, 4, "Tags: #a [[no]]\nSee also: [[Other|x]] https://h/p\nkept ![[pic.png|a picture]] [[Link]]\n"), (P, None, 6, 6, "![[only.png]]"), (C, None, 7, 9, "![[code]]\ntags: y"), (H, 1, 10, 10, "tags: heading")]
    rows = M.profiled(frame(spark, note), "notes").orderBy("block", "part").collect()
    assert [(r.block, r.kind, r.start_line, r.end_line, r.text) for r in rows] == [(0, P, 3, 3, "kept a picture [[Link]]"), (1, I, 6, 6, "only.png"), (2, C, 7, 9, "![[code]]\ntags: y"), (3, H, 10, 10, "tags: heading")]
    relations = {(r.target, r.relation, r.line) for r in M.note_relations(frame(spark, note)).collect()}
    assert relations == {("Other", "link", 2), ("https://h/p", "link", 2), ("pic.png", "asset", 3), ("Link", "link", 3), ("only.png", "asset", 6)}
    centred = [(W, None, 1, 1, '<div align="center">'), (H, 1, 2, 2, "t"), (W, None, 3, 3, "<p align=center><b>x</b></p>"), (W, None, 4, 4, "</div>")]
    assert [(r.kind, r.text) for r in M.profiled(frame(spark, centred), "centred").orderBy("block").collect()] == [(H, "t"), (P, "x")]
    with pytest.raises(ValueError, match="unknown profile"):
        M.profiled(frame(spark, page), "other")
