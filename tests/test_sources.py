"""Files, journals, versioned tables."""

from __future__ import annotations

import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import exprs as X
from sparkloom.operators import text as T
from sparkloom.sources import files, versioned


def test_inventory_and_verification(spark, tmp_path):
    for name, body in {"a/x.md": b"one", "a/b/Y.MD": b"two", "c.pdf": b"%PDF", "c.txt": b"no"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    got = files.inventory(spark, str(tmp_path)).collect()
    assert [r.relative for r in got] == ["a/b/Y.MD", "a/x.md", "c.pdf"]
    assert got[1].sha256 == hashlib.sha256(b"one").hexdigest() and got[1].source_id == str(uuid.uuid5(uuid.NAMESPACE_URL, "a/x.md"))
    snapshot = spark.createDataFrame([(r.relative, r.sha256) for r in got], "relative string, sha256 string")
    (tmp_path / "a/x.md").write_bytes(b"changed")
    (tmp_path / "c.pdf").unlink()
    states = {r.relative: r.state for r in files.verified(files.inventory(spark, str(tmp_path)), snapshot).collect()}
    assert states == {"a/b/Y.MD": "same", "a/x.md": "changed", "c.pdf": "gone"}


def test_journal_sets_torn_and_long_lines_aside(spark, tmp_path):
    good = json.dumps({"event_id": "e1", "sequence": 1, "type": "t", "payload": "{}"})
    long = json.dumps({"event_id": "e2", "sequence": 2, "payload": "x" * 200})
    (tmp_path / "j.jsonl").write_text(f"{good}\n\n{long}\n{good[:20]}")
    events, rejected = files.journal(spark, str(tmp_path / "j.jsonl"), most_bytes=150)
    assert [r.event_id for r in events.collect()] == ["e1"]
    assert sorted(r.reason for r in rejected.collect()) == ["corrupt", "too_long"]


def test_blob_slices_blocks_and_scopes(spark, tmp_path):
    (tmp_path / "blob").write_bytes(b"0123456789")
    r = files.blob_slice(spark, str(tmp_path / "blob"), 3, 4).first()
    assert bytes(r.data) == b"3456" and r.sha256 == hashlib.sha256(b"0123456789").hexdigest()
    with pytest.raises(ValueError):
        files.blob_slice(spark, str(tmp_path / "blob"), 0, 70_000)
    (tmp_path / "n.md").write_text("free\n<!-- begin:one -->\nbody\n<!-- end:one -->\nrest <!-- begin:two -->\n")
    b = files.managed_blocks(spark, str(tmp_path / "n.md")).collect()
    assert [(x.name, x.body, x.malformed) for x in b] == [("one", "body\n", True)]
    scopes = spark.createDataFrame([(["b", "a"], ["h"])], "hosts array<string>, nets array<string>")
    assert [(x.kind, x.value, len(x.reference)) for x in files.scope_references(scopes, ["hosts", "nets"]).collect()] == [("hosts", "a", 32), ("hosts", "b", 32), ("nets", "h", 32)]


def test_versions_publish_together_or_not_at_all(spark, tmp_path):
    store = versioned.VersionedTables(spark, str(tmp_path / "t"))
    one = spark.range(3)
    assert store.version() == 0 and store.publish({"a": one, "b": one}, expected=0) == 1
    with pytest.raises(versioned.Conflict):
        store.publish({"a": one}, expected=0)

    def refuse(tables, version):
        raise ValueError("audit failed")

    with pytest.raises(ValueError):
        store.publish({"a": spark.range(9)}, guard=refuse)
    assert store.version() == 1 and store.read("a").count() == 3
    assert store.publish({"a": spark.range(5)}) == 2 and store.read("a").count() == 5 and store.read("a", 1).count() == 3
    assert store.rollback() == 1 and store.read("a").count() == 3
    store.block("rebuild_required")
    with pytest.raises(RuntimeError):
        store.read("a")
    store.unblock()
    store.publish({"a": spark.range(6)})
    store.expire(keep=1)
    assert store.read("a").count() == 6


def test_bounded_decoding():
    assert T.decode_bounded("a%2520b&amp;lt;c") == "a b<c"
    assert T.decode_bounded(None) is None and T.decode_bounded("plain") == "plain"
    assert T.decode_bounded("x" * 70_000) == "[REDACTED]" == T.decode_bounded("%25" * 9 + "&" + "amp;" * 9)


def test_blocks_and_segments(spark):
    note = "# Title\n\nfirst para\nmore\n\n```sh\n# not a heading\n```\n- a\n- b\n\n| x | y |\n| 1 | 2 |\n> q\n---\n## Next\ntext"
    docs = spark.createDataFrame([(1, note), (2, "")], "doc_id long, text string")
    blocks = T.markdown_blocks(docs).orderBy("doc_id", "block").collect()
    assert [(b.kind, b.start_line, b.end_line) for b in blocks] == [("heading", 1, 1), ("paragraph", 3, 4), ("code", 6, 8), ("list", 9, 10), ("table", 12, 13), ("quote", 14, 14), ("rule", 15, 15), ("heading", 16, 16), ("paragraph", 17, 17)]
    seg = T.segments(T.markdown_blocks(docs), 30).orderBy("block").collect()
    assert seg[0].segment == seg[1].segment == 1, "a heading stays with the block after it"
    assert max(s.segment for s in seg) > 1


def test_target_kinds_and_ladder(spark):
    kinds = {"192.168.0.1": "ipv4", "256.1.1.1": "hostname", "::1": "ipv6", "Example.ORG": "hostname", "http://x/": "url", "a b": "invalid", "": "invalid", "box_1": "generic"}
    rows = spark.createDataFrame([(k,) for k in kinds], "t string").select("t", X.target_kind(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in rows} == kinds
    notes = {
        1: ("", "", "empty"), 2: ("a.pdf", "text", "pdf_not_parsed"), 3: ("n.md", "FLAG{abc}", "flag_only"), 4: ("n.md", "see https://x.example/walkthrough", "external_stub"),
        5: ("machine/n.md", "# One\n# Two\n```\nls\n```", "machine_walkthrough"), 6: ("n.md", "| a | b |\n| c | d |\n| e | f |", "cheatsheet_reference"), 7: ("n.md", "Some words that make a plain line.", "lesson"), 8: ("n.md", "hm", "ambiguous"),
    }
    docs = spark.createDataFrame([(i, p, t) for i, (p, t, _) in notes.items()], "doc_id long, path string, text string")
    assert {r.doc_id: r.reason for r in T.classify(docs, path_col="path").collect()} == {i: r for i, (*_, r) in notes.items()}


def test_of_two_writers_the_loser_changes_nothing(spark, tmp_path):
    store, other = (versioned.VersionedTables(spark, str(tmp_path / "t")) for _ in range(2))
    store.publish({"a": spark.range(1)})

    def overtaken(tables, folder):
        other.publish({"a": spark.range(7)})

    with pytest.raises(versioned.Conflict):
        store.publish({"a": spark.range(2)}, guard=overtaken)
    assert store.version() == 2 and store.read("a").count() == 7 and len(list(tmp_path.glob("t/v=*"))) == 2
    calls = []

    def build(base):
        if not calls:
            other.publish({"a": spark.range(8)})
        calls.append(base)
        return {"a": spark.range(base)}

    assert store.publish_with_restart(build) == 4 and calls == [2, 3] and store.read("a").count() == 3
    assert store.rollback() == 3 and store.publish({"a": spark.range(6)}) == 5, "a number is never used twice"
    assert store.read("a", 4).count() == 3
