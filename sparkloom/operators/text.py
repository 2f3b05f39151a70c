"""Structural text: classification ladder, sections, packing, budgets, redaction, bounded decoding."""

from __future__ import annotations

import html
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import exprs as X

FLAG = r"[A-Za-z0-9_]{2,16}\{[^{}\s]{1,128}\}"
HEADING = r"^#{1,6}\s+\S"
WALKTHROUGH = r"(?i)(walkthrough|writeup|write-up)"
URL = r"https?://[^\s)>\]\"']+"


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, line) with places from 0."""
    # outer: else Spark splits each text once more to filter on the number of its lines; null texts have none
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode_outer(F.split(F.col(text_col), "\n")).alias("pos", "line")).where("pos is not null")


def signals(text: Column) -> dict[str, Column]:
    """What the ladder looks at, each as an expression over the whole text."""
    ls = F.split(text, "\n")
    words = X.word_count(text)
    table_lines = F.size(F.filter(ls, lambda x: F.size(F.split(x, r"\|")) >= 3)).cast("long")
    narrative = F.size(F.filter(ls, lambda x: (F.size(F.split(F.trim(x), r"\s+")) >= 5) & ~x.contains("|"))).cast("long")
    return {
        "n_headings": F.size(F.filter(ls, lambda x: x.rlike(HEADING))).cast("long"),
        "n_fences": F.floor(F.size(F.filter(ls, lambda x: x.startswith("```"))) / 2).cast("long"),
        "n_words": words,
        "n_table_lines": table_lines,
        "n_narrative": narrative,
        "n_urls": F.size(F.regexp_extract_all(text, F.lit(f"({URL})"), 1)).cast("long"),
        "has_flag": text.rlike(FLAG),
        "n_walkthrough_urls": F.size(F.filter(F.regexp_extract_all(text, F.lit(f"({URL})"), 1), lambda u: u.rlike(WALKTHROUGH))).cast("long"),
    }


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """One row for each document: signals, then the first matching rule of the ladder with its reason, then a grade."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    path = F.lower(F.col(path_col)) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.trim(text).alias("t"), *[c.alias(n) for n, c in signals(text).items()])
    procedural = ((F.col("n_headings") >= 2) & (F.col("n_fences") >= 1)) | (F.col("t").rlike(r"(?i)\b(run|execute|start|open)\b") & F.col("t").rlike(r"(?i)\b(result|output|shows|returned)\b"))
    substance = (F.col("n_narrative") >= 1) | (F.col("n_table_lines") >= 3) | (F.col("n_fences") >= 1)
    table = (F.col("n_table_lines") >= 3) & (F.col("n_table_lines") >= F.col("n_narrative"))
    stub = (F.col("n_walkthrough_urls") == 1) & ~procedural & (F.col("has_flag") | (F.col("n_words") < 100))
    kind = (
        F.when(path.endswith(".pdf"), "quarantined:pdf_not_parsed")
        .when(F.col("t") == "", "excluded:empty")
        .when(F.col("has_flag") & ~procedural & (F.col("n_walkthrough_urls") == 0), "excluded:flag_only")
        .when(stub, "excluded:external_stub")
        .when(procedural & path.contains("machine"), "accepted:machine_walkthrough")
        .when(procedural & path.contains("challenge"), "accepted:challenge_walkthrough")
        .when(substance & table, "accepted:cheatsheet_reference")
        .when(substance, "accepted:lesson")
        .otherwise("quarantined:ambiguous")
    )
    walk = F.when(((F.col("n_headings") >= 3) & (F.col("n_fences") >= 2)) | ((F.col("n_words") >= 200) & (F.col("n_fences") >= 1)), "complete").otherwise("partial")
    lesson = F.when((F.col("n_words") >= 100) & (F.col("n_headings") >= 2), "complete").when(F.col("n_words") >= 20, "partial").otherwise("minimal")
    out = rows.withColumn("k", kind).withColumn("status", F.substring_index("k", ":", 1)).withColumn("reason", F.substring_index("k", ":", -1))
    grade = F.when(F.col("status") != "accepted", "unusable").when(F.col("reason").endswith("walkthrough"), walk).otherwise(lesson)
    return out.withColumn("grade", grade).drop("t", "k", "path")


def heading_path(blocks: DataFrame, levels: int = 3, doc: str = "doc_id", pos: str = "pos", level: str = "level", text: str = "line") -> DataFrame:
    """Adds ``path``: for each level the last heading that no later heading of a smaller level has closed."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out, parts = blocks, []
    for k in range(1, levels + 1):
        here = F.last(F.when(F.col(level) == k, F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))), ignorenulls=True).over(w)
        above = F.max(F.when((F.col(level) > 0) & (F.col(level) < k), F.col(pos))).over(w)
        out = out.withColumn(f"_h{k}", F.when(F.coalesce(above, F.lit(-1)) < here["p"], here["t"]))
        parts.append(f"_h{k}")
    return out.withColumn("path", F.concat_ws(" > ", *parts)).drop(*parts)


def packed(parts: Column, limit: int, joiner: int = 2) -> Column:
    """Lists of part sizes into packs of at most ``limit`` characters, in order; an oversized part is a pack of its own."""
    zero = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("packs"))

    def step(acc: Column, n: Column) -> Column:
        joined = acc["size"] + joiner + n
        fits = (acc["packs"] > 0) & (joined <= limit)
        return F.struct(F.when(fits, joined).otherwise(n).alias("size"), (acc["packs"] + F.when(fits, 0).otherwise(1)).alias("packs"))

    return F.aggregate(parts, zero, step, lambda acc: acc["packs"])


def within_budget(sizes: Column, limit: int) -> Column:
    """Greedy budget that skips what does not fit and goes on: {taken, used} over an ordered list of sizes."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("taken"))

    def step(acc: Column, n: Column) -> Column:
        fits = acc["used"] + n <= limit
        return F.struct((acc["used"] + F.when(fits, n).otherwise(0)).alias("used"), (acc["taken"] + F.when(fits, 1).otherwise(0)).alias("taken"))

    return F.aggregate(sizes, zero, step)


def decode_bounded(text: str | None, rounds: int = 8, most: int = 65_536, work: int = 262_144) -> str | None:
    """URL and HTML references decoded until nothing changes; what is too large or never settles is redacted whole."""
    if text is None:
        return None
    if len(text) > most:
        return "[REDACTED]"
    spent = 0
    for _ in range(rounds):
        spent += len(text)
        if spent > work:
            return "[REDACTED]"
        decoded = html.unescape(unquote(text))
        if decoded == text:
            return text
        text = decoded
    return "[REDACTED]"


#: Texts of a batch that stand as Python strings at once.
DECODE_ROWS = 256


def _decode_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        for k in range(0, len(texts), DECODE_ROWS):
            yield pa.array([decode_bounded(t.as_py()) for t in texts.slice(k, DECODE_ROWS)], pa.string())
        pa.default_memory_pool().release_unused()


def decoded(x: Column) -> Column:
    """``decode_bounded`` over a column, in Arrow batches that are taken in small slices."""
    return F.arrow_udf(_decode_batches, StringType())(x)


def link_counts(x: Column) -> dict[str, Column]:
    """Links and images of a page, by tags; wiki links and embeds of a note."""
    count = lambda p: F.regexp_count(x, F.lit(p)).cast("long")
    return {"n_links": count(r"(?i)<a[\s>]"), "n_images": count(r"(?i)<img[\s>]"), "n_wiki": count(r"(?<!!)\[\[[^\[\]]+\]\]"), "n_embeds": count(r"!\[\[[^\[\]]+\]\]")}


def markdown_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, block, kind, level, start_line, end_line, text): runs of like lines, with fences kept whole; lines from 1."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = lines(docs, id_col, text_col)
    mark = F.col("line").rlike(r"^\s*(```|~~~)")
    rows = rows.withColumn("marks", F.sum(mark.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = (F.col("marks") % 2 == 1) | mark
    kind = (
        F.when(inside, "code")
        .when(F.trim("line") == "", "blank")
        .when(F.col("line").rlike(HEADING), "heading")
        .when(F.col("line").rlike(r"^\s*\|.*\|\s*$"), "table")
        .when(F.col("line").rlike(r"^\s*([-*+]|\d+[.)])\s+"), "list")
        .when(F.col("line").rlike(r"^\s*>"), "quote")
        .when(F.col("line").rlike(r"^\s*([-*_]\s*){3,}$"), "rule")
        .when(F.col("line").rlike(r"^\s*!\[[^\]]*\]\([^)]*\)\s*$"), "image")
        .when(F.col("line").rlike(r"^\s*<[a-zA-Z/!]"), "html")
        .otherwise("paragraph")
    )
    rows = rows.withColumn("kind", kind)
    opens = mark & (F.col("marks") % 2 == 1)
    fresh = F.lag("kind").over(w).isNull() | (F.lag("kind").over(w) != F.col("kind")) | (F.col("kind") == "heading") | opens
    rows = rows.withColumn("block", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        rows.where("kind <> 'blank'")
        .groupBy("doc_id", "block", "kind")
        .agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
        .select("doc_id", "block", "kind", F.when(F.col("kind") == "heading", F.length(F.regexp_extract(F.col("ls")[0]["line"], r"^(#+)", 1))).alias("level"),
                (F.col("a") + 1).cast("long").alias("start_line"), (F.col("b") + 1).cast("long").alias("end_line"), F.array_join(F.col("ls.line"), "\n").alias("text"))
    )


def segments(blocks: DataFrame, limit: int = 12_000) -> DataFrame:
    """Blocks packed into segments by greedy filling; a heading stays with the block after it.

    Each document is one ordered list folded by a higher-order function; a document's blocks are what its text holds.
    """
    item = F.struct("block", "kind", "text")
    rows = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("bs"))
    zero = F.struct(F.lit(0).alias("size"), F.lit(0).alias("segment"), F.lit(False).alias("glued"), F.array().cast("array<struct<block:long,segment:int>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        size = F.length(b["text"])
        joined = acc["size"] + 2 + size
        fits = (acc["segment"] > 0) & ((joined <= limit) | acc["glued"])
        segment = acc["segment"] + F.when(fits, 0).otherwise(1)
        return F.struct(F.when(fits, joined).otherwise(size).alias("size"), segment.alias("segment"), (b["kind"] == "heading").alias("glued"), F.concat(acc["out"], F.array(F.struct(b["block"].cast("long").alias("block"), segment.alias("segment")))).alias("out"))

    return rows.select("doc_id", F.inline(F.aggregate("bs", zero, step, lambda acc: acc["out"])))
