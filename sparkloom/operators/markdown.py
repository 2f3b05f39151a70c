"""Markdown notes as rows: blocks with line spans, centred wrappers, sections, atomic groups and segments.

``blocks`` walks each document's lines once with a stack of open containers; that is the only per-document Python.
All that follows works on the rows: inline text by expressions, wrappers and sections by windows, the grammar of
groups by one pattern over a section's kinds, packing by one pass over sorted rows.

Defined results: a null or empty text has no blocks; rows that repeat an id are documents of their own only if the
id column tells them apart (blocks are numbered for each input row); texts of any length take linear time but for
the depth of their nesting.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .notes import command_like

BLOCK = "block long, kind string, level int, depth int, start_line long, end_line long, language string, text string"

# The tag names of the CommonMark specification that begin an HTML block of their own.
HTML_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p "
    "param search section summary table tbody td tfoot th thead title tr track ul"
).split()

_ATX = re.compile(r"(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_RULE = re.compile(r"([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_ITEM = re.compile(r"(?:([-+*])|(\d{1,9})([.)]))(?=[ \t]|$)")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_DELIMITERS = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r"\[(?:[^\[\]\\]|\\.)+\]:[ \t]*(?:<[^<>]*>|[^\s<]\S*)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
_TAG = r"<(?:[A-Za-z][\w-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|/[A-Za-z][\w-]*\s*)>"
#: What begins an HTML block, and what ends it (None: a blank line).
_HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{'|'.join(HTML_TAGS)})(?:\s|/?>|$)", re.I), None),
    (re.compile(rf"{_TAG}[ \t]*$"), None),
]
_IMAGES = re.compile(r"(?:(?:!\[[^\[\]]*\]\([^()\s]+(?:[ \t]+\"[^\"]*\")?\)|\[!\[[^\[\]]*\]\([^()]*\)\]\([^()]*\))\s*)+$")
_CELL = re.compile(r"(?:[^|\\]|\\.)*")


def _cells(line: str) -> list[str]:
    line = line.strip().removeprefix("|")
    if line.endswith("|") and not line.endswith("\\|"):
        line = line[:-1]
    return [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", line)]


class _Blocks:
    """The open containers (document, quotes, items), the open leaf, and the rows of all blocks in order."""

    def __init__(self):
        self.rows: list[dict] = []
        self.stack: list[dict] = [{"kind": "document", "children": 0}]
        self.leaf: dict | None = None

    def open(self, kind: str, n: int, **more) -> dict:
        row = {"kind": kind, "level": None, "depth": len(self.stack) - 1, "start": n, "end": n, "language": None, "lines": [], "children": 0} | more
        self.rows.append(row)
        self.stack[-1]["children"] += 1
        return row

    def close_leaf(self) -> None:
        leaf, self.leaf = self.leaf, None
        if leaf is None:
            return
        lines = leaf["lines"]
        if leaf["kind"] == "paragraph":
            gone = 0
            while gone < len(lines) and _DEFINITION.match(lines[gone]):
                gone += 1
            leaf["lines"] = lines[gone:]
            leaf["start"] += gone
            if not leaf["lines"]:
                leaf["kind"] = "definition"
            elif _IMAGES.match("\n".join(leaf["lines"])):
                leaf["kind"] = "image"
        elif leaf["kind"] == "code" and leaf.get("indented"):
            while lines and not lines[-1].strip():
                lines.pop()
            leaf["end"] = leaf["start"] + len(lines) - 1

    def close(self, keep: int, n: int) -> None:
        """Close the containers from ``keep`` on, before line ``n``; what ends in a quote ends with it."""
        if keep < len(self.stack):
            self.close_leaf()
        end = n - 1
        for c in self.stack[keep:]:
            if c["kind"] == "blockquote":
                end = min(end, c["last"])
            c["end"] = max(c["start"], end)
        del self.stack[keep:]

    def line(self, raw: str, n: int) -> None:
        body = raw.lstrip(" \t")
        text = raw[: len(raw) - len(body)].expandtabs(4) + body
        pos, matched = 0, 1
        for c in self.stack[1:]:
            rest = text[pos:].lstrip(" ")
            indent = len(text) - pos - len(rest)
            if c["kind"] == "blockquote":
                if indent > 3 or not rest.startswith(">"):
                    break
                pos += indent + 1
                c["last"] = n
                if text[pos : pos + 1] == " ":
                    pos += 1
                elif text[pos : pos + 1] == "\t":
                    text = text[:pos] + " " * 3 + text[pos + 1 :]
            elif not rest:
                if not c["children"]:
                    break  # an item that begins with a blank line holds no more of them
                pos = len(text) if indent < c["indent"] else pos + c["indent"]
            elif indent >= c["indent"]:
                pos += c["indent"]
            else:
                break
            matched += 1
        whole, leaf = matched == len(self.stack), self.leaf
        if whole and leaf is not None and leaf["kind"] in ("code", "html") and self.goes_on(leaf, text[pos:], n):
            return
        fresh = False
        while True:
            rest = text[pos:].lstrip(" ")
            indent = len(text) - pos - len(rest)
            within = whole and not fresh and self.leaf is not None and self.leaf["kind"] == "paragraph"
            if not rest or indent > 3:
                break
            if rest[0] == ">":
                self.close(matched, n)
                self.close_leaf()
                quote = self.open("blockquote", n, last=n)
                self.stack.append(quote)
                pos += indent + 1
                if text[pos : pos + 1] == " ":
                    pos += 1
            elif within and (m := _SETEXT.match(rest)) and any(not _DEFINITION.match(x) for x in self.leaf["lines"]):
                self.leaf |= {"kind": "heading", "level": 1 if m[1][0] == "=" else 2, "end": n}
                self.leaf = None
                return
            elif within and "|" in self.leaf["lines"][-1] + rest and _DELIMITERS.match(rest) and len(_cells(rest)) == len(_cells(self.leaf["lines"][-1])):
                head = self.leaf["lines"].pop()
                if self.leaf["lines"]:
                    self.leaf["end"] = n - 2
                    self.close_leaf()
                else:
                    self.rows.remove(self.leaf) if self.rows[-1] is not self.leaf else self.rows.pop()
                self.leaf = self.open("table", n - 1, end=n, lines=[" | ".join(_cells(head))], width=len(_cells(head)))
                return
            elif _RULE.match(rest):
                self.close(matched, n)
                self.close_leaf()
                self.open("thematic_break", n, lines=[re.sub(r"\s", "", rest)])
                return
            elif (m := _ITEM.match(rest)) and not (within and (not rest[m.end() :].strip() or m[2] not in (None, "1"))):
                after = rest[m.end() :].expandtabs(4)
                spaces = len(after) - len(after.lstrip(" "))
                wide = m.end() + (spaces if after.strip() and spaces <= 4 else 1)
                self.close(matched, n)
                self.close_leaf()
                kind = "unordered_list_item" if m[1] else "ordered_list_item"
                self.stack.append(self.open(kind, n, indent=indent + wide))
                text = text[:pos] + " " * indent + rest[: m.end()] + after
                pos = min(len(text), pos + indent + wide)
            elif m := _ATX.match(rest):
                self.close(matched, n)
                self.close_leaf()
                self.open("heading", n, level=len(m[1]), lines=[(m[2] or "").strip(" \t#") if set(m[2] or "") <= set("# \t") else m[2].strip()])
                return
            elif m := _FENCE.match(rest):
                self.close(matched, n)
                self.close_leaf()
                info = (m[2] if m[1] else m[4]).split()
                self.leaf = self.open("code", n, fence=m[1] or m[3], shift=indent, language=info[0] if info else None)
                return
            elif rest[0] == "<" and (k := next((k for k, (begins, _) in enumerate(_HTML) if begins.match(rest)), 9)) < (6 if self.leaf is not None and self.leaf["kind"] == "paragraph" else 7):
                self.close(matched, n)
                self.close_leaf()
                self.leaf = self.open("html", n, ends=_HTML[k][1], lines=[text[pos:].rstrip()])
                if self.leaf["ends"] and self.leaf["ends"].search(rest):
                    self.leaf = None
                return
            else:
                break
            matched, fresh, whole = len(self.stack), True, True
        self.plain(text[pos:], rest, indent, matched, n)

    def goes_on(self, leaf: dict, text: str, n: int) -> bool:
        """Whether an open code or HTML block takes the line."""
        bare = text.strip()
        if leaf.get("indented"):
            if bare and len(text) - len(text.lstrip(" ")) < 4:
                return False
            leaf["lines"].append(text[4:])
        elif leaf["kind"] == "code":
            closes = len(text) - len(text.lstrip(" ")) < 4 and bare.startswith(leaf["fence"]) and not bare.strip(leaf["fence"][0])
            if not closes:
                shift = min(leaf["shift"], len(text) - len(text.lstrip(" ")))
                leaf["lines"].append(text[shift:])
            leaf["end"] = n
            if closes:
                self.leaf = None
        else:
            if leaf["ends"] is None and not bare:
                return False
            leaf["lines"].append(text.rstrip())
            leaf["end"] = n
            if leaf["ends"] is not None and leaf["ends"].search(text):
                self.leaf = None
        return True

    def plain(self, text: str, rest: str, indent: int, matched: int, n: int) -> None:
        """What begins no block: a blank line, a continuation (also a lazy one), a table row, indented code, a new paragraph."""
        leaf = self.leaf
        if not rest:
            if leaf is not None and leaf["kind"] != "code":
                self.close_leaf()
            if any(c["kind"] == "blockquote" for c in self.stack[matched:]) or (matched < len(self.stack) and not self.stack[matched]["children"]):
                self.close(matched, n)
            return
        if leaf is not None and leaf["kind"] == "paragraph":
            for c in self.stack[matched:]:
                if c["kind"] == "blockquote":
                    c["last"] = n  # lazy
            leaf["lines"].append(rest.rstrip() if not rest.endswith("  ") else rest.rstrip() + "  ")
            leaf["end"] = n
            return
        if leaf is not None and leaf["kind"] == "table" and matched == len(self.stack) and indent < 4:
            cells = _cells(rest)[: leaf["width"]]
            leaf["lines"].append(" | ".join(cells + [""] * (leaf["width"] - len(cells))))
            leaf["end"] = n
            return
        self.close(matched, n)
        self.close_leaf()
        if indent > 3:
            self.leaf = self.open("code", n, indented=True, lines=[text[4:]])
        else:
            self.leaf = self.open("paragraph", n, lines=[rest.rstrip() if not rest.endswith("  ") else rest.rstrip() + "  "])


def blocks_of(text: str) -> list[tuple]:
    """(kind, level, depth, start_line, end_line, language, text) of every block; a container has the text of its leading paragraph."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n").split("\n") if text else []
    walk = _Blocks()
    for n, raw in enumerate(lines, 1):
        walk.line(raw, n)
    if walk.leaf is not None and walk.leaf.get("fence"):
        walk.leaf["end"] = min([len(lines), *(c["last"] for c in walk.stack if c["kind"] == "blockquote")])
    walk.close(1, len(lines) + 1)
    walk.close_leaf()
    out, rows = [], walk.rows
    leads = {id(b): a for a, b in zip(rows, rows[1:], strict=False) if "list_item" in a["kind"] + b["kind"] or a["kind"] == "blockquote" if a["kind"] in ("blockquote", "ordered_list_item", "unordered_list_item") and b["kind"] in ("paragraph", "image") and b["depth"] == a["depth"] + 1}
    for row in rows:
        if id(row) in leads:
            leads[id(row)]["lines"] = row["lines"]
    for row in rows:
        if id(row) not in leads and row["kind"] != "definition":
            joined = "\n".join(x.rstrip(" ") if row["kind"] not in ("code", "html", "table") else x for x in row["lines"])
            out.append((row["kind"], row["level"], row["depth"], row["start"], row["end"], row["language"], joined))
    return out


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, block, kind, level, depth, start_line, end_line, language, text): the blocks of each document, lines from 1."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in BLOCK.split(", "))]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):  # a bounded number of documents at once
                part, rows, own = b.slice(k, 64), [], []
                for i, text in enumerate(part.column(1)):
                    found = blocks_of(text.as_py() or "")
                    rows += [(n, *row) for n, row in enumerate(found)]
                    own += [i] * len(found)
                cols = list(zip(*rows, strict=True)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {BLOCK}")


def inline_text(x: Column) -> Column:
    """What a reader sees of inline Markdown: code spans, link labels and image texts without their signs, no emphasis marks, no escapes."""
    for pattern, to in (
        (r"!\[([^\[\]]*)\]\([^()]*\)", "$1"),
        (r"\[([^\[\]]*)\]\([^()]*\)", "$1"),
        (r"<((?:https?|ftp|mailto):[^<>\s]*)>", "$1"),
        (r"(`+)(?!`)[ ]?(.+?)[ ]?(?<!`)\1(?!`)", "$2"),
        (r"(?<![\w\\])(\*\*|__)(?=\S)(.+?)(?<=[^\s\\])\1(?!\w)", "$2"),
        (r"(?<![\w\\*])([*_])(?=[^\s*_])(.+?)(?<=[^\s\\*_])\1(?![\w*])", "$2"),
        (r"\\([!-/:-@\[-`{-~])", "$1"),
    ):
        x = F.regexp_replace(x, pattern, to)
    return x


def targets(x: Column) -> dict[str, Column]:
    """Link and image targets of a block, in order, from Markdown and from HTML tags."""
    links = F.concat(F.regexp_extract_all(x, F.lit(r"(?<!!)\[(?:[^\[\]]|!\[[^\[\]]*\]\([^()]*\))*\]\(\s*<?([^()\s<>]+)"), 1), F.regexp_extract_all(x, F.lit(r"<((?:https?|ftp|mailto):[^<>\s]*)>"), 1), F.regexp_extract_all(x, F.lit(r"(?i)<a\s[^<>]*?href\s*=\s*[\"']?([^\"'\s<>]+)"), 1))
    images = F.concat(F.regexp_extract_all(x, F.lit(r"!\[[^\[\]]*\]\(\s*<?([^()\s<>]+)"), 1), F.regexp_extract_all(x, F.lit(r"(?i)<img\s[^<>]*?src\s*=\s*[\"']?([^\"'\s<>]+)"), 1))
    return {"links": links, "images": images}


# Centred wrappers -----------------------------------------------------------------------------------------------

# Tags that have no end, and tags that end a line of visible text.
VOID_TAGS = "area base br col embed hr img input link meta source track wbr".split()
BOUNDARY_TAGS = "address article blockquote dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header li main nav ol p section table td th tr ul".split()
TOKEN = r"(?s)(<!--.*?-->|</?[A-Za-z][^<>]*>|[^<]+|<)"
#: What every text with a centred root has somewhere.
MAY_CENTRE = r"(?i)<(?:div|p)[^<>]*center"


def unwrapped(rows: DataFrame, doc: str = "doc_id", block: str = "block", kind: str = "kind", text: str = "text") -> DataFrame:
    """``rows`` without centred wrappers: adds ``visible`` (the text inside a wrapper that is a block's root, else the text) and ``role``.

    A heading, paragraph or HTML block whose only root element is a centred ``div`` or ``p`` is a wrapper: its visible
    text takes its place (nothing visible: the block goes). A wrapper that its block does not end stays open, and each
    later block of nothing but a closing tag ends one and goes. All of it is done by running balances over tag tokens:
    the root's end is where the balance of its name first returns to zero.

    Blocks are dealt once, and only texts that may have a centred root are cut into tokens. The key is a struct, which is
    never null, and the choice of texts no filter: either would make Spark put a filter below the dealing of one side.
    """
    names = rows.columns
    rows = rows.select(F.struct(doc, block).alias("_k"), *[c for c in names if c not in (doc, block)]).repartition("_k")
    may = F.col(kind).isin("heading", "html", "paragraph") & F.col(text).rlike(MAY_CENTRE)
    token = rows.select("_k", F.posexplode_outer(F.when(may, F.regexp_extract_all(F.col(text), F.lit(TOKEN), 1))).alias("t", "token")).where("token is not null")
    name = F.lower(F.regexp_extract("token", r"^</?([A-Za-z][\w-]*)", 1))
    is_open, is_close = F.col("token").rlike(r"^<[A-Za-z]"), F.col("token").rlike(r"^</[A-Za-z]")
    is_text = ~is_open & ~is_close & ~F.col("token").startswith("<!--")
    token = token.select("_k", "t", "token", name.alias("name"), is_open.alias("opens"), is_close.alias("closes"), is_text.alias("says"))
    in_order = Window.partitionBy("_k").orderBy("t")
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    centred = F.col("name").isin("div", "p") & F.col("token").rlike(r"(?i)\salign\s*=\s*[\"']?center\b|\sstyle\s*=\s*[\"'][^\"']*text-align\s*:\s*center")
    first = F.min(F.when(F.col("opens"), F.struct("t", "name", centred.alias("centred")))).over(Window.partitionBy("_k"))
    token = token.withColumn("root", first)
    whole = F.col("token").rlike(r"/>$") | F.col("name").isin(*VOID_TAGS)
    step = F.when(F.col("name") != F.col("root.name"), 0).when(F.col("opens") & ~whole, 1).when(F.col("closes"), -1).otherwise(0)
    token = token.withColumn("balance", F.sum(F.when(F.col("t") >= F.col("root.t"), step).otherwise(0)).over(upto))
    ended = F.coalesce(F.max(((F.col("balance") <= 0) & (F.col("t") >= F.col("root.t"))).cast("int")).over(before), F.lit(0)) == 1
    outside = (F.col("t") < F.col("root.t")) | ended
    blank = F.trim(F.translate("token", "\t\n\r\f", "    ")) == ""
    edge = F.when((F.col("t") == F.col("root.t")) | (F.col("closes") & (F.col("balance") <= 0) & (F.col("name") == F.col("root.name"))), "").when((F.col("name") == "br") | (F.col("name").isin(*BOUNDARY_TAGS) & (F.col("opens") | F.col("closes"))), "\n").otherwise("")
    label = F.coalesce(F.nullif(F.regexp_extract("token", r"(?i)\salt\s*=\s*[\"']([^\"']+)", 1), F.lit("")), F.nullif(F.regexp_extract("token", r"(?i)\ssrc\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit("")))
    token = token.withColumn("bad", outside & (F.col("opens") | (F.col("says") & ~blank))).withColumn("piece", F.when(F.col("says"), F.col("token")).otherwise(edge))
    image = F.when(F.col("opens") & (F.col("name") == "img") & F.col("token").rlike(r"(?i)\ssrc\s*="), F.struct("t", label.alias("label")))
    seen = token.groupBy("_k").agg(
        F.first("root").alias("root"),
        F.max("bad").alias("bad"),
        F.max_by("balance", "t").alias("open_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "piece"))), lambda x: x["piece"]), "").alias("said"),
        F.array_join(F.transform(F.array_sort(F.collect_list(image)), lambda x: x["label"]), " ").alias("labels"),
    )
    tidy = F.filter(F.transform(F.split(_decoded(F.col("said")), r"\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\f\r ]+", " "))), lambda x: x != "")
    seen = seen.select("_k", (F.col("root.centred") & ~F.col("bad")).alias("centred"), (F.col("open_end") > 0).alias("stays_open"), F.array_join(tidy, "\n").alias("said"), "labels")
    out = rows.join(seen, "_k", "left").withColumns({doc: F.col("_k")[doc], block: F.col("_k")[block]})
    wrapper = F.coalesce("centred", F.lit(False))
    closing = ~wrapper & (F.col(kind) == "html") & F.col(text).rlike(r"(?i)^\s*(</(?:div|p)\s*>)\s*$")
    out = out.withColumn("move", F.when(wrapper & F.col("stays_open"), 1).when(closing, -1).otherwise(0))
    ordered = Window.partitionBy(doc).orderBy(block).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(doc).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    # a balance that never falls below zero: the running sum less its lowest value so far, if that is negative
    out = out.withColumn("sum", F.sum("move").over(ordered)).withColumn("low", F.least(F.lit(0), F.coalesce(F.min("sum").over(earlier), F.lit(0))))
    open_before = F.coalesce(F.col("sum") - F.col("move"), F.lit(0)) - F.col("low")
    visible = F.when(wrapper, F.when(F.col("said") != "", F.col("said")).otherwise(F.col("labels"))).otherwise(F.col(text))
    role = F.when(wrapper & (F.coalesce("said", F.lit("")) == "") & (F.coalesce("labels", F.lit("")) == ""), "empty_wrapper").when(wrapper, "unwrapped").when(closing & (open_before > 0), "closing").otherwise("kept")
    return out.select(*names, visible.alias("visible"), role.alias("role"))


def _decoded(x: Column) -> Column:
    """The character references that hand-written wrappers use."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    return x


# Profiles -------------------------------------------------------------------------------------------------------

# Labels that end a scraped article, the kinds of block that may be one, and lines of a note that are metadata.
ARTICLE_ENDS = ("ad blocker detected", "cheatsheet", "connect to htb", "next", "previous")
LABEL_KINDS = ("heading", "paragraph", "ordered_list_item", "unordered_list_item")
METADATA = r"(?i)^\s*(tags|related\s+to|see\s+also|previous)\s*:"
EMBED = r"!\[\[([^\]|]+)(?:\|([^\]]*))?\]\]"
WIKI = r"(?<!!)\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
URL = r"(https?://[^\s)>\]\"']+)"


def article(rows: DataFrame, ends: tuple[str, ...] = ARTICLE_ENDS, doc: str = "doc_id") -> DataFrame:
    """A scraped page's blocks from its first heading of level 1 up to the next label that ends articles; without such a heading all."""
    every = Window.partitionBy(doc)
    label = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    first = F.min(F.when((F.col("kind") == "heading") & (F.col("level") == 1), F.col("block"))).over(every)
    rows = rows.withColumn("_first", first)
    cut = F.col("kind").isin(*LABEL_KINDS) & label.isin(*ends) & (F.col("block") > F.col("_first"))
    rows = rows.withColumn("_end", F.min(F.when(cut, F.col("block"))).over(every))
    inside = F.col("_first").isNull() | ((F.col("block") >= F.col("_first")) & F.coalesce(F.col("block") < F.col("_end"), F.lit(True)))
    return rows.where(inside).drop("_first", "_end")


def note_blocks(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A note's blocks without metadata lines, embeds replaced by what they show; a paragraph that loses lines becomes one block for each line left.

    Blocks keep their number; ``part`` tells the lines of one apart. An embed alone in its block is an image.
    """
    lines = F.split("text", "\n")
    meta = F.exists(lines, lambda x: x.rlike(METADATA)) & (F.col("kind") == "paragraph")
    whole = F.array(F.struct(F.lit(0).alias("part"), F.col("start_line").alias("a"), F.col("end_line").alias("z"), F.col("text").alias("t")))
    each = F.transform(lines, lambda x, i: F.struct(i.alias("part"), F.least(F.col("start_line") + i, F.col("end_line")).alias("a"), F.least(F.col("start_line") + i, F.col("end_line")).alias("z"), x.alias("t")))
    kept = F.when(meta, F.filter(each, lambda p: ~p["t"].rlike(METADATA) & (F.trim(p["t"]) != ""))).otherwise(whole)
    out = rows.withColumn("_p", F.explode(kept)).withColumn("_said", F.regexp_replace(F.regexp_replace(F.col("_p.t"), r"!\[\[[^\]|]+\|\s*([^\]]*[^\]\s])\s*\]\]", "$1"), EMBED, "$1"))
    alone = F.trim(F.col("_p.t")).rlike("^" + EMBED + "$")
    shown = {"text": F.when(F.col("kind") == "code", F.col("_p.t")).otherwise(F.col("_said")), "kind": F.when((F.col("kind") != "code") & alone, "image").otherwise(F.col("kind")), "start_line": F.col("_p.a"), "end_line": F.col("_p.z")}
    return out.select(*[shown[c].alias(c) if c in shown else F.col(c) for c in rows.columns], F.col("_p.part").cast("long").alias("part"))


def note_relations(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, target, line, relation) of a note's blocks: embeds are assets, wiki links and the addresses of metadata lines are links (``tags`` aside)."""
    lines = rows.where("kind <> 'code'").select(doc, "start_line", "end_line", "kind", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("line_no", F.least(F.col("start_line") + F.col("i"), F.col("end_line")))
    meta = F.col("line").rlike(METADATA) & (F.col("kind") == "paragraph")
    tags = meta & F.col("line").rlike(r"(?i)^\s*tags\s*:")
    named = lambda pattern, relation: F.transform(F.regexp_extract_all("line", F.lit(pattern), 1), lambda t: F.struct(F.trim(t).alias("target"), F.lit(relation).alias("relation")))
    links = F.concat(named(WIKI, "link"), F.when(meta, named(URL, "link")).otherwise(F.array().cast("array<struct<target:string,relation:string>>")))
    found = F.concat(F.when(meta, F.array().cast("array<struct<target:string,relation:string>>")).otherwise(named(EMBED, "asset")), F.when(tags, F.array().cast("array<struct<target:string,relation:string>>")).otherwise(links))
    return lines.select(doc, "line_no", F.inline(found)).groupBy(doc, "target", "relation").agg(F.min("line_no").alias("line"))


def profiled(rows: DataFrame, profile: str, doc: str = "doc_id") -> DataFrame:
    """The blocks (doc, block, part, kind, level, start_line, end_line, text) after the named profile; an unknown one is an error."""
    columns = [doc, "block", "part", "kind", "level", "start_line", "end_line", "text"]
    one = F.lit(0).cast("long").alias("part")
    if profile == "scraped":
        return article(rows, doc=doc).select("*", one).select(*columns)
    if profile == "notes":
        return note_blocks(rows, doc).select(*columns)
    if profile == "centred":
        kept = unwrapped(rows, doc).where("role not in ('closing', 'empty_wrapper')")
        kind = F.when((F.col("role") == "unwrapped") & (F.col("kind") == "html"), "paragraph").otherwise(F.col("kind"))
        return kept.select(doc, "block", one, kind.alias("kind"), "level", "start_line", "end_line", F.col("visible").alias("text"))
    raise ValueError(f"unknown profile: {profile}")


# Segments -------------------------------------------------------------------------------------------------------

#: One letter for each kind of block: a heading, a command, other code (a result), anything else.
#: Groups: a heading with its first block; an action with its command; a command with one result and one conclusion.
RUN = "[CR]R?T?"
GROUP = f"(H(?:{RUN}|T(?:{RUN})?)?|{RUN}|T{RUN}|T)"


def sections(rows: DataFrame, doc: str = "doc_id", block: str = "block", kind: str = "kind", level: str = "level") -> DataFrame:
    """Adds ``section`` (from 0). A heading opens one unless a shallower one is open; under a lone title its children do."""
    is_heading = F.col(kind) == "heading"
    at = F.when(is_heading, F.col(level))
    w = Window.partitionBy(doc).orderBy(block)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(doc)
    title = F.min(F.when(is_heading, F.struct(F.col(block).alias("b"), F.col(level).alias("l")))).over(every)
    rows = rows.withColumn("_title", title)
    later = F.min(F.when(F.col(block) > F.col("_title.b"), at)).over(every)
    holds = (F.col("_title.l") == 1) & F.coalesce(later > 1, F.lit(False))
    shallowest = F.min(at).over(before)
    plain = is_heading & (F.coalesce(F.col(level) <= shallowest, F.lit(True)))
    opens = F.when(holds, (F.col(block) == F.col("_title.b")) | (is_heading & (F.col(level) <= later))).otherwise(plain)
    rows = rows.withColumn("_opens", opens)
    # blocks before the first heading are a section of their own
    head = F.min(block).over(every)
    started = F.sum((F.coalesce("_opens", F.lit(False)) | (F.col(block) == head)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("section", started - 1).drop("_title", "_opens")


def packs_of(sizes: list[int], pieces: list[int], limit: int) -> list[dict]:
    """Greedy packs of a section in one pass: ``sizes`` of its blocks, ``pieces`` the number of blocks of each group; places from 1."""
    out, at, room = [], 0, 0
    for n in pieces:
        size = sum(sizes[at : at + n]) + 2 * (n - 1)
        if out and room + 2 + size <= limit:
            out[-1]["n"] += n
            out[-1]["large"] |= size > limit
            room += 2 + size
        else:
            out.append({"first": at + 1, "n": n, "large": size > limit})
            room = size
        at += n
    return out


def packed(sizes: Column, pieces: Column, limit: int) -> Column:
    """``packs_of`` over columns; only numbers go to Python."""

    def run(sizes: pa.Array, pieces: pa.Array) -> pa.Array:
        rows = zip(sizes.to_pylist(), pieces.to_pylist(), strict=True)
        return pa.array([packs_of(a, b, limit) for a, b in rows], pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32()), ("large", pa.bool_())])))

    return F.arrow_udf(run, "array<struct<first:int,n:int,large:boolean>>")(sizes, pieces)


def segments(rows: DataFrame, limit: int = 12_000, doc: str = "doc_id") -> DataFrame:
    """(doc, section, pack, first_block, last_block, start_line, end_line, n_chars, oversized, text): what retrieval and drafts read.

    ``rows`` are blocks (doc, block, kind, level, start_line, end_line, text). Blocks that segments never part are found by
    one pattern over a section's kinds. A group that alone exceeds ``limit`` cannot be cut: it is a segment of its own,
    marked ``oversized`` for the quarantine.

    A section is one list of its blocks, so ``rows``, behind which stand a walk and a redaction, are read once and dealt once.
    """
    shown = rows.select(doc, "block", "kind", "level", "start_line", "end_line", X.redact(F.col("text")).alias("text"))
    letter = F.when(F.col("kind") == "heading", "H").when((F.col("kind") == "code") & command_like(F.col("text")), "C").when(F.col("kind") == "code", "R").otherwise("T")
    block = F.struct("block", letter.alias("letter"), "start_line", "end_line", "text")
    lists = sections(shown, doc).groupBy(doc, "section").agg(F.array_sort(F.collect_list(block)).alias("bs"))
    kinds = F.array_join(F.col("bs.letter"), "")
    sizes = F.transform("bs", lambda b: F.coalesce(F.length(b["text"]), F.lit(0)))
    pieces = F.transform(F.regexp_extract_all(kinds, F.lit(GROUP), 1), lambda p: F.length(p))
    cut = F.transform("packs", lambda p: F.struct(F.slice("bs", p["first"], p["n"]).alias("bs"), p["large"].alias("large")))
    # outer: a section has a pack, and a filter on the size of the list would cut it twice
    out = lists.withColumn("packs", packed(sizes, pieces, limit)).select(doc, "section", F.posexplode_outer(cut).alias("pack", "p"))
    bs = F.col("p.bs")
    return out.select(
        doc, "section", F.col("pack").cast("long").alias("pack"), bs[0]["block"].alias("first_block"), F.element_at(bs, -1)["block"].alias("last_block"), F.array_min(bs["start_line"]).alias("start_line"),
        F.array_max(bs["end_line"]).alias("end_line"), F.col("p.large").alias("oversized"), F.array_join(bs["text"], "\n\n").alias("text"), F.length(F.array_join(bs["text"], "\n\n")).cast("long").alias("n_chars"),
    )
