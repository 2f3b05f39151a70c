"""Functions for SQL: what the built-in ones cannot say, registered under one prefix for a session."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.text import decode_bounded
from .exprs import ACCENTED, PLAIN

HIDDEN = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->")
TAG, ANCHOR, BLANK = re.compile(r"(?s)<[^>]*>"), re.compile(r"(?is)<a\b[^>]*>.*?</a\s*>"), re.compile(r"\s+")


def visible_text(page: str | None, anchors: bool = False) -> str | None:
    """What a page shows, without scripts, styles and comments, and without the text of links unless asked for."""
    if page is None:
        return None
    shown = HIDDEN.sub(" ", page)
    return BLANK.sub(" ", html.unescape(TAG.sub(" ", shown if anchors else ANCHOR.sub(" ", shown)))).strip()


def _each(f):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(f, na_action="ignore")

    return run


def chain_digest(values: pd.Series) -> str:
    """The digest of a group's values in sorted order, each chained to what stood before it; for groups of bounded size."""
    last = ""
    for v in sorted(values.dropna()):
        last = hashlib.sha256(f"{last}|{v}".encode()).hexdigest()
    return last


class MarkdownLines:
    """``(line_no, kind, text)`` of each line of a note that is not blank; lines from 1."""

    def eval(self, text: str):
        inside = False
        for n, line in enumerate((text or "").split("\n"), 1):
            fence = line.lstrip().startswith(("```", "~~~"))
            kind = "code" if inside or fence else "heading" if re.match(r"#{1,6}\s+\S", line) else "table" if re.match(r"\s*\|.*\|\s*$", line) else "list" if re.match(r"\s*([-*+]|\d+[.)])\s+", line) else "paragraph"
            inside ^= fence
            if line.strip():
                yield n, kind, line


class Packs:
    """``(pack, n, size)`` of a list of sizes, filled greedily up to a limit in order."""

    def eval(self, sizes: list[int], limit: int):
        pack, n, used = 1, 0, 0
        for s in sizes or []:
            if n and used + s > limit:
                yield pack, n, used
                pack, n, used = pack + 1, 0, 0
            n, used = n + 1, used + s
        if n:
            yield pack, n, used


def register(spark: SparkSession, prefix: str = "loom_") -> list[str]:
    """Register everything for ``spark.sql``; the names, sorted."""
    spark.udf.register(f"{prefix}decode_bounded", F.pandas_udf(_each(decode_bounded), StringType()))
    spark.udf.register(f"{prefix}visible_text", F.pandas_udf(_each(visible_text), StringType()))
    spark.udf.register(f"{prefix}chain_digest", F.pandas_udf(chain_digest, StringType(), F.PandasUDFType.GROUPED_AGG))
    spark.udtf.register(f"{prefix}markdown_lines", F.udtf(MarkdownLines, returnType="line_no int, kind string, text string"))
    spark.udtf.register(f"{prefix}packs", F.udtf(Packs, returnType="pack int, n int, size long"))
    # plain SQL functions stay inside generated code
    spark.sql(f"create or replace temporary function {prefix}strip_accents(x string) returns string return translate(lower(x), '{ACCENTED}', '{PLAIN}')")
    spark.sql(f"create or replace temporary function {prefix}normal(x string) returns string return lower(trim(regexp_replace(x, '\\\\s+', ' ')))")
    return sorted(f"{prefix}{n}" for n in ("decode_bounded", "visible_text", "chain_digest", "markdown_lines", "packs", "strip_accents", "normal"))


