"""Markdown operators over notes that the lines of ``documents`` are written into, one construct for each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import markdown as M
from ..operators.notes import COMMAND_NAME, COMMANDS, OUTPUTS, PROMPT
from .registry import query, table

#: (construct, its blocks: kind, level, depth, first and last line counted from the construct's first, language, text).
#: An item's lines end before the next line that is not blank.
CONSTRUCTS = [
    ("# {s}", [("heading", 1, 0, 0, 0, None, "{s}")]),
    ("{s}\n  more\n---", [("heading", 2, 0, 0, 2, None, "{s}\nmore")]),
    ("> {s}\nlazy\n> - in\n>   1. deep\n>\n> end", [("blockquote", None, 0, 0, 5, None, "{s}\nlazy"), ("unordered_list_item", None, 1, 2, 4, None, "in"), ("ordered_list_item", None, 2, 3, 4, None, "deep"), ("paragraph", None, 1, 5, 5, None, "end")]),
    ("1. {s}\n\n   again\n   - sub\n2) two", [("ordered_list_item", None, 0, 0, 3, None, "{s}"), ("paragraph", None, 1, 2, 2, None, "again"), ("unordered_list_item", None, 1, 3, 3, None, "sub"), ("ordered_list_item", None, 0, 4, 5, None, "two")]),
    ("```py x\n$ cat {s}\n\n# no\n```", [("code", None, 0, 0, 4, "py", "$ cat {s}\n\n# no")]),
    ("| a | b |\n|---|:-:|\n| {s} | y |", [("table", None, 0, 0, 2, None, "a | b\n{s} | y")]),
    ("- {s}\n- two\n\n      code", [("unordered_list_item", None, 0, 0, 0, None, "{s}"), ("unordered_list_item", None, 0, 1, 4, None, "two"), ("code", None, 1, 3, 3, None, "code")]),
    ('<div align="center">\n{s}\n</div>', [("html", None, 0, 0, 2, None, '<div align="center">\n{s}\n</div>')]),
    ("***", [("thematic_break", None, 0, 0, 0, None, "***")]),
    ("    sudo {s}\n\n{s}\n\n~~~\nout\n~~~", [("code", None, 0, 0, 0, None, "sudo {s}"), ("paragraph", None, 0, 2, 2, None, "{s}"), ("code", None, 0, 4, 6, None, "out")]),
]
N = len(CONSTRUCTS)
SAID = "trim('x ' || trim(regexp_replace(line, '[^A-Za-z0-9]+', ' ', 'g')))"


def _sql(value) -> str:
    return "null" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


LINES = f"l as (select doc_id, i, {SAID} as s from (select doc_id, unnest(range(len(ls))) as i, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents)))"
#: The blocks that the notes must have, written down from CONSTRUCTS.
BLOCKS = f"""{LINES},
k(p, k, kind, level, depth, a, e, language, form) as (values {", ".join(f"({p}, {k}, {', '.join(map(_sql, b))})" for p, (_, bs) in enumerate(CONSTRUCTS) for k, b in enumerate(bs))}),
z as (select *, 1 + coalesce(sum([{", ".join(str(t.count(chr(10)) + 2) for t, _ in CONSTRUCTS)}][1 + i % {N}]) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as first_line from l),
m as (select doc_id, i, k, kind, level, depth, first_line + a as start_line, first_line + e as end_line, language, replace(form, '{{s}}', s) as text from z join k on p = i % {N}
  union all select doc_id, max(i) + 1, 0, 'thematic_break', null, 0, max(first_line + [{", ".join(str(t.count(chr(10)) + 2) for t, _ in CONSTRUCTS)}][1 + i % {N}]), max(first_line + [{", ".join(str(t.count(chr(10)) + 2) for t, _ in CONSTRUCTS)}][1 + i % {N}]), null, '***' from z group by doc_id),
b as (select doc_id, row_number() over (partition by doc_id order by i, k) - 1 as block, kind, level, depth, cast(start_line as bigint) as start_line, cast(end_line as bigint) as end_line, language, text from m)"""


#: All but A-Z, a-z and 0-9, said by its ranges: Java takes six times as long over the same class said by what it leaves out.
OTHERS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x{10FFFF}]+"


def said(line):
    return F.trim(F.concat(F.lit("x "), F.trim(F.regexp_replace(line, OTHERS, " "))))


def notes(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, note): a Markdown note for each document."""
    forms = F.array(*[F.lit(t) for t, _ in CONSTRUCTS])
    parts = F.transform(F.split("text", "\n"), lambda line, i: F.replace(F.get(forms, i % N), F.lit("{s}"), said(line)))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.array_join(parts, "\n\n"), F.lit("\n\n***")).alias("note"))


@query(f"with {BLOCKS} select doc_id, block, kind, cast(level as integer) as level, cast(depth as integer) as depth, start_line, end_line, language, md5(text) as text_key from b")
def q_markdown_tree(spark: SparkSession, d: str) -> DataFrame:
    """Every block of every note: nested lists, quotes with lazy lines, headings of both styles, tables, fences, HTML."""
    found = M.blocks(notes(spark, d), text_col="note")
    return found.select("doc_id", "block", "kind", "level", "depth", "start_line", "end_line", "language", F.md5("text").alias("text_key"))


ENDS = ("two", "deep")


@query(f"""with {BLOCKS}, f as (select *, min(case when kind = 'heading' and level = 1 then block end) over (partition by doc_id) as a from b),
e as (select *, min(case when kind in ('heading', 'paragraph', 'ordered_list_item', 'unordered_list_item') and text in ({", ".join(f"'{x}'" for x in ENDS)}) and block > a then block end) over (partition by doc_id) as z from f)
select doc_id, block, kind from e where a is null or (block >= a and (z is null or block < z))""")
def q_scraped_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks between the first title and a label that ends articles."""
    return M.article(M.blocks(notes(spark, d), text_col="note"), ENDS).select("doc_id", "block", "kind")


LIMIT = 1500
COMMAND = f"""not regexp_matches(l1, '{OUTPUTS}') and regexp_extract(lower(case when regexp_extract(l1, '{PROMPT}', 1) = '' then l1 else trim(regexp_extract(l1, '{PROMPT}', 1)) end), '{COMMAND_NAME}', 1) in ({", ".join(f"'{c}'" for c in COMMANDS)})"""
REDACTED = r"""regexp_replace(regexp_replace(text, '[A-Za-z0-9_]{2,16}\{[^{}\s]{1,128}\}', '[REDACTED]', 'g'), '(^|[^A-Za-z0-9])[0-9a-fA-F]{32}([^A-Za-z0-9]|$)', '\1[REDACTED]\2', 'g')"""


@query(f"""with {BLOCKS},
r as (select doc_id, block, kind, level, start_line, end_line, {REDACTED} as text, trim(regexp_extract({REDACTED}, '^\\s*([^\\r\\n]+)', 1)) as l1 from b),
h as (select *, min(case when kind = 'heading' then block end) over (partition by doc_id) as tb, case when kind = 'heading' then 'H' when kind = 'code' then case when {COMMAND} then 'C' else 'R' end else 'T' end as letter from r),
t as (select *, min(case when block = tb then level end) over (partition by doc_id) as tl, min(case when kind = 'heading' and block > tb then level end) over (partition by doc_id) as later,
  min(case when kind = 'heading' then level end) over (partition by doc_id order by block rows between unbounded preceding and 1 preceding) as low from h),
o as (select *, case when tl = 1 and later > 1 then block = tb or (kind = 'heading' and level <= later) else kind = 'heading' and (low is null or level <= low) end or block = 0 as opens from t),
s as (select *, cast(sum(case when opens then 1 else 0 end) over (partition by doc_id order by block) - 1 as bigint) as section from o),
n as (select *, row_number() over (partition by doc_id, section order by block) as n from s),
g as (select doc_id, section, unnest(range(len(ps))) as g, unnest(ps) as piece from (select doc_id, section, regexp_extract_all(string_agg(letter, '' order by n), '{M.GROUP}') as ps from n group by all)),
e as (select *, sum(len(piece)) over (partition by doc_id, section order by g) as last from g),
c as (select e.doc_id, e.section, g, sum(length(text)) + 2 * (count(*) - 1) as n_chars, min(block) as a, max(block) as z from e join n on n.doc_id = e.doc_id and n.section = e.section and n.n between e.last - len(piece) + 1 and e.last group by all),
p as (select doc_id, section, list_reduce(list_prepend({{'room': -1::bigint, 'pack': 0::bigint, 'packs': []::bigint[]}}, list({{'room': n_chars::bigint, 'pack': 0::bigint, 'packs': []::bigint[]}} order by g)),
  lambda x, y: case when x.room < 0 then {{'room': y.room, 'pack': 0::bigint, 'packs': [0::bigint]}} when x.room + 2 + y.room > {LIMIT} then {{'room': y.room, 'pack': x.pack + 1, 'packs': list_append(x.packs, x.pack + 1)}}
    else {{'room': x.room + 2 + y.room, 'pack': x.pack, 'packs': list_append(x.packs, x.pack)}} end).packs as packs from c group by doc_id, section),
q as (select c.*, p.packs[1 + g] as pack from c join p using (doc_id, section))
select doc_id, section, pack, min(a) as first_block, max(z) as last_block, max(n_chars) > {LIMIT} as oversized, cast(sum(n_chars) + 2 * (count(*) - 1) as bigint) as n_chars from q group by doc_id, section, pack""")
def q_segments_grammar(spark: SparkSession, d: str) -> DataFrame:
    """Segments of the notes: sections, groups that are never cut, greedy packs."""
    found = M.segments(M.blocks(notes(spark, d), text_col="note"), LIMIT)
    return found.select("doc_id", "section", "pack", "first_block", "last_block", "oversized", "n_chars")


#: (kind, text, what is visible, role) of the blocks that lines are written into; the third opens a wrapper, the fifth ends it.
WRAPPERS = [
    ("html", '<div align="center">\n<h1>{s}</h1>\n<br>a &amp; b</div>', "{s}\na & b", "unwrapped"),
    ("paragraph", "{s}", "{s}", "kept"),
    ("html", '<div align="center">', "", "empty_wrapper"),
    ("html", '<p style="text-align: center"><img src="a.png" alt="{s}"></p>', "{s}", "unwrapped"),
    ("html", " </div> ", " </div> ", "closing"),
    ("html", "</div>", "</div>", "kept"),
    ("html", '<div align="left">{s}</div>', '<div align="left">{s}</div>', "kept"),
    ("heading", "<p align=center>{s}</p> tail", "<p align=center>{s}</p> tail", "kept"),
    ("code", '<div align="center">{s}</div>', '<div align="center">{s}</div>', "kept"),
    ("paragraph", "<p align='center'><b>{s}</p>", "{s}", "unwrapped"),
    ("html", '<div align="center"><div align="center">{s}</div>', "{s}", "unwrapped"),
    ("html", "<div align=center>{s}<!-- <p> --></div></b>", "{s}", "unwrapped"),
    ("html", "</p>", "</p>", "closing"),
]


@query(f"""with {LINES}, w(p, kind, visible, role) as (values {", ".join(f"({p}, {_sql(k)}, {_sql(v)}, {_sql(r)})" for p, (k, _, v, r) in enumerate(WRAPPERS))})
select doc_id, i as block, role, md5(replace(visible, '{{s}}', s)) as visible_key from l join w on p = i % {len(WRAPPERS)}""")
def q_centred_wrappers(spark: SparkSession, d: str) -> DataFrame:
    """Centred HTML wrappers taken off the blocks that the lines are written into."""
    form = F.get(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("text")) for k, t, *_ in WRAPPERS]), (F.col("block") % len(WRAPPERS)).cast("int"))
    # outer: a filter on the number of lines would split each text once more
    rows = table(spark, d, "documents").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("block", "line")).where("block is not null")
    rows = rows.select("doc_id", F.col("block").cast("long").alias("block"), form["kind"].alias("kind"), F.replace(form["text"], F.lit("{s}"), said(F.col("line"))).alias("text"))
    return M.unwrapped(rows).select("doc_id", "block", "role", F.md5("visible").alias("visible_key"))
