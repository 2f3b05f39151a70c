"""Policies, constraints, compilation routing, reports and bounded context: the operators around retrieval and journals."""

from __future__ import annotations

import base64
import html
import json
from collections.abc import Callable, Iterator
from urllib.parse import quote, quote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import exprs as X
from .relational import running_total


def authorized(targets: DataFrame, scopes: DataFrame, target: str = "target") -> DataFrame:
    """Targets with whether a scope entry covers them. ``scopes``: (kind, value) with kinds exact, hostname, origin, cidr.

    Exact values, host names and url origins are equi-joins. A CIDR block becomes a pair of (prefix length, prefix)
    and each IPv4 target meets it under its own prefixes, so containment is an equi-join too.
    """
    v = F.lower(F.trim(F.col(target)))
    kind = X.target_kind(v)
    host = F.lower(F.regexp_extract(v, r"^[a-z]+://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    origin = F.regexp_extract(v, r"^([a-z]+://[^/?#]+)", 1)
    number = F.when(kind == "ipv4", X.ipv4_number(v))
    prefixes = F.transform(F.sequence(F.lit(0), F.lit(32)), lambda n: F.concat(n.cast("string"), F.lit("/"), F.floor(number / F.pow(F.lit(2.0), 32 - n)).cast("long").cast("string")))
    single = F.array(F.struct(F.lit("exact").alias("kind"), v.alias("value")), F.struct(F.lit("hostname").alias("kind"), F.when(kind == "url", host).otherwise(v).alias("value")), F.struct(F.lit("origin").alias("kind"), origin.alias("value")))
    ranged = F.when(number.isNotNull(), F.transform(prefixes, lambda p: F.struct(F.lit("cidr").alias("kind"), p.alias("value")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    keys = targets.select(target, F.explode(F.concat(single, ranged)).alias("k")).select(target, "k.kind", "k.value").where("value <> ''").distinct()
    bits = F.substring_index("value", "/", -1).cast("int")
    block = F.concat(bits.cast("string"), F.lit("/"), F.floor(X.ipv4_number(F.substring_index("value", "/", 1)) / F.pow(F.lit(2.0), 32 - bits)).cast("long").cast("string"))
    entries = scopes.select("kind", F.when(F.col("kind") == "cidr", block).otherwise(F.lower("value")).alias("value")).distinct()
    covered = keys.join(entries, ["kind", "value"], "left_semi").select(target).distinct().withColumn("_ok", F.lit(True))
    return targets.join(covered, target, "left").withColumn("authorized", F.coalesce("_ok", F.lit(False)) & (kind != "invalid")).drop("_ok")


def variants(value: str) -> list[str]:
    """How a value may stand in a text, lower case: as it is, percent-encoded, with HTML references, in Base64 and in hex."""
    raw = value.encode()
    forms = [value, quote(value, safe=""), quote_plus(value), html.escape(value), base64.b64encode(raw).decode().rstrip("="), base64.urlsafe_b64encode(raw).decode().rstrip("="), raw.hex()]
    return sorted({f.lower() for f in forms})


def encoded_leaks(texts: DataFrame, private: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, n_values): texts that hold private values in any case and in any of their encodings, each value counted once."""
    low = F.lower(F.col(text_col))
    table = F.array(*[F.array(*map(F.lit, variants(p))) for p in sorted(set(private))])
    held = F.filter(table, lambda forms: F.exists(forms, lambda f: F.contains(low, f)))
    return texts.select(id_col, F.size(held).cast("long").alias("n_values")).where("n_values > 0")


def leaks(texts: DataFrame, private: list[str], id_col: str, text_col: str) -> DataFrame:
    """Texts that hold a private value in any case; the inventory is a short list of the caller's."""
    low = F.lower(F.col(text_col))
    hits = F.filter(F.array(*map(F.lit, sorted({p.lower() for p in private}))), lambda p: F.contains(low, p))
    return texts.select(id_col, F.size(hits).cast("long").alias("n_leaks")).where("n_leaks > 0")


def symbolized(text: Column, private: list[tuple[str, str]]) -> Column:
    """Private values replaced by their symbols, the longest first."""
    for value, symbol in sorted(private, key=lambda p: (-len(p[0]), p[0])):
        text = F.replace(text, F.lit(value), F.lit(symbol))
    return text


def research_policy(queries: DataFrame, text_col: str, aliases: list[str], flags: list[str]) -> DataFrame:
    """Outgoing queries with a decision and its reason: flags first, then protected names, then emptiness."""
    low = F.lower(F.col(text_col))
    some = lambda values: F.exists(F.array(*map(F.lit, values)), lambda v: F.contains(low, F.lower(v)))
    reason = F.when(F.trim(low) == "", "empty").when(some(flags), "contains_flag").when(some(aliases), "contains_protected_alias").otherwise("allowed")
    return queries.withColumn("reason", reason).withColumn("decision", F.when(reason == "allowed", "allowed").otherwise("rejected"))


def topic_compatible(sources: DataFrame, topics_col: str, exclusions: dict[str, list[str]], observed: str) -> DataFrame:
    """Sources whose topics the observed value does not exclude."""
    return sources.where(~F.arrays_overlap(F.col(topics_col), F.array(*map(F.lit, exclusions.get(observed, ["\u0000"])))))


def bundle_violations(bundles: DataFrame, key: str, declared: str, nested: str) -> DataFrame:
    """(key, missing, extra, repeats): declared ids against the ids of the nested records."""
    ids = F.transform(F.coalesce(F.col(nested), F.array().cast(bundles.schema[nested].dataType)), lambda s: s["id"])
    out = bundles.select(key, F.size(F.array_except(declared, ids)).cast("long").alias("missing"), F.size(F.array_except(ids, F.col(declared))).cast("long").alias("extra"), (F.size(ids) - F.size(F.array_distinct(ids))).cast("long").alias("repeats"))
    return out.where("missing > 0 or extra > 0 or repeats > 0")


def accounting(outcomes: DataFrame, source: str) -> DataFrame:
    """Sources that do not have exactly one outcome."""
    return outcomes.groupBy(source).agg(F.count("*").alias("n_outcomes")).where("n_outcomes <> 1")


def hot_cold(rows: DataFrame, by: str, key: str, active: Column, limit: int) -> DataFrame:
    """Rows with ``tier``: active ones first, then by key, ``limit`` of each group are hot; ``overflow`` marks an active row that is not."""
    w = Window.partitionBy(by).orderBy(active.cast("int").desc(), key)
    return rows.withColumn("n", F.row_number().over(w)).withColumn("tier", F.when(F.col("n") <= limit, "hot").otherwise("cold")).withColumn("overflow", active & (F.col("n") > limit)).drop("n")


def proof_progress(events: DataFrame, by: list[str], order: str, reset: Column, status: str, subject: str) -> DataFrame:
    """The last status of each subject in its latest generation; a reset event starts a new generation for its key."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("generation", (1 + F.sum(reset.cast("int")).over(w)).cast("long"))
    last = rows.withColumn("latest", F.max("generation").over(Window.partitionBy(*by))).where(~reset & (F.col("generation") == F.col("latest")))
    return last.groupBy(*by, subject, "generation").agg(F.max_by(status, order).alias(status), F.count("*").alias("n_assessments"))


def settlement_slices(items: DataFrame, key: str, size: str, piece: int, most_slices: int, most_bytes: int, by: str) -> DataFrame:
    """Pending bytes cut into pieces, as far as one pass of each group may go (slices and bytes, whichever ends first)."""
    pending = items.where(F.col(size) > 0).select(by, key, F.col(size).cast("long").alias(size)).withColumn("_pieces", F.ceil(F.col(size) / piece).cast("long"))
    summed = running_total(running_total(pending, by, [key], size, "_bytes"), by, [key], "_pieces", "_count")
    # only items that begin inside both limits are cut: a handful for each group
    near = summed.where((F.col("_bytes") - F.col(size) < most_bytes) & (F.col("_count") - F.col("_pieces") < most_slices))
    rows = near.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_pieces"), F.lit(most_slices).cast("long")) - 1)))
    rows = rows.withColumn("start", F.col("n") * piece).withColumn("length", F.least(F.lit(piece).cast("long"), F.col(size) - F.col("n") * piece))
    k = F.col("_count") - F.col("_pieces") + F.col("n") + 1
    used = F.col("_bytes") - F.col(size) + F.col("start") + F.col("length")
    return rows.where((k <= most_slices) & (used <= most_bytes)).select(by, key, "start", "length")


def merged_drafts(parts: DataFrame, source: str, ordinal: str, items: str, offset: str) -> DataFrame:
    """Chunk-wise drafts of a source as one: local ids get the chunk's prefix, cited indexes the chunk's offset."""
    rebased = F.transform(items, lambda x: F.struct(F.concat(F.lit("c"), F.col(ordinal).cast("string"), F.lit("_"), x["id"]).alias("id"), F.transform(x["cites"], lambda i: (i + F.col(offset)).cast("long")).alias("cites")))
    rows = parts.select(source, ordinal, rebased.alias("items"))
    ordered = F.array_sort(F.collect_list(F.struct(ordinal, "items")))
    return rows.groupBy(source).agg(ordered.alias("parts")).select(source, F.flatten(F.transform("parts", lambda p: p["items"])).alias("items"))


def compiled(prepared: DataFrame, key: str, payload: str, extract: Callable[[str], str], criticise: Callable[[str], str | None], repair: Callable[[str, str], str]) -> DataFrame:
    """(key, disposition, result, reason, n_repairs): extract, criticise, at most one repair, criticise again.

    The three steps are the caller's functions (model calls or fixtures). A row that fails is a failed row, never
    the end of the run.
    """
    kind = prepared.schema[key].dataType.simpleString()

    def one(text: str) -> tuple[str, str | None, str | None, int]:
        repairs = 0
        try:
            draft = extract(text)
            finding = criticise(draft)
            if finding is not None:
                repairs, draft = 1, repair(draft, finding)
                finding = criticise(draft)
        except Exception as e:  # noqa: BLE001  one source never stops the run
            return "failed", None, type(e).__name__, repairs
        return ("verified", draft, None, repairs) if finding is None else ("quarantined", None, finding, repairs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([one(t) for t in pdf[payload]], columns=["disposition", "result", "reason", "n_repairs"])
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    return prepared.select(key, payload).mapInPandas(run, f"{key} {kind}, disposition string, result string, reason string, n_repairs long")


SECRET_KEYS = ("password", "passwd", "secret", "token", "api_key", "authorization")


def sanitised_structure(text: str | None, most_depth: int = 32, most_nodes: int = 100_000) -> str | None:
    """JSON with secrets under telling keys redacted and keys sorted; what is too deep, too large or broken is redacted whole."""
    if text is None:
        return None
    nodes = 0

    def walk(x, depth: int):
        nonlocal nodes
        nodes += 1
        if depth > most_depth or nodes > most_nodes:
            raise ValueError("too deep or too large")
        if isinstance(x, dict):
            return {k: "[REDACTED]" if any(s in k.casefold() for s in SECRET_KEYS) else walk(v, depth + 1) for k, v in sorted(x.items())}
        return [walk(v, depth + 1) for v in x] if isinstance(x, list) else x

    try:
        return json.dumps(walk(json.loads(text), 0), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return '"[REDACTED]"'


def sanitised(x: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(sanitised_structure)

    return F.pandas_udf(run, StringType())(x)


def record_depth(x: Column, most: int = 32) -> Column:
    """Nesting depth of JSON by brackets outside strings."""
    bare = F.regexp_replace(F.regexp_replace(x, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    steps = F.transform(F.split(bare, ""), lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))
    return F.aggregate(steps, zero, lambda a, s: F.struct((a["now"] + s).alias("now"), F.greatest(a["top"], a["now"] + s).alias("top")), lambda a: a["top"]).cast("long")


def assessment(quality: Column, role: Column) -> dict[str, Column]:
    """Reliability by source quality; breadth and specificity by role."""
    return {
        "reliability": F.when(quality == "complete", 0.75).when(quality == "partial", 0.5).when(quality == "minimal", 0.25).otherwise(0.0),
        "breadth": F.when(role == "reference", "high").when(role == "guidance", "medium").when(role == "case_step", "low").otherwise("none"),
        "specificity": F.when(role.isin("case_step", "negative_evidence"), 0.75).otherwise(0.25),
    }


def health_counters(reports: DataFrame, store: str, session: str, code: str, order: str, most: int) -> DataFrame:
    """The current code of each session with its unbroken count, newest ``most`` sessions of each store."""
    w = Window.partitionBy(store, session).orderBy(order)
    rows = reports.withColumn("fresh", (F.lag(code).over(w).isNull() | (F.lag(code).over(w) != F.col(code))).cast("int"))
    rows = rows.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(store, session, "run").agg(F.max(code).alias(code), F.count("*").alias("n"), F.min(order).alias("since"))
    last = runs.groupBy(store, session).agg(F.max_by(F.struct(code, "n", "since"), "run").alias("r")).select(store, session, "r.*")
    return last.withColumn("k", F.row_number().over(Window.partitionBy(store).orderBy(F.desc("since"), session))).where(F.col("k") <= most).drop("k")
