"""Projection of nested records, digests, upserts, and audits of tables against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def nested(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str, order: str) -> DataFrame:
    """Parents with their children as one ordered array of structs."""
    item = F.struct(order, *[c for c in children.columns if c not in (order, child_key)])
    lists = children.groupBy(F.col(child_key).alias(key)).agg(F.array_sort(F.collect_list(item)).alias(name))
    return parents.join(lists, key, "left")


def projected(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Child rows of the nested records, unnested again, with a stable id each."""
    each = rows.select(key, F.explode(name).alias("c")).select(key, "c.*")
    kept = [c for c in each.columns if c != key]
    return each.withColumn("artifact_id", X.content_id(F.lit("step"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [key, *sorted(kept)]])))


def search_text(values: Column, limit: int = 8192) -> Column:
    """Search column of a record: distinct values, sorted, joined, redacted, cut."""
    return F.left(X.redact(F.array_join(F.array_sort(F.array_distinct(F.filter(values, lambda v: v != ""))), " ")), F.lit(limit))


def facet_rows(rows: DataFrame, id_col: str, columns: dict[str, Column]) -> DataFrame:
    """Unpivot: one facet row for each non-null column, with a content id; equal facets of a record are one row."""
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in columns.items()]))
    out = rows.select(F.col(id_col).alias("artifact_id"), each).where("value is not null").dropDuplicates(["artifact_id", "key", "value"])
    return out.withColumn("facet_id", F.left(X.digest(F.col("artifact_id"), F.col("key"), F.col("value")), F.lit(24)))


def row_digests(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, digest): independent of the order of the rows of a key."""
    each = rows.select(key, F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("r"))
    return each.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("r")), ";"), 256).alias("digest"))


def merge_sources(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Every row of a source that came anew is replaced; sources that did not come stay as they are."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def merge_records(current: DataFrame, incoming: DataFrame, key: str, created: str, updated: str) -> DataFrame:
    """The latest version of each record with its first creation time."""
    both = current.unionByName(incoming)
    rest = [c for c in both.columns if c not in (key, created)]
    newest = F.max_by(F.struct(*rest), F.struct(F.col(updated), *[F.col(c) for c in rest if c != updated]))
    return both.groupBy(key).agg(F.min(created).alias(created), newest.alias("r")).select(key, created, "r.*")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    keys = parents.select(F.col(parent_key).alias(child_key))
    return children.join(keys, child_key, "left_anti")


def duplicate_excess(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: by how many the rows exceed their distinct keys."""
    return rows.groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("excess"))


def parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, state): missing, orphan, stale or equal, by a full outer join on the key."""
    a, b = left.select(key, F.col("digest").alias("a")), right.select(key, F.col("digest").alias("b"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "orphan").when(F.col("a") != F.col("b"), "stale").otherwise("equal")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def unchanged(rows: DataFrame, manifest: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with ``unchanged``: the manifest holds the same key with the same values (null-safe)."""
    m = manifest.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_known"))
    same = F.coalesce(F.col("_known"), F.lit(False))
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(m, key, "left").withColumn("unchanged", same).select(*rows.columns, "unchanged")


def page_after(rows: DataFrame, key: str, cursor, size: int) -> DataFrame:
    """Keyset page: the rows behind the cursor; the filter reaches the scan."""
    return rows.where(F.col(key) > F.lit(cursor)).orderBy(key).limit(size)


def omitted_digest(rows: DataFrame, key: str, size: int, by: str) -> DataFrame:
    """For each group, what lies behind its first page: how many, and a digest over their keys in order."""
    w = Window.partitionBy(by).orderBy(key)
    ranked = rows.select(by, key, F.row_number().over(w).alias("n")).where(F.col("n") > size)
    return ranked.groupBy(by).agg(F.count("*").alias("n_omitted"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ","), 256).alias("digest"))


def select_duplicates(rows: DataFrame, identity: list[str], order: list[Column]) -> DataFrame:
    """One row for each identity: the least in the given order."""
    rest = [c for c in rows.columns if c not in identity]
    return rows.groupBy(*identity).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"), F.count("*").alias("n_same")).select(*identity, "r.*", "n_same")


def batch_complete(rows: DataFrame, batch: str, ordinal: str, mark: str) -> DataFrame:
    """(batch, n, complete): ordinals run from 1 without gap or repeat, and the mark is the same all over."""
    g = rows.groupBy(batch).agg(F.count("*").alias("n"), F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi"), F.count_distinct(ordinal).alias("u"), F.count_distinct(mark).alias("m"))
    return g.select(batch, "n", ((F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("u") == F.col("n"))).alias("complete"), (F.col("m") == 1).alias("uniform"))


def attach_assets(docs: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets of each document: files in its folder or any folder below; an equi-join on ancestor folders.

    ``docs``: (doc_path); ``assets``: (asset_path). No path is compared with another by prefix.
    """
    folder = F.regexp_replace("doc_path", r"/?[^/]*$", "")
    owners = docs.select("doc_path", folder.alias("dir"))
    above = assets.select("asset_path", F.explode(X.ancestors(F.col("asset_path"))).alias("dir"))
    return owners.join(above, "dir").where("doc_path <> asset_path").groupBy("doc_path").agg(F.array_sort(F.collect_set("asset_path")).alias("assets"))


def intervals_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of one key whose closed intervals [start, end] meet; hash join on the key, range as a residual."""
    x, y = a.alias("x"), b.alias("y")
    hit = (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.end") >= F.col("y.start")) & (F.col("x.start") <= F.col("y.end"))
    return x.join(y, hit)


def coverage_cursor(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, cursor, n_gaps): how far intervals of a key reach from their first start without a gap."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("gap", (F.col(start) > reach).cast("int")).withColumn("g", F.sum(F.coalesce("gap", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key).agg(F.max(F.when(F.col("g") == 0, F.col(end))).alias("cursor"), F.max("g").cast("long").alias("n_gaps"))
