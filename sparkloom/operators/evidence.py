"""Evidence, references and their rules: blobs with quotas, pages, registries, slices, constraints, drill-downs.

All of it is joins, windows within a key and aggregates; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import running_total
from .retrieval import small


def page_between(rows: DataFrame, order: str, after: int, through: int, limit: int) -> DataFrame:
    """The first ``limit`` rows behind ``after`` and up to the watermark ``through``: later appends never move a page."""
    return rows.where((F.col(order) > after) & (F.col(order) <= through)).orderBy(order).limit(limit)


def orphans(listing: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Listed rows whose key nothing refers to."""
    return listing.join(references.select(key).distinct(), key, "left_anti")


def orphan_counts(found: DataFrame, shown: DataFrame, key: str) -> DataFrame:
    """(key, n): how often an orphan that no page has shown yet occurs."""
    return orphans(found, shown, key).groupBy(key).agg(F.count("*").alias("n"))


def admitted_blobs(blobs: DataFrame, by: str, order: str, digest: str, size: str, item_limit: int, total_limit: int) -> DataFrame:
    """Adds ``verdict``: stored, duplicate, too_large or over_quota.

    A digest is stored once for each key of ``by``; what is stored up to a blob, itself included, must fit the total.
    ``order`` is a number that tells the blobs of a key apart; the budget of a hot key runs in two levels.
    """
    first = blobs.groupBy(F.col(by).alias("_of"), F.col(digest).alias("_what")).agg(F.min(order).alias("_at"))
    rows = blobs.join(first, F.col(by).eqNullSafe(F.col("_of")) & F.col(digest).eqNullSafe(F.col("_what"))).withColumn("_first", F.col(order) == F.col("_at")).drop("_of", "_what", "_at")
    fits = F.col(size) <= item_limit
    rows = running_total(rows.withColumn("_new", F.when(F.col("_first") & fits, F.col(size)).otherwise(0)), by, [order], "_new", "_used")
    verdict = F.when(~fits, "too_large").when(~F.col("_first"), "duplicate").when(F.col("_used") > total_limit, "over_quota").otherwise("stored")
    return rows.withColumn("verdict", verdict).drop("_first", "_new", "_used")


def registry_merge(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, values, state) of the registry after an update: added, updated, unchanged or kept (not in the update)."""
    a, b = old.select(key, F.struct(*values).alias("_old")), new.select(key, F.struct(*values).alias("_new"))
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "kept").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    rows = a.join(b, key, "full").withColumn("state", state).withColumn("_row", F.coalesce("_new", "_old"))
    return rows.select(key, *[F.col(f"_row.{v}").alias(v) for v in values], "state")


def slice_errors(slices: DataFrame, attachments: DataFrame, key: str) -> DataFrame:
    """Slices (key, start, stop, media) against attachments (key, size, kind): the first rule that each breaks, or null."""
    rows = slices.join(attachments.select(key, "size", "kind"), key, "left")
    error = (
        F.when(F.col("size").isNull(), "unknown_attachment")
        .when((F.col("start") < 0) | (F.col("stop") <= F.col("start")) | (F.col("stop") > F.col("size")), "range")
        .when(F.col("media") != F.col("kind"), "media")
    )
    return rows.withColumn("error", error)


def over_budget(candidates: DataFrame, by: str, order: list[Column], most: int, limits: dict[str, int]) -> DataFrame:
    """Adds ``reason``: the first column above its limit, ``too_many`` beyond ``most`` candidates of a key, or null."""
    reason = F.lit(None).cast("string")
    for column, limit in reversed(limits.items()):
        reason = F.when(F.col(column) > limit, column).otherwise(reason)
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return candidates.withColumn("_n", place).withColumn("reason", F.when(F.col("_n") > most, "too_many").otherwise(reason)).drop("_n")


def applicable_examples(constraints: DataFrame, observed: DataFrame, example: str = "example") -> DataFrame:
    """(example, applicable, n_broken): constraints (example, dimension, relation, value) against observed (dimension, value).

    ``required`` needs its value among the observed ones, ``incompatible`` forbids it, and ``platform`` needs it only
    where the dimension was observed at all.
    """
    seen = observed.groupBy("dimension").agg(F.collect_set("value").alias("values"))
    rows = constraints.join(F.broadcast(seen), "dimension", "left")  # one row for each dimension of one situation
    there = F.coalesce(F.array_contains("values", F.col("value")), F.lit(False))
    relation = F.col("relation")
    broken = ((relation == "required") & ~there) | ((relation == "incompatible") & there) | ((relation == "platform") & F.col("values").isNotNull() & ~there)
    return rows.groupBy(example).agg((~F.bool_or(broken)).alias("applicable"), F.count_if(broken).alias("n_broken"))


def ownership_conflicts(claims: DataFrame, manifest: DataFrame, key: str, owner: str) -> DataFrame:
    """Adds ``conflict``: foreign_owner, ambiguous_owner or null, for claims on keys that a manifest gives to owners."""
    held = manifest.groupBy(key).agg(F.count_distinct(owner).alias("_n"), F.min(owner).alias("_owner"))
    conflict = F.when(F.col("_n") > 1, "ambiguous_owner").when(F.col("_owner") != F.col(owner), "foreign_owner")
    return claims.join(held, key, "left").withColumn("conflict", conflict).drop("_n", "_owner")


def envelope_violations(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events (type, lane, origin) against rules (type, needs_lane, system_only): the first rule broken, or null."""
    rows = events.join(F.broadcast(rules), "type", "left")  # a closed table of event types
    violation = (
        F.when(F.col("needs_lane").isNull(), "unknown_type").when(F.col("needs_lane") & F.col("lane").isNull(), "lane_required").when(F.col("system_only") & (F.col("origin") != "system"), "system_only")
    )
    return rows.withColumn("violation", violation).drop("needs_lane", "system_only")


def resumable(rows: DataFrame, asked: DataFrame, by: str, scopes: str) -> DataFrame:
    """(request, n, chosen, how): the one row that a request's name or scopes pick; ambiguous if several, none if no one.

    Requests with the same scopes that rows carry are one class, and so are rows with the same scopes that are asked for;
    only classes meet, so the work does not grow with requests times rows.
    """
    exploded = rows.where(F.col(by).isNotNull()).select(F.col(by).alias("row"), F.explode(scopes).alias("scope"))
    wanted = asked.select("request", F.explode(scopes).alias("scope"))
    both = small(exploded.select("scope").distinct().join(wanted.select("scope").distinct(), "scope"))

    def sets(of: DataFrame, one: str) -> DataFrame:
        return of.join(both, "scope", "left_semi").groupBy(one).agg(F.array_sort(F.collect_set("scope")).alias("scopes"))

    kinds = sets(exploded, "row").groupBy("scopes").agg(F.count("*").alias("n"), F.min("row").alias("chosen"))
    known = sets(wanted, "request")
    met = known.select(F.col("scopes").alias("asked")).distinct().withColumn("scope", F.explode("asked")).join(kinds.withColumn("scope", F.explode("scopes")), "scope")
    each = met.groupBy("asked", "scopes").agg(F.first("n").alias("n"), F.first("chosen").alias("chosen"))  # classes that share several scopes meet once
    answers = each.groupBy("asked").agg(F.sum("n").alias("n"), F.min("chosen").alias("chosen"))
    found = known.join(small(answers), F.col("scopes") == F.col("asked")).select("request", "n", "chosen")
    got = asked.select("request").join(found, "request", "left").na.fill(0, ["n"])
    how = F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("ambiguous")
    return got.select("request", "n", F.when(F.col("n") == 1, F.col("chosen")).alias("chosen"), how.alias("how"))


def all_proven(required: DataFrame, assessments: DataFrame, key: str, proof: str, order: str) -> DataFrame:
    """(key, n_required, complete): whether the latest assessment of every required proof says supported."""
    last = assessments.groupBy(key, proof).agg(F.max_by("status", order).alias("status"))
    rows = required.join(last, [key, proof], "left")
    supported = F.coalesce(F.col("status") == "supported", F.lit(False))
    return rows.groupBy(key).agg(F.count("*").alias("n_required"), F.bool_and(supported).alias("complete"))


def verdict_violations(verdicts: DataFrame) -> DataFrame:
    """Adds ``violation``: verified with a material finding, reasons and messages of different number, citations not sorted and unique."""
    material = F.exists("findings", lambda f: f == "material")
    sound = F.array_sort(F.array_distinct("citations")) == F.col("citations")
    violation = F.when(F.col("verified") & material, "material_finding").when(F.size("reasons") != F.size("messages"), "unmatched_reasons").when(~sound, "citations")
    return verdicts.withColumn("violation", violation)


def child_sessions(sessions: DataFrame, session: str, parent: str, owner: str) -> DataFrame:
    """Child sessions with the owner that their parent is bound to; ``link`` says bound, unbound_parent or unknown_parent."""
    above = sessions.select(F.col(session).alias(parent), F.lit(True).alias("_known"), F.col(owner).alias("parent_owner"))
    rows = sessions.where(F.col(parent).isNotNull()).select(session, parent).join(above, parent, "left")
    link = F.when(F.col("_known").isNull(), "unknown_parent").when(F.col("parent_owner").isNull(), "unbound_parent").otherwise("bound")
    return rows.select(session, parent, "parent_owner", link.alias("link"))


def backed_values(values: DataFrame, proofs: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``backing``: one if exactly one supported proof refers to the value, none or several otherwise."""
    n = proofs.where("status = 'supported'").groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = values.join(n, keys, "left")
    return rows.withColumn("backing", F.when(F.col("_n") == 1, "one").when(F.col("_n") > 1, "several").otherwise("none")).drop("_n")


def archive_matches(records: DataFrame, archive: DataFrame, key: str, digest: str) -> DataFrame:
    """Records against the archived row that they cite by id: same, changed or missing."""
    there = archive.select(key, F.col(digest).alias("_digest"), F.lit(True).alias("_there"))
    rows = records.join(there, key, "left")
    return rows.withColumn("state", F.when(F.col("_there").isNull(), "missing").when(F.col(digest).eqNullSafe(F.col("_digest")), "same").otherwise("changed")).drop("_digest", "_there")


def drill_down(hits: DataFrame, examples: DataFrame, by: str, artifact: str, lane_order: list[str], most: int = 16) -> DataFrame:
    """(by, example, lane, n): the first ``most`` distinct applicable examples of the hits, lanes in order, then rank.

    An example that several hits share counts at its best place.
    """
    place = F.array_position(F.array(*map(F.lit, lane_order)), F.col("lane")).cast("int")
    rows = hits.withColumn("_lane", place).join(examples.where("applicable").select(artifact, "example"), artifact)
    best = rows.groupBy(by, "example").agg(F.min(F.struct("_lane", "rank", "lane")).alias("_m"))
    order = Window.partitionBy(by).orderBy("_m._lane", "_m.rank", "example")
    return best.withColumn("n", F.row_number().over(order).cast("long")).where(F.col("n") <= most).select(by, "example", "_m.lane", "n")


def outcome_totals(outcomes: DataFrame, variant: str, category: str) -> DataFrame:
    """(variant, totals): the outcomes of a variant by category, as "category=n" in order of the categories."""
    n = outcomes.groupBy(variant, category).agg(F.count("*").alias("n"))
    each = F.array_sort(F.collect_list(F.concat_ws("=", F.col(category), F.col("n").cast("string"))))
    return n.groupBy(variant).agg(F.array_join(each, ",").alias("totals"))  # categories are a closed set


def capped(rows: DataFrame, by: str, order: list[Column], most: int, mandatory: Column, reserve: int) -> DataFrame:
    """At most ``most`` rows of a key: first up to ``reserve`` mandatory ones, then the others in order, then what is left."""
    inner = F.row_number().over(Window.partitionBy(by, mandatory).orderBy(*order))
    rows = rows.withColumn("_must", mandatory).withColumn("_n", inner)
    first = F.col("_must") & (F.col("_n") <= reserve)
    w = Window.partitionBy(by).orderBy(F.when(first, 0).otherwise(1), *order)
    return rows.withColumn("n", F.row_number().over(w).cast("long")).where(F.col("n") <= most).drop("_must", "_n")


def frontier_violations(proposals: DataFrame, batch: str, place: str, entity: str, score: str, least: int = 3) -> DataFrame:
    """(batch, n, n_rising, n_repeated, needs_rationale): scores must fall with the place, entities be unique, and a short batch say why."""
    rows = proposals.withColumn("_before", F.lag(score).over(Window.partitionBy(batch).orderBy(place)))
    n = F.count("*")
    return rows.groupBy(batch).agg(
        n.alias("n"), F.count_if(F.col(score) > F.col("_before")).alias("n_rising"), (n - F.count_distinct(entity)).alias("n_repeated"), ((n < least) & (F.max(F.length(F.trim("rationale"))) == 0)).alias("needs_rationale")
    )


def pending_first(attachments: DataFrame, attempts: DataFrame, by: str, key: str, most: int = 512) -> DataFrame:
    """The first ``most`` pending attachments of a key: never attempted ones first, then by last attempt, then by id."""
    last = attempts.groupBy(by, key).agg(F.max("seq").alias("last_attempt"))
    rows = attachments.join(last, [by, key], "left")
    order = Window.partitionBy(by).orderBy(F.coalesce("last_attempt", F.lit(0)), key)
    return rows.withColumn("n", F.row_number().over(order).cast("long")).where(F.col("n") <= most)


def children(rows: DataFrame, array: str, keys: list[str], wanted: DataFrame, child: str = "id") -> DataFrame:
    """The elements of an array that a request names by parent keys and child id."""
    each = rows.select(*keys, F.explode(array).alias("_c")).select(*keys, "_c.*")
    return each.join(wanted, [*keys, child], "left_semi")


def snapshot_token(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(token, n): one digest of a whole table, whatever its order: sums of row digests, so no task holds more than a running total."""
    row = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)
    part = rows.select(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)").alias("h"), F.conv(F.substring(row, 16, 15), 16, 10).cast("decimal(38,0)").alias("g"))
    total = part.agg(F.count("*").alias("n"), F.sum("h").alias("h"), F.sum("g").alias("g"))
    return total.select(F.sha2(F.concat_ws("-", F.col("n").cast("string"), F.col("h").cast("string"), F.col("g").cast("string")), 256).alias("token"), "n")
