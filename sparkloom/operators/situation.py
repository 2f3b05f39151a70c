"""The situation of an engagement as sums of its events: counts, latest places and digests per family, kept by deltas.

Every event of a family adds one entry. A family's digest is the sum (modulo 2 ** 60) of its entries' hashes, so it does
not depend on the order in which events came, and the digest of old and new events is the sum of both. An append reads
the new events and the few state rows of their engagements, never the journal; a rebuild over all events gives the same.

Defined results: events of no family and rows without an engagement add nothing; a null payload counts as an empty one;
rows that repeat an engagement and sequence count as often as they come (the journal forbids them); references that no
earlier event of the engagement answers are told by ``ungrounded``, and do not stop the sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which event types make which family of the situation.
FAMILIES = {
    "interpretations": ("interpretation_succeeded", "interpretation_failed"),
    "observations": ("observation_extracted",),
    "hypotheses": ("hypothesis_formed",),
    "unresolved": ("missing_information_identified",),
    "attempts": ("outcome_assessed",),
    "proofs": ("objective_proof_observed", "flag_rejected"),
    "research": ("research_source_consulted", "research_source_assessed"),
}
MODULUS = 1 << 60
#: Families of which the situation shows the material revision: the last event that changed what is known.
STATE = ["engagement_id", "family", "n_entries", "last_sequence", "digest"]


def family_of(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, kinds in FAMILIES.items():
        out = F.when(kind.isin(*kinds), name).otherwise(out)
    return out


def entry_hash(*material: Column) -> Column:
    """The first 60 bits of the sha256 of the material, as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(m.cast("string"), F.lit("")) for m in material]), 256), 1, 15), 16, 10).cast("long")


def deltas(events: DataFrame) -> DataFrame:
    """(engagement_id, family, n_entries, last_sequence, digest): what events (engagement_id, sequence, event_id, type, payload) add."""
    rows = events.select("engagement_id", family_of(F.col("type")).alias("family"), "sequence", entry_hash(F.col("engagement_id"), F.col("sequence"), F.col("event_id"), F.col("type"), F.col("payload")).alias("hash"))
    return summed(rows.where("family is not null and engagement_id is not null").select("engagement_id", "family", F.lit(1).cast("long").alias("n_entries"), F.col("sequence").cast("long").alias("last_sequence"), F.col("hash").alias("digest")))


def summed(rows: DataFrame) -> DataFrame:
    """State rows and deltas of the same families added up."""
    digest = F.sum(F.col("digest").cast("decimal(38,0)")) % F.lit(MODULUS)
    return rows.groupBy("engagement_id", "family").agg(F.sum("n_entries").alias("n_entries"), F.max("last_sequence").alias("last_sequence"), digest.cast("long").alias("digest"))


def appended(state: DataFrame, events: DataFrame) -> DataFrame:
    """The state after more events."""
    return summed(state.select(*STATE).unionByName(deltas(events)))


def touched(state: DataFrame, events: DataFrame) -> DataFrame:
    """The state rows that more events change, after the change: what a store has to replace. Only their engagements are read."""
    new = deltas(events)
    old = state.select(*STATE).join(new.select("engagement_id", "family"), ["engagement_id", "family"], "left_semi")
    return summed(old.unionByName(new))


def situations(state: DataFrame) -> DataFrame:
    """One row for each engagement: entries of each family, the material revision, and one digest over the families in order of name."""
    names = sorted(FAMILIES)
    # each family of an engagement is one state row, so the conditional sums only turn rows into columns
    wide = state.groupBy("engagement_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("family") == f, F.col("n_entries"))), F.lit(0)).alias(f"n_{f}") for f in names],
        F.max("last_sequence").alias("material_revision"),
        *[F.coalesce(F.sum(F.when(F.col("family") == f, F.col("digest"))), F.lit(0)).alias(f"_{f}") for f in names],
    )
    whole = F.sha2(F.concat_ws("|", *[F.concat(F.lit(f"{f}:"), F.col(f"_{f}").cast("string")) for f in names]), 256)
    return wide.withColumn("situation_sha256", whole).drop(*[f"_{f}" for f in names])


def ungrounded(events: DataFrame, cites: Column, known: DataFrame | None = None) -> DataFrame:
    """(engagement_id, sequence, cited) of citations (an array of event ids) that no earlier event of the engagement answers.

    ``known`` (engagement_id, event_id, sequence) holds earlier journals; of it only the ids that are cited are looked up.
    """
    own = events.select("engagement_id", "event_id", F.col("sequence").alias("at"))
    places = own if known is None else own.unionByName(known.select("engagement_id", "event_id", F.col("sequence").alias("at")))
    asked = events.where(family_of(F.col("type")).isNotNull()).select("engagement_id", "sequence", F.explode(cites).alias("cited")).distinct()
    found = asked.join(places, (asked["engagement_id"] == places["engagement_id"]) & (asked["cited"] == places["event_id"]) & (places["at"] < asked["sequence"]), "left_anti")
    return found.select("engagement_id", "sequence", "cited")
