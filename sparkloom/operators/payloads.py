"""Typed event payloads: JSON as VARIANT, checked against declared fields, and laid out as columns for one type.

Declarations are rows (type, field, kind, required): a join, not code, decides what a payload lacks or holds too much.
``kind`` is what ``schema_of_variant`` calls the value: BIGINT, STRING, BOOLEAN, ARRAY, OBJECT; NUMBER stands for all numbers.

Defined results: a payload that is no JSON object (null included) is one problem, ``not_an_object``; a null field counts as
absent; a type without declarations is ``unknown_type``; rows are told apart by the key columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of typed payloads, as "field KIND" with a question mark where the field may be absent.
DECLARED = {
    "engagement_opened": "scope_references ARRAY, title STRING?",
    "lane_bound": "lane_key STRING",
    "lane_unbound": "lane_key STRING, reason STRING?",
    "scope_changed": "scope_references ARRAY, reason STRING?",
    "objective_changed": "objective STRING",
    "decision_recorded": "decision_id STRING, strategy STRING, rationale STRING?, proposal_id STRING?",
    "tool_call_started": "call_id STRING, tool_name STRING, arguments OBJECT?",
    "tool_call_completed": "call_id STRING, technical_status STRING, duration_ms NUMBER?",
    "tool_call_terminated": "call_id STRING, reason STRING",
    "evidence_attached": "evidence_id STRING, size BIGINT, media_type STRING, sha256 STRING",
    "closure_requested": "terminal_watermark BIGINT, in_flight_call_ids ARRAY, origin STRING?",
    "closure_cancelled": "closure_event_id STRING",
    "report_generated": "report_id STRING, report_revision BIGINT, generation_reason STRING",
    "engagement_closed": "report_id STRING, report_revision BIGINT, closure_event_id STRING, terminal_watermark BIGINT",
    "engagement_verified": "report_id STRING, report_revision BIGINT",
    "observation_extracted": "fact STRING, confidence NUMBER, source_event_ids ARRAY",
    "hypothesis_formed": "statement STRING, confidence NUMBER, supporting_event_ids ARRAY, contradicting_event_ids ARRAY?",
    "missing_information_identified": "question STRING, related_event_ids ARRAY?",
    "outcome_assessed": "category STRING, summary STRING, attachment_event_id STRING, terminal_tool_event_id STRING, source_event_ids ARRAY",
    "objective_proof_observed": "proof_requirement_id STRING, assessment_generation BIGINT, assessment STRING, candidate_value OBJECT, source_event_ids ARRAY",
    "interpretation_succeeded": "attachment_event_id STRING, evidence_id STRING, covered_slices ARRAY, emitted_event_ids ARRAY",
    "interpretation_failed": "attachment_event_id STRING, evidence_id STRING, attempted_slices ARRAY, reason_code STRING",
    "frontier_proposed": "batch_id STRING, proposals ARRAY, situation_sha256 STRING",
    "frontier_criticized": "batch_id STRING, accepted BOOLEAN, critique STRING?",
    "frontier_rejected": "batch_id STRING, reason_code STRING",
    "strategy_reconciled": "batch_id STRING, expected_records BIGINT, records ARRAY",
    "strategy_archived": "strategy_id STRING, reason STRING, score NUMBER",
    "strategy_reactivated": "strategy_id STRING, archived_event_id STRING, condition STRING?",
    "research_query_proposed": "query STRING, reason STRING?",
    "research_source_consulted": "source_id STRING, locator STRING",
    "research_source_assessed": "source_id STRING, consulted_event_id STRING, assessment STRING, related_event_ids ARRAY?",
    "promotion_requested": "attempt_id STRING, attempt_ordinal BIGINT, promotion_revision BIGINT, verification_event_id STRING",
    "case_promoted": "attempt_id STRING, promotion_revision BIGINT, source_id STRING, case_ids ARRAY",
}
SQL_TYPE = {"BIGINT": "bigint", "STRING": "string", "BOOLEAN": "boolean", "NUMBER": "double", "ARRAY": "variant", "OBJECT": "variant"}


def declarations(spark: SparkSession, declared: dict[str, str] | None = None) -> DataFrame:
    """(type, field, kind, required) of the declared payloads; as many rows as there are fields written down."""
    rows = []
    for kind, fields in (DECLARED if declared is None else declared).items():
        for field in filter(None, fields.split(", ")):
            name, of = field.split()
            rows.append((kind, name, of.removesuffix("?"), not of.endswith("?")))
        if not fields:
            rows.append((kind, None, None, False))
    return spark.createDataFrame(rows, "type string, field string, kind string, required boolean")


def problems(events: DataFrame, keys: list[str], declared: DataFrame, payload: str = "payload") -> DataFrame:
    """(keys, field, problem): every field that a payload lacks, holds undeclared, or holds in another kind."""
    known = F.broadcast(declared.select("type").distinct())  # the declarations are written down: a bounded table
    parsed = events.select(*keys, "type", F.try_parse_json(payload).alias("v"))
    shape = F.schema_of_variant("v")
    unknown = parsed.join(known, "type", "left_anti").select(*keys, F.lit(None).cast("string").alias("field"), F.lit("unknown_type").alias("problem"))
    rows = parsed.join(known, "type").withColumn("whole", F.coalesce(shape.startswith("OBJECT"), F.lit(False)))
    odd = rows.where("not whole").select(*keys, F.lit(None).cast("string").alias("field"), F.lit("not_an_object").alias("problem"))
    # the names of an object's fields, then each value's shape, both without a schema
    each = rows.where("whole").select(*keys, "type", F.explode(F.map_entries(F.col("v").cast("map<string,variant>"))).alias("f"))
    held = each.select(*keys, "type", F.col("f.key").alias("field"), F.regexp_extract(F.schema_of_variant("f.value"), "^([A-Z]+)", 1).alias("shape")).where("shape <> 'VOID'")
    number = F.col("kind").isin("NUMBER") & F.col("shape").isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT")
    judged = held.join(F.broadcast(declared), ["type", "field"], "left")
    wrong = F.when(F.col("kind").isNull(), "undeclared").when((F.col("kind") != F.col("shape")) & ~number, "wrong_kind")
    bad = judged.select(*keys, "field", wrong.alias("problem")).where("problem is not null")
    needed = rows.where("whole").join(F.broadcast(declared.where("required")), "type").select(*keys, "field")
    missing = needed.join(held.select(*keys, "field"), [*keys, "field"], "left_anti").select(*keys, "field", F.lit("missing").alias("problem"))
    return unknown.unionByName(odd).unionByName(bad).unionByName(missing)


def laid_out(events: DataFrame, keys: list[str], kind: str, declared: dict[str, str] | None = None, payload: str = "payload") -> DataFrame:
    """The payloads of one type as typed columns; a value of another kind is null. Lists and objects stay VARIANT."""
    fields = [f.split() for f in (DECLARED if declared is None else declared)[kind].split(", ") if f]
    v = F.try_parse_json(payload)
    return events.where(F.col("type") == kind).select(*keys, *[F.try_variant_get(v, f"$.{name}", SQL_TYPE[of.removesuffix("?")]).alias(name) for name, of in fields])


def unanswered(events: DataFrame, keys: list[str], references: dict[str, list[str]], journal: str = "engagement_id", payload: str = "payload") -> DataFrame:
    """(keys, field, cited): references of payloads (type: fields, single or lists) to events that do not come before in the journal."""
    v = F.try_parse_json(payload)
    one = None
    for kind, fields in references.items():
        for field in fields:
            cited = F.coalesce(F.try_variant_get(v, f"$.{field}", "array<string>"), F.array(F.try_variant_get(v, f"$.{field}", "string")))
            rows = events.where(F.col("type") == kind).select(*keys, journal, "sequence", F.lit(field).alias("field"), F.explode(F.filter(cited, lambda x: x.isNotNull())).alias("cited"))
            one = rows if one is None else one.unionByName(rows)
    places = events.select(F.col(journal).alias("_j"), F.col("event_id").alias("_id"), F.col("sequence").alias("_at"))
    return one.join(places, (one[journal] == places["_j"]) & (one["cited"] == places["_id"]) & (places["_at"] < one["sequence"]), "left_anti").select(*dict.fromkeys([*keys]), "field", "cited")
