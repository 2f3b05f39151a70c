"""Knowledge bundles: nested JSON files under a declared schema, read in part, with one token for the whole snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.evidence import snapshot_token
from ..operators.integrity import search_text

_ARTIFACT = "artifact_id STRING, title STRING, text STRING, facets ARRAY<STRUCT<namespace STRING, key STRING, value STRING>>, citations ARRAY<STRUCT<segment STRING, start_line BIGINT, end_line BIGINT>>"
BUNDLE = (
    "source_id STRING, revision STRING, verification STRUCT<status STRING, confidence DOUBLE, reasons ARRAY<STRING>>, "
    f"references ARRAY<STRUCT<{_ARTIFACT}>>, cases ARRAY<STRUCT<{_ARTIFACT}, steps ARRAY<STRUCT<step_id STRING, action STRING, outcome STRING>>>>, "
    "rules ARRAY<STRUCT<artifact_id STRING, statement STRING, lane STRING, rationale ARRAY<STRING>, exceptions ARRAY<STRING>, contradicting ARRAY<STRING>>>, execution_examples ARRAY<STRUCT<example_id STRING, parent_artifact_id STRING, command STRING>>"
)
CORRUPT = "_corrupt"


def declared() -> T.StructType:
    return T.StructType.fromDDL(BUNDLE)


class SnapshotChanged(RuntimeError):
    """The files changed while they were read."""


class CorruptBundle(ValueError):
    """A file is no whole bundle, so nothing of the snapshot is given out."""


def narrowed(kind: T.DataType, wanted: list[str]) -> T.DataType:
    """A schema with the wanted fields only; ``cases.steps.step_id`` names a leaf inside lists of structs."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(narrowed(kind.elementType, wanted), kind.containsNull)
    if not isinstance(kind, T.StructType) or "" in wanted:
        return kind
    unknown = {w.partition(".")[0] for w in wanted} - set(kind.fieldNames())
    if unknown:
        raise ValueError(f"no such field: {sorted(unknown)[0]}")
    inner = {f.name: [w.partition(".")[2] for w in wanted if w.partition(".")[0] == f.name] for f in kind.fields}
    return T.StructType([T.StructField(f.name, narrowed(f.dataType, inner[f.name]), f.nullable) for f in kind.fields if inner[f.name]])


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, sha256, size) of every bundle file."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return rows.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def revision(spark: SparkSession, folder: str) -> str:
    """One token over (file, sha256, size) of the snapshot."""
    return snapshot_token(files(spark, folder), ["file", "sha256", "size"]).first().token


def scan(spark: SparkSession, folder: str, wanted: list[str] | None = None) -> DataFrame:
    """A row for each file: the wanted fields and ``_corrupt``, the text of a file that is no bundle. Other fields are not built."""
    schema = T.StructType([*(declared() if wanted is None else narrowed(declared(), wanted)).fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("pathGlobFilter", "*.json").json(folder)


def verified(spark: SparkSession, folder: str, wanted: list[str] | None = None) -> DataFrame:
    """The verified bundles; quarantined ones are left out."""
    need = ["source_id", "verification.status"]
    rows = scan(spark, folder, None if wanted is None else list(dict.fromkeys([*wanted, *need])))
    return rows.where(F.col("verification.status") == "verified").drop(CORRUPT)


def guarded(spark: SparkSession, folder: str, out: str, wanted: list[str] | None = None) -> tuple[DataFrame, str]:
    """(verified bundles as a columnar copy in ``out``, their token). A corrupt file or a change meanwhile gives nothing.

    Consumers read the copy: columns and nested fields that a query does not ask for are not read from it.
    """
    token = revision(spark, folder)
    torn = scan(spark, folder, ["source_id", "verification.status"])
    if not torn.where(F.col(CORRUPT).isNotNull() | F.col("source_id").isNull() | F.col("verification.status").isNull()).isEmpty():
        raise CorruptBundle(folder)
    path = f"{out.rstrip('/')}/{token}"
    verified(spark, folder, wanted).write.mode("overwrite").parquet(path)
    if revision(spark, folder) != token:
        raise SnapshotChanged(folder)
    return spark.read.parquet(path), token


def example_locators(bundles: DataFrame) -> DataFrame:
    """(example_id, parent_artifact_id, source_id): where an example is found; its command is never projected."""
    return bundles.select("source_id", F.explode("execution_examples").alias("e")).select("e.example_id", "e.parent_artifact_id", "source_id")


def rule_rows(bundles: DataFrame) -> DataFrame:
    """(artifact_id, source_id, lane, statement, rationale, exceptions): the search columns of rules, lists sorted and redacted."""
    rules = bundles.select("source_id", F.explode("rules").alias("r"))
    return rules.select("r.artifact_id", "source_id", "r.lane", search_text(F.array("r.statement")).alias("statement"), search_text(F.col("r.rationale")).alias("rationale"), search_text(F.col("r.exceptions")).alias("exceptions"))


def rule_sources(bundles: DataFrame) -> DataFrame:
    """(artifact_id, source, relation): the source that a rule comes from, and those that contradict it."""
    rules = bundles.select("source_id", F.explode("rules").alias("r"))
    own = rules.select("r.artifact_id", F.col("source_id").alias("source"), F.lit("supports").alias("relation"))
    against = rules.select("r.artifact_id", F.explode("r.contradicting").alias("source"), F.lit("contradicts").alias("relation"))
    return own.unionByName(against).distinct()
