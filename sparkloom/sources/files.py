"""Files as sources: inventory, fingerprints, journals in JSON lines, byte ranges, managed blocks in notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X

SUFFIXES = (".md", ".pdf")


def inventory(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, relative, suffix, sha256, size, source_id) of every document file below ``root``, hidden by Spark's own rule."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace(F.col("path"), "^.*?" + _quoted(root.rstrip("/").removeprefix("file://")) + "/", "")
    rows = files.select("path", relative.alias("relative"), X.suffix(F.col("path")).alias("suffix"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
    return rows.where(F.col("suffix").isin(*suffixes)).withColumn("source_id", X.uuid5(F.col("relative"))).orderBy("relative")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def verified(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Files of an earlier inventory with what is true of them now: same, changed or gone."""
    now = files.select("relative", F.col("sha256").alias("now"))
    state = F.when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("sha256"), "changed").otherwise("same")
    return snapshot.join(now, "relative", "left").withColumn("state", state).drop("now")


EVENT = T.StructType([T.StructField(n, k) for n, k in (("event_id", T.StringType()), ("engagement_id", T.StringType()), ("sequence", T.LongType()), ("occurred_at", T.TimestampType()), ("type", T.StringType()), ("payload", T.StringType()), ("previous_hash", T.StringType()), ("event_hash", T.StringType()))])


def journal(spark: SparkSession, path: str, most_bytes: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """(events, rejected lines): JSON lines that do not parse, or are too long, go aside with their text; a torn tail is one of them."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", T.StructType([*EVENT.fields, T.StructField("_corrupt", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = raw.select("value", parsed.alias("e"), (F.octet_length("value") > most_bytes).alias("too_long"))
    bad = F.col("too_long") | F.col("e").isNull() | F.col("e._corrupt").isNotNull() | F.col("e.sequence").isNull()
    return rows.where(~bad).select(*[F.col(f"e.{f.name}") for f in EVENT.fields]), rows.where(bad).select("value", F.when(F.col("too_long"), "too_long").otherwise("corrupt").alias("reason"))


def blob_slice(spark: SparkSession, path: str, offset: int, limit: int) -> DataFrame:
    """(sha256, data): a byte range of each blob, with the digest of the whole blob to verify."""
    if not 0 < limit <= 65_536:
        raise ValueError("limit must lie in 1..65536")
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.sha2("content", 256).alias("sha256"), F.substring("content", F.lit(offset + 1), F.lit(limit)).alias("data"))


def managed_blocks(spark: SparkSession, path: str, begin: str = "<!-- begin:", end: str = "<!-- end:") -> DataFrame:
    """(path, name, body, malformed) of the managed blocks in free notes; other lines are left alone."""
    notes = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    pattern = rf"(?s){begin}([a-z0-9-]+) -->\n(.*?){end}\1 -->"
    names = F.regexp_extract_all("text", F.lit(pattern), 1)
    bodies = F.regexp_extract_all("text", F.lit(pattern), 2)
    opened = F.regexp_count("text", F.lit(begin))
    rows = notes.select("path", F.explode_outer(F.arrays_zip(names.alias("name"), bodies.alias("body"))).alias("b"), (opened != F.size(names)).alias("malformed"))
    return rows.select("path", "b.name", "b.body", "malformed")


def point_lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """An equality filter on a key column: it reaches the scan."""
    return rows.where(F.col(key) == F.lit(value))


def scope_references(scopes: DataFrame, columns: list[str]) -> DataFrame:
    """(kind, value, reference): the entries of a scope with hashed ids, sorted."""

    def entries(name: str) -> Column:
        return F.transform(F.col(name), lambda v: F.struct(F.lit(name).alias("kind"), v.alias("value")))

    rows = scopes.select(F.explode(F.flatten(F.array(*map(entries, columns)))).alias("r")).select("r.kind", "r.value").distinct()
    return rows.withColumn("reference", F.left(F.sha2(F.concat_ws("\u0000", "kind", "value"), 256), F.lit(32))).orderBy("kind", "value")
