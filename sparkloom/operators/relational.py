"""Generic relational pieces that sit between the domain operators: as-of join, range join in buckets, set comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str) -> DataFrame:
    """Each left row with the latest right value at or before it: one union, one window, no pairing of rows."""
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*by, on, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = b.unionByName(a, allowMissingColumns=True)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*left.columns, value)


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """Points with the closed ranges that hold them, joined on buckets of ``width``; a range visits each bucket it spans."""
    p = points.withColumn("_b", F.floor(F.col(point) / width))
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "_b").where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("_b")


#: Rows of a key from which it is spread over several parts.
HOT_ROWS = 65_536


def quantile_parts(rows: DataFrame, by: str, lead: Column, parts: int = 256, hot: int = HOT_ROWS) -> DataFrame:
    """Adds ``_part``: hot keys are cut at approximate quantiles of ``lead`` (a double), whatever its values are; other keys are one part.

    Parts follow the order of ``lead`` and equal values share a part. Quantiles are computed for hot keys only, of which
    there are at most as many as ``hot`` goes into the rows.
    """
    many = rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n")).where(F.col("_n") > hot)
    share = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    named = rows.select(F.col(by).alias("_by"), lead.alias("_lead"))
    of_hot = named.join(many.select(F.col("_by").alias("_hot")), F.col("_by").eqNullSafe(F.col("_hot")), "left_semi")
    cuts = of_hot.groupBy("_by").agg(F.percentile_approx("_lead", share, parts * 40).alias("_cuts"))
    joined = rows.join(cuts, F.col(by).eqNullSafe(F.col("_by")), "left")
    below = F.size(F.filter("_cuts", lambda c: c < lead))
    return joined.withColumn("_part", F.when(F.col("_cuts").isNull() | lead.isNull(), 0).otherwise(below)).drop("_by", "_cuts")


def running_total(rows: DataFrame, by: str, order: list[str], value: str, name: str = "running", parts: int = 256, hot: int = HOT_ROWS) -> DataFrame:
    """Adds the sum of ``value`` over a key's rows up to each row; a hot key is spread over up to ``parts`` tasks.

    A hot key is cut at quantiles of the first order column (a number): sums run inside each part, and the totals of
    the parts before it, of which a key has at most ``parts``, are added. Order columns must tell rows apart.
    """
    cut = quantile_parts(rows, by, F.col(order[0]).cast("double"), parts, hot)
    inner = Window.partitionBy(by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_p")).agg(F.sum(value).alias("_sum"))
    ahead = F.sum("_sum").over(Window.partitionBy("_by").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("_by", "_p", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    summed = cut.withColumn("_run", F.sum(value).over(inner))
    joined = summed.join(offsets, F.col(by).eqNullSafe(F.col("_by")) & F.col("_part").eqNullSafe(F.col("_p")), "left")
    return joined.withColumn(name, F.col("_run") + F.col("_ahead")).drop("_by", "_p", "_part", "_run", "_ahead")
