"""Joins on ranges and nearest values as equi-joins on buckets, so that Spark hashes and shuffles instead of nesting loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def buckets(low: Column, high: Column, width: float) -> Column:
    """The numbers of all buckets that a closed range touches."""
    return F.explode(F.sequence(F.floor(low / width).cast("long"), F.floor(high / width).cast("long")))


def interval_join(points: DataFrame, intervals: DataFrame, key: str, t: str, start: str, end: str, width: float, how: str = "inner") -> DataFrame:
    """Points (key, t) with the intervals (key, start, end) that hold them, ends included. Column names of the two sides
    must differ but for the key. Only intervals are copied, once per bucket they touch; ``width`` near their usual length
    keeps that to two or three."""
    cut = intervals.withColumn("__bucket", buckets(F.col(start), F.col(end), width)).withColumnRenamed(key, "__key")
    at = points.withColumn("__at", F.floor(F.col(t) / width).cast("long"))
    match = (F.col(key) == F.col("__key")) & (F.col("__at") == F.col("__bucket")) & F.col(t).between(F.col(start), F.col(end))
    joined = at.join(cut, match, how)
    return joined.drop("__key", "__bucket", "__at") if how in ("inner", "left") else joined.drop("__at")


def band_join(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, width: float) -> DataFrame:
    """Pairs of one key whose values differ by at most ``width``; column names must differ but for the key."""
    spread = right.withColumn("__bucket", buckets(F.col(rt) - width, F.col(rt) + width, width)).withColumnRenamed(key, "__key")
    at = left.withColumn("__at", F.floor(F.col(lt) / width).cast("long"))
    return at.join(spread, (F.col(key) == F.col("__key")) & (F.col("__at") == F.col("__bucket")) & (F.abs(F.col(lt) - F.col(rt)) <= width)).drop("__key", "__bucket", "__at")


def nearest_join(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, tolerance: float, tie: str, by: list[str]) -> DataFrame:
    """Each row of ``left`` (identified by ``by``) with the row of ``right`` nearest to it within ``tolerance``; of equally
    near ones the one with the smallest ``tie``. Rows without one are left out."""
    pairs = band_join(left, right, key, lt, rt, tolerance)
    kept = [c for c in left.columns if c not in by]
    nearest = F.min(F.struct(F.abs(F.col(lt) - F.col(rt)).alias("distance"), F.col(tie).alias("__tie"), *[F.col(c) for c in right.columns if c not in (key, tie)])).alias("__n")
    out = pairs.groupBy(*by).agg(*[F.first(c).alias(c) for c in kept], nearest)
    return out.select(*left.columns, "__n.distance", F.col("__n.__tie").alias(tie), *[F.col(f"__n.{c}") for c in right.columns if c not in (key, tie)])
