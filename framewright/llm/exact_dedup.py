"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

1. One scan of the texts writes a lean table of digests (no text travels through any exchange).
2. A Misra-Gries summary per task (the frequent-items sketch is its weighted form), merged in two levels, names at most
   ``max_heavy`` candidate digests.
3. The candidates are counted exactly and their winners found with map-side aggregation: the verified winners.
4. The winners (at most ``max_heavy`` rows) are broadcast; rows of heavy digests are decided map-side, without shuffle.
5. Of the remaining digests the winners of those that occur more than once are found with map-side aggregation too, and
   an ordinary join brings them to their rows: no group is ever gathered, and a join can be split where a window can't.

Defined results: null text counts as empty; empty texts are equal to each other and to texts of white space only. Of
equal texts the one with the most code points stays, then the smallest doc_id (null last), then one of the repeated rows.
An empty table gives an empty result; other columns are ignored by :func:`decide` and kept by :func:`dedup`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, frequent, read_table, staying, written

#: Most digests that are treated as heavy, and counters of the summary: a digest of over 1 in 2,000 rows is always found.
MAX_HEAVY, COUNTERS = 1000, 10_000


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def decide(docs: DataFrame, max_heavy: int = MAX_HEAVY, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, th (a hash of the text) for each row of ``docs`` (doc_id, text)."""
    rows = written(
        docs.select(
            "doc_id",
            digest(F.col("text")).alias("dig"),
            F.char_length(F.coalesce("text", F.lit(""))).alias("len"),
            F.xxhash64("text").alias("th"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "digests",
    )
    order = [(-F.col("len")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("uid")]
    candidates = frequent(rows, "dig", max_heavy, counters).select(F.col("item").alias("dig"))
    winners = written(
        rows.join(F.broadcast(candidates), "dig", "left_semi").groupBy("dig").agg(F.min(F.struct(*order)).alias("w"), F.count(F.lit(1)).alias("group_size")),
        "winners",
    ).select("dig", "group_size", F.col("w.doc_id").alias("keep_id"), F.col("w.uid").alias("keep_uid"))
    heavy = rows.join(F.broadcast(winners), "dig").select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("dig").alias("text_sha256"), "th")
    rest = rows.join(F.broadcast(winners), "dig", "left_anti")
    several = written(rest.groupBy("dig").agg(F.min(F.struct(*order)).alias("w"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "several")
    light = rest.join(several.withColumnRenamed("dig", "of"), F.col("dig") == F.col("of"), "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("w.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        (F.col("n").isNull() | (F.col("uid") == F.col("w.uid"))).alias("kept"),
        F.col("dig").alias("text_sha256"),
        "th",
    )
    return heavy.unionByName(light)


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return staying(docs, decide(docs).groupBy("doc_id", "th").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(read_table(spark, sf_dir, "documents")).drop("th")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS len FROM documents
), h AS (SELECT doc_id, len, sha256(norm) AS text_sha256 FROM n)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) = 1 AS kept, text_sha256
FROM h
"""
