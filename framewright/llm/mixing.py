"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target of words (weights filled up to ``max_repeats`` times the source's own size, the excess reshared)
and a schedule of its weight over training time t from 0 to 1: a line from ``start`` to ``end``, scaled so that its
integral is 1. The integral W(t) is the share of the source's target that is demanded by time t. The source's documents
lie one after another in a fixed pseudo-random order, repeated as often as the target asks; the words before a document
are the cumulative demand at which it is due, and W's inverse gives its training position, one for each time that it is
taken. Documents are then range-sorted by position.

The running sums that give each document its place are made in two levels, so no source is ever gathered in one task:
sums per (source, bucket of the order key), a prefix over the buckets, and a window inside each bucket. The number of
buckets is the square root of the number of rows, so both levels grow slowly.

The order key is a digest of id and text, so rows that share an id, or have none, spread over the buckets too.

Defined results: null text has size 0; null source is a source of its own, last in order; sources without words have
target 0; rows without words take 0 and have no position. Repeated rows are taken one by one, each at a place of its own.
Reruns give the same rows. An empty table gives an empty result; other columns are ignored by :func:`assign` and kept by
:func:`mix`.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written

MAX_REPEATS = 3
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: (start, end) of the schedule by the source's weight: light sources fade out, heavy ones fade in, the middle is level.
SCHEDULES = {1: (1.5, 0.5), 2: (1.0, 1.0), 3: (0.5, 1.5)}


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(doc_id: Column, source: Column, text: Column) -> Column:
    """A fixed pseudo-random order of documents, the same on each run; only rows that repeat id, source and text share a key."""
    named = F.coalesce(F.concat(F.lit("+"), source), F.lit("-"))
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")), named).cast("binary"))


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, weight, target: one row a source. Water-filling in whole numbers: with sources in order of
    size per weight, a source stops at its cap exactly if the level that the remaining ones reach exceeds its own."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((rank - 1) % len(WEIGHTS) + 1).cast("int")).cast("long"))
    by_level = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        weighed.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - MAX_REPEATS * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", MAX_REPEATS * F.col("source_size") * F.col("weights_left") < F.col("weight") * F.col("left"))
        .withColumn("free", F.col("total") - F.sum(F.when(F.col("capped"), MAX_REPEATS * F.col("source_size")).otherwise(0)).over(everything))
        .withColumn("free_weight", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything))
    )
    target = F.when(F.col("capped"), (MAX_REPEATS * F.col("source_size")).cast("double")).otherwise((F.col("weight") * F.col("free")).cast("double") / F.col("free_weight"))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def position(share: Column, start: Column, end: Column) -> Column:
    """The inverse of W(t) = (start t + (end - start) t^2 / 2) / ((start + end) / 2)."""
    area = share * (start + end) / 2
    slope = end - start
    return F.when(slope == 0, share).otherwise((F.sqrt(start * start + 2 * slope * area) - start) / slope)


def assign(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, weight, target, taken, ahead (the source's words before it) and key, for each row of ``docs`` (doc_id, text, source).

    A source's whole passes take every document; the last, partial pass takes documents in the fixed order until the
    target (rounded down) is met, the last of them in part."""
    sized = written(docs.select("doc_id", "source", words(F.col("text")).alias("size"), order_key(F.col("doc_id"), F.col("source"), F.col("text")).alias("key")), "sized")
    n = sized.count()
    digits = max(1, round(math.log(max(n, 1), 16) / 2))  # hexadecimal digits: about the square root of n buckets
    placed = sized.withColumn("bucket", F.substring("key", 1, digits))
    level = targets(sized)
    per_bucket = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(
        per_bucket.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .drop("words")
        .join(level.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .drop("of")
        .withColumnsRenamed({"source": "b_source", "bucket": "b_bucket"}),
        "starts",
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumn("upto", F.sum("size").over(inside))
    joined = summed.join(starts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    out = joined.withColumn("ahead", F.col("base") + F.col("upto") - F.col("size")).withColumn("taken", taken())
    return out.select("doc_id", "source", "size", "source_size", "weight", "target", "taken", "ahead", "key")


def taken() -> Column:
    """Words that the mix takes of a row with ``ahead`` words of its source before it: whole passes, then a part of one."""
    whole = F.floor("target").cast("long")
    passes = F.expr("if(source_size > 0, floor(target) div source_size, 0)")
    return passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), whole - passes * F.col("source_size") - F.col("ahead")))


def times() -> Column:
    """How often the mix takes a row, a last part counted as one."""
    return F.when(F.col("taken") > 0, F.expr("(taken + size - 1) div size")).otherwise(0).cast("long")


def due(ahead: Column, target: Column, weight: Column) -> Column:
    """The training position, 0 to 1, at which ``ahead`` words of a source's target have been demanded."""
    start, end = (F.coalesce(*[F.when(weight == w, F.lit(line[k])) for w, line in SCHEDULES.items()]) for k in (0, 1))
    return position(F.least(F.lit(1.0), ahead / target), start, end)


def position_of(copy: Column) -> Column:
    return due(F.col("ahead") + copy * F.col("source_size"), F.col("target"), F.col("weight"))


def mix(docs: DataFrame) -> DataFrame:
    """The training sequence: each copy that the mix takes of a row of ``docs``, with that row's columns, range-sorted by
    position. A copy that is taken in part is there as a whole; rows that the mix doesn't take are not there.

    Rows find their plan by key; those that share one stand one after another from the smallest ``ahead`` on."""
    plan = written(
        assign(docs).groupBy(F.col("key").alias("__key")).agg(F.min("ahead").alias("first"), *[F.first(c).alias(c) for c in ("size", "source_size", "weight", "target")]).select("__key", F.struct("first", "size", "source_size", "weight", "target").alias("__plan")),
        "mixed",
    )
    # partitioned by key once: for the numbers of rows that share one, and for the join
    numbered = docs.withColumn("__own", order_key(F.col("doc_id"), F.col("source"), F.col("text"))).withColumn("__repeat", F.row_number().over(Window.partitionBy("__own").orderBy(F.lit(1))) - 1)
    placed = numbered.join(plan.hint("merge"), F.col("__own") == F.col("__key"))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    one = placed.select(F.struct(*kept).alias("row"), "__own", "__plan.size", "__plan.source_size", "__plan.weight", "__plan.target", (F.col("__plan.first") + F.col("__repeat") * F.col("__plan.size")).alias("ahead"))
    copies = one.withColumn("taken", taken()).filter("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), times() - 1)))
    return copies.withColumn("at", position_of(F.col("copy"))).orderBy("at", "__own", "copy").select("row.*")


def stored(docs: DataFrame) -> DataFrame:
    """``docs`` with the file and the row in it (``at_file``, ``at_row``) at which each of its rows is stored. Null for rows
    that don't come straight from a table of files."""
    try:
        return docs.select("*", F.col("_metadata.file_name").alias("at_file"), F.col("_metadata.row_index").alias("at_row"))
    except AnalysisException:
        return docs.withColumns({"at_file": F.lit(None).cast("string"), "at_row": F.lit(None).cast("long")})


def in_sequence(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with ``seq``, their place in the training sequence from 0 on, in place of ``at_file`` and ``at_row``, which
    they have from :func:`stored` of ``table``: what :func:`mix` gave, written and read again. Null where these are null.

    The range sort writes its parts in order, each one in order, so a row's place is the number of rows in the parts before
    its own and its number therein. The parts are counted from the footers; a reader may take them in any order."""
    number = F.regexp_extract("at_file", r"^part-(\d+)", 1).cast("long")
    before = Window.orderBy(number, "at_file").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(table).filter("at_file is not null").groupBy("at_file").agg(F.count(F.lit(1)).alias("n"))
    starts = written(parts.select(F.col("at_file").alias("of_file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "parts")
    return rows.join(starts, F.col("at_file") == F.col("of_file"), "left").withColumn("seq", F.col("base") + F.col("at_row")).drop("at_file", "at_row", "of_file", "base")


def positions(mixed: DataFrame) -> DataFrame:
    """``times``, ``position`` (of the first copy) and ``positions`` (of all copies, in 1e-9 of the training, joined by
    commas) beside the columns of ``mixed`` (assign's); null where a row isn't taken."""
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.col("times") - 1), lambda c: F.floor(position_of(c) * 1e9).cast("string"))
    told = mixed.withColumn("times", times())
    return told.withColumn("position", F.when(F.col("times") > 0, position_of(F.lit(0)))).withColumn("positions", F.when(F.col("times") > 0, F.array_join(each, ",")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = written(positions(assign(read_table(spark, sf_dir, "documents"))), "mixed")
    return mixed.orderBy(F.col("position").asc_nulls_last(), "key").select("doc_id", "size", "source_size", "target", "taken", "times", "position", "positions")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':' || coalesce('+' || source, '-')) AS k FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0) AS BIGINT) AS left_words,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS BIGINT) AS left_weight, CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM w WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (SELECT *, 3 * source_size * left_weight < weight * left_words AS capped FROM l
), f AS (
  SELECT *, CAST(total - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER () AS BIGINT) AS free,
    CAST(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS BIGINT) AS free_weight FROM c
), t AS (
  SELECT source, source_size, weight, CASE weight WHEN 1 THEN -1e0 WHEN 2 THEN 0e0 ELSE 1e0 END AS slope,
    CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight * free AS DOUBLE) / free_weight END AS target FROM f
), r AS (
  SELECT d.*, t.source_size, t.target, t.slope, CAST(floor(t.target) AS BIGINT) AS whole,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (SELECT *, CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END AS passes FROM r
), g AS (SELECT *, CAST(passes * size + greatest(0, least(size, whole - passes * source_size - ahead)) AS BIGINT) AS taken FROM p
), m AS (SELECT *, CAST(CASE WHEN taken > 0 THEN (taken + size - 1) // size ELSE 0 END AS BIGINT) AS times FROM g
), a AS (
  -- the schedule of weight 1 is the line from 1.5 to 0.5, of 2 level, of 3 from 0.5 to 1.5: it begins at 1 - slope / 2
  SELECT *, [least(1e0, (ahead + i * source_size) / target) for i in range(0, times)] AS shares FROM m
), q AS (
  SELECT *, [CASE WHEN slope = 0 THEN x ELSE (sqrt((1 - slope / 2) * (1 - slope / 2) + 2 * slope * x) - (1 - slope / 2)) / slope END for x in shares] AS due_at FROM a
)
SELECT doc_id, size, source_size, target, taken, times, CASE WHEN times > 0 THEN due_at[1] END AS position,
  CASE WHEN times > 0 THEN array_to_string([CAST(floor(x * 1e9) AS BIGINT) for x in due_at], ',') END AS positions FROM q
"""
