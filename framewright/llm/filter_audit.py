"""How five filters interact in every order in which they can be applied, counted with wide packed integers.

A document's outcome in all 120 orders depends only on its mask, the set of filters that it fails (and on whether it is
labelled good or toxic). So each mask is mapped to one big integer with a field of 64 bits for each count of each of the 600
(order, step) outcomes: 1 where the document counts there, 0 elsewhere. A part's integers are summed; a field can't overflow
into the next one, as no part has 2**64 documents, and at the end the fields are unpacked.

Masks come from expressions on the whole text. Filter E (an equal text of a smaller doc_id anywhere in the table) compares
SHA-256 digests: the smallest id of each digest that occurs more than once is found with map-side aggregation, and an
ordinary join brings it to the rows. Integers are summed in each task first, then a part's partial sums meet in a stream of
sorted rows, in two levels, each holding one sum at a time.

Defined results: null text counts as empty (so it fails A alone, or A and E); a null doc_id is neither smaller than another
nor has a smaller one, and has no labels; equal texts of one and the same id don't fail E; of repeated labels of a document
any 1 counts; null lang is the empty part; very long texts are one row's memory as in any expression on text; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
STEPS = len(ORDERS) * len(FILTERS)
#: Bits of a field; parts whose sums a task holds before it lets them go; tasks whose sums meet at the first level.
FIELD, HELD, TOGETHER = 64, 4096, 256


def outcomes(mask: int, good: bool, toxic: bool) -> np.ndarray:
    """0 or 1 for each of COUNTS (rows) at each step of each order (columns) of a document that fails the filters of ``mask``."""
    out = np.zeros((len(COUNTS), STEPS), np.int64)
    for o, order in enumerate(ORDERS):
        gone = False
        for s, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            fails = bool(mask & bit)
            here = fails and not gone
            out[:, o * len(FILTERS) + s] = not (gone or fails), here, fails and gone, mask == bit, here and good, here and toxic
            gone = gone or fails
    return out


def packed(fields: np.ndarray) -> int:
    """The integer whose fields, lowest first, are the given counts."""
    return int.from_bytes(fields.astype("<u8").tobytes(), "little")


def unpacked(n: int) -> np.ndarray:
    return np.frombuffer(n.to_bytes(len(COUNTS) * STEPS * FIELD // 8, "little"), "<u8").reshape(len(COUNTS), STEPS).astype(np.int64)


def integers() -> list[int]:
    """One integer for each code: the mask, then 32 where the document is good, then 64 where it is toxic."""
    return [packed(outcomes(code & 31, bool(code & 32), bool(code & 64))) for code in range(128)]


def own_failures(text: Column, words: Column) -> Column:
    """The bits of A to D for a text that isn't null and its words."""
    n, length = F.size(words).cast("long"), F.length(text).cast("long")
    capitals = length - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * capitals > 10 * length, text.rlike("[#$%&*|]"))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, code (see :func:`integers`) of each row of ``docs`` (doc_id, text, lang)."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lean = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("t")).withColumn("w", words)
    rows = written(lean.select("doc_id", "part", own_failures(F.col("t"), F.col("w")).alias("mask"), F.sha2("t", 256).alias("digest")), "masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("doc_id").alias("n")).filter("n > 1").select(F.col("digest").alias("of"), "least")
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # written in between, so that each join deals out a plain table and adaptive execution can split a frequent text
    told = written(rows.join(first, F.col("digest") == F.col("of"), "left").select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("least"), 16).otherwise(0)).alias("mask")), "told")
    code = F.col("mask") + 32 * F.coalesce("good", F.lit(0)) + 64 * F.coalesce("toxic", F.lit(0))
    return told.join(marks, F.col("doc_id") == F.col("labelled"), "left").select("part", code.cast("int").alias("code"))


def _table(sums: dict[str, int]) -> pa.RecordBatch:
    size = len(COUNTS) * STEPS * FIELD // 8
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([n.to_bytes(size, "little") for n in sums.values()], pa.binary())], names=["part", "sum"])


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task's rows (part, code), a part again where a task sees more than HELD parts."""
    of, sums = integers(), {}
    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        both = parts.indices.to_numpy().astype(np.int64) * 128 + batch.column("code").to_numpy()
        names = parts.dictionary.to_pylist()
        for key, n in zip(*(x.tolist() for x in np.unique(both, return_counts=True)), strict=True):
            name = names[key // 128]
            sums[name] = sums.get(name, 0) + n * of[key % 128]  # n documents of one mask
            if len(sums) >= HELD:
                yield _table(sums)
                sums = {}
    if sums:
        yield _table(sums)


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the sums of equal parts, which come one after the other."""
    part, total = None, 0
    for batch in batches:
        done = {}
        for name, n in zip(batch.column("part").to_pylist(), batch.column("sum").to_pylist(), strict=True):
            if name != part and part is not None:
                done[part] = total
                total = 0
            part, total = name, total + int.from_bytes(n, "little")
        if done:
            yield _table(done)
    if part is not None:
        yield _table({part: total})


def unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """600 rows of counts for each part's sum."""
    at = {name: np.array([o * 5 + order.index(name) for o, order in enumerate(ORDERS)]) for name in FILTERS}
    letters = [name for order in ORDERS for name in order]
    for batch in batches:
        for part, n in zip(batch.column("part").to_pylist(), batch.column("sum").to_pylist(), strict=True):
            fields = unpacked(int.from_bytes(n, "little"))
            shapley = {name: int(fields[1, places].sum()) for name, places in at.items()}
            columns = [[part] * STEPS, [order for order in ORDERS for _ in FILTERS], [*range(1, 6)] * len(ORDERS)]
            arrays = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), *map(pa.array, fields), pa.array([shapley[x] for x in letters], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "filter_order", "step", *COUNTS, "shapley"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, the counts of COUNTS and shapley: 600 rows a part of ``docs`` (doc_id, text, lang)."""
    kind = "part string, sum binary"
    partial = written(masks(docs, labels).mapInArrow(summed, kind).withColumn("g", F.floor(F.spark_partition_id() / TOGETHER)), "partial")
    some = partial.repartition("part", "g").sortWithinPartitions("part", "g").select("part", "sum").mapInArrow(met, kind)
    whole = some.repartition("part").sortWithinPartitions("part").mapInArrow(met, kind)
    return whole.mapInArrow(unfolded, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS) + ", shapley long")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    [w for w in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> ''] AS w FROM documents
), marks AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    map {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
      'C': 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t), 'D': regexp_matches(t, '[#$%&*|]'),
      'E': coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY t), false)} AS fails
  FROM words LEFT JOIN marks ON words.doc_id = marks.doc_id
), grouped AS (SELECT part, good, toxic, fails, count(*) AS n FROM m GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
seen AS (
  SELECT g.part, g.n, g.good, g.toxic, s.filter_order, s.step, g.fails[s.filter_order[s.step]] AS bad,
    len([x for x in string_split(s.filter_order[1:s.step - 1], '') if x <> '' AND g.fails[x]]) > 0 AS gone,
    len([x for x in ['A', 'B', 'C', 'D', 'E'] if g.fails[x]]) AS failures
  FROM grouped g CROSS JOIN steps s
), counted AS (
  SELECT part, filter_order, step, filter_order[step] AS letter,
    CAST(coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (bad AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (bad AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (bad AND failures = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (bad AND NOT gone AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (bad AND NOT gone AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM seen GROUP BY part, filter_order, step
)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM counted
"""
