"""SimHash near-deduplication through pivot distance tables.

1. One pass over the texts makes the fingerprints; copies meet in one row per distinct fingerprint (smallest doc_id).
2. For each distinct fingerprint its Hamming distances to many reference fingerprints are computed once: the pivot table.
   It doesn't find candidates: these come from bands of the fingerprint's bits. Two fingerprints within ``most`` bits can
   differ in at most ``most`` bands, so equality of all other bands is a key on which all pairs of interest meet (for each
   choice of the bands that may differ), and an ordinary hash exchange deals the candidates out.
3. Within a block (one key), pairs whose distances to the references differ by more than ``most`` anywhere are
   discarded by the triangle inequality; the survivors are verified. Blocks of over ``BLOCK`` rows are dealt out anew with
   twice as many bands, until the last level (16 bands of 4 bits), where a block can't hold more than 2**(4*most) rows.
   A block gives a spanning forest of its links, not all pairs: the components are the same.
4. The components of the links are found by star contraction on tables.

Defined results: null text is empty; a text without words has fingerprint zero and links like any other; a text with
fewer words than a shingle is one shingle. Repeated rows share a fingerprint, hence a component. ``component_id`` is the
smallest doc_id of the component; null ids are ignored for it unless there is no other. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import light, read_table, small_batches, staying, written
from .graph import components

WORDS, MOST_BITS, SEED = 3, 2, 42
#: Bands of the levels, and most rows of a block that is compared as it is.
LEVELS, BLOCK = (4, 8, 16), 256
#: Bytes of a text that are cut into words at a time.
PART = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Random reference fingerprints.
REFERENCES = np.random.default_rng(20240229).integers(0, 2**64, 32, np.uint64)


def shingle_hashes(raw: bytes, words: int = WORDS) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of the lower-cased words, in parts, so that a very long text needs little memory.
    ``bytes.split`` and ``bytes.lower`` know ASCII only, as asked."""
    digest, held, start, short = xxhash.xxh64_intdigest, [], 0, True
    while start < len(raw):
        blank = _BLANK.search(raw, start + PART)
        stop = blank.start() if blank else len(raw)
        held = held + raw[start:stop].lower().split()
        start = stop
        if len(held) >= words:
            short = False
            yield np.array([digest(b" ".join(s), SEED) for s in zip(*(held[i:] for i in range(words)), strict=False)], np.uint64)
            held = held[len(held) - words + 1 :]
    if short and held:
        yield np.array([digest(b" ".join(held), SEED)], np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """Bit by bit the majority (over half) of the hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        n += len(hashes)
        for i in range(0, len(hashes), 65536):
            part = hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(raw: bytes, words: int = WORDS) -> int:
    return majority(shingle_hashes(raw, words))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, th (a hash of the text, to tell rows apart that repeat an id), fp (long, the 64 bits) of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            fps = np.array([fingerprint((t or "").encode(), words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(fps.view(np.int64))], names=["doc_id", "th", "fp"])

    return light(docs).select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, fp long")


def with_pivots(distinct: DataFrame) -> DataFrame:
    """fp and pivots (binary, one distance a byte) of each row of ``distinct`` (fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            table = np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array([x.tobytes() for x in table], pa.binary())], names=["fp", "pivots"])

    return distinct.select("fp").mapInArrow(run, "fp long, pivots binary")


def block_keys(fp: Column, bands: int, most: int) -> Column:
    """For each choice of the ``most`` bands that may differ: its number, and the bits of all the others."""
    width = 64 // bands
    band = lambda k: ((1 << width) - 1) << (k * width)
    keys = []
    for n, free in enumerate(combinations(range(bands), most)):
        mask = (1 << 64) - 1
        for k in free:
            mask &= ~band(k)
        keys.append(F.struct(F.lit(n).alias("choice"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("rest")))
    return F.explode(F.array(*keys))


def forest(fps: np.ndarray, pivots: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of one block, as places in it."""
    n = len(fps)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    order = np.argsort(pivots[:, 0], kind="stable")  # one coordinate bounds the range of partners, the others thin it out
    first = pivots[order, 0].astype(np.int16)
    stops = np.searchsorted(first, first + most, "right")
    out = []
    for a in range(n):
        others = order[a + 1 : stops[a]]
        if not len(others):
            continue
        i = order[a]
        near = others[(np.abs(pivots[others].astype(np.int16) - pivots[i]).max(1) <= most)]
        near = near[np.bitwise_count(fps[near] ^ fps[i]) <= most]
        for j in near.tolist():
            x, y = find(int(i)), find(j)
            if x != y:
                root[x] = y
                out.append((int(i), j))
    return out


def links(distinct: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """a, b: fingerprints that link; a spanning set of the links within each block. ``distinct``: fp, pivots (written)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blocks(table: pa.Table, last: bool):
            choice, rest = (table.column(k).to_numpy() for k in ("choice", "rest"))
            edges = np.flatnonzero((choice[1:] != choice[:-1]) | (rest[1:] != rest[:-1])) + 1
            bounds = [0, *edges.tolist(), len(rest)]
            done = len(bounds) - 1 if last else len(bounds) - 2
            fps = table.column("fp").to_numpy().view(np.uint64)
            pivots = np.frombuffer(b"".join(table.column("pivots").to_pylist()), np.uint8).reshape(len(fps), -1)
            found: list[tuple[int, int]] = []
            for k in range(done):
                s, e = bounds[k], bounds[k + 1]
                if e - s > 1:
                    found += [(s + i, s + j) for i, j in forest(fps[s:e], pivots[s:e], most)]
            pairs = np.array(found, np.int64).reshape(-1, 2)
            ids = fps.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], names=["a", "b"]), table.slice(bounds[done]).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4096:
                out, held = blocks(pa.Table.from_batches(held), False)
                yield out
        if held and sum(b.num_rows for b in held):
            yield blocks(pa.Table.from_batches(held), True)[0]

    out = None
    todo = distinct
    for level, bands in enumerate(LEVELS):
        keyed = todo.select("fp", block_keys(F.col("fp"), bands, most).alias("k")).select("fp", "k.choice", "k.rest")
        sizes = written(keyed.groupBy("choice", "rest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "blocks")
        last = level == len(LEVELS) - 1
        small = sizes if last else sizes.filter(f"n <= {BLOCK}")
        full = todo.select("fp", "pivots", block_keys(F.col("fp"), bands, most).alias("k")).select("fp", "pivots", "k.choice", "k.rest")
        members = full.join(small.select("choice", "rest"), ["choice", "rest"]).select("fp", "pivots", "choice", "rest")
        found = members.repartition("choice", "rest").sortWithinPartitions("choice", "rest").mapInArrow(compare, "a long, b long")
        out = found if out is None else out.unionByName(found)
        if last:
            break
        large = sizes.filter(f"n > {BLOCK}").select("choice", "rest")
        if large.isEmpty():
            break
        todo = written(full.join(large, ["choice", "rest"], "left_semi").select("fp", "pivots").distinct(), "hot")
    return out


def classes(prints: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """fp, root (one fingerprint of the class), component_id of each distinct fingerprint of ``prints`` (doc_id, fp; written)."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    table = written(with_pivots(distinct), "pivots")
    roots = components(links(table, most))
    joined = written(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = written(joined.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id")), "smallest")
    return joined.join(smallest, F.col("root") == F.col("of")).select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, most: int = MOST_BITS) -> DataFrame:
    """doc_id, th, fp, root, component_id of each row of ``docs`` (doc_id, text)."""
    prints = written(fingerprints(docs, words), "prints")
    by_fp = written(classes(prints, most), "classes").withColumnRenamed("fp", "of")
    return prints.join(by_fp, F.col("fp") == F.col("of")).select("doc_id", "th", "fp", "root", "component_id")


def dedup(docs: DataFrame, words: int = WORDS, most: int = MOST_BITS) -> DataFrame:
    """One row of each component of ``docs``, the one with the smallest doc_id, with all its columns."""
    return first_of_each(docs, near_duplicates(docs, words, most).groupBy("root", "doc_id", "th").agg(F.count(F.lit(1)).alias("n")))


def first_of_each(docs: DataFrame, classed: DataFrame) -> DataFrame:
    """One row of each class of ``docs``, the one with the smallest doc_id, with all its columns. ``classed``: doc_id, th (a
    hash of the text), root and n, the number of rows that repeat both."""
    rows = written(classed, "rows")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    stay = rows.groupBy(F.col("root").alias("of")).agg(F.min(own).alias("s"))
    return staying(docs, rows.join(stay, F.col("root") == F.col("of")).withColumn("stays", own.eqNullSafe(F.col("s"))))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
