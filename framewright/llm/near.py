"""Near copies by the share of common shingles, found through SimHash fingerprints.

Five-word fingerprints of texts with a Jaccard similarity of 0.8 differ in about ten bits of 64, which no bands of bits
and no pivot distances can deal out. So the candidates come from keys on the shingles themselves, and the fingerprints do
what they can: they discard candidates before the exact comparison.

1. One pass makes for each text its fingerprint and ``BANDS`` keys, each from ``ROWS`` smallest mixed shingle hashes. A pair
   of similarity s shares a key with probability 1 - (1 - s**ROWS)**BANDS: 0.9998 at 0.8, more above.
2. Texts that share a key form a block. Blocks go to tasks in groups of about ``GROUP`` rows and ``GROUP_SHINGLES`` shingles
   (4 MB): the rows of a larger block are dealt out at random, and ``ANCHORS`` rows of it go to all its groups, so that its
   copies hang together.
3. In a group, pairs of rows that aren't connected yet are tried: pairs whose distances to the pivots or whose fingerprints
   differ by over ``BITS``, or whose sizes rule the similarity out, are discarded; the shingles of the others are compared.
4. A first round takes the first ``EARLY`` bands. Then only blocks that hold several components are left. Their rows are
   compared across components: rows outside of a large block's main component visit all its groups (in groups of their
   own, if they are many). So each pair that shares a key is compared or already connected: no link between components is
   lost, and neither memory nor work grows with the pairs of a block of copies.

Defined results: null texts are empty; texts without words are equal to each other; a text with fewer words than a shingle
is one shingle; case of A-Z doesn't count. Rows that repeat id and text are one node. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WIDE_GROUP, light, parted, row_key, small_batches, written
from .graph import components
from .simhash import REFERENCES, first_of_each, majority, shingle_hashes

WORDS, LEAST = 5, 0.8
BANDS, ROWS, EARLY = 16, 4, 4
#: Differing bits at which a pair is discarded: five deviations above what a similarity of 0.8 gives.
BITS = 25
GROUP, GROUP_SHINGLES, ANCHORS = 512, 1 << 19, 16
_KEYS = np.random.default_rng(88).integers(0, 2**64, (3, BANDS * ROWS), np.uint64) | np.uint64(1)


def shingles(raw: bytes, words: int) -> np.ndarray:
    """The distinct hashes of the shingles, sorted; one of its own for a text without words."""
    parts = [np.unique(h) for h in shingle_hashes(raw, words)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(1, np.uint64)


def band_keys(own: np.ndarray) -> np.ndarray:
    """One key for each band, from the smallest mixed hashes of a set of shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for i in range(0, len(own), 1024):
            mixed = own[i : i + 1024, None] ^ _KEYS[0]
            mixed *= _KEYS[1]
            least = np.minimum(least, mixed.min(0))
        rows = (least * _KEYS[2]).reshape(BANDS, ROWS)
        keys = np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            keys = (keys ^ rows[:, r] ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return keys


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, th (a hash of the text), fp, size (of the set of shingles), keys of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            fps, sizes, keys = [], [], []
            for text in batch.column("text").to_pylist():
                parts = list(shingle_hashes((text or "").encode(), words))
                fps.append(majority(parts))
                own = np.unique(np.concatenate(parts)) if parts else np.zeros(1, np.uint64)
                sizes.append(len(own))
                keys.append(band_keys(own))
            flat = np.concatenate(keys).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), lists], names=["doc_id", "th", "fp", "size", "keys"])

    return light(docs).select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, fp long, size long, keys array<long>")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """node, fp, own (binary, the sorted shingle hashes) of each row of ``texts`` (node, fp, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            own = [shingles((text or "").encode(), words).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("fp"), pa.array(own, pa.binary())], names=["node", "fp", "own"])

    return texts.select("node", "fp", "text").mapInArrow(run, "node long, fp long, own binary")


def common_share(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return both / (len(a) + len(b) - both)


def verified(labels: np.ndarray, visits: np.ndarray, fps: np.ndarray, own: list[np.ndarray], least: float, bits: int) -> list[tuple[int, int]]:
    """Links between the components (``labels``) of one group that connect them. ``visits`` is 0 for a row that others come
    to, 1 for a visitor, 2 for both: a pair is one of a visitor and a row that is visited."""
    was, labels = labels, labels.copy()
    pivots = np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int16)
    sizes = np.array([len(x) for x in own])
    visited, out = np.flatnonzero(visits != 1), []
    for i in np.flatnonzero(visits >= 1).tolist():
        near = visited[labels[visited] != labels[i]]
        near = near[np.minimum(sizes[near], sizes[i]) >= least * np.maximum(sizes[near], sizes[i])]
        if not len(near):
            continue
        near = near[np.abs(pivots[near] - pivots[i]).max(1) <= bits]
        near = near[np.bitwise_count(fps[near] ^ fps[i]) <= bits]
        for j in near.tolist():
            if labels[i] != labels[j] and common_share(own[i], own[j]) >= least:
                labels[labels == labels[j]] = labels[i]
                out.append((int(was[i]), int(was[j])))
    return out


def compared(groups: DataFrame, least: float, bits: int) -> DataFrame:
    """a, b: labels that link in ``groups`` (key, sub, chunk, label, visits, fp, own)."""
    names = ("key", "sub", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def decide(table: pa.Table) -> list[tuple[int, int]]:
            labels, visits, fps = (table.column(c).to_numpy() for c in ("label", "visits", "fp"))
            own = [np.frombuffer(x, np.uint64) for x in table.column("own").to_pylist()]
            return verified(labels, visits, fps.view(np.uint64), own, least, bits)

        def links(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy() for c in names])
            cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1
            found: list[tuple[int, int]] = []
            if last is not None and (ids[:, 0] != last).any():
                found += decide(pa.Table.from_batches(held))
                held = []
            last = ids[:, -1]
            bounds = [0, *cuts.tolist(), batch.num_rows]
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                held.append(batch.slice(s, e - s))
                if e < batch.num_rows:
                    found += decide(pa.Table.from_batches(held))
                    held = []
            yield links(found)
        if held:
            yield links(decide(pa.Table.from_batches(held)))

    return groups.repartition(*names).sortWithinPartitions(*names).select(*names, "label", "visits", "fp", "own").mapInArrow(run, "a long, b long")


def dealt(number, group: int):
    """Into how many groups ``number`` rows are dealt."""
    return F.ceil(number / group).cast("long")


def first_links(members: DataFrame, sets: DataFrame, least: float, bits: int, group: int) -> DataFrame:
    """Links within the groups of ``members`` (key, node, n: the block's weight), all rows of a group with all others."""
    zero = F.lit(0).cast("long")
    spread = members.withColumn("sub", F.pmod(F.xxhash64("node"), dealt(F.col("n"), group)))
    large = members.filter(F.col("n") > group).withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node", F.lit(5)))))
    anchors = large.filter(F.col("at") <= ANCHORS).withColumn("to", F.explode(F.sequence(zero, dealt(F.col("n"), group) - 1)))
    anchors = anchors.filter(F.col("to") != F.pmod(F.xxhash64("node"), dealt(F.col("n"), group)))
    rows = spread.select("key", "sub", "node").unionByName(anchors.select("key", F.col("to").alias("sub"), "node"))
    return compared(rows.join(sets, "node").select("key", "sub", zero.alias("chunk"), F.col("node").alias("label"), F.lit(2).alias("visits"), "fp", "own"), least, bits)


def later_links(members: DataFrame, sets: DataFrame, least: float, bits: int, group: int) -> DataFrame:
    """Links across the components (``label``) of the blocks of ``members`` (key, node, size, n, label), which have several."""
    zero = F.lit(0).cast("long")
    small = members.filter(F.col("n") <= group).select("key", zero.alias("sub"), zero.alias("chunk"), "node", "label", F.lit(2).alias("visits"))
    large = members.filter(F.col("n") > group)
    counts = large.groupBy("key", "label").agg(F.greatest(F.count(F.lit(1)), F.ceil(F.sum("size") * group / GROUP_SHINGLES)).cast("long").alias("rows"))
    main = counts.groupBy("key").agg(F.max_by("label", F.struct("rows", "label")).alias("main"), (F.sum("rows") - F.max("rows")).alias("others"))
    large = large.join(written(main, "main"), "key").withColumns({"subs": dealt(F.col("n"), group), "chunks": dealt(F.col("others"), group)})
    stay = large.withColumn("sub", F.pmod(F.xxhash64("node"), F.col("subs"))).withColumn("chunk", F.explode(F.sequence(zero, F.col("chunks") - 1))).withColumn("visits", F.lit(0))
    visit = large.filter("label <> main").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks"))).withColumn("sub", F.explode(F.sequence(zero, F.col("subs") - 1))).withColumn("visits", F.lit(1))
    columns = ["key", "sub", "chunk", "node", "label", "visits"]
    rows = small.unionByName(stay.select(*columns)).unionByName(visit.select(*columns))
    return compared(rows.join(sets, "node").select(*columns, "fp", "own"), least, bits)


def similar(docs: DataFrame, words: int = WORDS, least: float = LEAST, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """doc_id, th, n (how many rows repeat both), root (the same for all rows of a component) of ``docs`` (doc_id, text)."""
    once = sketches(docs, words).groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("rows"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    nodes = written(once.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keyed = nodes.select("node", "size", F.posexplode("keys").alias("band", "key"))
    # the weight of a block: its rows, or what its shingles count for in rows
    weight = F.greatest(F.count(F.lit(1)), F.ceil(F.sum("size") * group / GROUP_SHINGLES)).cast("long")
    blocks = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), weight.alias("n")).filter("rows > 1").drop("rows")
    members = written(keyed.join(written(blocks, "blocks"), "key").select("key", "band", "node", "size", "n"), "members")
    wanted = written(members.select("node").distinct().join(nodes.select("node", row_key(F.col("doc_id"), F.col("th")).alias("__key"), "fp"), "node"), "wanted")
    _, hit = parted(docs.select("doc_id", "text"), wanted)
    texts = hit.join(wanted.hint("merge"), F.col("__own") == F.col("__key")).select("node", "fp", "text")
    sets = written(shingle_sets(texts, words).groupBy("node").agg(F.first("fp").alias("fp"), F.first("own").alias("own")), "shingles", WIDE_GROUP)
    early = components(first_links(members.filter(F.col("band") < EARLY), sets, least, bits, group))
    labelled = written(members.join(early.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("key", "node", "size", "n", F.coalesce("root", "node").alias("label")), "labelled")
    mixed = written(labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("key"), "mixed_blocks")
    across = written(later_links(labelled.join(mixed, "key"), sets, least, bits, group), "across")
    first = nodes.select("node", "doc_id", "th", "rows").join(early.select(F.col("node").alias("of"), F.col("root").alias("label")), F.col("node") == F.col("of"), "left").select("doc_id", "th", "rows", F.coalesce("label", "node").alias("label"))
    if across.isEmpty():
        return first.select("doc_id", "th", F.col("rows").alias("n"), F.col("label").alias("root"))
    late = components(across)
    return first.join(late.select(F.col("node").alias("of"), "root"), F.col("label") == F.col("of"), "left").select("doc_id", "th", F.col("rows").alias("n"), F.coalesce("root", "label").alias("root"))


def dedup(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """One row of each component of ``docs``, the one with the smallest doc_id, with all its columns."""
    return first_of_each(docs, similar(docs, words, least))
