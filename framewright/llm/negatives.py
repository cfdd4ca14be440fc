"""Hard negatives: for each anchor and each of its best rows of the same label, the best rows of other labels whose score
lies in a window below that row's score. Found with multiway hyperplane trees (GNAT).

Inner product is made a metric as in :mod:`.topk`: one more coordinate makes all candidates' norms equal, so the squared
distance to a query is |q|^2 + m - 2 q.x and a window of scores is an annulus of distances around the query.

A tree's inner node has up to ``FAN`` split points; an entry belongs to the nearest one (multiway hyperplanes), and for each
split point the node stores the smallest and largest distance to the entries of every sibling's subtree. A query measures
its distance to one split point after another; by the stored ranges each one eliminates those siblings whose subtree can't
meet the annulus, often before they are measured. What is left is opened nearest first, and the annulus shrinks as good
scores are found. Leaves are decided by exact whole-number inner products. Queries go down a tree together, so that each
node's distances and each leaf's scores are one array operation.

The root of all is the same thing as a table: ``ROUTES`` split points at most, and a table of the distance ranges between
split points and regions, which Spark aggregates. Regions are dealt out in shards of about ``SHARD`` entries, one tree each;
the trees for positives hold one label each, so that a rare label's few rows are found without wading through others.
Queries travel to the trees of the regions that the root's ranges leave over: positives first to the anchor's own region,
which gives a score to beat, then to the others; negatives by their window. A task reads a tree once and streams queries
past it, and a tree that very many ask is sent once for ``BLOCK`` of them.

Equal vectors of one label are one entry with the ids of its first rows (the most that any query can use), found with a limit
before the shuffle, so a very common vector is never gathered; the driver gets split points, ranges and region sizes only,
all of bounded number.

Defined results: rows with a null label, a null vector, null or non-finite components, or without an id take no part;
shorter vectors count as padded with zeros; rows that repeat an id all count, and each is an anchor if the id is an anchor's;
an anchor leaves out its own row only; ties go to the smaller vec_id; fewer positives or negatives give fewer rows, and a
negative positive score gives an empty window; an empty table gives an empty result; other columns are ignored. Scores must
fit 64 bits; where squared norms pass 2**52, the borders of windows are those of doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written
from .topk import distances, lifted, vectors_of

K, EVERY = 5, 100
#: Split points of the root at most; entries of a shard and of a leaf; split points of an inner node; queries that a copy of a
#: tree gets, and that go down it together.
ROUTES, SHARD, LEAF, FAN, BLOCK, TOGETHER = 64, 4096, 128, 12, 4096, 256
NOBODY = np.iinfo(np.int64).min
TREE = "family long, region int, shard long, vectors binary, labels binary, ids array<array<long>>, nodes binary, ranges binary"
NODE = np.dtype([("point", "<i4"), ("start", "<i4"), ("stop", "<i4"), ("leaf", "?"), ("ranges", "<i8")])


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree over ``points``: its nodes, breadth first (an inner node's range is of nodes, a leaf's of entries; ``point`` is
    the entry that is a node's split point; ``ranges`` is where an inner node's table begins), the order of the entries, and
    all range tables: for split point i and sibling j the least and the largest distance."""
    nodes: list[tuple] = []
    order, tables, placed, used = [], [], 0, 0
    queue, head = [(np.arange(len(points)), 0)], 0
    while head < len(queue):
        members, point = queue[head]
        head += 1
        away = distances(points[members], points[members[0]]) if len(members) > LEAF else np.zeros(1)
        if not away.any():  # few entries, or all in one place
            nodes.append((point, placed, placed + len(members), True, 0))
            order.append(members)
            placed += len(members)
            continue
        picks, near = [int(away.argmax())], np.full(len(members), np.inf)
        columns: list[np.ndarray] = []  # distances of all members to each split point
        while True:
            columns.append(distances(points[members], points[members[picks[-1]]]))
            near = np.minimum(near, columns[-1])
            if len(picks) == FAN or not near.any():
                break
            picks.append(int(near.argmax()))  # the farthest from those before
        side = np.argmin(columns, 0)
        groups = [side == j for j in range(len(picks))]
        table = np.array([[(d[g].min(), d[g].max()) for g in groups] for d in columns])
        start = len(queue)
        queue += [(members[g], int(members[p])) for g, p in zip(groups, picks, strict=True)]
        nodes.append((point, start, len(queue), False, used))
        tables.append(table.ravel())
        used += table.size
    table = np.array(nodes, NODE)
    places = np.concatenate(order) if order else np.zeros(0, np.int64)
    where = np.empty(len(points), np.int64)
    where[places] = np.arange(len(points))
    if len(points):
        table["point"] = where[table["point"]]
    return table, places, np.concatenate(tables) if tables else np.zeros(0)


class Annuli:
    """The distances from each of some queries at which a score of its window can lie; they shrink as ``floor`` rises."""

    def __init__(self, q: np.ndarray, most: float, low: np.ndarray, high: np.ndarray):
        qq = (q.astype(np.float64) ** 2).sum(1)
        self.base, self.slack, self.floor, self.high = qq + most, 1e-7 * (qq + most) + 1e-3, low.astype(np.float64), high.astype(np.float64)
        self.inner = np.sqrt(np.maximum(self.base - 2 * (self.high + self.slack), 0))
        self.outer = np.empty(len(q))
        self.rise(np.arange(len(q)), self.floor)

    def rise(self, at: np.ndarray, floor: np.ndarray) -> None:
        self.floor[at] = np.maximum(self.floor[at], floor)
        self.outer[at] = np.sqrt(np.maximum(self.base[at] - 2 * (self.floor[at] - self.slack[at]), 0))

    def meet(self, at: np.ndarray, d: np.ndarray, least: np.ndarray, largest: np.ndarray) -> np.ndarray:
        """Whether entries at distances ``least`` to ``largest`` of a point, at distance ``d`` of the queries ``at``, may lie
        in each one's annulus: queries (rows) by ranges (columns)."""
        d, inner, outer = d[:, None], self.inner[at, None], self.outer[at, None]
        return (d - largest <= outer) & (least - d <= outer) & (d + largest >= inner)


def search(q: np.ndarray, most: float, low: np.ndarray, high: np.ndarray, other_than: np.ndarray, tree: tuple, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Queries, entries and scores of the entries that may be among each query's best ``keep`` scores of its window, ties
    included, and how many scores were computed. Entries of label ``other_than`` (where it isn't NOBODY) don't count. The
    queries go down the tree together: each node is met by those that it can't be ruled out for."""
    vectors, points, labels, nodes, ranges = tree
    none = -np.inf if vectors.dtype == np.float64 else np.iinfo(np.int64).min
    rings = Annuli(q, most, low, high)
    targets = np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], 1)
    best = np.full((len(q), keep), none, vectors.dtype)
    found, computed = [], 0
    stack = [(0, np.arange(len(q)), np.zeros(len(q)))]  # node, queries, their least possible distance to what is below
    while stack:
        k, at, bound = stack.pop()
        at = at[bound <= rings.outer[at]]  # annuli may have shrunk meanwhile
        start, stop = int(nodes["start"][k]), int(nodes["stop"][k])
        if not len(at):
            continue
        if not nodes["leaf"][k]:
            m = stop - start
            table = ranges[nodes["ranges"][k] : nodes["ranges"][k] + 2 * m * m].reshape(m, m, 2)
            alive, bound = np.ones((len(at), m), bool), np.zeros((len(at), m))
            for i in range(m):
                on = np.flatnonzero(alive[:, i])
                if len(on):
                    d = distances(targets[at[on]], points[nodes["point"][start + i]])
                    alive[on] &= rings.meet(at[on], d, table[i, :, 0], table[i, :, 1])
                    bound[on] = np.maximum(bound[on], np.maximum(d[:, None] - table[i, :, 1], table[i, :, 0] - d[:, None]))
            for j in np.argsort(-np.where(alive, bound, 0).sum(0) / np.maximum(alive.sum(0), 1)).tolist():  # the nearest is taken first
                on = np.flatnonzero(alive[:, j])
                stack.append((start + j, at[on], bound[on, j]))
            continue
        scores = q[at] @ vectors[start:stop].T
        computed += scores.size
        good = (scores >= rings.floor[at, None]) & (scores <= rings.high[at, None]) & ((other_than[at, None] == NOBODY) | (labels[start:stop] != other_than[at, None]))
        on = np.flatnonzero(good.any(1))
        if len(on):
            both = np.concatenate([best[at[on]], np.where(good[on], scores[on], none)], 1)
            best[at[on]] = np.partition(both, both.shape[1] - keep, 1)[:, -keep:]
            floor = best[at[on]].min(1).astype(np.float64)
            rings.rise(at[on], np.where(floor == float(none), -np.inf, floor))
            good &= scores >= rings.floor[at, None]
            r, e = np.nonzero(good)
            found.append((at[r], e + start, scores[r, e]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, vectors.dtype), computed
    r, e, scores = (np.concatenate(x) for x in zip(*found, strict=True))
    good = scores >= rings.floor[r]
    return r[good], e[good], scores[good], computed


def load(dim: int, most: float):
    """A shard's tree from its entries (family, region, shard, q, label, ids)."""

    def make(table: pa.Table) -> pa.Table:
        x = vectors_of(table.column("q").combine_chunks(), dim)
        nodes, order, ranges = build(lifted(x, most))
        ids = table.column("ids").combine_chunks().take(pa.array(order)).to_pylist()
        label = table.column("label").to_numpy()[order]
        names = [c.split()[0] for c in TREE.split(", ")]
        return pa.table([*(table.column(c).slice(0, 1) for c in names[:3]), *(pa.array([a.tobytes()]) for a in (x[order], label)), pa.array([ids], pa.list_(pa.list_(pa.int64()))), *(pa.array([a.tobytes()]) for a in (nodes, ranges))], names=names)

    return make


def visit(dim: int, most: float, keep: int):
    """Streams queries past the trees: rows are sorted, and each copy of a tree comes before those that ask it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = ids = None
        for batch in batches:
            out: list[tuple] = []
            trees = np.flatnonzero(batch.column("nodes").is_valid().to_numpy(zero_copy_only=False)).tolist()
            queries = vectors_of(batch.column("q").fill_null([]) if batch.column("q").null_count else batch.column("q"), dim)
            numbers = lambda c, if_null: batch.column(c).fill_null(if_null).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            least, most_ = np.iinfo(np.int64).min, np.iinfo(np.int64).max
            low, high = numbers("low", least).astype(np.float64), numbers("high", most_).astype(np.float64)
            low[low == float(least)], high[high == float(most_)] = -np.inf, np.inf
            other_than, qids = numbers("other_than", NOBODY), batch.column("qid")
            for start, stop in zip([-1, *trees], [*trees, batch.num_rows], strict=True):
                if start >= 0:
                    vectors, labels, nodes, ranges = (batch.column(c)[start].as_py() for c in ("vectors", "labels", "nodes", "ranges"))
                    x, ids = np.frombuffer(vectors, np.int64).reshape(-1, dim), batch.column("ids")[start].values
                    # doubles hold whole numbers of this size exactly, and multiply faster
                    tree = (x.astype(np.float64) if most < 2**52 else x, lifted(x, most), np.frombuffer(labels, np.int64), np.frombuffer(nodes, NODE), np.frombuffer(ranges))
                for k in range(start + 1, stop, TOGETHER):
                    part = slice(k, min(k + TOGETHER, stop))
                    r, e, scores, _ = search(queries[part].astype(tree[0].dtype), most, low[part], high[part], other_than[part], tree, keep)
                    order = np.argsort(r, kind="stable")
                    r, e, scores = r[order], e[order], scores[order].astype(np.int64)
                    cuts = np.searchsorted(r, np.arange(part.stop - k + 1))
                    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        some = [(-s, i) for s, x in zip(scores[a:b].tolist(), e[a:b].tolist(), strict=True) for i in ids[x].as_py()]
                        qid = qids[k + n].as_py() if some else None
                        out += [(qid, i, -s) for s, i in sorted(some)[:keep]]
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["qid", "vec_id", "score"])

    return run


class Forest:
    """The trees over ``entries`` (key, label, q, ids; written) and the root that tells which of them a query must ask."""

    def __init__(self, entries: DataFrame, n: int, most: float, dim: int):
        self.most, self.dim = most, dim
        wanted = min(ROUTES, max(1, round(n / SHARD)))
        routes = [list(r.q) + [0] * (dim - len(r.q)) for r in entries.orderBy(F.xxhash64("key"), "key", "label").limit(wanted).select("q").collect()]  # ROUTES vectors at most
        self.centres = centres = lifted(np.array(routes, np.int64).reshape(wanted, dim), most)

        def away(batch: pa.RecordBatch) -> np.ndarray:
            x = lifted(vectors_of(batch.column("q"), dim), most)
            return np.stack([distances(x, c) for c in centres])

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "label", "q", "ids")), pa.array(away(batch).argmin(0).astype(np.int32))], names=["key", "label", "q", "ids", "region"])

        def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least, largest = np.full((wanted, wanted), np.inf), np.full((wanted, wanted), -np.inf)
            for batch in batches:
                d, side = away(batch), batch.column("region").to_numpy()
                for j in np.unique(side):
                    own = d[:, side == j]
                    least[:, j], largest[:, j] = np.minimum(least[:, j], own.min(1)), np.maximum(largest[:, j], own.max(1))
            i, j = np.nonzero(np.isfinite(least))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(least[i, j]), pa.array(largest[i, j])], names=["i", "j", "least", "largest"])

        self.routed = written(entries.select("key", "label", "q", "ids").mapInArrow(nearest, "key string, label long, q array<long>, ids array<long>, region int"), "routed")
        self.least, self.largest = np.full((wanted, wanted), np.inf), np.full((wanted, wanted), -np.inf)
        for r in self.routed.select("q", "region").mapInArrow(spans, "i int, j int, least double, largest double").groupBy("i", "j").agg(F.min("least").alias("least"), F.max("largest").alias("largest")).collect():  # ROUTES squared rows at most
            self.least[r.i, r.j], self.largest[r.i, r.j] = r.least, r.largest

    def grown(self, family: str) -> tuple[DataFrame, DataFrame]:
        """Trees of the entries with an equal value of the expression ``family``, and the number of shards of each family and region."""
        entries = self.routed.withColumn("family", F.expr(family).cast("long"))
        sizes = written(entries.groupBy("family", "region").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("long").alias("shards")), "sizes")
        dealt = entries.join(sizes, ["family", "region"]).withColumn("shard", F.pmod(F.xxhash64("key", "label"), "shards"))
        return written(dealt.groupBy("family", "region", "shard").applyInArrow(load(self.dim, self.most), TREE), "trees"), sizes

    def regions(self, queries: DataFrame, but_own: bool = False) -> DataFrame:
        """qid, family, region of the regions that the root's ranges leave over for ``queries`` (qid, family, q, low, high, region)."""
        centres, least, largest, most, dim = self.centres, self.least, self.largest, self.most, self.dim

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = vectors_of(batch.column("q"), dim)
                low, high = (np.array([default if x is None else float(x) for x in batch.column(c).to_pylist()]) for c, default in (("low", -np.inf), ("high", np.inf)))
                rings, everyone = Annuli(q, most, low, high), np.arange(len(q))
                points, go = np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], 1), np.ones((len(q), len(centres)), bool)
                for c, a, b in zip(centres, least, largest, strict=True):
                    go &= rings.meet(everyone, distances(points, c), a, b)
                if but_own:
                    go[everyone, batch.column("region").to_numpy()] = False
                at, to = np.nonzero(go)
                yield pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(at)), batch.column("family").take(pa.array(at)), pa.array(to.astype(np.int32))], names=["qid", "family", "region"])

        return queries.select("qid", "family", "q", "low", "high", "region").mapInArrow(spread, "qid string, family long, region int")

    def hits(self, grown: tuple[DataFrame, DataFrame], queries: DataFrame, pairs: DataFrame, keep: int) -> DataFrame:
        """qid, vec_id, score: the ``keep`` best of each tree that ``pairs`` (qid, family, region; written) names."""
        trees, sizes = grown
        loads = pairs.groupBy("family", "region").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks")).join(sizes, ["family", "region"])
        numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        copies = trees.join(loads.drop("shards"), ["family", "region"]).withColumn("block", numbers("blocks")).drop("blocks")
        to = pairs.join(loads, ["family", "region"]).withColumn("block", F.pmod(F.xxhash64("qid"), "blocks")).withColumn("shard", numbers("shards"))
        sent = to.join(queries.select("qid", "q", "low", "high", "other_than"), "qid").select("family", "region", "shard", "block", "qid", "q", "low", "high", "other_than")
        both = copies.unionByName(sent, allowMissingColumns=True)
        place = ["family", "region", "shard", "block"]
        # a null qid sorts first: the tree before its queries
        return both.repartition(*place).sortWithinPartitions(*place, "qid").mapInArrow(visit(self.dim, self.most, keep), "qid string, vec_id long, score long")


def best(hits: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best rows of each qid, numbered."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("n", place).filter(F.col("n") <= keep)


def lists(hits: DataFrame, keep: int) -> DataFrame:
    """qid, best: the ``keep`` best of each as an array, best first."""
    return best(hits, keep).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("best"))


def valid_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, q, key of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    return (
        embeddings.filter(F.col("embedding").isNotNull() & fine & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
        .select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")).alias("q"))
        .withColumn("key", F.sha2(F.concat_ws(",", F.col("q").cast("array<string>")), 256))
    )


def mine(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors, whose vec_id is divisible
    by ``every``, among the rows of ``embeddings`` (vec_id, embedding, label)."""
    spark = embeddings.sparkSession
    rows = written(valid_rows(embeddings), "vectors")
    first = F.row_number().over(Window.partitionBy("label", "key").orderBy("vec_id"))  # limited in each task before the shuffle
    some = rows.withColumn("n", first).filter(F.col("n") <= k + 1)
    entries = written(some.groupBy("label", "key").agg(F.first("q").alias("q"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    norm = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, most, dim = entries.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("q"))).first()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    forest = Forest(entries, n, most, dim)
    qid, none = F.concat_ws(":", "key", "label"), F.lit(None).cast("long")
    self_score = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x * x)
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "label", "key", self_score.alias("self"), qid.alias("qid"))
    anchors = written(asked.select("key", "label", "qid").distinct().join(forest.routed.select("key", "label", "q", "region"), ["key", "label"]), "anchors")

    trees = forest.grown("label")
    queries = anchors.select("qid", F.col("label").alias("family"), "q", none.alias("low"), none.alias("high"), none.alias("other_than"), "region")
    near = written(best(forest.hits(trees, queries, queries.select("qid", "family", "region"), k + 1), k + 1), "near")
    beaten = written(queries.drop("low").join(near.filter(F.col("n") == k + 1).select("qid", F.col("score").alias("low")), "qid", "left"), "beaten")
    pairs = written(forest.regions(beaten, but_own=True), "pairs")
    ranked = written(lists(near.drop("n").unionByName(forest.hits(trees, beaten, pairs, k + 1)), k + 1), "positives")
    # of its list an anchor leaves out one row of its own id and score: its own row, or one that can't be told from it
    place = F.array_position("best", F.struct((-F.col("self")).alias("less"), "vec_id")).cast("int")
    rest = F.when(place > 0, F.concat(F.slice("best", F.lit(1), place - 1), F.slice("best", place + 1, F.lit(k + 1)))).otherwise(F.col("best"))
    positives = written(asked.join(ranked, "qid").select(F.col("vec_id").alias("anchor_id"), "key", "label", F.explode(F.slice(rest, 1, k)).alias("p")).select("anchor_id", "key", "label", F.col("p.vec_id").alias("positive_id"), (-F.col("p.less")).alias("positive_score"), F.concat_ws(":", "key", "label", -F.col("p.less")).alias("qid")), "pairs")

    low = F.expr("(4 * positive_score + 4) DIV 5")  # of a positive score: four fifths, rounded up
    windows = positives.filter("positive_score >= 0").select("qid", "key", "label", "positive_score").distinct()
    queries = written(windows.select("*", low.alias("low")).join(anchors.select("key", "label", "q", "region"), ["key", "label"]).select("qid", F.lit(0).cast("long").alias("family"), "q", "low", F.col("positive_score").alias("high"), F.col("label").alias("other_than"), "region"), "windows")
    negatives = lists(forest.hits(forest.grown("0"), queries, written(forest.regions(queries), "pairs"), k), k)
    out = positives.join(negatives, "qid").select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("at", "b"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("negative_id"), "positive_score", (-F.col("b.less")).alias("negative_score"))


def relabelled(embeddings: DataFrame) -> DataFrame:
    """``embeddings`` with the label changed where vec_id is divisible by 7."""
    label = F.col("label").cast("long")
    return embeddings.select("vec_id", "embedding", F.when(F.pmod("vec_id", F.lit(7)) == 0, (label + 1) % 10).otherwise(label).alias("label"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(relabelled(read_table(spark, sf_dir, "embeddings")))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.uid, a.vec_id AS anchor_id, b.uid AS other, b.vec_id, a.label = b.label AS alike, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.uid <> b.uid WHERE a.vec_id % 100 = 0
), p AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS n FROM s WHERE alike),
w AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.uid, p.n ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.uid = s.uid AND NOT s.alike AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score WHERE p.n <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 5
"""
