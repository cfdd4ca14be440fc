"""Exact top-k by inner product with M-trees.

Inner product is made a metric: with the largest squared norm m of all candidates, each candidate gets one more coordinate
sqrt(m - |x|^2) and queries get 0 there, so that the squared distance is |q|^2 + m - 2 q.x: the nearest are the best.

Equal vectors are one entry with the ids of their k + 1 first rows (the most that any query can use), found with a limit
before the shuffle, so a very common vector is never gathered. A bounded number of routing objects splits the entries into
regions, regions are dealt out in shards of about ``SHARD`` entries, and each shard is bulk-loaded as an M-tree: pages with
a centre, a covering radius and the distance to the parent's centre, leaf entries with the distance to their page's centre.

Queries travel to the trees. First to the region of their nearest routing object, which gives each a k-th best score to
beat; then to those regions whose ball can hold a better one. A task reads a tree once, then streams the queries that ask
it; a tree that very many ask is sent once for ``BLOCK`` of them. In a tree a query takes pages from a heap in order of
their least possible distance, stops at the first that can't beat the score, and by the stored distances and the triangle
inequality it skips pages and entries without computing their distance. Scores are whole-number inner products.

Defined results: every row is a candidate of its own, so rows that repeat an id, or both an id and a vector, all count and
are all asked for if the id is a query's; a query leaves out its own row only, so its copies may answer it. Vectors that
are null or hold null or non-finite components, and rows without an id, take no part; shorter vectors count as padded with
zeros; ties go to the smaller vec_id; fewer than k candidates give fewer rows; an empty table gives an empty result; other
columns are ignored. Scores must fit 64 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written

K, EVERY = 5, 50
#: Routing objects at most; entries of a shard, of a leaf page, children of a page; queries to which one copy of a tree is sent.
ROUTES, SHARD, LEAF, FAN, BLOCK = 256, 4096, 512, 16, 4096
TREE = "region int, shard long, vectors binary, ids array<array<long>>, nodes binary, entry_distances binary"
NODE = np.dtype([("centre", "<i4"), ("start", "<i4"), ("stop", "<i4"), ("leaf", "?"), ("radius", "<f8"), ("to_parent", "<f8")])


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Candidates with the coordinate that makes their norms equal."""
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]], 1)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(1))


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bulk-loads a tree: nodes (breadth first; a node's children or entries are a range), the order of the entries, and
    each entry's distance to the centre of its leaf."""
    nodes: list[list] = []
    order = np.zeros(len(points), np.int64)
    to_centre = np.zeros(len(points))
    queue = [(np.arange(len(points)), 0, 0.0)]  # members, centre (a member), distance to the parent's centre
    placed, head = 0, 0
    while head < len(queue):
        members, centre, to_parent = queue[head]
        head += 1
        d = distances(points[members], points[centre])
        radius = float(d.max(initial=0))
        if len(members) <= LEAF or radius == 0:
            order[placed : placed + len(members)] = members
            to_centre[placed : placed + len(members)] = d
            nodes.append([centre, placed, placed + len(members), True, radius, to_parent])
            placed += len(members)
            continue
        picks = [int(d.argmax())]  # farthest first
        near = distances(points[members], points[members[picks[0]]])
        side = np.zeros(len(members), np.int64)
        while len(picks) < FAN and near.max() > 0:
            picks.append(int(near.argmax()))
            d2 = distances(points[members], points[members[picks[-1]]])
            closer = d2 < near
            side[closer], near = len(picks) - 1, np.minimum(near, d2)
        start = len(queue)
        for k, p in enumerate(picks):
            own = members[side == k]
            if len(own):
                queue.append((own, int(members[p]), float(distances(points[members[p]][None], points[centre])[0])))
        nodes.append([centre, start, len(queue), False, radius, to_parent])
    table = np.array([tuple(x) for x in nodes], NODE)
    where = np.empty(len(points), np.int64)
    where[order] = np.arange(len(points))
    if len(table):
        table["centre"] = where[table["centre"]]
    return table, order, to_centre


def search(q: np.ndarray, most: float, vectors: np.ndarray, points: np.ndarray, nodes: np.ndarray, entry_d: np.ndarray, keep: int, beat: float) -> tuple[list[tuple[int, int]], int]:
    """(score, entry) of the entries that may be among the query's best ``keep`` by score, ties included; at least all
    that score ``beat`` or more among them. Beside them, how many entries the stored distances didn't rule out."""
    qq = float(q @ q)
    point = np.append(q.astype(np.float64), 0.0)
    slack = 1e-7 * (qq + most) + 1e-3
    score_at = lambda d: (qq + most - d * d) / 2 + slack  # noqa: E731  the best score at this distance or beyond
    best = np.zeros(0, vectors.dtype)  # the best scores so far, ``keep`` at most
    found: list[tuple[np.ndarray, np.ndarray]] = []
    root_d = float(distances(points[nodes["centre"][:1]], point)[0])
    heap = [(max(0.0, root_d - float(nodes["radius"][0])), 0, root_d)]
    floor, looked_at = beat, 0
    while heap:
        least, k, d = heapq.heappop(heap)
        if score_at(least) < floor:
            break
        node = nodes[k]
        start, stop = int(node["start"]), int(node["stop"])
        if not node["leaf"]:
            # the stored distance to this node's centre bounds a child before its own centre is looked at
            children = nodes[start:stop]
            bound = np.abs(d - children["to_parent"]) - children["radius"]
            near = np.flatnonzero(score_at(np.maximum(bound, 0)) >= floor)
            if len(near):
                to_centre = distances(points[children["centre"][near]], point)
                low = np.maximum(to_centre - children["radius"][near], 0)
                for c in np.flatnonzero(score_at(low) >= floor).tolist():
                    heapq.heappush(heap, (float(low[c]), start + int(near[c]), float(to_centre[c])))
            continue
        near = np.flatnonzero(score_at(np.abs(d - entry_d[start:stop])) >= floor) + start
        looked_at += len(near)
        if len(near):
            # where hardly any entry is skipped, one product over the page costs less than picking them out
            scores = vectors[near] @ q if 2 * len(near) < stop - start else (vectors[start:stop] @ q)[near - start]
            good = scores >= floor
            scores, near = scores[good], near[good]
            found.append((scores, near))
            best = np.concatenate([best, scores])
            if len(best) > keep:
                best = np.partition(best, len(best) - keep)[-keep:]
            if len(best) == keep:
                floor = max(floor, float(best.min()))
    return [(int(s), e) for scores, near in found for s, e in zip(scores[scores >= floor].tolist(), near[scores >= floor].tolist(), strict=True)], looked_at


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == out.size:
        return flat.reshape(out.shape).astype(np.int64)
    if len(flat):
        out[np.repeat(np.arange(len(column)), lengths), np.concatenate([np.arange(n) for n in lengths])] = flat
    return out


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all rows of ``embeddings`` (vec_id, embedding) for each row whose
    vec_id is divisible by ``every``, itself left out."""
    spark = embeddings.sparkSession
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    valid = embeddings.filter(F.col("embedding").isNotNull() & fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("q"))
    rows = written(valid.withColumn("key", F.sha2(F.concat_ws(",", F.col("q").cast("array<string>")), 256)), "vectors")
    first = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))  # limited in each task before the shuffle
    entries = written(rows.withColumn("n", first).filter(F.col("n") <= k + 1).groupBy("key").agg(F.first("q").alias("q"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    norm = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, most, dim = entries.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("q"))).first()
    self_score = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x * x)
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), self_score.alias("self"), "key")
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    wanted = min(ROUTES, max(1, round(n / SHARD)))
    routes = np.array([list(r.q) + [0] * (dim - len(r.q)) for r in entries.orderBy(F.xxhash64("key")).limit(wanted).select("q").collect()], np.int64).reshape(wanted, dim)  # ROUTES vectors at most
    centres = lifted(routes, most)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = lifted(vectors_of(batch.column("q"), dim), most)
            d = np.stack([distances(x, c) for c in centres], 1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("q"), batch.column("ids"), pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], names=["key", "q", "ids", "region", "away"])

    routed = written(entries.mapInArrow(nearest, "key string, q array<long>, ids array<long>, region int, away double"), "routed")
    regions = routed.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.max("away").alias("radius"))
    balls = {r.region: (r.size, r.radius) for r in regions.collect()}  # ROUTES rows at most
    shards = F.coalesce(*[F.when(F.col("region") == r, F.lit(-(-size // SHARD))) for r, (size, _) in balls.items()])

    def load(table: pa.Table) -> pa.Table:
        x = vectors_of(table.column("q").combine_chunks(), dim)
        nodes, order, d = build(lifted(x, most))
        ids = table.column("ids").combine_chunks().take(pa.array(order))
        return pa.table([table.column("region").slice(0, 1), table.column("shard").slice(0, 1), pa.array([x[order].tobytes()]), pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64()))), pa.array([nodes.tobytes()]), pa.array([d.tobytes()])], names=[c.split()[0] for c in TREE.split(", ")])

    trees = written(routed.withColumn("shard", F.pmod(F.xxhash64("key"), shards)).groupBy("region", "shard").applyInArrow(load, TREE), "trees")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None  # of the rows that follow: they are sorted, and each copy of a tree comes before its queries
        for batch in batches:
            out: list[tuple] = []
            is_tree = batch.column("nodes").is_valid().to_numpy(zero_copy_only=False)
            queries = vectors_of(batch.column("q").fill_null([]) if batch.column("q").null_count else batch.column("q"), dim)
            beats = batch.column("beat").to_pylist()
            for r in range(batch.num_rows):
                if is_tree[r]:
                    vectors, nodes, entry_d = (batch.column(c)[r].as_py() for c in ("vectors", "nodes", "entry_distances"))
                    x, ids = np.frombuffer(vectors, np.int64).reshape(-1, dim), batch.column("ids")[r].values
                    # scores are whole numbers that doubles hold exactly where ``most`` is small, and multiply faster
                    tree = (x.astype(np.float64) if most < 2**52 else x, lifted(x, most), np.frombuffer(nodes, NODE), np.frombuffer(entry_d))
                    continue
                x, points, nodes, entry_d = tree
                beat = -np.inf if beats[r] is None else beats[r]
                found, _ = search(queries[r].astype(x.dtype), most, x, points, nodes, entry_d, k + 1, beat)
                best = sorted((-s, i) for s, e in found for i in ids[e].as_py())[: k + 1]
                key = batch.column("key")[r].as_py()
                out += [(key, i, -s) for s, i in best]
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["key", "vec_id", "score"])

    def hits(queries: DataFrame) -> DataFrame:
        """The best of the regions that ``queries`` (key, q, beat, region; written) name; key, vec_id, score."""
        blocks = queries.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))  # ROUTES rows at most
        copies = trees.join(F.broadcast(blocks), "region").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        sent = queries.join(F.broadcast(blocks), "region").withColumn("block", F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks"))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)))
        both = copies.unionByName(sent.select("region", "shard", "block", "key", "q", "beat"), allowMissingColumns=True)
        # a null key sorts first: the tree before its queries
        return both.repartition("region", "shard", "block").sortWithinPartitions("region", "shard", "block", "key").mapInArrow(visit, "key string, vec_id long, score long")

    best = Window.partitionBy("key").orderBy(F.col("score").desc(), "vec_id")
    queries = written(asked.select("key").distinct().join(routed.select("key", "q", "region"), "key"), "queries")
    near = written(hits(queries.withColumn("beat", F.lit(None).cast("long"))).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1), "near")
    scored = queries.join(near.filter(F.col("n") == k + 1).select("key", F.col("score").alias("beat")), "key", "left")

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius = np.array([balls[r][1] if r in balls else -np.inf for r in range(len(centres))])
        for batch in batches:
            q = vectors_of(batch.column("q"), dim).astype(np.float64)
            points = np.concatenate([q, np.zeros((len(q), 1))], 1)
            low = np.maximum(np.stack([distances(points, c) for c in centres], 1) - radius, 0)
            qq = (q * q).sum(1)[:, None]
            bound = (qq + most - low * low) / 2 + 1e-7 * (qq + most) + 1e-3
            beat = batch.column("beat").to_numpy(zero_copy_only=False).astype(np.float64)
            go = (np.isnan(beat)[:, None] | (bound >= beat[:, None])) & np.isfinite(radius)
            go[np.arange(len(q)), batch.column("region").to_numpy(zero_copy_only=False)] = False
            i, r = np.nonzero(go)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(i)), batch.column("q").take(pa.array(i)), batch.column("beat").take(pa.array(i)), pa.array(r.astype(np.int32))], names=["key", "q", "beat", "region"])

    others = written(scored.select("key", "q", "beat", "region").mapInArrow(elsewhere, "key string, q array<long>, beat long, region int"), "elsewhere")
    ranked = near.select("key", "vec_id", "score").unionByName(hits(others)).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    lists = written(ranked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("best")), "best")  # k + 1 of a key
    # of its list a query leaves out one row that has its own id and score: its own row, or one that can't be told from it
    place = F.array_position("best", F.struct((-F.col("self")).alias("less"), F.col("query_id").alias("vec_id"))).cast("int")
    rest = F.when(place > 0, F.concat(F.slice("best", F.lit(1), place - 1), F.slice("best", place + 1, F.lit(k + 1)))).otherwise(F.col("best"))
    return asked.join(lists, "key").select("query_id", F.posexplode(F.slice(rest, 1, k)).alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", (-F.col("b.less")).alias("score"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.uid, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.uid <> b.uid WHERE a.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
