"""Visual evidence of findings: local features and their matches, similarity of whole images and of the parts that findings
mark, and the comparison and merging of findings by all six signals.

An image is a small grid of gray values and a colour signature. Its features are the windows of the grid, each with a binary
descriptor: which of its values lie above their mean. Features are made once an image, parts once a finding; pairs of
findings carry keys, and images meet by one join of the different pairs of images.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import check_text, ex, r6
from ..plans.registry import register
from .consolidate import _CENTRE, _NEAR, _TEXT, WEIGHTS, MergeLimits, islands, jaccard, near_pairs, sequence_ratio, tokens
from .evaluate import iou
from .groups import walked
from .scenes import segmented, signed
from .temporal import by_video, difference_hash, pearson

#: Width of the grid and of a feature's window; cells of a part's grid.
WIDE, WINDOW, PART = 8, 4, 4
#: A match counts if it is this much nearer than the next; matches from which the share of coherent ones is told; least coverage.
RATIO, LEAST, COVERED, SHARE = 0.75, 6, 8.0, 0.20


def features_of(px: str) -> Column:
    """The descriptors of all windows of a grid, row by row; bit k is the window's k-th value, row by row."""
    grid = WIDE - WINDOW + 1
    cells = lambda at: F.transform(F.sequence(F.lit(0), F.lit(WINDOW * WINDOW - 1)), lambda k: F.element_at(px, (at + F.floor(k / WINDOW) * WIDE + k % WINDOW + 1).cast("int")))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, v: s + v)
    starts = F.transform(F.sequence(F.lit(0), F.lit(grid * grid - 1)), lambda i: F.floor(i / grid) * WIDE + i % grid)
    bits = F.transform(F.transform(starts, cells), lambda w: total(F.transform(w, lambda v, k: F.when(v * WINDOW * WINDOW > total(w), F.expr("bigint(1)") * F.pow(F.lit(2), k).cast("long")).otherwise(F.lit(0).cast("long")))))
    return F.when(F.size(px) == WIDE * WIDE, bits)


def compare_descriptors(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of rows of descriptors how many are matched (much nearer than the next), and how many of these agree on the
    most frequent shift of their windows."""
    grid = WIDE - WINDOW + 1
    d = np.bitwise_count(a[:, :, None] ^ b[:, None, :]).astype(np.int16)
    nearest = d.argmin(2)
    least, second = np.partition(d, 1, 2)[:, :, :2].transpose(2, 0, 1)
    good = least < RATIO * second
    own = np.arange(a.shape[1])
    shift = (nearest // grid - own // grid) * 64 + (nearest % grid - own % grid)
    alike = (shift[:, :, None] == shift[:, None, :]) & good[:, :, None] & good[:, None, :]
    return good.sum(1), alike.sum(2).max(1)


def feature_score(good: np.ndarray, most: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The similarity, and the share of coherent matches (nan for few): coverage, weighted by how coherent the matches are."""
    ratio = np.where(good >= LEAST, most / np.maximum(good, 1), np.nan)
    value = np.minimum(1.0, good / np.maximum(COVERED, features * SHARE)) * np.where(np.isnan(ratio), 0.25, 0.4 + 0.6 * ratio)
    return np.floor(value * 1e5 + 0.5) / 1e5, ratio


def matched(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with feature_similarity (null where an image has too few features), good_matches and inlier_ratio (the share of
    matches that agree on one shift; null for few), from the descriptors in ``left`` and ``right``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            good, most, known = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
            sides = [batch.column(c) for c in (left, right)]
            lists = [(np.diff(s.offsets.to_numpy()), s.offsets.to_numpy()[:-1], s.values.to_numpy(zero_copy_only=False)) for s in sides]
            known = (lists[0][0] >= 2) & (lists[1][0] >= 2)
            for x, y in {*zip(lists[0][0][known].tolist(), lists[1][0][known].tolist(), strict=True)}:
                at = np.flatnonzero(known & (lists[0][0] == x) & (lists[1][0] == y))
                for k in range(0, len(at), 2048):
                    part = at[k : k + 2048]
                    good[part], most[part] = compare_descriptors(*(v[starts[part, None] + np.arange(size)].astype(np.uint64) for (_, starts, v), size in zip(lists, (x, y), strict=True)))
            value, ratio = feature_score(good, most, np.minimum(lists[0][0], lists[1][0]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(value, mask=~known), pa.array(good), pa.array(ratio, mask=np.isnan(ratio))], names=[*batch.schema.names, "feature_similarity", "good_matches", "inlier_ratio"]
            )

    types = ", ".join([*(f"`{c}` {t}" for c, t in pairs.dtypes), "feature_similarity double", "good_matches long", "inlier_ratio double"])
    return pairs.mapInArrow(run, types)


_CELLS = f"[px[CAST(corner + (k // {WINDOW}) * {WIDE} + k % {WINDOW} + 1 AS INT)] for k in range({WINDOW * WINDOW})]"
_GRID = WIDE - WINDOW + 1
#: desc (image_id, i, bits) from images (image_id, px), and fm (l, r, good, most) from image_pairs (l, r).
DESCRIBED = f"""starts AS (SELECT image_id, px, i, (i // {_GRID}) * {WIDE} + i % {_GRID} AS corner FROM (SELECT image_id, px, unnest(range({_GRID * _GRID})) AS i FROM images WHERE len(px) = {WIDE * WIDE})),
cells AS (SELECT image_id, i, {_CELLS} AS w FROM starts),
descr AS (SELECT image_id, i, CAST(list_sum([CASE WHEN w[k + 1] * {WINDOW * WINDOW} > list_sum(w) THEN 1 << k ELSE 0 END for k in range({WINDOW * WINDOW})]) AS BIGINT) AS bits FROM cells)"""
MATCHED = f"""near_by AS (SELECT p.l, p.r, a.i, b.i AS j, bit_count(xor(a.bits, b.bits)) AS d FROM image_pairs p JOIN descr a ON a.image_id = p.l JOIN descr b ON b.image_id = p.r),
two AS (SELECT l, r, i, arg_min(j, d * 1000 + j) AS j, list_sort(list(d))[1] AS d1, list_sort(list(d))[2] AS d2 FROM near_by GROUP BY l, r, i),
shifts AS (SELECT l, r, (j // {_GRID} - i // {_GRID}) * 64 + j % {_GRID} - i % {_GRID} AS shift, count(*) AS n FROM two WHERE d1 < {RATIO} * d2 GROUP BY ALL),
good AS (SELECT l, r, sum(n) AS good, max(n) AS most FROM shifts GROUP BY l, r),
fm AS (SELECT p.l, p.r, coalesce(good, 0) AS good, CASE WHEN good >= {LEAST} THEN most / CAST(good AS DOUBLE) END AS ratio,
  CASE WHEN x.image_id IS NOT NULL AND y.image_id IS NOT NULL THEN floor(least(1.0, coalesce(good, 0) / {COVERED}) * CASE WHEN good >= {LEAST} THEN 0.4 + 0.6 * (most / CAST(good AS DOUBLE)) ELSE 0.25 END * 1e5 + 0.5) / 1e5 END AS feature
  FROM image_pairs p LEFT JOIN good g ON g.l = p.l AND g.r = p.r LEFT JOIN (SELECT DISTINCT image_id FROM descr) x ON x.image_id = p.l LEFT JOIN (SELECT DISTINCT image_id FROM descr) y ON y.image_id = p.r)"""


def r5(column: Column) -> Column:
    return F.floor(column * 1e5 + 0.5) / 1e5


def agreement(a: Column, b: Column) -> Column:
    """The share of equal entries of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v) / F.size(a)


def part_of(px: str) -> Column:
    """The part of a grid that a finding's box marks, in PART x PART cells."""
    place = lambda low, size, k: F.least(F.lit(WIDE - 1), F.greatest(F.lit(0), F.floor((F.col(low) + F.col(size) * (k + 0.5) / PART) * WIDE))).cast("int")
    cells = F.sequence(F.lit(0), F.lit(PART * PART - 1))
    return F.when(F.size(px) == WIDE * WIDE, F.transform(cells, lambda k: F.element_at(px, place("y", "height", F.floor(k / PART)) * WIDE + place("x", "width", k % PART) + 1)))


_PLACE = f"least({WIDE - 1}, greatest(0, CAST(floor(({{low}} + {{size}} * ({{k}} + 0.5) / {PART}) * {WIDE}) AS INT)))"
_PART = f"[px[{_PLACE.format(low='y', size='height', k=f'(k // {PART})')} * {WIDE} + {_PLACE.format(low='x', size='width', k=f'(k % {PART})')} + 1] for k in range({PART * PART})]"
_CORRELATED = "greatest(0.0, least(1.0, CASE WHEN list_var_pop({a}) > 0 AND list_var_pop({b}) > 0 THEN (list_dot_product({a}, {b}) / len({a}) - list_avg({a}) * list_avg({b})) / sqrt(list_var_pop({a}) * list_var_pop({b})) ELSE 1.0 END))"


def image_similarity(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """l, r and image (similarity of whole images) of the different pairs (l, r) of ``images`` (image_id, px, signature)."""
    told = images.select("image_id", "px", F.transform("signature", lambda x: x.cast("double")).alias("signature"), features_of("px").alias("features"), difference_hash("px").alias("hash"))
    side = lambda c, k: told.select(F.col("image_id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("signature", "features", "hash")])
    met = pairs.select("l", "r").distinct().join(side("l", 0), "l").join(side("r", 0), "r")
    seen = met.withColumns({"hsv": r5(pearson("l_signature", "r_signature")), "dhash": agreement(F.col("l_hash"), F.col("r_hash"))}).select("l", "r", "hsv", "dhash", "l_features", "r_features")
    both = matched(seen, "l_features", "r_features")
    score = F.when(F.col("feature_similarity").isNull(), 0.65 * F.col("hsv") + 0.35 * F.col("dhash")).otherwise(0.45 * F.col("hsv") + 0.25 * F.col("dhash") + 0.30 * F.col("feature_similarity"))
    return both.select("l", "r", r5(score).alias("image"), "hsv", "dhash", "feature_similarity", "good_matches", "inlier_ratio")


def compare_evidence(findings: DataFrame, evidence: DataFrame, images: DataFrame, limits: MergeLimits = MergeLimits(), with_ratio: bool = True) -> DataFrame:
    """The near pairs of findings with all signals (image and the marked part where both findings have an image, see
    ``evidence``: finding_id, image_id), the score over the signals that are there, and the reasons against merging."""
    shown = findings.join(evidence, "finding_id", "left").join(images.select("image_id", "px"), "image_id", "left")
    marked = shown.withColumn("part", part_of("px")).withColumn("image_id", F.when(F.col("px").isNotNull(), F.col("image_id")))
    own = marked.select("finding_id", F.col("image_id").alias("l"), F.col("part").alias("l_part"))
    other = marked.select(F.col("finding_id").alias("r_finding_id"), F.col("image_id").alias("r"), F.col("part").alias("r_part"))
    p = near_pairs(findings, limits.pair_gap).join(own, "finding_id").join(other, "r_finding_id")
    left, right = tokens(F.col("description")), tokens(F.col("r_description"))
    text = jaccard(left, right)
    if with_ratio:
        text = F.greatest(text, sequence_ratio(F.array_join(left, " "), F.array_join(right, " ")))
    p = p.withColumns({"overlap": r5(ex(iou("", "r_"))), "centre": r5(ex(_CENTRE)), "text": r5(text), "time": r5(F.greatest(F.lit(0.0), 1 - F.abs(F.col("ts_s") - F.col("r_ts_s")) / limits.pair_gap))})
    p = p.join(image_similarity(p.filter("l is not null and r is not null"), images).select("l", "r", "image"), ["l", "r"], "left")
    p = p.withColumns({"a": F.transform("l_part", lambda x: x.cast("double")), "b": F.transform("r_part", lambda x: x.cast("double"))})
    crop = r5(0.65 * r5(pearson("a", "b")) + 0.35 * agreement(part_hash("l_part"), part_hash("r_part")))
    p = p.withColumn("region", r5(F.when(F.col("image").isNull(), F.col("overlap")).otherwise(0.70 * crop + 0.30 * F.col("overlap"))))
    p = p.withColumn("score", r5(ex(SCORE)))
    against = [
        F.when((F.col("overlap") < limits.box_iou) & (F.col("centre") > limits.centre), "region_location_changed"),
        *[F.when(F.col("image").isNotNull() & (F.col(c) < least), reason) for c, least, reason in (("image", limits.image, "whole_image_similarity_too_low"), ("region", limits.region, "region_similarity_too_low"), ("text", limits.text, "semantic_similarity_too_low"), ("score", limits.score, "weighted_score_too_low"))],
        *[F.when(F.col("image").isNull() & (F.col(c) < least), reason) for c, least, reason in (("overlap", limits.blind_iou, "metadata_only_bbox_iou_too_low"), ("text", limits.blind_text, "metadata_only_semantic_similarity_too_low"), ("score", limits.blind_score, "metadata_only_score_too_low"))],
    ]
    return p.withColumn("reasons", F.concat_ws(",", *against)).withColumn("merge", F.col("reasons") == "")


def part_hash(part: str) -> Column:
    return difference_hash(part, PART)


SCORE = (
    f"CASE WHEN image IS NULL THEN ({WEIGHTS['time']} * time + {WEIGHTS['room']} + {WEIGHTS['category']} + {WEIGHTS['region']} * region + {WEIGHTS['text']} * text) / {1 - WEIGHTS['image']} "
    f"ELSE {WEIGHTS['time']} * time + {WEIGHTS['room']} + {WEIGHTS['category']} + {WEIGHTS['image']} * image + {WEIGHTS['region']} * region + {WEIGHTS['text']} * text END"
)


class Joining:
    """The greedy merge of an island's findings in order of time, from the pairs that may merge: each joins the cluster of its
    best earlier match whose span stays within the limit (the earliest such cluster and member wins ties). Held are the ids and
    times of clusters that a later finding can still reach."""

    def __init__(self, limits: MergeLimits):
        self.limits, self.clusters = limits, []

    def push(self, row) -> list[tuple]:
        gone = [c for c in self.clusters if row.ts_s - c[-1][1] > self.limits.pair_gap]
        self.clusters = [c for c in self.clusters if row.ts_s - c[-1][1] <= self.limits.pair_gap]
        score = {m["id"]: m["score"] for m in row.matches} if row.matches is not None else {}
        near = [(-score[i], n, k) for n, c in enumerate(self.clusters) if row.ts_s - c[0][1] <= self.limits.cluster_span for k, (i, _) in enumerate(c) if i in score]
        if near:
            self.clusters[min(near)[1]].append((row.finding_id, row.ts_s))
        else:
            self.clusters.append([(row.finding_id, row.ts_s)])
        return self.told(gone)

    @staticmethod
    def told(clusters: list[list]) -> list[tuple]:
        return [(i, min(c)[0], len(c)) for c in clusters for i, _ in c]

    def end(self) -> list[tuple]:
        return self.told(self.clusters)


def consolidate_evidence(findings: DataFrame, evidence: DataFrame, images: DataFrame, limits: MergeLimits = MergeLimits()) -> DataFrame:
    """finding_id, cluster (its smallest finding), members: the greedy merge by all six signals."""
    pairs = compare_evidence(findings, evidence, images, limits).filter("merge")
    matches = pairs.groupBy(F.col("r_finding_id").alias("finding_id")).agg(F.collect_list(F.struct(F.col("finding_id").alias("id"), "score")).alias("matches"))  # of the seconds before it
    keys = ["video_id", "room", "category", "island"]
    wanted = islands(findings, limits.pair_gap).select(*keys, "finding_id", "ts_s").join(matches, "finding_id", "left")
    return walked(wanted.select(*keys, "finding_id", "ts_s", "matches"), keys, ["ts_s", "finding_id"], lambda: Joining(limits), "finding_id long, cluster long, members long")


_SIX = f"""images AS (SELECT frame_number AS image_id, px, [CAST(v AS DOUBLE) for v in signature] AS signature FROM frame_px), {_NEAR}, {DESCRIBED},
shown AS (SELECT f.finding_id, i.image_id, CASE WHEN len(px) = {WIDE * WIDE} THEN {_PART} END AS part FROM findings f LEFT JOIN evidence USING (finding_id) LEFT JOIN images i USING (image_id)),
met AS (SELECT n.*, a.image_id AS l, b.image_id AS r, a.part AS l_part, b.part AS r_part FROM near n JOIN shown a ON a.finding_id = n.finding_id JOIN shown b ON b.finding_id = n.r_finding_id),
image_pairs AS (SELECT DISTINCT l, r FROM met WHERE l IS NOT NULL AND r IS NOT NULL), {MATCHED},
seen AS (SELECT p.l, p.r, floor({_CORRELATED.format(a='x.signature', b='y.signature')} * 1e5 + 0.5) / 1e5 AS hsv, len([1 for i in range(1, 65) if (i - 1) % 8 <> 0 AND (x.px[i] > x.px[i - 1]) = (y.px[i] > y.px[i - 1])]) / 56.0 AS dhash
  FROM image_pairs p JOIN images x ON x.image_id = p.l JOIN images y ON y.image_id = p.r),
img AS (SELECT l, r, floor(CASE WHEN feature IS NULL THEN 0.65 * hsv + 0.35 * dhash ELSE 0.45 * hsv + 0.25 * dhash + 0.30 * feature END * 1e5 + 0.5) / 1e5 AS image FROM seen JOIN fm USING (l, r)),
sig AS (SELECT m.*, image, floor({iou('', 'r_')} * 1e5 + 0.5) / 1e5 AS overlap, floor({_CENTRE} * 1e5 + 0.5) / 1e5 AS centre, floor({_TEXT} * 1e5 + 0.5) / 1e5 AS text, floor(greatest(0.0, 1 - abs(ts_s - r_ts_s) / 12.0) * 1e5 + 0.5) / 1e5 AS time,
  [CAST(v AS DOUBLE) for v in l_part] AS a, [CAST(v AS DOUBLE) for v in r_part] AS b FROM met m LEFT JOIN img ON img.l = m.l AND img.r = m.r),
crops AS (SELECT *, floor((0.65 * (floor({_CORRELATED.format(a='a', b='b')} * 1e5 + 0.5) / 1e5) + 0.35 * (len([1 for i in range(1, 17) if (i - 1) % 4 <> 0 AND (l_part[i] > l_part[i - 1]) = (r_part[i] > r_part[i - 1])]) / 12.0)) * 1e5 + 0.5) / 1e5 AS crop FROM sig),
reg AS (SELECT *, floor(CASE WHEN image IS NULL THEN overlap ELSE 0.70 * crop + 0.30 * overlap END * 1e5 + 0.5) / 1e5 AS region FROM crops),
c AS (SELECT *, floor(({SCORE}) * 1e5 + 0.5) / 1e5 AS score FROM reg),
why AS (SELECT *, concat_ws(',', CASE WHEN overlap < 0.05 AND centre > 0.22 THEN 'region_location_changed' END, CASE WHEN image < 0.55 THEN 'whole_image_similarity_too_low' END, CASE WHEN image IS NOT NULL AND region < 0.50 THEN 'region_similarity_too_low' END,
  CASE WHEN image IS NOT NULL AND text < 0.40 THEN 'semantic_similarity_too_low' END, CASE WHEN image IS NOT NULL AND score < 0.68 THEN 'weighted_score_too_low' END, CASE WHEN image IS NULL AND overlap < 0.30 THEN 'metadata_only_bbox_iou_too_low' END,
  CASE WHEN image IS NULL AND text < 0.65 THEN 'metadata_only_semantic_similarity_too_low' END, CASE WHEN image IS NULL AND score < 0.78 THEN 'metadata_only_score_too_low' END) AS reasons FROM c)"""


def _images(px: DataFrame) -> DataFrame:
    return px.select(F.col("frame_number").alias("image_id"), "px", "signature")


_SIGNALS = ("overlap", "text", "image", "region", "score")
register(
    "j06_six_signals", "findings evidence frame_px",
    lambda f, e, p: compare_evidence(f, e, _images(p), with_ratio=False).select("finding_id", "r_finding_id", *[r6(F.col(c)).alias(c) for c in _SIGNALS], "reasons", "merge"),
    f"WITH {_SIX} SELECT finding_id, r_finding_id, {', '.join(f'R6({c}) AS {c}' for c in _SIGNALS)}, reasons, reasons = '' AS merge FROM why",
)
register("q02_visual_consolidation", "findings evidence frame_px", lambda f, e, p: consolidate_evidence(f, e, _images(p)))


def seen_twice(px: DataFrame) -> DataFrame:
    """Each frame of ``px`` (video_id, frame_number, px, signature) against the one before it in its video: hsv (correlation of
    signatures), dhash, and what :func:`matched` tells of their features."""
    own = px.withColumns({"features": features_of("px"), "hash": difference_hash("px")})
    pairs = own.withColumns({f"prior_{c}": F.lag(c).over(by_video()) for c in ("px", "signature", "features", "hash")}).filter("prior_px is not null")
    told = pairs.withColumns({"hsv": r5(pearson("signature", "prior_signature")), "dhash": agreement(F.col("hash"), F.col("prior_hash"))})
    return matched(told.select("video_id", "frame_number", "hsv", "dhash", "prior_features", "features"), "prior_features", "features")


@dataclass(frozen=True)
class DuplicateLimits:
    histogram: float = 0.94
    feature: float = 0.55
    matches: int = 12
    inliers: float = 0.35


def duplicate_method(c: DuplicateLimits) -> str:
    """How two frames are near duplicates: by colour that features support or don't speak about, by features alone, or by both."""
    colour = f"(hsv >= {c.histogram} AND coalesce(feature_similarity >= {max(0.10, 0.5 * c.feature)}, true))"
    shape = f"coalesce(feature_similarity >= {c.feature} AND good_matches >= {c.matches} AND inlier_ratio >= {c.inliers}, false)"
    return f"CASE WHEN {colour} AND {shape} THEN 'hsv_and_geometric_orb' WHEN {shape} THEN 'geometric_orb' WHEN {colour} THEN 'hsv_with_feature_support' ELSE 'not_duplicate' END"


#: The weights of colour, difference hash and features in the similarity of two images, with and without features.
VISUAL = "CASE WHEN feature_similarity IS NULL THEN 0.65 * hsv + 0.35 * dhash ELSE 0.45 * hsv + 0.25 * dhash + 0.30 * feature_similarity END"
#: The signatures of the test tables are noise, so their limits are low.
LOW = DuplicateLimits(histogram=0.1, feature=0.2, matches=6, inliers=0.3)
_TWICE = f"""images AS (SELECT frame_number AS image_id, px, [CAST(v AS DOUBLE) for v in signature] AS signature FROM frame_px),
before AS (SELECT video_id, frame_number, lag(frame_number) OVER (PARTITION BY video_id ORDER BY frame_number) AS l FROM frame_px), image_pairs AS (SELECT l, frame_number AS r FROM before WHERE l IS NOT NULL),
{DESCRIBED}, {MATCHED},
twice AS (SELECT b.video_id, b.frame_number, floor({_CORRELATED.format(a='x.signature', b='y.signature')} * 1e5 + 0.5) / 1e5 AS hsv, len([1 for i in range(1, 65) if (i - 1) % 8 <> 0 AND (x.px[i] > x.px[i - 1]) = (y.px[i] > y.px[i - 1])]) / 56.0 AS dhash,
  feature AS feature_similarity, good AS good_matches, ratio AS inlier_ratio FROM before b JOIN fm ON fm.l = b.l AND fm.r = b.frame_number JOIN images x ON x.image_id = b.l JOIN images y ON y.image_id = b.frame_number)"""
register(
    "f06_near_duplicate", "frame_px", lambda p: seen_twice(p).select("video_id", "frame_number", ex(duplicate_method(LOW)).alias("method"), "feature_similarity", "good_matches", r6(F.col("inlier_ratio")).alias("inlier_ratio")),
    f"WITH {_TWICE} SELECT video_id, frame_number, {duplicate_method(LOW)} AS method, feature_similarity, CAST(good_matches AS BIGINT) AS good_matches, R6(inlier_ratio) AS inlier_ratio FROM twice",
)
register("f12_visual_similarity", "frame_px", lambda p: seen_twice(p).select("video_id", "frame_number", r6(ex(VISUAL)).alias("score")), f"WITH {_TWICE} SELECT video_id, frame_number, R6({VISUAL}) AS score FROM twice")


def feature_value(a: np.ndarray | None, b: np.ndarray | None) -> float | None:
    """The similarity of two images' descriptors as :func:`matched` tells it, for kernels that hold the arrays."""
    if a is None or b is None or len(a) < 2 or len(b) < 2:
        return None
    good, most = compare_descriptors(a[None].astype(np.uint64), b[None].astype(np.uint64))
    return float(feature_score(good, most, np.array([min(len(a), len(b))]))[0][0])


def described(frames: DataFrame, px: DataFrame) -> DataFrame:
    """Signed frames (with signature_id) and the features of their images (``px``: frame_number, px)."""
    return frames.join(px.select(F.col("frame_number").alias("signature_id"), features_of("px").alias("features")), "signature_id", "left")


def feature_segments(frames: DataFrame) -> DataFrame:
    """video_id, frame_number, scene_index, boundary by colours and features: see :func:`~framewright.operators.scenes.segmented`."""
    wanted = frames.select("video_id", "frame_number", "t", "reasons", "motion_pct", "signature", "features")
    return segmented(wanted, features=feature_value, told=["video_id", "frame_number"])


register("q01_feature_segmentation", "frames embeddings frame_px", lambda f, e, p: feature_segments(described(signed(f, e), p)))
