"""Evaluation of detectors against annotations: interval and box joins, matching, confusion, funnels, accounting."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import ex, r6
from ..plans.registry import register
from ..sources.scratch import dropped, stored
from .frames import score_frames
from .rangejoin import band_join, interval_join

# Which findings confirm which annotated defect (categories, then words that must all be met).
_SOFT = ("fixture_damage", "visible_damage", "other")
MATCH_RULES = {
    "drywall_hole": (("wall_hole",), ("hole|opening",)),
    "unfinished_drywall_patch": (("paint_damage", "visible_damage", "other"), ("repair|patch|spackle|uneven finish",)),
    "unfinished_wall_patch_paint": (("paint_damage", "visible_damage", "other"), ("patch|spackle|filled hole|unfinished",)),
    "cabinet_mounting_damage": (("fixture_damage", "visible_damage", "missing_hardware", "other"), ("cabinet|vanity", "mount|fastener|chipp|hole|holder")),
    "bathtub_rim_crack": (_SOFT, ("tub", "crack")),
    "toilet_base_displacement": (_SOFT, ("toilet|base", "offset|caulk outline|displac|shifted")),
    "toilet_paper_holder_sagging": (_SOFT, ("holder", "toilet paper|paper roll", "sag|droop|downward|tilt|angled")),
    "water_dripping": (_SOFT, ("water drop|water drip|falling drop|leak|dripping water",)),
}


def confirms(truth: str, category: str = "category", description: str = "description") -> str:
    """True where a finding confirms an annotation of the class in column ``truth``."""
    parts = []
    for name, (categories, words) in MATCH_RULES.items():
        named = ", ".join(f"'{c}'" for c in categories)
        said = " AND ".join(f"RX(lower({description}), '{w}')" for w in words)
        parts.append(f"({truth} = '{name}' AND {category} IN ({named}) AND {said})")
    return "(" + " OR ".join(parts) + ")"


def iou(a: str, b: str) -> str:
    """Intersection over union of the boxes whose columns begin with ``a`` and ``b``."""
    w = f"greatest(0.0, least({a}x + {a}width, {b}x + {b}width) - greatest({a}x, {b}x))"
    h = f"greatest(0.0, least({a}y + {a}height, {b}y + {b}height) - greatest({a}y, {b}y))"
    union = f"({a}width * {a}height + {b}width * {b}height - {w} * {h})"
    return f"(CASE WHEN {union} > 0 THEN {w} * {h} / {union} ELSE 0.0 END)"


def points_in_intervals(frames: DataFrame, intervals: DataFrame) -> DataFrame:
    i = intervals.withColumnRenamed("category", "truth")
    return interval_join(frames.select("video_id", "frame_number", "t"), i, "video_id", "t", "start_s", "end_s", 2.0)


register(
    "j02_point_in_interval", "frames truth_intervals", lambda f, i: points_in_intervals(f, i).select("video_id", "frame_number", "interval_id"),
    "SELECT f.video_id, f.frame_number, i.interval_id FROM frames f JOIN truth_intervals i ON f.video_id = i.video_id AND f.t >= i.start_s AND f.t <= i.end_s",
)


def covered_findings(findings: DataFrame, intervals: DataFrame) -> DataFrame:
    """Findings inside an annotated interval that confirm its class."""
    i = intervals.withColumnRenamed("category", "truth")
    return interval_join(findings, i, "video_id", "ts_s", "start_s", "end_s", 2.0).filter(ex(confirms("truth")))


_COVERED = f"FROM findings f JOIN (SELECT interval_id, video_id AS v, start_s, end_s, category AS truth FROM truth_intervals) i ON f.video_id = i.v AND f.ts_s >= i.start_s AND f.ts_s <= i.end_s WHERE {confirms('truth')}"
register("j03_theta_category_join", "findings truth_intervals", lambda f, i: covered_findings(f, i).select("finding_id", "interval_id"), f"SELECT finding_id, interval_id {_COVERED}")
_P23 = " UNION ALL ".join(f"SELECT '{t}' AS truth" for t in MATCH_RULES)
register(
    "p23_category_match", "findings",
    lambda f: f.crossJoin(F.broadcast(f.sparkSession.createDataFrame([(t,) for t in MATCH_RULES], "truth string"))).filter(ex(confirms("truth"))).groupBy("truth").agg(F.count(F.lit(1)).alias("findings")),
    f"WITH t AS ({_P23}) SELECT truth, count(*) AS findings FROM findings, t WHERE {confirms('truth')} GROUP BY truth",
)
register(
    "t13_top_in_interval", "findings truth_intervals",
    lambda f, i: interval_join(f, i.withColumnRenamed("category", "truth"), "video_id", "ts_s", "start_s", "end_s", 2.0).withColumn("n", F.row_number().over(Window.partitionBy("interval_id").orderBy(F.col("confidence").desc(), "finding_id"))).filter("n <= 3").select("interval_id", "finding_id", "n"),
    "SELECT i.interval_id, f.finding_id, CAST(row_number() OVER (PARTITION BY i.interval_id ORDER BY f.confidence DESC, f.finding_id) AS INTEGER) AS n FROM findings f JOIN truth_intervals i ON f.video_id = i.video_id AND f.ts_s BETWEEN i.start_s AND i.end_s QUALIFY n <= 3",
)


def box_pairs(findings: DataFrame, truth: DataFrame, least: float = 0.1) -> DataFrame:
    """Finding and annotated box within 0.1 s of each other, their overlap, and why they don't match if they don't."""
    t = truth.select("video_id", "box_id", F.col("ts_s").alias("box_s"), F.col("category").alias("truth"), *[F.col(c).alias(f"b_{c}") for c in ("x", "y", "width", "height")])
    pairs = band_join(findings, t, "video_id", "ts_s", "box_s", 0.1)
    valid = ex("x + width <= 1.00001 AND y + height <= 1.00001 AND b_x + b_width <= 1.00001 AND b_y + b_height <= 1.00001")
    over = ex(iou("", "b_"))
    reason = F.when(F.col("category") != F.col("truth"), "wrong_condition").when(~valid, "invalid_box").when(over < least, "wrong_or_overly_broad_location").otherwise("verified_match")
    return pairs.withColumns({"overlap": over, "reason": reason})


_PAIRS = f"""t AS (SELECT video_id AS v, box_id, ts_s AS box_s, category AS truth, x AS b_x, y AS b_y, width AS b_width, height AS b_height FROM truth_boxes),
pairs AS (SELECT *, {iou('', 'b_')} AS overlap, CASE WHEN category <> truth THEN 'wrong_condition' WHEN NOT (x + width <= 1.00001 AND y + height <= 1.00001 AND b_x + b_width <= 1.00001 AND b_y + b_height <= 1.00001) THEN 'invalid_box'
  WHEN {iou('', 'b_')} < 0.1 THEN 'wrong_or_overly_broad_location' ELSE 'verified_match' END AS reason FROM findings f JOIN t ON f.video_id = t.v AND abs(f.ts_s - t.box_s) <= 0.1)"""
register("j04_box_match", "findings truth_boxes", lambda f, t: box_pairs(f, t).select("finding_id", "box_id", "reason", r6(F.col("overlap")).alias("overlap")), f"WITH {_PAIRS} SELECT finding_id, box_id, reason, R6(overlap) AS overlap FROM pairs")


#: Rounds after which something must be wrong: each round decides at least the first finding that is left in each clip.
MOST_ROUNDS = 10_000


def match_one_to_one(pairs: DataFrame) -> DataFrame:
    """Greedy matching by overlap: findings in order of their best overlap, each takes its best box that is still free.

    In rounds over all clips at once: a finding takes its favourite of the boxes that are left if it comes first among all
    findings that are left and could have that box, as then nobody before it can take it. Both are map-side minima, so a dense
    clip is spread out like any other."""
    clip, left = ["video_id"], pairs.filter("reason = 'verified_match'").select("video_id", "finding_id", "box_id", "overlap")
    order = left.groupBy("video_id", "finding_id").agg((-F.max("overlap")).alias("turn"))
    left, found = stored(left.join(order, ["video_id", "finding_id"]), "pairs"), []
    for _ in range(MOST_ROUNDS):
        if left.isEmpty():
            break
        favourite = left.groupBy("video_id", "finding_id").agg(F.min(F.struct((-F.col("overlap")).alias("less"), "box_id")).alias("f")).select("video_id", "finding_id", "f.box_id", (-F.col("f.less")).alias("overlap"))
        first = left.groupBy("video_id", "box_id").agg(F.min(F.struct("turn", "finding_id")).alias("t")).select("video_id", "box_id", F.col("t.finding_id").alias("finding_id"))
        found.append(stored(favourite.join(first, ["video_id", "finding_id", "box_id"]), "taken"))
        rest = left.join(found[-1].select(*clip, "finding_id"), [*clip, "finding_id"], "left_anti").join(found[-1].select(*clip, "box_id"), [*clip, "box_id"], "left_anti")
        before, left = left, stored(rest.select("video_id", "finding_id", "box_id", "overlap", "turn"), "pairs")
        dropped(before)
    else:
        raise RuntimeError("the matching did not settle")
    columns = ("video_id", "finding_id", "box_id", "overlap")
    return functools.reduce(DataFrame.unionByName, [t.select(*columns) for t in found], left.select(*columns))


_ORDERED = f"""WITH RECURSIVE {_PAIRS}, ok AS (SELECT video_id, finding_id, list(box_id ORDER BY overlap DESC, box_id) AS boxes, list(overlap ORDER BY overlap DESC, box_id) AS shares, max(overlap) AS best FROM pairs WHERE reason = 'verified_match' GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY best DESC, finding_id) AS n FROM ok),
walk AS (SELECT video_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS finding_id, CAST(NULL AS BIGINT) AS box_id, CAST(NULL AS DOUBLE) AS overlap, CAST([] AS BIGINT[]) AS taken FROM o WHERE n = 1
  UNION ALL SELECT video_id, n, finding_id, box, shares[list_position(boxes, box)], CASE WHEN box IS NULL THEN taken ELSE list_append(taken, box) END
  FROM (SELECT o.*, w.taken, list_filter(o.boxes, lambda b: NOT list_contains(w.taken, b))[1] AS box FROM walk w JOIN o ON o.video_id = w.video_id AND o.n = w.n + 1))"""
register(
    "j05_greedy_matching", "findings truth_boxes", lambda f, t: match_one_to_one(box_pairs(f, t)).select("video_id", "finding_id", "box_id", r6(F.col("overlap")).alias("overlap")),
    f"{_ORDERED} SELECT video_id, finding_id, box_id, R6(overlap) AS overlap FROM walk WHERE box_id IS NOT NULL",
)


def coverage(findings: DataFrame, frames: DataFrame, intervals: DataFrame) -> DataFrame:
    """Of each class of annotated intervals: how many, seen by a frame, confirmed by a finding, and their shares."""
    seen = points_in_intervals(frames, intervals).select("interval_id").distinct().withColumn("seen", F.lit(1))
    hit = covered_findings(findings, intervals).select("interval_id").distinct().withColumn("hit", F.lit(1))
    return intervals.join(seen, "interval_id", "left").join(hit, "interval_id", "left").groupBy("category").agg(F.count(F.lit(1)).alias("intervals"), F.count("seen").alias("seen"), F.count("hit").alias("confirmed"), r6(F.count("hit") / F.count(F.lit(1))).alias("recall"))


register(
    "a02_interval_recall", "findings frames truth_intervals", coverage,
    f"""WITH hit AS (SELECT DISTINCT interval_id {_COVERED}), seen AS (SELECT DISTINCT i.interval_id FROM frames f JOIN truth_intervals i ON f.video_id = i.video_id AND f.t BETWEEN i.start_s AND i.end_s)
SELECT category, count(*) AS intervals, count(seen.interval_id) AS seen, count(hit.interval_id) AS confirmed, R6(count(hit.interval_id) / CAST(count(*) AS DOUBLE)) AS recall
FROM truth_intervals i LEFT JOIN seen ON i.interval_id = seen.interval_id LEFT JOIN hit ON i.interval_id = hit.interval_id GROUP BY category""",
)


def loss_funnel(findings: DataFrame, frames: DataFrame, intervals: DataFrame) -> DataFrame:
    """Where annotated intervals are lost: no frame, no frame of quality, no finding, no finding over the gate, or not."""
    good = points_in_intervals(score_frames(frames).filter("reasons = ''"), intervals).select("interval_id").distinct().withColumn("good", F.lit(True))
    found = covered_findings(findings, intervals).groupBy("interval_id").agg(F.max("confidence").alias("best"))
    joined = intervals.join(good, "interval_id", "left").join(found, "interval_id", "left")
    stage = F.when(F.col("good").isNull(), "quality").when(F.col("best").isNull(), "detection").when(F.col("best") < 0.65, "confidence_gate").otherwise("reported")
    return joined.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("intervals"))


from .frames import SCORED  # noqa: E402

register(
    "a28_loss_funnel", "findings frames truth_intervals", loss_funnel,
    f"""WITH {SCORED}, good AS (SELECT DISTINCT i.interval_id FROM scored f JOIN truth_intervals i ON f.video_id = i.video_id AND f.t BETWEEN i.start_s AND i.end_s WHERE reasons = ''),
found AS (SELECT interval_id, max(confidence) AS best {_COVERED} GROUP BY interval_id)
SELECT CASE WHEN g.interval_id IS NULL THEN 'quality' WHEN best IS NULL THEN 'detection' WHEN best < 0.65 THEN 'confidence_gate' ELSE 'reported' END AS stage, count(*) AS intervals
FROM truth_intervals i LEFT JOIN good g ON i.interval_id = g.interval_id LEFT JOIN found h ON i.interval_id = h.interval_id GROUP BY 1""",
)
register(
    "j22_stage_trace", "findings truth_intervals",
    lambda f, i: i.select("interval_id").join(covered_findings(f, i).groupBy("interval_id").agg(F.min_by("finding_id", F.struct(-F.col("confidence"), "finding_id")).alias("candidate")), "interval_id", "left").join(f.filter("confidence >= 0.65").select(F.col("finding_id").alias("final")), F.col("candidate") == F.col("final"), "left").select("interval_id", F.coalesce("candidate", F.lit(-1)).cast("long").alias("candidate"), F.coalesce("final", F.lit(-1)).cast("long").alias("final")),
    f"""WITH c AS (SELECT interval_id, finding_id, confidence {_COVERED} QUALIFY row_number() OVER (PARTITION BY interval_id ORDER BY confidence DESC, finding_id) = 1)
SELECT i.interval_id, coalesce(c.finding_id, -1) AS candidate, CASE WHEN c.confidence >= 0.65 THEN c.finding_id ELSE -1 END AS final FROM truth_intervals i LEFT JOIN c ON i.interval_id = c.interval_id""",
)
register(
    "j23_evidence_alignment", "frames truth_intervals",
    lambda f, i: band_join(i.select("video_id", "interval_id", (F.col("start_s") + 1.0).alias("mid")), f.select("video_id", "t"), "video_id", "mid", "t", 0.01).select("video_id", "interval_id").distinct().groupBy("video_id").agg(F.count(F.lit(1)).alias("aligned")),
    "SELECT i.video_id, count(DISTINCT i.interval_id) AS aligned FROM truth_intervals i JOIN frames f ON f.video_id = i.video_id AND abs(i.start_s + 1.0 - f.t) <= 0.01 GROUP BY i.video_id",
)


def adjudicate(findings: DataFrame, intervals: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviewed matches: of the findings that confirm an interval the first counts, later ones are unmatched; a video with
    a pending review (finding_id, pending) has no result."""
    hits = covered_findings(findings, intervals).withColumn("n", F.row_number().over(Window.partitionBy("interval_id").orderBy("ts_s", "finding_id"))).join(reviews, "finding_id", "left")
    per = hits.groupBy("video_id").agg(F.count_if(F.col("n") == 1).alias("matched"), F.count_if(F.col("n") > 1).alias("unmatched"), F.bool_and(~F.coalesce("pending", F.lit(False))).alias("complete"))
    return per.select("video_id", F.when(F.col("complete"), F.col("matched")).otherwise(-1).cast("long").alias("matched"), F.when(F.col("complete"), F.col("unmatched")).otherwise(-1).cast("long").alias("unmatched"), "complete")


register(
    "j21_adjudication", "findings truth_intervals reviews", adjudicate,
    f"""WITH h AS (SELECT f.video_id, finding_id, row_number() OVER (PARTITION BY interval_id ORDER BY ts_s, finding_id) AS n {_COVERED}),
p AS (SELECT video_id, count(*) FILTER (WHERE n = 1) AS m, count(*) FILTER (WHERE n > 1) AS u, count(*) FILTER (WHERE pending) = 0 AS complete FROM h JOIN reviews USING (finding_id) GROUP BY video_id)
SELECT video_id, CASE WHEN complete THEN m ELSE -1 END AS matched, CASE WHEN complete THEN u ELSE -1 END AS unmatched, complete FROM p""",
)


def confusion(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Confusion counts with precision, recall, specificity, F1 and balanced accuracy, null on a zero denominator."""
    p, q = F.col("positive"), F.col("predicted_positive")
    counts = verdicts.groupBy(*by).agg(F.count_if(p & q).alias("tp"), F.count_if(~p & ~q).alias("tn"), F.count_if(~p & q).alias("fp"), F.count_if(p & ~q).alias("fn"))
    return counts.select(
        *by, "tp", "tn", "fp", "fn", r6(ex("try_divide(tp, tp + fp)")).alias("precision"), r6(ex("try_divide(tp, tp + fn)")).alias("recall"), r6(ex("try_divide(tn, tn + fp)")).alias("specificity"),
        r6(ex("try_divide(2 * tp, 2 * tp + fp + fn)")).alias("f1"), r6(ex("(try_divide(tp, tp + fn) + try_divide(tn, tn + fp)) / 2")).alias("balanced"),
    )


register(
    "a01_confusion", "clip_verdicts", lambda v: confusion(v, ["source_group"]),
    """WITH c AS (SELECT source_group, count(*) FILTER (WHERE positive AND predicted_positive) AS tp, count(*) FILTER (WHERE NOT positive AND NOT predicted_positive) AS tn,
  count(*) FILTER (WHERE NOT positive AND predicted_positive) AS fp, count(*) FILTER (WHERE positive AND NOT predicted_positive) AS fn FROM clip_verdicts GROUP BY source_group)
SELECT source_group, tp, tn, fp, fn, R6(tp / nullif(CAST(tp + fp AS DOUBLE), 0)) AS precision, R6(tp / nullif(CAST(tp + fn AS DOUBLE), 0)) AS recall, R6(tn / nullif(CAST(tn + fp AS DOUBLE), 0)) AS specificity,
  R6(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0)) AS f1, R6((tp / nullif(CAST(tp + fn AS DOUBLE), 0) + tn / nullif(CAST(tn + fp AS DOUBLE), 0)) / 2) AS balanced FROM c""",
)
register(
    "j12_resolution_flag", "clip_images documents",
    lambda v, d: v.join(d.select(F.col("doc_id").alias("image_id"), "source"), "image_id", "left").select("clip_id", "image_id", F.when(F.col("source").isNull(), "unresolved_image_id").otherwise("resolved").alias("state")),
    "SELECT clip_id, image_id, CASE WHEN source IS NULL THEN 'unresolved_image_id' ELSE 'resolved' END AS state FROM clip_images LEFT JOIN documents ON doc_id = image_id",
)
register(
    "j14_completeness", "clip_verdicts documents",
    lambda v, d: d.select(F.col("doc_id").alias("a")).join(v.select(F.col("clip_id").alias("b")), F.col("a") == F.col("b"), "full_outer").agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both")),
    "SELECT count(*) FILTER (WHERE clip_id IS NULL) AS missing, count(*) FILTER (WHERE doc_id IS NULL) AS extra, count(*) FILTER (WHERE clip_id IS NOT NULL AND doc_id IS NOT NULL) AS both FROM documents FULL OUTER JOIN clip_verdicts ON doc_id = clip_id",
)
register(
    "u03_symmetric_difference", "clip_verdicts",
    lambda v: (lambda a, b: a.exceptAll(b).withColumn("side", F.lit("label_only")).unionByName(b.exceptAll(a).withColumn("side", F.lit("predicted_only"))))(v.filter("positive").select("clip_id"), v.filter("predicted_positive").select("clip_id")),
    "SELECT clip_id, CASE WHEN positive THEN 'label_only' ELSE 'predicted_only' END AS side FROM clip_verdicts WHERE positive <> predicted_positive",
)

# Requests and costs
PRICES = (("A", 3.0, 15.0), ("N", 0.8, 4.0), ("R", 1.0, 5.0))


def costs(requests: DataFrame) -> DataFrame:
    """Cost of each video's requests; the price table has a row per model and is broadcast."""
    prices = requests.sparkSession.createDataFrame(PRICES, "model_id string, price_in double, price_out double")
    joined = requests.join(F.broadcast(prices), "model_id", "left")
    return joined.groupBy("video_id").agg(r6(F.sum(F.col("input_tokens") / 1e6 * F.col("price_in") + F.col("output_tokens") / 1e6 * F.col("price_out"))).alias("cost"), F.count_if(F.col("price_in").isNull()).alias("unpriced"))


_PRICES = " UNION ALL ".join(f"SELECT '{m}' AS model_id, {a} AS price_in, {b} AS price_out" for m, a, b in PRICES)
register("j11_model_cost", "requests", costs, f"WITH p AS ({_PRICES}) SELECT video_id, R6(sum(input_tokens / 1e6 * price_in + output_tokens / 1e6 * price_out)) AS cost, count(*) FILTER (WHERE price_in IS NULL) AS unpriced FROM requests LEFT JOIN p USING (model_id) GROUP BY video_id")
register(
    "a19_request_count", "requests", lambda r: r.groupBy("video_id").agg(F.when(F.count_distinct("request_id") == 0, F.count(F.lit(1))).otherwise(F.count_distinct("request_id")).alias("requests"), F.count(F.lit(1)).alias("records")),
    "SELECT video_id, CASE WHEN count(DISTINCT request_id) = 0 THEN count(*) ELSE count(DISTINCT request_id) END AS requests, count(*) AS records FROM requests GROUP BY video_id",
)
register(
    "a20_request_totals", "requests", lambda r: r.groupBy("video_id", "model_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), r6(F.sum("model_seconds")).alias("seconds"), F.count_distinct("request_id").alias("requests")),
    "SELECT video_id, model_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, R6(sum(model_seconds)) AS seconds, count(DISTINCT request_id) AS requests FROM requests GROUP BY ALL",
)
register(
    "a25_detector_fusion", "requests",
    lambda r: r.groupBy("request_id").agg(F.bool_or(F.col("model_id") == "R").alias("positive"), F.sum("input_tokens").alias("tokens"), F.array_join(F.array_sort(F.collect_set("model_id")), "+").alias("components")),
    "SELECT request_id, bool_or(model_id = 'R') AS positive, CAST(sum(input_tokens) AS BIGINT) AS tokens, string_agg(DISTINCT model_id, '+' ORDER BY model_id) AS components FROM requests GROUP BY request_id",
)


def accounting(requests: DataFrame) -> DataFrame:
    """Totals per video with the overall total beside them, from one grouping with a rollup."""
    return requests.rollup("video_id").agg(F.sum("input_tokens").alias("tokens"), F.count(F.lit(1)).alias("records")).withColumn("video_id", F.coalesce("video_id", F.lit(-1)).cast("long"))


register("a29_accounting", "requests", accounting, "SELECT CAST(coalesce(video_id, -1) AS BIGINT) AS video_id, CAST(sum(input_tokens) AS BIGINT) AS tokens, count(*) AS records FROM requests GROUP BY ROLLUP (video_id)")
register("a32_compute_cost", "requests", lambda r: r.groupBy("model_id").agg(r6(F.sum("model_seconds") / F.count_distinct("video_id") / 3600 * 0.7181).alias("cost_per_video")), "SELECT model_id, R6(sum(model_seconds) / count(DISTINCT video_id) / 3600 * 0.7181) AS cost_per_video FROM requests GROUP BY model_id")


def batches(requests: DataFrame, size: int = 8) -> DataFrame:
    """Requests of a video in batches of ``size``: the number of the batch and the place in it."""
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("request_id", "attempt")) - 1
    return requests.withColumn("n", n).select("video_id", "request_id", "attempt", F.floor(F.col("n") / size).cast("long").alias("batch"), (F.col("n") % size).cast("long").alias("place"))


_BATCH = "WITH n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY request_id, attempt) - 1 AS n FROM requests), b AS (SELECT video_id, request_id, attempt, n // 8 AS batch, n % 8 AS place FROM n)"
register("w11_batch_numbers", "requests", batches, f"{_BATCH} SELECT video_id, request_id, attempt, batch, place FROM b")


def remap(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Batch-local places of ``answers`` (video_id, batch, place) back to global ids; a place that isn't there is rejected."""
    joined = answers.join(batches(requests), ["video_id", "batch", "place"], "left")
    return joined.groupBy("video_id").agg(F.count("request_id").alias("mapped"), F.count_if(F.col("request_id").isNull()).alias("rejected"))


register("j13_batch_remap", "requests answers", remap, "SELECT video_id, count(*) FILTER (WHERE place < 8) AS mapped, count(*) FILTER (WHERE place >= 8) AS rejected FROM answers GROUP BY video_id")


def evenly(requests: DataFrame, wanted: int = 5) -> DataFrame:
    """``wanted`` rows of each video, evenly spaced in order (half-even rounding of the places)."""
    ordered = requests.select("video_id", "request_id", "attempt", (F.row_number().over(Window.partitionBy("video_id").orderBy("request_id", "attempt")) - 1).alias("n"), F.count(F.lit(1)).over(Window.partitionBy("video_id")).alias("size"))
    places = F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: F.bround(i * (F.col("size") - 1) / (wanted - 1), 0).cast("long"))
    return ordered.filter(F.array_contains(places, F.col("n").cast("long"))).select("video_id", "request_id", "attempt")


register(
    "w12_even_pick", "requests", evenly,
    """WITH n AS (SELECT video_id, request_id, attempt, row_number() OVER (PARTITION BY video_id ORDER BY request_id, attempt) - 1 AS n, count(*) OVER (PARTITION BY video_id) AS size FROM requests)
SELECT video_id, request_id, attempt FROM n WHERE list_contains([CAST(round_even(i * (size - 1) / 4.0, 0) AS BIGINT) for i in range(0, 5)], n)""",
)
register(
    "u04_name_sets", "requests",
    lambda r: r.groupBy("video_id").agg(F.collect_set("model_id").alias("have")).select("video_id", F.array_join(F.array_sort(F.array_except(F.array(F.lit("A"), F.lit("N"), F.lit("X")), "have")), ",").alias("missing"), F.array_join(F.array_sort(F.array_except("have", F.array(F.lit("A"), F.lit("N"), F.lit("X")))), ",").alias("unknown")),
    "WITH h AS (SELECT video_id, list(DISTINCT model_id) AS have FROM requests GROUP BY video_id) SELECT video_id, array_to_string([m for m in ['A', 'N', 'X'] if NOT list_contains(have, m)], ',') AS missing, array_to_string(list_sort([m for m in have if m NOT IN ('A', 'N', 'X')]), ',') AS \"unknown\" FROM h",
)
register(
    "j18_nearest_frames", "frames findings",
    lambda f, g: band_join(g.select("video_id", "finding_id", "ts_s"), f.select("video_id", "frame_number", "t"), "video_id", "ts_s", "t", 10.0).withColumn("n", F.row_number().over(Window.partitionBy("finding_id").orderBy(F.abs(F.col("t") - F.col("ts_s")), "t", "frame_number"))).filter("n <= 4").select("finding_id", "frame_number", "n"),
    "SELECT g.finding_id, f.frame_number, CAST(row_number() OVER (PARTITION BY g.finding_id ORDER BY abs(f.t - g.ts_s), f.t, f.frame_number) AS INTEGER) AS n FROM findings g JOIN frames f ON f.video_id = g.video_id AND abs(g.ts_s - f.t) <= 10.0 QUALIFY n <= 4",
)
