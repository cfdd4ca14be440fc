"""Frame verdicts: blur, exposure, motion, the quality score, reasons for rejection, and roll-ups over them.

Every verdict is an expression over the measured columns, so a pass over the frame table is one narrow stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import ex, r6
from ..plans.registry import register


@dataclass(frozen=True)
class FrameLimits:
    """Limits of the frame verdicts (fixed values of the default profile)."""

    sharpness: float = 45.0
    tiles_pct: float = 50.0
    blur_motion: float = 8.0
    blur_factor: float = 1.5
    dark_mean: float = 25.0
    bright_mean: float = 235.0
    dark_pct: float = 60.0
    bright_pct: float = 35.0
    motion: float = 30.0


LIMITS = FrameLimits()


def blur_reasons(c: FrameLimits = LIMITS) -> str:
    return f"""concat_ws(',', CASE WHEN sharpness < {c.sharpness} THEN 'low_global_laplacian' END,
  CASE WHEN sharpness < {c.sharpness} * 1.5 AND tile_median < {c.sharpness} AND sharp_tiles_pct < {c.tiles_pct} THEN 'insufficient_sharp_tiles' END,
  CASE WHEN motion_pct >= {c.blur_motion} AND sharpness < {c.sharpness} * {c.blur_factor} THEN 'motion_supported_blur' END)"""


def blur_class(c: FrameLimits = LIMITS) -> str:
    return f"CASE WHEN {blur_reasons(c)} <> '' THEN 'blurry' WHEN sharpness >= {c.sharpness} * 2.5 THEN 'sharp' ELSE 'usable' END"


def exposure_class(c: FrameLimits = LIMITS) -> str:
    return f"""CASE WHEN brightness_mean < {c.dark_mean} OR dark_pct >= {c.dark_pct} THEN 'too_dark'
  WHEN brightness_mean > {c.bright_mean} OR bright_pct >= {c.bright_pct} THEN 'overexposed' ELSE 'usable' END"""


def motion_class(c: FrameLimits = LIMITS) -> str:
    return f"CASE WHEN motion_pct IS NULL THEN 'unknown' WHEN motion_pct > {c.motion} THEN 'fast' ELSE 'stable' END"


def quality_score(c: FrameLimits = LIMITS) -> str:
    mean = "greatest(0.0, 100.0 - abs(brightness_mean - 127.5) / 127.5 * 100.0)"
    base = f"(CASE WHEN {exposure_class(c)} = 'usable' THEN greatest(70.0, {mean}) ELSE least(40.0, {mean}) END)"
    light = f"greatest(0.0, {base} - least(50.0, greatest(dark_pct, bright_pct) / 2.0))"
    still = f"(CASE WHEN motion_pct IS NULL THEN 100.0 ELSE greatest(0.0, 100.0 - motion_pct / {c.motion * 2} * 100.0) END)"
    return f"0.45 * least(100.0, sharpness / {c.sharpness * 2} * 100.0) + 0.30 * {light} + 0.25 * {still}"


def rejection_reasons(c: FrameLimits = LIMITS) -> str:
    return f"""concat_ws(',', CASE WHEN {blur_class(c)} = 'blurry' THEN 'blurry' END, CASE WHEN {exposure_class(c)} <> 'usable' THEN {exposure_class(c)} END,
  CASE WHEN {motion_class(c)} = 'fast' THEN 'fast_motion' END)"""


def score_frames(frames: DataFrame, c: FrameLimits = LIMITS) -> DataFrame:
    """All verdicts beside the columns of ``frames``."""
    return frames.withColumns(
        {
            "blur": ex(blur_class(c)),
            "exposure": ex(exposure_class(c)),
            "motion": ex(motion_class(c)),
            "quality": ex(quality_score(c)),
            "reasons": ex(rejection_reasons(c)),
        }
    ).withColumn("decision", F.when(F.col("reasons") == "", "candidate_quality_pass").otherwise("rejected_quality"))


KEY = "video_id, frame_number"
SCORED = f"scored AS (SELECT *, {blur_class()} AS blur, {exposure_class()} AS exposure, {motion_class()} AS motion, {quality_score()} AS quality, {rejection_reasons()} AS reasons FROM frames)"

register("p01_blur_verdict", "frames", lambda f: f.select("video_id", "frame_number", ex(blur_class()).alias("blur"), ex(blur_reasons()).alias("reasons")), f"SELECT {KEY}, {blur_class()} AS blur, {blur_reasons()} AS reasons FROM frames")
register("p02_exposure_verdict", "frames", lambda f: f.select("video_id", "frame_number", ex(exposure_class()).alias("exposure")), f"SELECT {KEY}, {exposure_class()} AS exposure FROM frames")
register("p03_motion_verdict", "frames", lambda f: f.select("video_id", "frame_number", ex(motion_class()).alias("motion")), f"SELECT {KEY}, {motion_class()} AS motion FROM frames")
register("p04_quality_score", "frames", lambda f: f.select("video_id", "frame_number", ex(f"R6({quality_score()})").alias("quality")), f"SELECT {KEY}, R6({quality_score()}) AS quality FROM frames")
register("p05_rejection", "frames", lambda f: score_frames(f).select("video_id", "frame_number", "reasons", "decision"), f"WITH {SCORED} SELECT {KEY}, reasons, CASE WHEN reasons = '' THEN 'candidate_quality_pass' ELSE 'rejected_quality' END AS decision FROM scored")


def stride_sample(frames: DataFrame, stride: int) -> DataFrame:
    return frames.filter(F.col("frame_number") % stride == 0)


register("p06_stride_sample", "frames", lambda f: stride_sample(f, 3).select("video_id", "frame_number", "event_id"), "SELECT video_id, frame_number, event_id FROM frames WHERE frame_number % 3 = 0")

QUALITY_REASONS = ("blurry", "too_dark", "overexposed", "fast_motion")


def passes(frames: DataFrame) -> DataFrame:
    """Whether a frame passed the quality gates, from its reasons as a list."""
    reasons = F.filter(F.split("reasons", ","), lambda x: x != "")
    return frames.select("video_id", "frame_number", (~F.arrays_overlap(reasons, F.array(*[F.lit(x) for x in QUALITY_REASONS]))).alias("quality_pass"), (~F.array_contains(reasons, "near_duplicate") & (F.size(reasons) == 0)).alias("dedupe_pass"))


register("p34_reason_passes", "frames", lambda f: passes(score_frames(f)), f"WITH {SCORED} SELECT {KEY}, reasons = '' AS quality_pass, reasons = '' AS dedupe_pass FROM scored")
MINIMUM = "least(3, CASE WHEN {d} < 8.0 THEN 1 WHEN {d} < 20.0 THEN 2 ELSE 3 END)"
register(
    "p35_duration_minimum", "frames",
    lambda f: f.groupBy("video_id").agg(F.max("t").alias("duration")).select("video_id", r6(F.col("duration")).alias("duration"), ex(MINIMUM.format(d="duration")).alias("minimum")),
    f"SELECT video_id, R6(max(t)) AS duration, {MINIMUM.format(d='max(t)')} AS minimum FROM frames GROUP BY video_id",
)


def frame_reduction(scored: DataFrame) -> DataFrame:
    """How each video's frames fall through the gates."""
    has = lambda x: F.count_if(F.array_contains(F.split("reasons", ","), x))
    return scored.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("sampled"), has("blurry").alias("rejected_blur"), (has("too_dark") + has("overexposed")).alias("rejected_exposure"),
        has("fast_motion").alias("rejected_motion"), F.count_if(F.col("reasons") == "").alias("passed"),
        r6((1 - F.count_if(F.col("reasons") == "") / F.count(F.lit(1))) * 100).alias("reduction_pct"),
    )


register(
    "a03_frame_reduction", "frames", lambda f: frame_reduction(score_frames(f)),
    f"""WITH {SCORED} SELECT video_id, count(*) AS sampled, count(*) FILTER (WHERE blur = 'blurry') AS rejected_blur,
  count(*) FILTER (WHERE exposure <> 'usable') AS rejected_exposure, count(*) FILTER (WHERE motion = 'fast') AS rejected_motion,
  count(*) FILTER (WHERE reasons = '') AS passed, R6((1 - count(*) FILTER (WHERE reasons = '') / CAST(count(*) AS DOUBLE)) * 100) AS reduction_pct
FROM scored GROUP BY video_id""",
)
register(
    "a26_rejection_counters", "frames", lambda f: score_frames(f).select(F.explode(F.filter(F.split("reasons", ","), lambda x: x != "")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("frames")),
    f"WITH {SCORED} SELECT reason, count(*) AS frames FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM scored) WHERE reason <> '' GROUP BY reason",
)


MEDIAN3 = """SELECT video_id, frame_number, R6(median(motion_pct) OVER w) AS motion_median, count(motion_pct) OVER w AS known
FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY frame_number ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""


def rolling_values(frames: DataFrame, rows: int = 3) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("frame_number").rowsBetween(-(rows - 1), 0)
    return frames.select("video_id", "frame_number", F.array_join(F.transform(F.collect_list("motion_pct").over(w), lambda x: F.floor(x * 100 + 0.5).cast("long").cast("string")), ",").alias("window"))


def median_of_three(frames: DataFrame) -> DataFrame:
    """The median of the window's values from the sorted list (Spark has no median over moving frames)."""
    w = Window.partitionBy("video_id").orderBy("frame_number").rowsBetween(-2, 0)
    values = frames.withColumn("v", F.sort_array(F.collect_list("motion_pct").over(w)))
    n = F.size("v")
    middle = F.when(n == 0, None).otherwise((F.element_at("v", F.greatest(F.lit(1), ((n + 1) / 2).cast("int"))) + F.element_at("v", F.greatest(F.lit(1), (n / 2).cast("int") + 1 - F.when(n == 0, 1).otherwise(0)))) / 2)
    return values.select("video_id", "frame_number", r6(middle).alias("motion_median"), n.cast("long").alias("known"))


register("a05_motion_median", "frames", median_of_three, MEDIAN3)
register(
    "w02_rolling_motion", "frames", rolling_values,
    """SELECT video_id, frame_number, coalesce(string_agg(CAST(CAST(floor(motion_pct * 100 + 0.5) AS BIGINT) AS VARCHAR), ',' ORDER BY frame_number) OVER w, '') AS "window"
FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY frame_number ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
register(
    "t09_nearest_two_seconds", "frames",
    lambda f: score_frames(f).withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy(F.abs(F.col("t") - 2.0), F.col("quality").desc(), "t", "frame_number"))).filter("n = 1").select("video_id", "frame_number"),
    f"WITH {SCORED} SELECT video_id, frame_number FROM scored QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY abs(t - 2.0), quality DESC, t, frame_number) = 1",
)
register(
    "w06_largest_gap", "frames",
    lambda f: f.withColumn("next_t", F.lead("t").over(Window.partitionBy("video_id").orderBy("frame_number"))).filter("next_t is not null").groupBy("video_id").agg(F.min_by(F.struct("t", "next_t"), F.struct(-(F.col("next_t") - F.col("t")), "frame_number")).alias("g")).select("video_id", r6((F.col("g.t") + F.col("g.next_t")) / 2).alias("midpoint")),
    """WITH g AS (SELECT video_id, frame_number, t, lead(t) OVER (PARTITION BY video_id ORDER BY frame_number) AS next_t FROM frames)
SELECT video_id, R6((t + next_t) / 2) AS midpoint FROM g WHERE next_t IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY next_t - t DESC, frame_number) = 1""",
)
register(
    "f18_null_safe_ratio", "frames",
    lambda f: f.groupBy("video_id").agg(F.count_if(F.col("motion_pct") > 30).alias("fast"), F.count_if(F.col("sharpness") > 140).alias("crisp")).select("video_id", r6(ex("try_divide(fast, crisp)")).alias("ratio")),
    "SELECT video_id, R6(count(*) FILTER (WHERE motion_pct > 30) / nullif(CAST(count(*) FILTER (WHERE sharpness > 140) AS DOUBLE), 0)) AS ratio FROM frames GROUP BY video_id",
)
register(
    "j17_window_expansion", "findings",
    lambda f: f.filter("confidence between 0.5 and 0.85").join(f.groupBy("video_id").agg(F.max("ts_s").alias("duration")), "video_id").select("finding_id", "video_id", "ts_s", "duration", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("n")).withColumn("at", F.col("ts_s") - 2.0 + F.col("n") * 0.5).filter("at >= 0 and at <= duration").select("finding_id", "n", r6(F.col("at")).alias("at")),
    """WITH d AS (SELECT video_id, max(ts_s) AS duration FROM findings GROUP BY video_id), e AS (
  SELECT finding_id, CAST(n AS INTEGER) AS n, ts_s - 2.0 + n * 0.5 AS at_s, duration FROM findings JOIN d USING (video_id), range(0, 9) r(n) WHERE confidence BETWEEN 0.5 AND 0.85)
SELECT finding_id, n, R6(at_s) AS at FROM e WHERE at_s >= 0 AND at_s <= duration""",
)
