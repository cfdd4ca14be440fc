"""Scene segmentation of ordered frames, and what follows from scenes: roll-ups, coverage, fallbacks, caps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.dialect import ex, r6
from ..plans.registry import register
from ..sources.scratch import stored
from .frames import SCORED, score_frames


@dataclass(frozen=True)
class SceneLimits:
    histogram: float = 0.75
    combined: float = 0.55
    least_s: float = 4.0
    most_s: float = 30.0
    moving: float = 12.0
    feature: float = 0.22


def similarity(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Correlation of two signatures, clamped to 0..1; without one of them nothing differs."""
    if a is None or b is None:
        return 1.0
    x, y = a - a.mean(), b - b.mean()
    d = np.sqrt((x @ x) * (y @ y))
    return 1.0 if d == 0 else float(min(1.0, max(0.0, x @ y / d)))


def boundary(prior: float, reference: float, elapsed: float, motion: float | None, c: SceneLimits, features: tuple[float | None, float | None] = (None, None)) -> tuple[bool, str]:
    """Whether a frame begins a scene, and why, from its similarity to the frame before and to the scene's reference: of colours,
    and of ``features`` where both images have some."""
    fused = [h if f is None else 0.65 * h + 0.35 * f for h, f in zip((prior, reference), features, strict=True)]
    still = 1.0 if motion is None or motion != motion else max(0.0, 1.0 - motion / (2 * c.moving))
    combined = 0.9 * (0.6 * fused[0] + 0.4 * fused[1]) + 0.1 * still
    if 0 < c.most_s <= elapsed:
        return True, "maximum_scene_duration"
    if elapsed < c.least_s:
        return False, "suppressed_by_minimum_scene_duration" if combined < c.combined else "similar_scene"
    if features[0] is not None and features[0] < c.feature and prior < c.histogram and combined < c.combined:
        return True, "hsv_and_feature_drop"
    if features[0] is None and max(prior, reference) < 0.8 * c.histogram and combined < c.combined:
        return True, "hsv_drop_features_unavailable"
    if fused[1] < 0.9 * c.combined and fused[0] < 1.05 * c.combined:
        return True, "scene_reference_divergence"
    if fused[1] < 0.9 * c.combined and fused[0] >= max(1.25 * c.combined, 0.65):
        return True, "stable_view_differs_from_scene_reference"
    if motion is not None and motion >= c.moving and combined < c.combined:
        return True, "visual_drop_with_camera_motion"
    return False, "similar_scene"


@dataclass
class SceneState:
    """What the segmentation of one video remembers: two signatures with their features, the scene's number and start."""

    scene: int = 0
    start: float | None = None
    prior: np.ndarray | None = None
    reference: np.ndarray | None = None
    prior_features: np.ndarray | None = None
    reference_features: np.ndarray | None = None

    def step(self, t: float, signature: np.ndarray | None, rejected: bool, motion: float | None, c: SceneLimits, features: np.ndarray | None = None, value: Callable | None = None, like: Callable = similarity) -> tuple[int, str]:
        """``value`` tells the similarity of two images' features, ``like`` that of their signatures."""
        if self.start is None:
            self.start = t
        both = (value(self.prior_features, features), value(self.reference_features, features)) if value else (None, None)
        change, reason = boundary(like(self.prior, signature), like(self.reference, signature), t - self.start, motion, c, both)
        if change and rejected and reason != "maximum_scene_duration":
            change, reason = False, "deferred_until_quality_frame"
        if change:
            self.scene, self.start = self.scene + 1, t
            self.reference, self.reference_features = (None, None) if rejected else (signature, features)
        elif self.reference is None and not rejected:
            self.reference, self.reference_features = signature, features
        self.prior, self.prior_features = signature, features
        return self.scene, reason if change else ""


class Remembered:
    """A similarity of two arrays that is looked up where the same two were compared before. Arrays of equal bytes are one
    (:meth:`one`); it forgets all when it has seen ``arrays`` of them or ``pairs``."""

    def __init__(self, similarity: Callable, arrays: int = 4096, pairs: int = 16384):
        self.similarity, self.arrays, self.pairs = similarity, arrays, pairs
        self.seen: dict[bytes, np.ndarray] = {}
        self.told: dict[tuple[int, int], tuple] = {}  # holds the arrays, so that their ids stay theirs

    def one(self, a: np.ndarray | None) -> np.ndarray | None:
        if a is None:
            return None
        own = a.tobytes()
        if (known := self.seen.get(own)) is None:
            if len(self.seen) >= self.arrays:
                self.seen.clear()
            known = self.seen[own] = a.copy()  # not a view that keeps its batch
        return known

    def __call__(self, a: np.ndarray | None, b: np.ndarray | None) -> float | None:
        if a is None or b is None:
            return self.similarity(a, b)
        if (known := self.told.get((id(a), id(b)))) is None:
            if len(self.told) >= self.pairs:
                self.told.clear()
            known = self.told[id(a), id(b)] = (a, b, self.similarity(a, b))
        return known[2]


def arrays(column: pa.Array) -> list[np.ndarray | None]:
    """The lists of an array column as slices of one array."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(float), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
    here = column.is_valid().to_pylist()
    return [flat[s:e] if ok else None for ok, s, e in zip(here, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def segmented(frames: DataFrame, c: SceneLimits = SceneLimits(), features: Callable | None = None, told: list[str] | None = None) -> DataFrame:
    """scene_index and boundary (the reason, where a scene begins) beside the columns of ``frames`` (video_id, frame_number,
    t, reasons, motion_pct, signature, and an array of features if ``features`` tells the similarity of two of them). Each video's frames pass through one task in order; the state is constant in size,
    so a video of any length can be segmented, and the columns pass along (those ``told``, or all), so nothing has to be joined
    again. Similarities of images are remembered, so that those which were compared before aren't again."""
    kept = told or frames.columns
    names = [*kept, "scene_index", "boundary"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, state = None, SceneState()
        like, value = Remembered(similarity), Remembered(features) if features else None
        for batch in batches:
            videos, times, reasons, motions = (batch.column(k).to_pylist() for k in ("video_id", "t", "reasons", "motion_pct"))
            scenes, why = [], []
            local = arrays(batch.column("features")) if features else [None] * batch.num_rows
            for v, t, r, motion, signature, own in zip(videos, times, reasons, motions, arrays(batch.column("signature")), local, strict=True):
                if v != video:
                    video, state = v, SceneState()
                scene, reason = state.step(t, like.one(signature), bool(r), motion, c, value.one(own) if value else None, value, like)
                scenes.append(scene)
                why.append(reason)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(scenes, pa.int32()), pa.array(why, pa.string())], names=names)

    schema = StructType([*(frames.schema[k] for k in kept), StructField("scene_index", IntegerType()), StructField("boundary", StringType())])
    return frames.repartition("video_id").sortWithinPartitions("video_id", "t", "frame_number").mapInArrow(run, schema)


def segment(frames: DataFrame, c: SceneLimits = SceneLimits()) -> DataFrame:
    """video_id, frame_number, scene_index, boundary of each frame of ``frames``: see :func:`segmented`."""
    wanted = frames.select("video_id", "frame_number", "t", "reasons", "motion_pct", "signature")
    return segmented(wanted, c, told=["video_id", "frame_number"])


def unsigned(frames: DataFrame) -> DataFrame:
    """Scored frames without signatures: only the longest duration ends a scene."""
    return score_frames(frames).withColumn("signature", F.lit(None).cast("array<float>"))


def with_scenes(frames: DataFrame) -> DataFrame:
    """Scored frames with their scenes, by duration alone."""
    return segmented(unsigned(frames)).drop("signature", "boundary")


def signatures_of(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("signature_id"), F.col("embedding").alias("signature"))


def signed(frames: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Scored frames with their signatures; a frame that has none stays, without one."""
    return score_frames(frames).join(signatures_of(embeddings), "signature_id", "left")


_SCENES = f"""{SCORED}, walk AS (
  SELECT video_id, frame_number, t, t AS start_s, 0 AS scene_index FROM scored WHERE frame_number = 0
  UNION ALL SELECT f.video_id, f.frame_number, f.t, CASE WHEN f.t - w.start_s >= 30.0 THEN f.t ELSE w.start_s END, CASE WHEN f.t - w.start_s >= 30.0 THEN w.scene_index + 1 ELSE w.scene_index END
  FROM walk w JOIN scored f ON f.video_id = w.video_id AND f.frame_number = w.frame_number + 1),
scened AS (SELECT s.*, CAST(w.scene_index AS INTEGER) AS scene_index FROM scored s JOIN walk w USING (video_id, frame_number))"""
register("q01_scene_segmentation", "frames", lambda f: segment(unsigned(f)).select("video_id", "frame_number", "scene_index"), f"WITH RECURSIVE {_SCENES} SELECT video_id, frame_number, scene_index FROM scened")


def scene_table(scened: DataFrame, least_s: float = 4.0) -> DataFrame:
    """Scenes with their frames; a short last scene is merged into the one before it."""
    ends = scened.groupBy("video_id", "scene_index").agg(F.min("t").alias("start_s"), F.max("t").alias("end_s"))
    last = Window.partitionBy("video_id").orderBy(F.col("scene_index").desc())
    short = ends.withColumn("n", F.row_number().over(last)).withColumn("into", F.when((F.col("n") == 1) & (F.col("end_s") - F.col("start_s") < least_s), F.lead("scene_index").over(last)))
    return short.withColumn("merged_index", F.coalesce("into", "scene_index"))


def relabel(scened: DataFrame) -> DataFrame:
    """Frames with the scene they belong to after the short tail is merged."""
    table = scene_table(scened).filter("into is not null").select(F.col("video_id").alias("of"), F.col("scene_index").alias("was"), "into")
    joined = scened.join(table, (F.col("video_id") == F.col("of")) & (F.col("scene_index") == F.col("was")), "left")
    return joined.select("video_id", "frame_number", F.coalesce("into", "scene_index").alias("scene_index"))


_ENDS = """ends AS (SELECT video_id, scene_index, min(t) AS start_s, max(t) AS end_s FROM scened GROUP BY ALL),
tail AS (SELECT *, row_number() OVER w AS n, lead(scene_index) OVER w AS before FROM ends WINDOW w AS (PARTITION BY video_id ORDER BY scene_index DESC)),
merged AS (SELECT video_id, scene_index, coalesce(CASE WHEN n = 1 AND end_s - start_s < 4.0 THEN before END, scene_index) AS merged_index FROM tail)"""
register("w14_short_tail_merge", "frames", lambda f: relabel(with_scenes(f)), f"WITH RECURSIVE {_SCENES}, {_ENDS} SELECT video_id, frame_number, merged_index AS scene_index FROM scened JOIN merged USING (video_id, scene_index)")


def scene_rollup(scened: DataFrame) -> DataFrame:
    """Per scene its frames, those that pass, and whether it is covered by one or needs a fallback."""
    return scened.groupBy("video_id", "scene_index").agg(F.count(F.lit(1)).alias("sampled"), F.count_if(F.col("reasons") == "").alias("passed"), r6(F.min("t")).alias("start_s"), r6(F.max("t") - F.min("t")).alias("duration_s")).withColumn("coverage", F.when(F.col("passed") > 0, "strict").otherwise("best_available_fallback"))


register(
    "a04_scene_rollup", "frames", lambda f: scene_rollup(with_scenes(f)),
    f"""WITH RECURSIVE {_SCENES} SELECT video_id, scene_index, count(*) AS sampled, count(*) FILTER (WHERE reasons = '') AS passed, R6(min(t)) AS start_s, R6(max(t) - min(t)) AS duration_s,
  CASE WHEN count(*) FILTER (WHERE reasons = '') > 0 THEN 'strict' ELSE 'best_available_fallback' END AS coverage FROM scened GROUP BY ALL""",
)
_PASSED = "WHERE reasons = ''"
register(
    "w03_keyframe_ordinal", "frames",
    lambda f: with_scenes(f).filter("reasons = ''").withColumn("n", F.row_number().over(Window.partitionBy("video_id", "scene_index").orderBy("t", "frame_number"))).select("video_id", "frame_number", F.format_string("scene-%03d-frame-%02d.jpg", F.col("scene_index") + 1, F.col("n")).alias("name")),
    f"WITH RECURSIVE {_SCENES} SELECT video_id, frame_number, printf('scene-%03d-frame-%02d.jpg', scene_index + 1, row_number() OVER (PARTITION BY video_id, scene_index ORDER BY t, frame_number)) AS name FROM scened {_PASSED}",
)
register(
    "w04_coverage_representative", "frames",
    lambda f: with_scenes(f).filter("reasons = ''").withColumn("n", F.row_number().over(Window.partitionBy("video_id", "scene_index").orderBy(F.col("quality").desc(), "frame_number"))).filter("n = 1").select("video_id", "scene_index", "frame_number"),
    f"WITH RECURSIVE {_SCENES} SELECT video_id, scene_index, frame_number FROM scened {_PASSED} QUALIFY row_number() OVER (PARTITION BY video_id, scene_index ORDER BY quality DESC, frame_number) = 1",
)
_RANKED = "CASE WHEN exposure <> 'usable' THEN 1 ELSE 0 END, length(reasons) - length(replace(reasons, ',', '')), quality DESC, sharpness DESC, coalesce(motion_pct, 1000.0), frame_number"


def fallbacks(scened: DataFrame) -> DataFrame:
    """For scenes in which no frame passed, the best there is: by exposure, number of reasons, quality, sharpness, motion."""
    covered = scened.filter("reasons = ''").select("video_id", "scene_index").distinct()
    order = [F.when(F.col("exposure") != "usable", 1).otherwise(0), F.size(F.split("reasons", ",")), F.col("quality").desc(), F.col("sharpness").desc(), F.coalesce("motion_pct", F.lit(1000.0)), "frame_number"]
    rest = scened.join(covered, ["video_id", "scene_index"], "left_anti")
    return rest.withColumn("n", F.row_number().over(Window.partitionBy("video_id", "scene_index").orderBy(*order))).filter("n = 1").select("video_id", "scene_index", "frame_number")


register(
    "w05_scene_fallback", "frames", lambda f: fallbacks(with_scenes(f)),
    f"""WITH RECURSIVE {_SCENES}, c AS (SELECT DISTINCT video_id, scene_index FROM scened WHERE reasons = '')
SELECT video_id, scene_index, frame_number FROM scened ANTI JOIN c USING (video_id, scene_index) QUALIFY row_number() OVER (PARTITION BY video_id, scene_index ORDER BY {_RANKED}) = 1""",
)


def capped(scened: DataFrame, most: int = 12) -> DataFrame:
    """At most ``most`` frames of a video: the best of each scene first, then by quality."""
    best = F.row_number().over(Window.partitionBy("video_id", "scene_index").orderBy(F.col("quality").desc(), "frame_number")) == 1
    ranked = scened.filter("reasons = ''").withColumn("required", best)
    return ranked.withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy(F.col("required").desc(), F.col("quality").desc(), "frame_number"))).filter(F.col("n") <= most).select("video_id", "frame_number", "required")


register(
    "t01_global_cap", "frames", lambda f: capped(with_scenes(f)),
    f"""WITH RECURSIVE {_SCENES}, q AS (SELECT *, row_number() OVER (PARTITION BY video_id, scene_index ORDER BY quality DESC, frame_number) = 1 AS required FROM scened {_PASSED})
SELECT video_id, frame_number, required FROM q QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY required DESC, quality DESC, frame_number) <= 12""",
)
_CHANGE = "CASE WHEN elapsed >= 30.0 THEN 'maximum_scene_duration' WHEN elapsed < 4.0 THEN 'too_early' WHEN motion_pct >= 12.0 THEN 'moving' ELSE 'similar_scene' END"
register(
    "f07_change_reason", "frames", lambda f: f.withColumn("elapsed", F.col("t") - F.lag("t", 3).over(Window.partitionBy("video_id").orderBy("frame_number"))).filter("elapsed is not null").select("video_id", "frame_number", ex(_CHANGE).alias("reason")),
    f"WITH e AS (SELECT *, t - lag(t, 3) OVER (PARTITION BY video_id ORDER BY frame_number) AS elapsed FROM frames) SELECT video_id, frame_number, {_CHANGE} AS reason FROM e WHERE elapsed IS NOT NULL",
)


def centred(x: Column) -> Column:
    """An array less its mean, which is told once."""
    total = F.aggregate(F.transform(x, lambda w: w.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.element_at(F.transform(F.array(F.try_divide(total, F.size(x))), lambda mean: F.transform(x, lambda v: v.cast("double") - mean)), 1)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)


def correlations(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """a, b, like: of each of ``pairs`` (a, b: ids) whose images both have ``signatures`` (signature_id, signature) their
    correlation, clamped to 0..1; 1 without variation. Each signature is centred once."""
    own = signatures.filter("signature is not null").select("signature_id", centred(F.col("signature")).alias("c")).withColumn("square", dot(F.col("c"), F.col("c")))
    side = lambda k: own.select(F.col("signature_id").alias(k), F.col("c").alias(f"{k}_c"), F.col("square").alias(f"{k}_square"))
    spread = F.sqrt(F.col("a_square") * F.col("b_square"))
    told = F.when(spread == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(F.col("a_c"), F.col("b_c")) / spread)))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", r6(told).alias("like"))


_STILL = "(CASE WHEN motion_pct IS NULL THEN 1.0 ELSE greatest(0.0, 1.0 - motion_pct / 24.0) END)"
COMBINED = f"(0.9 * (0.6 * prior + 0.4 * reference) + 0.1 * {_STILL})"
CHANGE = f"""CASE WHEN elapsed >= 30.0 THEN 'maximum_scene_duration' WHEN elapsed < 4.0 AND {COMBINED} < 0.55 THEN 'suppressed_by_minimum_scene_duration' WHEN elapsed < 4.0 THEN 'similar_scene'
  WHEN greatest(prior, reference) < 0.6 AND {COMBINED} < 0.55 THEN 'hsv_drop_features_unavailable' WHEN reference < 0.495 AND prior < 0.5775 THEN 'scene_reference_divergence'
  WHEN reference < 0.495 AND prior >= 0.6875 THEN 'stable_view_differs_from_scene_reference' WHEN motion_pct >= 12.0 AND {COMBINED} < 0.55 THEN 'visual_drop_with_camera_motion' ELSE 'similar_scene' END"""


def change_scores(frames: DataFrame, signatures: DataFrame) -> DataFrame:
    """The fused similarity and the reason for each frame against the one before it and the video's first, as if the scene
    had begun three frames ago. ``frames``: video_id, frame_number, t, motion_pct, signature_id; ``signatures``: signature_id,
    signature. Frames carry ids, and images meet by one join of the different pairs of ids."""
    w = Window.partitionBy("video_id").orderBy("frame_number")
    ids = [F.lag("signature_id").over(w).alias("before"), F.first("signature_id").over(w).alias("opening")]
    seen = stored(frames.select("video_id", "frame_number", "motion_pct", "signature_id", *ids, (F.col("t") - F.lag("t", 3).over(w)).alias("elapsed")).filter("elapsed is not null"), "changes")
    pairs = seen.select(F.explode(F.array(*[F.struct(F.col(k).alias("a"), F.col("signature_id").alias("b")) for k in ("before", "opening")])).alias("p")).select("p.a", "p.b").distinct()
    like, both = stored(correlations(pairs, signatures), "likenesses"), seen
    for k, name in (("before", "prior"), ("opening", "reference")):
        both = both.join(like.select(F.col("a").alias(k), F.col("b").alias("signature_id"), F.col("like").alias(name)), [k, "signature_id"], "left")
    return both.withColumns({name: F.coalesce(name, F.lit(1.0)) for name in ("prior", "reference")}).withColumns({"combined": ex(COMBINED), "reason": ex(CHANGE)})


_CENTRED = "[CAST(v AS DOUBLE) - list_sum([CAST(w AS DOUBLE) for w in {x}]) / len({x}) for v in {x}]"
_CORR = "CASE WHEN {a} IS NULL OR {b} IS NULL THEN 1.0 WHEN sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b})) = 0 THEN 1.0 ELSE least(1.0, greatest(0.0, list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b})))) END"
register(
    "f07_change_score", "frames embeddings", lambda f, e: change_scores(f, signatures_of(e)).select("video_id", "frame_number", "prior", "reference", r6(F.col("combined")).alias("combined"), "reason"),
    f"""WITH s AS (SELECT video_id, frame_number, t, motion_pct, {_CENTRED.format(x="embedding")} AS c FROM frames LEFT JOIN embeddings ON vec_id = signature_id),
w AS (SELECT *, lag(c) OVER v AS b, first_value(c) OVER v AS o, t - lag(t, 3) OVER v AS elapsed FROM s WINDOW v AS (PARTITION BY video_id ORDER BY frame_number)),
k AS (SELECT video_id, frame_number, motion_pct, elapsed, R6({_CORR.format(a="b", b="c")}) AS prior, R6({_CORR.format(a="o", b="c")}) AS reference FROM w WHERE elapsed IS NOT NULL)
SELECT video_id, frame_number, prior, reference, R6({COMBINED}) AS combined, {CHANGE} AS reason FROM k""",
)
_SEEN = f"""s AS (SELECT video_id, frame_number, t, motion_pct, reasons <> '' AS bad, {_CENTRED.format(x="embedding")} AS c FROM scored LEFT JOIN embeddings ON vec_id = signature_id),
walk AS (SELECT video_id, frame_number, t AS start_s, 0 AS scene, c AS pc, CASE WHEN NOT bad THEN c END AS rc, '' AS boundary FROM s WHERE frame_number = 0
  UNION ALL SELECT video_id, frame_number, CASE WHEN begins THEN t ELSE start_s END, scene + CASE WHEN begins THEN 1 ELSE 0 END, c,
    CASE WHEN begins AND bad THEN NULL WHEN begins OR (rc IS NULL AND NOT bad) THEN c ELSE rc END, CASE WHEN begins THEN reason ELSE '' END
  FROM (SELECT *, reason NOT IN ('similar_scene', 'suppressed_by_minimum_scene_duration') AND (NOT bad OR reason = 'maximum_scene_duration') AS begins FROM (SELECT *, {CHANGE} AS reason
    FROM (SELECT s.*, w.start_s, w.scene, w.rc, s.t - w.start_s AS elapsed, {_CORR.format(a="w.pc", b="s.c")} AS prior, {_CORR.format(a="w.rc", b="s.c")} AS reference FROM walk w JOIN s ON s.video_id = w.video_id AND s.frame_number = w.frame_number + 1))))"""
register("q01_visual_segmentation", "frames embeddings", lambda f, e: segment(signed(f, e)), f"WITH RECURSIVE {SCORED}, {_SEEN} SELECT video_id, frame_number, CAST(scene AS INTEGER) AS scene_index, boundary FROM walk")
