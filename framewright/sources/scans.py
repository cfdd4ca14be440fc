"""Registered scans and sinks: evidence files are written from the given tables in the layout that the readers expect, and
read back; the checks ask the tables themselves."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frames import LIMITS, score_frames
from ..operators.scenes import scene_rollup, with_scenes
from ..plans.registry import register
from ..streaming.jobs import drained
from . import readers, sinks
from .scratch import scratch

#: Frames of a manifest's part: no document grows with its video.
PART_FRAMES = 1000


def manifest_files(frames: DataFrame) -> str:
    """Manifests as JSON lines: a video's frames are dealt out in parts of ``PART_FRAMES``, each a document with the video's
    entry; its scenes are in the first one. Files are as many as tasks, whatever the number of videos."""
    scened = with_scenes(frames).withColumn("part", F.floor(F.col("frame_number") / PART_FRAMES))
    name = F.concat(F.lit("v"), F.col("video_id").cast("string"), F.lit(".mp4"))
    listed = scened.groupBy("video_id", "part").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "frame_number", F.col("t").alias("timestamp_seconds"), F.col("quality").alias("evidence_quality_score"), F.when(F.col("reasons") == "", "pass").otherwise("reject").alias("decision"),
                    F.filter(F.split("reasons", ","), lambda r: r != "").alias("rejection_reasons"), "scene_index", F.struct(F.col("sharpness").alias("variance_of_laplacian")).alias("blur"), F.struct(F.col("motion_pct").alias("percent_per_second")).alias("motion"),
                )
            )
        ).alias("frame_assessments"),
    )
    lengths = scened.groupBy("video_id").agg(F.max("t").alias("length"), F.count(F.lit(1)).alias("total"))
    scenes = scene_rollup(scened).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("scene_index", F.col("start_s").alias("start_seconds"), F.col("duration_s").alias("duration_seconds")))).alias("scenes"), F.lit(0).cast("long").alias("part"))
    video = F.struct(name.alias("filename"), F.col("total").alias("total_frames"), F.col("length").alias("duration_seconds"))
    path = scratch(frames.sparkSession, "manifests")
    listed.join(scenes, ["video_id", "part"], "left").join(lengths, "video_id").select(video.alias("video"), "scenes", "frame_assessments").write.json(path)
    return path


def manifest_frames(frames: DataFrame) -> DataFrame:
    """The frames of the manifests, each with what its video's entry and its scene's say."""
    found = readers.manifests(frames.sparkSession, manifest_files(frames), lines=True)
    scenes = found["scenes"].select("video_id", "scene_index", F.col("start_seconds").alias("scene_start"))
    videos = found["videos"].select("video_id", "total_frames")
    return (
        found["frames"].join(videos, "video_id").join(scenes, ["video_id", "scene_index"])
        .select("video_id", "total_frames", "frame_number", F.col("timestamp_seconds").alias("t"), "decision", F.array_join("rejection_reasons", ",").alias("reasons"), "scene_index", "scene_start", F.col("blur.variance_of_laplacian").alias("sharpness"), F.col("motion.percent_per_second").alias("motion_pct"))
    )


from ..operators.scenes import _SCENES  # noqa: E402

register(
    "s01_manifest_scan", "frames", manifest_frames,
    f"""WITH RECURSIVE {_SCENES} SELECT 'v' || video_id || '.mp4' AS video_id, count(*) OVER (PARTITION BY video_id) AS total_frames, frame_number, t, CASE WHEN reasons = '' THEN 'pass' ELSE 'reject' END AS decision, reasons, scene_index,
  R6(min(t) OVER (PARTITION BY video_id, scene_index)) AS scene_start, sharpness, motion_pct FROM scened""",
)


def split_rows(verdicts: DataFrame) -> DataFrame:
    """A list of clips as CSV, scanned with its checks."""
    path = scratch(verdicts.sparkSession, "split")
    listed = verdicts.select(F.col("clip_id").cast("string").alias("video"), F.lit("development").alias("split"), "source_group", F.col("positive").cast("int").cast("string").alias("ground_truth_positive"))
    listed.write.csv(path, header=True)
    return readers.split_list(verdicts.sparkSession, path).select("video", "split", "source_group", "positive")


register("s02_split_scan", "clip_verdicts", split_rows, "SELECT CAST(clip_id AS VARCHAR) AS video, 'development' AS split, source_group, positive FROM clip_verdicts")


def annotation_rows(intervals: DataFrame) -> DataFrame:
    """Annotation documents as JSON lines, one a video; an interval that says nothing of ``should_detect`` has to be found."""
    path = scratch(intervals.sparkSession, "annotations")
    issue = F.struct("category", F.col("interval_id").cast("string").alias("description"), F.col("start_s").alias("timestamp_start"), F.col("end_s").alias("timestamp_end"), "should_detect")
    intervals.groupBy(F.col("video_id").cast("string").alias("video")).agg(F.collect_list(issue).alias("issues")).write.json(path)
    return readers.annotations(intervals.sparkSession, path, lines=True)


register(
    "s03_annotation_scan", "annotated", annotation_rows,
    "SELECT CAST(video_id AS VARCHAR) AS video, category, CAST(interval_id AS VARCHAR) AS description, start_s, end_s FROM annotated WHERE coalesce(should_detect, true)",
)


def report_rows(findings: DataFrame) -> DataFrame:
    """Detector reports as JSON lines, scanned as one report for each clip."""
    path = scratch(findings.sparkSession, "reports")
    issue = F.struct("category", "description", F.col("ts_s").alias("timestamp"), "confidence")
    findings.groupBy(F.col("video_id").cast("string").alias("clip")).agg(F.collect_list(issue).alias("issues")).write.json(path)
    return readers.reports(findings.sparkSession, path, lines=True).select("clip", F.explode("issues").alias("i")).select("clip", "i.category", F.col("i.timestamp").alias("ts_s"), "i.confidence")


register("s04_report_scan", "findings", report_rows, "SELECT CAST(video_id AS VARCHAR) AS clip, category, ts_s, confidence FROM findings")


def run_rows(runs: DataFrame) -> DataFrame:
    """Benchmark runs through the CSV sink."""
    path = scratch(runs.sparkSession, "runs")
    sinks.write_runs(runs, path)
    types = "execution_order long, phase string, environment string, run_index long, success boolean, wall_clock_seconds double, error string"
    return runs.sparkSession.read.csv(path, header=True, schema=types)


register("s06_run_list", "runs", run_rows, "SELECT CAST(NULL AS BIGINT) AS execution_order, phase, environment, CAST(NULL AS BIGINT) AS run_index, success, wall_clock_seconds, CAST(NULL AS VARCHAR) AS error FROM runs")


def diagnosis_rows(findings: DataFrame) -> DataFrame:
    """Nested traces through the flattening sink: its CSV beside the nested JSON, which must say the same."""
    spark, path = findings.sparkSession, scratch(findings.sparkSession, "diagnosis")
    traces = findings.groupBy("video_id").agg(F.count(F.lit(1)).alias("all"), F.min("finding_id").alias("first"), F.max("category").alias("last")).select("video_id", F.struct(F.col("all").alias("n"), "first").alias("found"), F.struct("last").alias("category"))
    sinks.write_diagnosis(traces, path)
    nested = spark.read.schema(traces.schema).json(f"{path}/json").select(F.col("video_id").cast("string").alias("id"), F.col("found.n").alias("n"))
    flat = spark.read.csv(f"{path}/csv", header=True)
    return flat.join(nested, flat["video_id"] == nested["id"]).select("video_id", "found_n", "found_first", "category_last", (F.col("found_n").cast("long") == F.col("n")).alias("same"))


register(
    "s07_diagnosis", "findings", diagnosis_rows,
    "SELECT CAST(video_id AS VARCHAR) AS video_id, CAST(count(*) AS VARCHAR) AS found_n, CAST(min(finding_id) AS VARCHAR) AS found_first, max(category) AS category_last, true AS same FROM findings GROUP BY video_id",
)


def log_counts(events: DataFrame) -> DataFrame:
    """Structured log lines as a stream, drained: how often each job said what, and in which attempts."""
    path = scratch(events.sparkSession, "log")
    lines = events.select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("status").alias("event"), F.col("job_id").cast("string").alias("job_id"), F.create_map(F.lit("attempt"), F.col("attempt").cast("string")).alias("details"))
    lines.write.json(path)
    told = drained(readers.log_stream(events.sparkSession, path).select("event", "job_id", F.col("details")["attempt"].alias("attempt")), "log-lines")
    return told.groupBy("job_id", "event").agg(F.count(F.lit(1)).alias("lines"), F.max("attempt").alias("attempt"))


register("s11_log_stream", "job_events", log_counts, "SELECT CAST(job_id AS VARCHAR) AS job_id, status AS event, count(*) AS lines, max(CAST(attempt AS VARCHAR)) AS attempt FROM job_events GROUP BY ALL")


def image_rows(frame_px: DataFrame) -> DataFrame:
    """Frames as image files, scanned and decoded."""
    path = scratch(frame_px.sparkSession, "images")
    sinks.write_images(frame_px, path)
    found = readers.frame_images(frame_px.sparkSession, path, names="*.txt")
    return found.select(F.col("video_id").cast("long").alias("video_id"), "frame_number", "width", "height", F.array_join("px", ",").alias("px"), "error")


register(
    "s05_image_scan", "frame_px", image_rows,
    "SELECT CAST(video_id AS BIGINT) AS video_id, frame_number, CAST(8 AS INTEGER) AS width, CAST(ceil(len(px) / 8) AS INTEGER) AS height, array_to_string(px, ',') AS px, CAST(NULL AS VARCHAR) AS error FROM frame_px",
)


def recorded(frames: DataFrame) -> DataFrame:
    """Verdicts stored beside the limits that they were made with, read back."""
    path = scratch(frames.sparkSession, "recorded")
    sinks.with_parameters(score_frames(frames).select("video_id", "frame_number", "reasons"), LIMITS).write.parquet(path)
    return frames.sparkSession.read.parquet(path).select("video_id", "frame_number", "reasons", *[F.col(f"parameters.{k}").alias(f"limit_{k}") for k in asdict(LIMITS)])


from ..operators.frames import SCORED  # noqa: E402

register("s14_parameters", "frames", recorded, f"WITH {SCORED} SELECT video_id, frame_number, reasons, " + ", ".join(f"{v} AS limit_{k}" for k, v in asdict(LIMITS).items()) + " FROM scored")


def strict(frames: DataFrame) -> DataFrame:
    """Frames that a run with other limits rejects for motion or darkness."""
    c = sinks.overridden(LIMITS, {"motion": 12.0, "dark_mean": 80.0})
    return score_frames(frames, c).groupBy("video_id").agg(F.count_if(F.col("reasons").contains("fast_motion")).alias("fast"), F.count_if(F.col("reasons").contains("too_dark")).alias("dark"))


register(
    "y05_overrides", "frames", strict,
    "SELECT video_id, count(*) FILTER (WHERE motion_pct > 12.0) AS fast, count(*) FILTER (WHERE brightness_mean < 80.0 OR dark_pct >= 60.0) AS dark FROM frames GROUP BY video_id",
)
