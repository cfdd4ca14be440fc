"""Sinks: benchmark lists, flattened diagnoses, action logs, artifacts by kind, parameters beside results."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_COLUMNS = ("execution_order", "phase", "environment", "run_index", "success", "wall_clock_seconds", "error")


def write_runs(runs: DataFrame, path: str) -> None:
    """Benchmark runs as CSV with a header, in a fixed order of columns; missing ones are empty."""
    columns = [F.col(c) if c in runs.columns else F.lit(None).cast("string").alias(c) for c in RUN_COLUMNS]
    runs.select(*columns).write.csv(path, header=True)


def write_diagnosis(traces: DataFrame, path: str) -> None:
    """Nested traces as JSON, and flat as CSV (structs become ``outer_inner`` columns)."""
    traces.write.json(f"{path}/json")
    flat = []
    for f in traces.schema:
        inner = getattr(f.dataType, "names", None)
        flat += [F.col(f"{f.name}.{n}").cast("string").alias(f"{f.name}_{n}") for n in inner] if inner else [F.col(f.name).cast("string").alias(f.name)]
    traces.select(*flat).write.csv(f"{path}/csv", header=True)


def action_log(actions: DataFrame) -> DataFrame:
    """One JSON document per candidate with its actions in order."""
    return actions.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("sequence_no", "action", "confidence_after"))).alias("actions")).select("candidate_id", F.to_json(F.struct("candidate_id", "actions")).alias("document"))


def write_images(frames: DataFrame, path: str, width: int = 8) -> None:
    """Frames (video_id, frame_number, px: whole numbers to 255, row by row) as plain gray maps: a folder for each video, in it
    one file for each task that has some of its frames, each header naming its frame."""
    height = F.ceil(F.size("px") / width).cast("int")
    image = F.format_string("P2\n# frame %d\n%d %d\n255\n%s", "frame_number", F.lit(width), height, F.array_join(F.transform("px", lambda x: x.cast("string")), " "))
    frames.select("video_id", image.alias("value")).write.partitionBy("video_id").text(path)


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """Artifacts laid out by inspection and kind, so that readers prune to what they ask for."""
    artifacts.repartition("inspection_id", "kind").write.partitionBy("inspection_id", "kind").parquet(path)


def with_parameters(df: DataFrame, *limits) -> DataFrame:
    """The thresholds that a result was made with, as a struct beside it."""
    values = {k: v for limit in limits for k, v in asdict(limit).items()}
    return df.withColumn("parameters", F.struct(*[F.lit(v).alias(k) for k, v in values.items()]))


def overridden(limits, changes: dict):
    """``limits`` with the named values changed; unknown names are refused."""
    unknown = set(changes) - set(asdict(limits))
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    return type(limits)(**{**asdict(limits), **changes})
