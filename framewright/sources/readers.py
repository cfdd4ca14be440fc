"""Scans of evidence files: manifests, split lists, annotations, reports, images, logs."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .images import images_of

FRAME = "struct<frame_number:bigint,timestamp_seconds:double,evidence_quality_score:double,decision:string,rejection_reasons:array<string>,scene_index:int,blur:struct<variance_of_laplacian:double>,motion:struct<percent_per_second:double>>"
SCENE = "struct<scene_index:int,start_seconds:double,end_seconds:double,duration_seconds:double,start_reason:string,end_reason:string>"
KEYFRAME = "struct<filename:string,frame_number:bigint,timestamp_seconds:double,scene_index:int,score_components:map<string,double>>"
MANIFEST = f"video struct<filename:string,fps:double,width:int,height:int,total_frames:bigint,duration_seconds:double>, scenes array<{SCENE}>, keyframes array<{KEYFRAME}>, frame_assessments array<{FRAME}>"
ANNOTATION = "video string, issues array<struct<category:string,description:string,timestamp_start:double,timestamp_end:double,should_detect:boolean>>"
SPLIT = "video string, split string, source_group string, ground_truth_positive string"


def manifests(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """The tables of manifests: videos, scenes, keyframes, frames. A file is one document or, with ``lines``, one document a line,
    of which a video may have several, each with a part of its lists. Broken documents fail the scan."""
    docs = spark.read.schema(MANIFEST).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    name = F.col("video.filename").alias("video_id")
    part = lambda c: docs.select(name, F.explode(c).alias("x")).select("video_id", "x.*")
    return {"videos": docs.select(name, "video.*").dropDuplicates(["video_id"]), "scenes": part("scenes"), "keyframes": part("keyframes"), "frames": part("frame_assessments")}


def split_list(spark: SparkSession, path: str) -> DataFrame:
    """A list of videos with their labels; duplicates, unknown labels or a missing class fail, found in one pass."""
    rows = spark.read.csv(path, header=True, schema=SPLIT, encoding="UTF-8")
    found = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("video").alias("videos"), F.count_if(~F.coalesce(F.col("ground_truth_positive").isin("0", "1"), F.lit(False))).alias("unknown"),
        F.count_if(F.col("ground_truth_positive") == "1").alias("positive"),
    ).first()
    if found.videos != found.rows or found.unknown or not 0 < found.positive < found.rows:
        raise ValueError(f"the list of videos is not valid: {found.asDict()}")
    return rows.withColumn("positive", F.col("ground_truth_positive") == "1")


def annotations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per annotated interval that a detector should find (the default); with ``lines`` a document is a line, not a file."""
    docs = spark.read.schema(ANNOTATION).option("multiLine", not lines).json(path)
    return docs.select("video", F.explode("issues").alias("i")).filter(F.coalesce("i.should_detect", F.lit(True))).select("video", "i.category", "i.description", F.col("i.timestamp_start").alias("start_s"), F.col("i.timestamp_end").alias("end_s"))


def reports(spark: SparkSession, *paths: str, lines: bool = False) -> DataFrame:
    """Detector reports, one for each clip, of the layouts ``<clip>/detector_report.json``, ``<clip>.detector_report.json`` and
    ``clip=<clip>/`` with any file in it, as Spark writes them; with ``lines`` one report a line that names its clip, many a file."""
    issues = "issues array<struct<category:string,description:string,timestamp:double,confidence:double>>"
    docs = spark.read.schema(f"clip string, {issues}" if lines else issues).option("multiLine", not lines).json(list(paths))
    path = F.col("_metadata.file_path")
    named = docs if lines else docs.withColumn("clip", F.coalesce(F.nullif(F.regexp_extract(path, r"/clip=([^/]+)/[^/]+$", 1), F.lit("")), F.regexp_extract(path, r"([^/]+?)[/.]detector_report\.json$", 1)))
    twice = named.groupBy("clip").agg(F.count(F.lit(1)).alias("n")).filter("n <> 1").limit(5).collect()
    if twice:
        raise ValueError(f"clips without exactly one report: {[r.clip for r in twice]}")
    return named.select("clip", "issues")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Extracted frames, decoded on the executors."""
    return spark.read.format("image").option("dropInvalid", True).load(path)


FRAME_IMAGE = "path string, frame_number long, width int, height int, px array<int>, error string"


def frame_images(spark: SparkSession, path: str, names: str = "*", most_bytes: int = 64 << 20, since: str | None = None) -> DataFrame:
    """path, frame_number, width, height, px (gray, row by row), error of each image in files named like ``names``, written
    ``since`` (a time stamp) if given; folders such as ``video_id=3`` are columns.

    A file may hold one image or, as portable maps, many, so that frames need not be a small file each. The number of a frame is
    its header's comment ``frame <n>``, else the last number in the file's name. Files over ``most_bytes`` aren't opened, and
    those that can't be decoded don't end the scan: both give a row with an error."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", names)
    files = (reader.option("modifiedAfter", since) if since else reader).load(path)
    folders = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]
    large = files.filter(F.col("length") > most_bytes)  # the length is known without reading the file
    kept = [c.strip() for c in FRAME_IMAGE.split(", ")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, (name, data) in enumerate(zip(batch.column("path").to_pylist(), batch.column("content"), strict=True)):
                own = re.findall(r"\d+", name.rsplit("/", 1)[-1])
                try:
                    for said, px in images_of(data.as_py()):
                        number = re.search(r"frame (\d+)", said)
                        rows.append((k, name, int(number[1]) if number else int(own[-1]) if own else None, px.shape[1], px.shape[0], px.ravel(), None))
                except (ValueError, struct.error, zlib.error) as e:
                    rows.append((k, name, None, None, None, None, f"{type(e).__name__}: {e}"))
            places = pa.array([r[0] for r in rows], pa.int64())
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string())
            columns = [pa.array([r[n + 1] for r in rows], kind) for n, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(places) for c in folders), *columns], names=[*folders, *(c.split()[0] for c in kept)])

    types = ", ".join([*(f"`{c}` {t}" for c, t in files.dtypes if c in folders), *kept])
    read = files.filter(F.col("length") <= most_bytes).select(*folders, "path", "content").mapInArrow(decode, types)
    refused = large.select(*folders, "path", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in kept[1:-1]], F.format_string("%d bytes are more than %d", "length", F.lit(most_bytes)).alias("error"))
    return read.unionByName(refused)


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Structured log lines as a stream."""
    schema = "timestamp timestamp, event string, inspection_id string, job_id string, stage string, details map<string,string>"
    return spark.readStream.schema(schema).json(path)
