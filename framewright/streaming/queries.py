"""Streams over the given tables as registered queries; each has the SQL of its batch twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import check_text, ex
from ..operators import scenes
from ..operators.jobs import LEGAL
from ..plans.registry import ORACLES, QUERIES
from ..sources.scratch import scratch
from ..sources.views import check_sql, view
from .jobs import drained, event_stream, guarded_writes, latest_of, lifecycle, once_per_job, scene_stream, telemetry_windows, throttle
from .ordered import with_state_store

EVERY = 21600.0
_DONE, _TOTAL = "CAST(event_id % 30 AS INT)", "CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE 26 END AS INT)"
_SAID = "CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END"


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(telemetry_windows(event_stream(spark, sf_dir)), "windows", "complete")


LEASE, MOST = 3600.0, 3


def life(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(with_state_store(spark), sf_dir)
    return drained(lifecycle(events, LEASE, MOST), "lifecycle", session=spark).select("job_id", F.floor(F.col("at") * 1000 + 0.5).alias("at_ms"), "kind", "attempt")


def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(once_per_job(event_stream(spark, sf_dir), "10000 days"), "once").select("job_id", "status").groupBy("job_id", "status").agg(F.count(F.lit(1)).alias("times"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = event_stream(with_state_store(spark), sf_dir).select("job_id", "event_id", "ts", "status", F.col("status").alias("stage"), ex(_SAID).alias("message"), ex(_DONE).alias("completed"), ex(_TOTAL).alias("total"))
    return drained(throttle(told, EVERY), "progress", session=spark).select("job_id", F.floor(F.col("at") * 1000 + 0.5).alias("at_ms"), "stage", "message", F.coalesce("percent", F.lit(-1)).alias("percent"))


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(guarded_writes(event_stream(with_state_store(spark), sf_dir)), "writes", session=spark)


def write_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes(spark, sf_dir).select("job_id", "event_id", "prior", "status", "accepted", "version")


def present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_of(writes(spark, sf_dir))


def scene_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames as a stream: written once, in parts, and read as they lie there."""
    path = scratch(spark, "frames")
    scenes.unsigned(view(spark, sf_dir, "frames")).select("video_id", "frame_number", "t", "reasons", "motion_pct", "signature").write.parquet(path)
    table = spark.read.parquet(path)
    return drained(scene_stream(spark.readStream.schema(table.schema).parquet(path)), "scenes").select("video_id", "frame_number", "scene_index")


QUERIES.update({"x08_stream_windows": windows, "x02_stream_lifecycle": life, "x04_stream_dedupe": first_events, "x01_progress_throttle": progress, "x07_scene_stream": scene_frames, "s12_write_log": write_log, "s12_stream_upsert": present})
ORACLES["x08_stream_windows"] = ORACLES["x08_tumbling_errors"]
ORACLES["x07_scene_stream"] = ORACLES["q01_scene_segmentation"]
ORACLES["x04_stream_dedupe"] = check_sql(("job_events",), "SELECT DISTINCT job_id, status, CAST(1 AS BIGINT) AS times FROM job_events")
ORACLES["x01_progress_throttle"] = check_sql(
    ("job_events",),
    check_text(f"""WITH RECURSIVE o AS (SELECT job_id, at_s, status, {_SAID} AS said, {_DONE} AS done, {_TOTAL} AS total, row_number() OVER (PARTITION BY job_id ORDER BY at_s, event_id) AS n FROM job_events),
walk AS (SELECT job_id, n, at_s, status, said, done, total, said AS written, at_s AS last_s, true AS emit FROM o WHERE n = 1
  UNION ALL SELECT o.job_id, o.n, o.at_s, o.status, o.said, o.done, o.total,
    CASE WHEN o.status <> w.status OR o.said <> w.written OR o.status = 'COMPLETE' OR o.at_s - w.last_s >= {EVERY} THEN o.said ELSE w.written END,
    CASE WHEN o.status <> w.status OR o.said <> w.written OR o.status = 'COMPLETE' OR o.at_s - w.last_s >= {EVERY} THEN o.at_s ELSE w.last_s END,
    o.status <> w.status OR o.said <> w.written OR o.status = 'COMPLETE' OR o.at_s - w.last_s >= {EVERY}
  FROM walk w JOIN o ON o.job_id = w.job_id AND o.n = w.n + 1)
SELECT job_id, CAST(floor(at_s * 1000 + 0.5) AS BIGINT) AS at_ms, status AS stage, said AS message,
  CAST(coalesce(CASE WHEN total > 0 AND done <= total THEN least(CASE WHEN status = 'COMPLETE' THEN 100 ELSE 99 END, DIV(100 * done, total)) END, -1) AS INTEGER) AS percent
FROM walk WHERE emit"""),
)
# live: a lease that has not ended when the next event comes; a lapse is told when an event or the last event of all is at or past it
_LIVE = "(w.until IS NOT NULL AND w.until > o.at_s)"
_TAKES = f"(NOT w.over AND NOT {_LIVE} AND o.status = 'PROCESSING')"
_ENDS = f"(NOT w.over AND {_LIVE} AND (o.status = 'COMPLETE' OR o.status = 'FAILED'))"
ORACLES["x02_stream_lifecycle"] = check_sql(
    ("job_events",),
    check_text(f"""WITH RECURSIVE o AS (SELECT job_id, at_s, status, row_number() OVER (PARTITION BY job_id ORDER BY at_s, event_id) AS n FROM job_events),
walk AS (SELECT job_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS at_s, CAST(NULL AS VARCHAR) AS kind, 0 AS attempt, CAST(NULL AS DOUBLE) AS until, false AS lapsed, false AS over FROM o WHERE n = 1
  UNION ALL SELECT o.job_id, o.n, o.at_s,
    CASE WHEN w.over THEN 'refused_terminal' WHEN o.status = 'QUEUED' THEN NULL WHEN o.status = 'PROCESSING' THEN CASE WHEN {_LIVE} THEN 'refused_leased' WHEN w.lapsed OR w.until IS NOT NULL THEN 'reclaimed' ELSE 'claimed' END
      WHEN NOT {_LIVE} THEN 'stale' WHEN o.status = 'PROGRESS' THEN 'extended' WHEN o.status = 'COMPLETE' THEN 'completed' WHEN w.attempt >= {MOST} THEN 'dead' ELSE 'retry' END,
    w.attempt + CASE WHEN {_TAKES} THEN 1 ELSE 0 END,
    CASE WHEN w.over OR {_ENDS} THEN NULL WHEN {_TAKES} OR ({_LIVE} AND o.status = 'PROGRESS') THEN o.at_s + {LEASE} WHEN {_LIVE} THEN w.until END,
    NOT {_TAKES} AND (w.lapsed OR (w.until IS NOT NULL AND NOT {_LIVE})),
    w.over OR ({_ENDS} AND (o.status = 'COMPLETE' OR w.attempt >= {MOST}))
  FROM walk w JOIN o ON o.job_id = w.job_id AND o.n = w.n + 1),
ends AS (SELECT job_id, until, attempt, coalesce(lead(at_s) OVER (PARTITION BY job_id ORDER BY n), (SELECT max(at_s) FROM o)) AS seen FROM walk)
SELECT job_id, CAST(floor(at_s * 1000 + 0.5) AS BIGINT) AS at_ms, kind, attempt FROM walk WHERE kind IS NOT NULL
UNION ALL SELECT job_id, CAST(floor(until * 1000 + 0.5) AS BIGINT), 'expired', attempt FROM ends WHERE until <= seen"""),
)
_STEPS = ", ".join(f"('{a}', '{b}')" for a, b in LEGAL)
_WRITES = f"""WITH RECURSIVE o AS (SELECT job_id, event_id, status, row_number() OVER (PARTITION BY job_id ORDER BY at_s, event_id) AS n FROM job_events),
walk AS (SELECT job_id, n, event_id, CAST(NULL AS VARCHAR) AS prior, status, true AS accepted, 1 AS version, status AS present FROM o WHERE n = 1
  UNION ALL SELECT o.job_id, o.n, o.event_id, w.present, o.status, (w.present, o.status) IN ({_STEPS}), w.version + CASE WHEN (w.present, o.status) IN ({_STEPS}) THEN 1 ELSE 0 END,
    CASE WHEN (w.present, o.status) IN ({_STEPS}) THEN o.status ELSE w.present END
  FROM walk w JOIN o ON o.job_id = w.job_id AND o.n = w.n + 1)"""
ORACLES["s12_write_log"] = check_sql(("job_events",), f"{_WRITES} SELECT job_id, event_id, prior, status, accepted, version FROM walk")
ORACLES["s12_stream_upsert"] = check_sql(
    ("job_events",),
    f"""{_WRITES} SELECT job_id, arg_max(status, version) FILTER (WHERE accepted) AS status, arg_max(event_id, version) FILTER (WHERE accepted) AS event_id, max(version) AS version,
  count(*) FILTER (WHERE NOT accepted) AS refused FROM walk GROUP BY job_id""",
)
