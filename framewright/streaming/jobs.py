"""Job events as streams: telemetry windows, idempotence, progress throttling, leases, scene boundaries.

Each stateful operator keeps one small record per key, which it can give up when the key has been silent, so state is bounded by
what is live. Rules over jobs run in order of event time with timers (:mod:`.ordered`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import LEGAL, stage_percent
from ..operators.scenes import SceneLimits, SceneState
from ..sources.scratch import scratch
from .ordered import in_order

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
STATUS = {"signup": "QUEUED", "view": "PROCESSING", "click": "PROGRESS", "purchase": "COMPLETE", "error": "FAILED"}


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table of a folder as a stream of job events (event_id, job_id, ts, status, amount)."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(folder)
    table = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return raw.select("event_id", F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), table[F.col("event_type")].alias("status"), F.col("value").alias("amount"))


def telemetry_windows(events: DataFrame, minutes: int = 5, late: str = "10 minutes", alarm: int = 2) -> DataFrame:
    """Failures, events and sums by tumbling window; state of windows behind the watermark is dropped."""
    w = F.window("ts", f"{minutes} minutes")
    rolled = events.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count_if(F.col("status") == "FAILED").alias("errors"), F.count(F.lit(1)).alias("events"), F.sum("amount").alias("amount"))
    return rolled.select(F.unix_seconds("w.start").alias("start_s"), "errors", "events", (F.floor(F.col("amount") * 1e6 + 0.5) / 1e6).alias("amount"), (F.col("errors") >= alarm).alias("alarm"))


def once_per_job(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first event of each job and status within the watermark: retried messages change nothing."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id", "status"])


def timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout


PROGRESS = "job_id long, at double, stage string, message string, percent int"


class Throttle:
    """What is written of a job's progress (at, stage, message, percent, finished): each row that says something new, ends a
    stage, or comes ``every`` seconds or more after the last one written. State: the stage seen last, message and time written."""

    def __init__(self, every: float):
        self.every = every

    def step(self, key: int, row: dict, state: list | None) -> tuple[list[tuple], list]:
        stage, message, at = state or [None, None, None]
        news = [row["stage"], row["message"]] != [stage, message]
        silent = at is None or row["at"] - at >= self.every
        if not (news or silent or row["finished"]):
            return [], [row["stage"], message, at]
        return [(key, row["at"], row["stage"], row["message"], row["percent"])], [row["stage"], row["message"], row["at"]]

    def due(self, state: list) -> None:
        return None

    def lapse(self, key: int, state: list) -> tuple[list[tuple], list]:
        return [], state


def throttle(progress: DataFrame, every: float = 2.0, late: str = "0 seconds", forget_s: float | None = None) -> DataFrame:
    """The throttled stream of ``progress`` (job_id, event_id, ts, stage, message, status, completed, total): one row for each
    write, with the percentage of :func:`~framewright.operators.jobs.stage_percent`. Rows pass in order of time, whatever
    micro-batches they come in; a job that has been silent ``forget_s`` seconds of event time is forgotten."""
    told = stage_percent(progress).select("job_id", "event_id", "ts", (F.unix_micros("ts") / 1e6).alias("at"), "stage", "message", F.col("percent").cast("int").alias("percent"), (F.col("status") == "COMPLETE").alias("finished"))
    return in_order(told, "job_id", "ts", "event_id", Throttle(every), PROGRESS, late, forget_s)


LIFE = "job_id long, at double, kind string, attempt int"


class Lease:
    """A job's claims (at, status): claim, extend, fail, complete. A claim during a live lease is refused; a lease that nobody
    extends ends by itself and is reported, and the next claim takes the job over; a failure after ``most`` attempts is the
    last. State: attempt, end of the lease (null: none), whether one has lapsed, whether the job is over."""

    def __init__(self, lease: float, most: int):
        self.lease, self.most = lease, most

    def due(self, state: list) -> float | None:
        return state[1]

    def lapse(self, key: int, state: list) -> tuple[list[tuple], list]:
        return [(key, state[1], "expired", state[0])], [state[0], None, True, False]

    def step(self, key: int, row: dict, state: list | None) -> tuple[list[tuple], list]:
        out: list[tuple] = []
        state = state or [0, None, False, False]
        if state[1] is not None and state[1] <= row["at"]:  # it ended before this
            out, state = self.lapse(key, state)
        attempt, until, lapsed, over = state
        status, live = row["status"], until is not None
        if over:
            kind = "refused_terminal"
        elif status == "PROCESSING":
            kind = "refused_leased" if live else "reclaimed" if lapsed else "claimed"
            if not live:
                attempt, until, lapsed = attempt + 1, row["at"] + self.lease, False
        elif status not in ("PROGRESS", "FAILED", "COMPLETE"):
            return out, state
        elif not live:
            kind = "stale"
        elif status == "PROGRESS":
            kind, until = "extended", row["at"] + self.lease
        else:
            kind = "completed" if status == "COMPLETE" else "dead" if attempt >= self.most else "retry"
            until, over = None, kind != "retry"
        return [*out, (key, row["at"], kind, attempt)], [attempt, until, lapsed, over]


def lifecycle(events: DataFrame, lease: float = 3600.0, most: int = 3, late: str = "0 seconds", forget_s: float | None = None) -> DataFrame:
    """Claims, refusals, lapses, retries and ends of a stream of job events (job_id, event_id, ts, status). A lapse is told when
    the watermark has passed it, without waiting for the job's next event."""
    timed = events.select("job_id", "event_id", "ts", "status", (F.unix_micros("ts") / 1e6).alias("at"))
    return in_order(timed, "job_id", "ts", "event_id", Lease(lease, most), LIFE, late, forget_s)


SCENE_STATE = "scene int, start double, prior array<double>, reference array<double>"


def scene_stream(frames: DataFrame, c: SceneLimits = SceneLimits(), idle_ms: int | None = None) -> DataFrame:
    """Scenes of frames as they come (video_id, frame_number, t, reasons, motion_pct, signature): a video's rows of one
    micro-batch are sorted, so the source must not deliver a frame behind one that it delivered before."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import numpy as np

        if state.hasTimedOut:
            state.remove()
            return
        s = SceneState()
        if state.exists:
            scene, start, prior, reference = state.get
            s = SceneState(scene, start, None if prior is None else np.array(prior), None if reference is None else np.array(reference))
        out = []
        for r in pd.concat(list(batches)).sort_values(["t", "frame_number"]).itertuples(index=False):
            signature = None if r.signature is None else np.asarray(r.signature, float)
            scene, why = s.step(r.t, signature, bool(r.reasons), None if r.motion_pct != r.motion_pct else r.motion_pct, c)
            out.append((key[0], r.frame_number, scene, why))
        listed = lambda x: None if x is None else [float(v) for v in x]
        state.update((s.scene, s.start, listed(s.prior), listed(s.reference)))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["video_id", "frame_number", "scene_index", "boundary"])

    wanted = frames.select("video_id", "frame_number", "t", "reasons", "motion_pct", F.col("signature").cast("array<double>").alias("signature"))
    return wanted.groupBy("video_id").applyInPandasWithState(step, "video_id long, frame_number long, scene_index int, boundary string", SCENE_STATE, "append", timeout(idle_ms))


def drained(stream: DataFrame, name: str, mode: str = "append", session: SparkSession | None = None) -> DataFrame:
    """Runs a stream over all that is there now and gives the table that it wrote, read by ``session`` if it isn't the stream's."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out).outputMode(mode)
    else:
        writer = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).outputMode(mode)
    query = writer.option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return (session or spark).read.schema(stream.schema).parquet(out)


WRITES = "job_id long, event_id long, at double, prior string, status string, accepted boolean, version int"


class Guarded:
    """Writes of a job's status: one that may not follow the present one is refused and told, and changes nothing; so is a
    repeated one, which isn't told again. State: status, number of accepted writes, time and id of the last event."""

    def step(self, key: int, row: dict, state: list | None) -> tuple[list[tuple], list]:
        status, version, at, event = state or [None, 0, None, None]
        if event is not None and (row["at"], row["event_id"]) <= (at, event):
            return [], [status, version, at, event]
        accepted = status is None or (status, row["status"]) in LEGAL
        told = (key, row["event_id"], row["at"], status, row["status"], accepted, version + accepted)
        return [told], [row["status"] if accepted else status, version + accepted, row["at"], row["event_id"]]

    def due(self, state: list) -> None:
        return None

    def lapse(self, key: int, state: list) -> tuple[list[tuple], list]:
        return [], state


def guarded_writes(events: DataFrame, late: str = "0 seconds", forget_s: float | None = None) -> DataFrame:
    """The log of all writes of a stream of job events (job_id, event_id, ts, status), accepted or refused: it is only ever
    appended to, and :func:`latest_of` gives the present state of each job."""
    timed = events.select("job_id", "event_id", "ts", "status", (F.unix_micros("ts") / 1e6).alias("at"))
    return in_order(timed, "job_id", "ts", "event_id", Guarded(), WRITES, late, forget_s)


def latest_of(log: DataFrame) -> DataFrame:
    """Each job's present status and version, and how many writes were refused: the log, compacted (map-side maxima)."""
    last = F.max_by(F.struct("status", "event_id", "version"), F.when(F.col("accepted"), F.col("version"))).alias("s")
    return log.groupBy("job_id").agg(last, F.count_if(~F.col("accepted")).alias("refused")).select("job_id", "s.status", "s.event_id", "s.version", "refused")
