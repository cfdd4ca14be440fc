"""Readers, sinks and streams; each stream against its batch twin."""

from __future__ import annotations

import json
import struct
import zlib
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewright.operators import frames, jobs, pixels, scenes
from framewright.sources import readers, sinks
from framewright.sources.views import view
from framewright.streaming import jobs as streams
from framewright.streaming import ordered
from framewright.streaming.ordered import PROVIDER, with_state_store

SF = "/root/testdata/sf0.001"


def test_manifest_scan(spark, tmp_path):
    doc = {
        "video": {"filename": "a.mp4", "fps": 30.0, "width": 8, "height": 8, "total_frames": 90, "duration_seconds": 3.0},
        "scenes": [{"scene_index": 0, "start_seconds": 0.0, "end_seconds": 3.0, "duration_seconds": 3.0, "start_reason": "video_start", "end_reason": "video_end"}],
        "keyframes": [{"filename": "x.jpg", "frame_number": 30, "timestamp_seconds": 1.0, "scene_index": 0, "score_components": {"sharpness": 0.5}}],
        "frame_assessments": [{"frame_number": n * 30, "timestamp_seconds": float(n), "rejection_reasons": ["blurry"] * n, "scene_index": 0, "blur": {"variance_of_laplacian": 50.0}, "motion": {"percent_per_second": None}} for n in range(3)],
    }
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=2))
    got = readers.manifests(spark, str(tmp_path))
    assert {k: v.count() for k, v in got.items()} == {"videos": 1, "scenes": 1, "keyframes": 1, "frames": 3}
    assert got["keyframes"].select("score_components").first()[0] == {"sharpness": 0.5}


def test_split_list(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("video,split,source_group,ground_truth_positive\na,development,g,1\nb,development,g,0\n")
    assert readers.split_list(spark, str(good)).filter("positive").count() == 1
    for text in ("a,d,g,1\na,d,g,0\n", "a,d,g,1\nb,d,g,2\n", "a,d,g,1\nb,d,g,1\n"):
        bad = tmp_path / "bad.csv"
        bad.write_text("video,split,source_group,ground_truth_positive\n" + text)
        with pytest.raises(ValueError):
            readers.split_list(spark, str(bad))


def test_annotations_and_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"video": "a", "issues": [{"category": "x", "timestamp_start": 1, "timestamp_end": 2}, {"category": "y", "timestamp_start": 1, "timestamp_end": 2, "should_detect": False}]}))
    assert [r.category for r in readers.annotations(spark, str(tmp_path / "a.json")).collect()] == ["x"]
    (tmp_path / "r" / "c1").mkdir(parents=True)
    for p in ("r/c1/detector_report.json", "r/c2.detector_report.json"):
        (tmp_path / p).write_text(json.dumps({"issues": []}))
    paths = (str(tmp_path / "r" / "c1"), str(tmp_path / "r" / "c2.detector_report.json"))
    assert sorted(r.clip for r in readers.reports(spark, *paths).collect()) == ["c1", "c2"]
    (tmp_path / "r" / "c1.detector_report.json").write_text(json.dumps({"issues": []}))
    with pytest.raises(ValueError):
        readers.reports(spark, *paths, str(tmp_path / "r" / "c1.detector_report.json"))


def test_image_scan(spark, tmp_path):
    rows = np.arange(64, dtype=np.uint8).reshape(8, 8)
    (tmp_path / "a.pgm").write_bytes(b"P5 8 8 255\n" + rows.tobytes())
    import struct
    import zlib

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in rows))) + chunk(b"IEND", b"")
    (tmp_path / "b.png").write_bytes(png)
    got = pixels.from_images(readers.images(spark, str(tmp_path))).collect()
    assert len(got) == 1 and got[0].px == list(map(float, range(64)))
    measured = pixels.measure(spark.createDataFrame([(1, 2, got[0].px)], "video_id long, frame_number long, px array<double>")).first()
    assert measured["mean"] == 31.5 and measured.sharpness == pixels.sharpness(rows.astype(float))[0]


def test_sinks(spark, tmp_path):
    runs = spark.createDataFrame([(1, "measured", "F", True, 2.0)], "execution_order int, phase string, environment string, success boolean, wall_clock_seconds double")
    sinks.write_runs(runs, str(tmp_path / "runs"))
    assert spark.read.csv(str(tmp_path / "runs"), header=True).columns == list(sinks.RUN_COLUMNS)
    traces = spark.createDataFrame([(1, (2, "x"))], "clip long, found struct<n:long,why:string>")
    sinks.write_diagnosis(traces, str(tmp_path / "d"))
    assert spark.read.csv(str(tmp_path / "d" / "csv"), header=True).columns == ["clip", "found_n", "found_why"]
    log = sinks.action_log(spark.createDataFrame([(1, 2, "b", 0.5), (1, 1, "a", 0.25)], "candidate_id long, sequence_no long, action string, confidence_after double")).first()
    assert [a["action"] for a in json.loads(log.document)["actions"]] == ["a", "b"]
    sinks.write_artifacts(spark.createDataFrame([("i", "evidence", 1), ("i", "reports", 2)], "inspection_id string, kind string, n long"), str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).filter("kind = 'reports'").count() == 1
    limits = sinks.overridden(frames.LIMITS, {"sharpness": 50.0})
    assert sinks.with_parameters(runs, limits).select("parameters.sharpness").first()[0] == 50.0
    with pytest.raises(ValueError):
        sinks.overridden(frames.LIMITS, {"sharpnes": 1})


def walk(rule, rows, state=None):
    out = []
    for r in rows:
        got, state = rule.step(1, r, state)
        out += got
    return out, state


def test_progress_rules():
    row = lambda at, stage, message, percent, end=False: {"at": at, "stage": stage, "message": message, "percent": percent, "finished": end}
    rule = streams.Throttle(2.0)
    out, state = walk(rule, [row(0.0, "extract", "m", 57)] + [row(0.0, "extract", "m", n) for n in range(48)])
    assert out == [(1, 0.0, "extract", "m", 57)]
    out, state = walk(rule, [row(1.0, "extract", "m", 3), row(2.5, "extract", "m", None), row(2.6, "select", "m", None), row(2.7, "select", "n", 99), row(2.8, "select", "n", 100, True), row(2.9, "select", "n", None, True)], state)
    assert [(r[1], r[4]) for r in out] == [(2.5, None), (2.6, None), (2.7, 99), (2.8, 100), (2.9, None)]


def test_leases():
    rule = streams.Lease(10.0, 3)
    steps = ((0, "PROCESSING"), (5, "PROCESSING"), (8, "PROGRESS"), (30, "PROGRESS"), (31, "PROCESSING"), (32, "FAILED"), (33, "PROCESSING"), (34, "FAILED"), (35, "PROCESSING"))
    out, state = walk(rule, [{"at": float(a), "status": s} for a, s in steps])
    assert [(k, t) for _, t, k, _ in out] == [
        ("claimed", 0), ("refused_leased", 5), ("extended", 8), ("expired", 18), ("stale", 30), ("reclaimed", 31), ("retry", 32), ("claimed", 33), ("dead", 34), ("refused_terminal", 35)
    ]
    assert state[3] and rule.due(state) is None
    out, state = walk(rule, [{"at": 0.0, "status": "PROCESSING"}, {"at": 1.0, "status": "QUEUED"}])
    assert rule.due(state) == 10.0 and rule.lapse(1, state) == ([(1, 10.0, "expired", 1)], [1, None, True, False])


def test_writes_that_may_not_follow_are_refused():
    rows = [(1, "QUEUED"), (2, "COMPLETE"), (3, "PROCESSING"), (3, "PROCESSING"), (4, "PROGRESS"), (5, "QUEUED"), (6, "COMPLETE")]
    out, state = walk(streams.Guarded(), [{"at": float(k), "event_id": k, "status": s} for k, s in rows])
    assert [(r[1], r[5], r[6]) for r in out] == [(1, True, 1), (2, False, 1), (3, True, 2), (4, True, 3), (5, False, 3), (6, True, 4)]
    assert walk(streams.Guarded(), [{"at": float(k), "event_id": k, "status": s} for k, s in rows], state) == ([], state)  # a replay


class CountedState:
    """State and timers of one key, as the stateful processor's handle gives them, with the number of calls."""

    def __init__(self):
        self.calls, self.timers, self.value, self.entries = 0, set(), None, {}

    def getValueState(self, name, schema):
        return SimpleNamespace(get=lambda: self.call(lambda: self.value), update=lambda v: self.call(lambda: setattr(self, "value", v)), clear=lambda: self.call(lambda: setattr(self, "value", None)))

    def getMapState(self, name, *schemas):
        return SimpleNamespace(getValue=lambda k: self.call(lambda: self.entries[k]), updateValue=lambda k, v: self.call(lambda: self.entries.update({k: v})), removeKey=lambda k: self.call(lambda: self.entries.pop(k)))

    def call(self, f):
        self.calls += 1
        return f()

    def registerTimer(self, ms):
        self.call(lambda: self.timers.add(ms))


def passed_in_order(rows, few, watermarks, monkeypatch):
    """What the writes' rule tells of one job's ``rows`` (us_of_event, event_id, status), all given at once, and the state after."""
    monkeypatch.setattr(ordered, "FEW", few)
    names = [c.split()[0] for c in streams.WRITES.split(", ")]
    run, state = ordered.InOrder(streams.Guarded(), names, ["us_of_event", "event_id", "at", "status"], "event_id", None), CountedState()
    run.init(state)
    frame = pd.DataFrame([(us, n, us / 1e6, s) for us, n, s in rows], columns=["us_of_event", "event_id", "at", "status"])
    assert list(run.handleInputRows((1,), iter([frame[: len(rows) // 2], frame[len(rows) // 2 :]]), None)) == []
    out = []
    for now in watermarks:
        while due := sorted(t for t in state.timers if t < now):
            for part in run.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), None):  # noqa: B023
                out += part["event_id"].tolist()
            state.timers.discard(due[0])
    return out, state


def test_waiting_events_cost_few_calls_of_state(monkeypatch):
    day, names = 86_400_000_000, ("QUEUED", "PROCESSING", "PROGRESS")
    rows = [((37 * k) % 60 * day // 2, k, names[k % 3]) for k in range(60)]
    want = [n for _, n, _ in sorted(rows)]
    got, state = passed_in_order(rows, 2_000, [31 * day // 1000], monkeypatch)
    assert got == want and state.calls <= 8 and not state.entries  # not several for each day
    for few, watermarks in ((2_000, [3, 11, 31]), (10, [31]), (10, [3, 11, 31])):
        got, state = passed_in_order(rows, few, [w * day // 1000 for w in watermarks], monkeypatch)
        assert got == want and not state.entries and not state.timers


def test_events_of_one_millisecond_pass_in_order_of_time(monkeypatch):
    rows = [(5_000_900, 1, "PROCESSING"), (5_000_100, 2, "QUEUED"), (5_000_500, 3, "QUEUED")]
    assert passed_in_order(rows, 2_000, [9_000], monkeypatch)[0] == [2, 3, 1]


def test_streams_agree_with_batch(spark):
    events = view(spark, SF, "job_events")
    windows = streams.drained(streams.telemetry_windows(streams.event_stream(spark, SF)), "w", "complete")
    assert sorted(map(tuple, windows.collect())) == sorted(map(tuple, jobs.telemetry_windows(events).collect()))
    once = streams.drained(streams.once_per_job(streams.event_stream(spark, SF)), "o")
    assert once.groupBy("job_id", "status").count().count() == events.select("job_id", "status").distinct().count()


def test_several_micro_batches_agree_with_one(spark, tmp_path):
    own = with_state_store(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER  # the given session stays as it is
    t0 = datetime(2024, 1, 1)
    rows = [(k, k % 3, t0 + timedelta(minutes=7 * k), ("QUEUED", "PROCESSING", "PROGRESS", "PROCESSING", "FAILED", "PROGRESS", "COMPLETE")[(k * k + k // 3) % 7]) for k in range(90)]
    schema = "event_id long, job_id long, ts timestamp, status string"
    rules = {"lease": streams.Lease(1500.0, 2), "guarded": streams.Guarded()}
    results = {}
    for parts in (1, 3):
        for n in range(parts):  # within a part in no order; the last of a part comes before the first of the next
            part = rows[n * 90 // parts : (n + 1) * 90 // parts]
            own.createDataFrame(part[1::2] + part[::2], schema).coalesce(1).write.parquet(str(tmp_path / f"in{parts}" / f"part{n}"))
        source = lambda: own.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / f"in{parts}"))  # noqa: B023, E731
        life = streams.drained(streams.lifecycle(source(), 1500.0, 2), "l")
        log = streams.drained(streams.guarded_writes(source()), "g")
        results[parts] = [sorted(map(tuple, df.collect())) for df in (life, log)]
    assert results[1] == results[3]
    want = []
    for job in range(3):
        state, own_rows = None, [{"at": r[2].timestamp(), "event_id": r[0], "status": r[3]} for r in rows if r[1] == job]
        for r in own_rows:
            got, state = rules["lease"].step(job, r, state)
            want += got
        if rules["lease"].due(state) is not None and rules["lease"].due(state) <= rows[-1][2].timestamp():
            want += rules["lease"].lapse(job, state)[0]
    shift = want[0][1] - min(r[1] for r in results[1][0] if r[0] == want[0][0])  # the zone of the session and of this process
    assert results[1][0] == sorted((j, a - shift, k, n) for j, a, k, n in want) and any(r[2] == "expired" for r in results[1][0])


def test_silent_jobs_are_forgotten(spark, tmp_path):
    own = with_state_store(spark)
    t0 = datetime(2024, 1, 1)
    rows = [[(1, 7, t0, "QUEUED"), (2, 8, t0, "QUEUED")], [(3, 8, t0 + timedelta(hours=5), "PROCESSING")], [(4, 7, t0 + timedelta(hours=6), "COMPLETE"), (5, 8, t0 + timedelta(hours=6), "COMPLETE")]]
    for n, part in enumerate(rows):
        own.createDataFrame(part, "event_id long, job_id long, ts timestamp, status string").coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}"))
    source = own.readStream.schema("event_id long, job_id long, ts timestamp, status string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = {r.event_id: (r.prior, r.accepted) for r in streams.drained(streams.guarded_writes(source, forget_s=3 * 3600.0), "f").collect()}
    assert got[4] == (None, True)  # job 7 was silent for six hours, so nothing is known of it
    assert got[5][0] in ("PROCESSING", None) and set(got) == {1, 2, 3, 4, 5}


def test_frame_images(spark, tmp_path):
    r = np.random.default_rng(3)
    px = r.integers(0, 256, (5, 7, 4), np.uint8)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))

    def filtered(image):  # each line with another of the five filters
        h, w, c = image.shape
        wide = np.zeros((h + 1, w + 1, c), int)
        wide[1:, 1:] = image
        lines = []
        for y in range(h):
            left, up, corner, own = wide[y + 1, :-1], wide[y, 1:], wide[y, :-1], wide[y + 1, 1:]
            p = left + up - corner
            near = np.abs(np.stack([p - left, p - up, p - corner]))
            paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
            lines.append(bytes([y % 5]) + ((own - (0, left, up, (left + up) // 2, paeth)[y % 5]) % 256).astype(np.uint8).tobytes())
        return b"".join(lines)

    for kind, c in ((0, 1), (2, 3), (4, 2), (6, 4)):
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(filtered(px[:, :, :c]))) + chunk(b"IEND", b"")
        (tmp_path / f"frame_{kind:06d}.png").write_bytes(png)
    (tmp_path / "frame_10.pgm").write_bytes(b"P5 7 5 255\n" + px[:, :, 0].tobytes() + b"P2\n# frame 11\n2 1 9\n3\n 9\n")
    (tmp_path / "frame_12.ppm").write_bytes(b"P6\n7 5\n255\n" + px[:, :, :3].tobytes())
    (tmp_path / "frame_13.pgm").write_bytes(b"P5 7 5 255\n" + b"cut off")
    (tmp_path / "frame_14.png").write_bytes(b"no image")
    (tmp_path / "frame_15.pgm").write_bytes(b"P5 1000 5 255\n" + bytes(5000))
    (tmp_path / "notes.csv").write_text("not an image")
    got = {r.frame_number if r.error is None else r.path.rsplit("/")[-1]: r for r in readers.frame_images(spark, str(tmp_path), "frame_*", most_bytes=4000).collect()}
    plain, mixed = px[:, :, 0].ravel().tolist(), np.floor(px[:, :, :3] @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(int).ravel().tolist()
    assert set(got) == {0, 2, 4, 6, 10, 11, 12, "frame_13.pgm", "frame_14.png", "frame_15.pgm"}
    assert got[0].px == got[4].px == got[10].px == plain and got[2].px == got[6].px == got[12].px == mixed and got[11].px == [3, 9]
    assert (got[0].width, got[0].height) == (7, 5) and "5014 bytes" in got["frame_15.pgm"].error
    sinks.write_images(spark.createDataFrame([(1, 5, list(range(64))), (1, 6, [1] * 8), (2, 7, [0] * 16)], "video_id long, frame_number long, px array<int>").coalesce(1), str(tmp_path / "w"))
    back = readers.frame_images(spark, str(tmp_path / "w"), "*.txt")
    assert {(r.video_id, r.frame_number, r.height, tuple(r.px)) for r in back.collect()} == {(1, 5, 8, tuple(range(64))), (1, 6, 1, (1,) * 8), (2, 7, 2, (0,) * 16)}
    assert back.select("path").distinct().count() == 2  # one file for all frames of a video


def test_scene_stream_agrees_with_batch(spark, tmp_path):
    full = scenes.signed(view(spark, SF, "frames"), spark.read.parquet(f"{SF}/embeddings.parquet")).select("video_id", "frame_number", "t", "reasons", "motion_pct", F.col("signature").cast("array<double>").alias("signature"))
    for n in range(3):
        full.filter(f"floor(frame_number / 25) = {n}" if n < 2 else "frame_number >= 50").coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}"))
    source = spark.readStream.schema(full.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = streams.drained(streams.scene_stream(source), "s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, scenes.segment(full).collect()))
