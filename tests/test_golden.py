"""Golden cases: exact boundaries and small examples with known results."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewright.functions.dialect import ex
from framewright.operators import benchmark, consolidate, evaluate, findings, frames, keyframes, pixels, policy, scenes
from framewright.operators.rangejoin import interval_join, nearest_join

FINDING = "finding_id long, video_id long, ts_s double, room string, category string, description string, confidence double, x double, y double, width double, height double"


def finding(i, t=0.0, room="kitchen", category="wall_stain", text="Water stain on the wall", confidence=0.9, box=(0.1, 0.1, 0.2, 0.2)):
    return (i, 1, float(t), room, category, text, confidence, *box)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), FINDING)


def column(df, expression):
    return [r[0] for r in df.orderBy("finding_id").select(expression).collect()]


def test_routing_boundaries(spark):
    df = table(spark, *[finding(i, text="Surface looks worn", confidence=c) for i, c in enumerate((0.85001, 0.85, 0.50, 0.49999))], finding(9, text="Possible exposed wiring near the outlet", confidence=0.31))
    assert column(df, ex(policy.route())) == ["ACCEPT_CANDIDATE", "INVESTIGATE_CANDIDATE", "INVESTIGATE_CANDIDATE", "REJECT_CANDIDATE", "INVESTIGATE_CANDIDATE"]
    assert column(df, ex(policy.route("true")))[-1] == "REQUEST_HUMAN_APPROVAL"
    assert column(policy.safety(df), "reasons")[-1] == "safety phrase: exposed wiring"


def test_labels(spark):
    df = table(spark, *[finding(i, confidence=c) for i, c in enumerate((0.8, 0.7999, 0.6, 0.59, None, 1.5))])
    assert column(df, ex(findings.LABEL)) == ["High", "Medium", "Medium", "Low", None, None]


def test_severity_cascade(spark):
    cases = [
        ("Visible hole in wall", "wall_hole", "hole_or_puncture", policy.FIX), ("Missing outlet cover", "missing_hardware", "missing_protective_cover", policy.FIX), ("Broken fixture", "fixture_damage", "broken_condition", policy.FIX),
        ("Ceiling discoloration", "visible_staining", "possible_moisture_evidence", policy.REVIEW), ("Thin crack", "wall_crack", "visible_cracking", policy.REVIEW), ("Paint scuff", "paint_damage", "paint_scuff", policy.COSMETIC),
        ("Minor chipped trim", "trim_damage", "minor_trim_damage", policy.COSMETIC), ("Dusty shelf with dust", "cleanliness", "cleanliness", policy.COSMETIC), ("Odd surface", "roof_leak_x", "fallback:review", policy.REVIEW),
    ]
    df = policy.classify(table(spark, *[finding(i, category=c, text=t) for i, (t, c, *_) in enumerate(cases)]))
    assert [tuple(r) for r in df.orderBy("finding_id").select("rule_id", "severity").collect()] == [(r, s) for *_, r, s in cases]
    by_table = policy.classify_by_rules(df.drop("rule_id", "severity"), policy.rule_table(spark))
    assert column(by_table, "rule_id")[:8] == [r for *_, r, _ in cases][:8]


def test_safe_wording(spark):
    texts = ["Mold on the wall", "Mouldy corner", "The outlet is dangerous", "Electrical panel looks unsafe", "Structural crack", "Structurally compromised beam", "Surface looks worn"]
    got = column(table(spark, *[finding(i, text=t) for i, t in enumerate(texts)]), ex(policy.SAFE))
    safe = list(policy.SAFE_TEXTS.values())
    assert got == [safe[0], safe[0], safe[1], safe[1], safe[2], safe[2], "Surface looks worn"]


def test_readiness_example(spark):
    assert policy.readiness(spark.createDataFrame([(3, 4, 5), (30, 0, 0), (0, 1, 0)], "fix long, review long, cosmetic long")).select("score").collect() == [(78,), (0,), (99,)]


def test_consolidation_of_repeated_views(spark):
    same = [finding(i, t, text="Visible water stain near window") for i, t in enumerate((268, 270, 271, 274, 276))]
    got = consolidate.consolidate(table(spark, *same)).collect()
    assert {r.cluster for r in got} == {0} and {r.members for r in got} == {5}
    apart = [finding(0, 268), finding(1, 270, room="bath"), finding(2, 271, category="floor_stain"), finding(3, 298)]
    assert len({r.cluster for r in consolidate.consolidate(table(spark, *apart)).collect()}) == 4
    pair = consolidate.compare_findings(table(spark, finding(0, 268), finding(1, 274))).collect()
    assert len(pair) == 1 and pair[0].merge


def test_consolidation_is_the_same_without_islands(spark):
    r = np.random.default_rng(4)
    rows = [finding(i, r.uniform(0, 90), text=["Water stain on wall", "Crack along wall"][i % 2], box=(0.1 + 0.01 * (i % 5), 0.1, 0.3, 0.3)) for i in range(60)]
    split = {x.finding_id: x.cluster for x in consolidate.consolidate(table(spark, *rows)).collect()}
    wide = consolidate.MergeLimits()
    whole = consolidate.islands
    try:
        consolidate.islands = lambda f, gap=12.0: f.withColumn("island", F.lit(0))
        together = {x.finding_id: x.cluster for x in consolidate.consolidate(table(spark, *rows), wide).collect()}
    finally:
        consolidate.islands = whole
    assert split == together and len(set(split.values())) < 60
    assert split == {x.finding_id: x.cluster for x in consolidate.consolidate(table(spark, *rows).repartition(7)).collect()}


def test_suppression_and_spacing(spark):
    df = table(spark, finding(0, 0, confidence=0.9), finding(1, 3, confidence=0.8), finding(2, 9, confidence=0.7), finding(3, 3, confidence=0.6, box=(0.7, 0.7, 0.1, 0.1)))
    assert sorted(r.finding_id for r in consolidate.suppress(df).collect()) == [0, 2, 3]
    spaced = table(spark, *[finding(i, t, confidence=c) for i, (t, c) in enumerate(((0, 0.49), (2, 0.5), (4, 0.65), (6, 0.85), (8, 0.86)))])
    assert sorted(r.finding_id for r in consolidate.spaced_top(spaced).collect()) == [1, 2, 3]


def spaced_by_brute_force(rows, k=3, apart=1.0):
    chosen = []
    for r in sorted((r for r in rows if 0.5 <= r[6] <= 0.85), key=lambda r: (r[6], r[2], r[0])):
        if len(chosen) < k and all(abs(r[2] - c[2]) >= apart for c in chosen):
            chosen.append(r)
    return sorted(c[0] for c in chosen)


def test_spacing_among_dense_findings(spark):
    near = [finding(i, t, confidence=c) for i, (t, c) in enumerate(((0.95, 0.5), (1.0, 0.51), (1.1, 0.52), (1.2, 0.53), (1.97, 0.54), (9.0, 0.84)))]
    assert sorted(r.finding_id for r in consolidate.spaced_top(table(spark, *near)).collect()) == spaced_by_brute_force(near) == [0, 4, 5]
    r = np.random.default_rng(8)
    for k in (3, 6):
        dense = [finding(i, np.round(r.uniform(0, 8), 2), confidence=float(np.round(r.uniform(0.45, 0.9), 3))) for i in range(200)]
        assert sorted(x.finding_id for x in consolidate.spaced_top(table(spark, *dense), k).collect()) == spaced_by_brute_force(dense, k)


def test_spatial_scoring(spark):
    box = spark.createDataFrame([(0, 1, 0.0, "wall_hole", 0.1, 0.1, 0.2, 0.2), (1, 1, 5.0, "wall_crack", 0.4, 0.4, 0.05, 0.05)], "box_id long, video_id long, ts_s double, category string, x double, y double, width double, height double")
    df = table(spark, finding(0, 0.0, category="wall_stain"), finding(1, 5.0, category="wall_crack", box=(0.0, 0.0, 1.0, 1.0)), finding(2, 0.05, category="wall_hole"), finding(3, 0.0, category="wall_hole", box=(0.12, 0.1, 0.2, 0.2)))
    got = {(r.finding_id, r.box_id): r.reason for r in evaluate.box_pairs(df, box).collect()}
    assert got == {(0, 0): "wrong_condition", (1, 1): "wrong_or_overly_broad_location", (2, 0): "verified_match", (3, 0): "verified_match"}
    assert [(r.finding_id, r.box_id) for r in evaluate.match_one_to_one(evaluate.box_pairs(df, box)).collect()] == [(2, 0)]


def test_confusion_cases(spark):
    rows = lambda g, tp, tn, fp, fn: [(g, True, True)] * tp + [(g, False, False)] * tn + [(g, False, True)] * fp + [(g, True, False)] * fn
    df = spark.createDataFrame(rows("a", 8, 9, 0, 1) + rows("b", 1, 7, 1, 5) + rows("c", 0, 15, 0, 8), "source_group string, positive boolean, predicted_positive boolean")
    got = {r.source_group: r for r in evaluate.confusion(df, ["source_group"]).collect()}
    assert (got["a"].precision, round(got["a"].recall, 4), round(got["a"].f1, 4)) == (1.0, 0.8889, 0.9412)
    assert (got["b"].precision, got["b"].recall, got["b"].specificity, got["b"].f1) == (0.5, 0.166667, 0.875, 0.25)
    assert got["c"].precision is None


def test_model_cost(spark):
    df = spark.createDataFrame([(1, "A", 1000, 100), (2, "X", 5, 5)], "video_id long, model_id string, input_tokens long, output_tokens long")
    got = {r.video_id: (r.cost, r.unpriced) for r in evaluate.costs(df).collect()}
    assert got[1] == (0.0045, 0) and got[2] == (None, 1)


def test_run_statistics(spark):
    rows = [("F", "warmup", True, 99.0)] + [("F", "measured", True, 10.0), ("F", "measured", False, 50.0)] + [("O", "measured", True, float(v)) for v in (1, 2, 3, 4, 5)]
    got = {r.environment: r for r in benchmark.run_stats(spark.createDataFrame(rows, "environment string, phase string, success boolean, wall_clock_seconds double"), ["environment"]).collect()}
    assert (got["F"].attempts, got["F"].successes, got["F"]["mean"], got["F"].deviation) == (2, 1, 10.0, 0.0)
    assert got["O"].p95 == 4.8


def frame(n, t, sharpness=150.0, motion=0.0, brightness=128.0, tiles=100.0, signature=None):
    return (1, n, float(t), sharpness, sharpness * 0.9, tiles, brightness, 0.0, 0.0, motion, signature)


FRAME = "video_id long, frame_number long, t double, sharpness double, tile_median double, sharp_tiles_pct double, brightness_mean double, dark_pct double, bright_pct double, motion_pct double, signature array<double>"


def test_frame_verdicts(spark):
    df = spark.createDataFrame([frame(0, 0, 50.0), frame(1, 1, 50.0, motion=10.0), frame(2, 2, 50.0, tiles=11.0), frame(3, 3, brightness=5.0), frame(4, 4, brightness=250.0), frame(5, 5, motion=None)], FRAME)
    got = frames.score_frames(df).orderBy("frame_number").collect()
    assert [r.blur for r in got] == ["usable", "blurry", "usable", "sharp", "sharp", "sharp"]
    assert [r.exposure for r in got][3:5] == ["too_dark", "overexposed"] and got[5].motion == "unknown"
    assert df.filter("frame_number = 2").withColumn("tile_median", F.lit(40.0)).select(ex(frames.blur_reasons())).first()[0] == "insufficient_sharp_tiles"


def test_scenes_by_duration_view_and_tail(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    shots = [frame(n, n, signature=a if n < 10 else b) for n in range(45)]
    df = frames.score_frames(spark.createDataFrame(shots, FRAME))
    got = [(r.scene_index, r.boundary) for r in scenes.segment(df).orderBy("frame_number").collect()]
    assert got[9][0] == 0 and got[10] == (1, "hsv_drop_features_unavailable") and got[40] == (2, "maximum_scene_duration")
    again = [(r.scene_index, r.boundary) for r in scenes.segment(df.repartition(5)).orderBy("frame_number").collect()]
    assert got == again
    scened = df.join(scenes.segment(df).select("video_id", "frame_number", "scene_index"), ["video_id", "frame_number"]).filter("frame_number < 43")
    assert scenes.relabel(scened).filter("frame_number >= 40").select("scene_index").distinct().collect() == [(1,)]


def test_late_boundary_waits_for_a_good_frame(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    shots = [frame(n, n, sharpness=10.0 if 8 <= n < 12 else 150.0, signature=a if n < 8 else b) for n in range(20)]
    got = [r.scene_index for r in scenes.segment(frames.score_frames(spark.createDataFrame(shots, FRAME))).orderBy("frame_number").collect()]
    assert got == [0] * 12 + [1] * 8


def test_keyframes(spark):
    r = np.random.default_rng(1)
    view = [list(map(float, r.normal(size=16))) for _ in range(4)]
    shots = [frame(n, n * 2.0, sharpness=100.0 + n, signature=view[n % 4]) for n in range(12)]
    df = frames.score_frames(spark.createDataFrame(shots, FRAME)).withColumn("scene_index", F.lit(0))
    got = {x.frame_number: x.decision for x in keyframes.select_keyframes(df).collect()}
    assert [n for n, d in got.items() if d == "rejected_duplicate"] and set(n for n, d in got.items() if d != "rejected_duplicate") == {8, 9, 10, 11}
    assert sum(d == "selected_keyframe" for d in got.values()) >= 3
    assert [keyframes.least_for(d, 3) for d in (4, 12, 30)] == [1, 2, 3] and keyframes.least_for(30, 0) == 0
    near = [pd.DataFrame([(1, s, n, t, q, view[0])], columns=["video_id", "scene_index", "frame_number", "t", "sharpness", "signature"]).itertuples(index=False).__next__() for s, n, t, q in ((0, 0, 0.0, 5.0), (1, 1, 2.0, 9.0), (2, 2, 30.0, 9.0))]
    walk = keyframes.Neighbours(0.94, 8.0)
    assert [x for r in near for x in walk.push(r)] + walk.end() == [(1, 1, 1), (1, 2, 2)]


def test_minimum_fill_sees_all_frames(spark):
    view = [float(x) for x in np.random.default_rng(2).normal(size=16)]
    # videos 1 and 2 have one good frame, late, and their best other ones are later still; video 3 has enough
    sharp = {1: {20: 150.0}, 2: {16: 150.0}, 3: dict.fromkeys(range(40), 150.0)}
    other = [[float(x) for x in v] for v in np.random.default_rng(3).normal(size=(40, 16))]
    shots = [(v, *frame(n, n, sharp[v].get(n, 5.0 + n), signature=other[n] if v == 3 else view)[1:]) for v in sharp for n in range(40)]
    full = frames.score_frames(spark.createDataFrame(shots, FRAME)).withColumn("scene_index", F.lit(0))
    chosen = {(r.video_id, r.frame_number) for r in keyframes.select_keyframes(full).collect() if r.decision == "selected_keyframe"}
    rows, want = full.collect(), set()
    for v in sharp:
        own = [r for r in rows if r.video_id == v]
        times = [r.t for r in own if (v, r.frame_number) in chosen]
        for spaced in (True, False):
            for r in sorted(own, key=lambda r: (-r.quality, -r.sharpness, r.frame_number)):
                if len(times) < 3 and (v, r.frame_number) not in chosen | want and not (spaced and any(abs(r.t - x) < 2.0 for x in times)):
                    want.add((v, r.frame_number))
                    times.append(r.t)
    marked = keyframes._marked(full)
    assert marked.count() == len(rows) and {(r.video_id, r.frame_number) for r in marked.filter("selected").collect()} == chosen
    got = {(r.video_id, r.frame_number) for r in keyframes.fill_to_minimum(marked).collect()}
    assert got == want and {v for v, _ in got} == {1, 2} and max(n for _, n in got) >= 12


def views_by_brute_force(at, shots, most=3, apart=0.8):
    near = sorted(((-q / 200, t) for t, q in shots if abs(t - at) <= 6.0))
    chosen = [side[0][1] for side in ([x for x in near if x[1] < at], [x for x in near if x[1] > at]) if side]
    for _, t in near:
        if len(chosen) < most and t not in chosen and all(abs(t - c) >= apart for c in chosen):
            chosen.append(t)
    return chosen


def test_alternate_views_of_all_findings(spark):
    r = np.random.default_rng(6)
    shots = [(float(t), float(q)) for t, q in zip(np.arange(0, 40, 0.5), r.uniform(1, 300, 80), strict=True)]
    seen = [finding(i, np.round(r.uniform(0, 45), 1)) for i in range(20)]
    f = spark.createDataFrame([frame(n, t, q) for n, (t, q) in enumerate(shots)], FRAME)
    got = {(x.finding_id, x.t) for x in keyframes.alternate_views(keyframes._views(table(spark, *seen), f)).collect()}
    assert got == {(x[0], t) for x in seen for t in views_by_brute_force(x[2], shots)} and len({i for i, _ in got}) > 9


def test_registered_views_and_fill_cover_their_tables(spark):
    from framewright.plans import catalog
    from framewright.sources.views import view

    sf = "/root/testdata/sf0.001"
    shots, want = {}, set()
    for r in view(spark, sf, "frames").select("video_id", "t", "sharpness").collect():
        shots.setdefault(r.video_id, []).append((r.t, r.sharpness))
    for r in view(spark, sf, "findings").collect():
        want |= {r.finding_id for t, _ in shots[r.video_id] if 0 < abs(t - r.ts_s) <= 6.0}
    got = {r.finding_id for r in catalog.QUERIES["t07_alternate_views"](spark, sf).collect()}
    assert want <= got and any(i % 9 for i in got)
    picked = {}
    for r in catalog.QUERIES["t11_diverse_selection"](spark, sf).filter("decision = 'selected_keyframe'").collect():
        picked[r.video_id] = picked.get(r.video_id, 0) + 1
    filled = {}
    for r in catalog.QUERIES["t10_minimum_fill"](spark, sf).collect():
        filled[r.video_id] = filled.get(r.video_id, 0) + 1
    assert filled == {v: n for v, s in shots.items() if (n := min(len(s), 3) - picked.get(v, 0)) > 0}


def test_pixels():
    flat = np.full((16, 16), 128.0)
    assert pixels.sharpness(flat)[0] == 0 and pixels.exposure(flat)[0] == 128
    board = np.indices((16, 16)).sum(0) % 2 * 255.0
    assert pixels.sharpness(board)[0] > 1e5 and pixels.sharpness(board)[2] == 100
    mask = np.array([[1, 0, 1, 1], [1, 0, 0, 1], [1, 1, 1, 1], [0, 0, 0, 0], [0, 1, 0, 1]])
    assert sorted(pixels.components(mask)) == [(1, 1, 4, 1, 1), (1, 3, 4, 1, 1), (9, 0, 0, 4, 3)]
    assert abs(np.linalg.norm(pixels.hue_saturation(np.random.default_rng(0).integers(0, 256, (8, 8, 3)))) - 1) < 1e-9
    assert abs(pixels.brighten(np.full((4, 4), 50)).mean() - 107) < 1 and pixels.brighten(np.full((4, 4), 120)).mean() > 120
    square = np.array([[0, 0], [100, 0], [100, 100], [0, 100]], float)
    assert pixels.viewpoint_change(square, square, 640, 480) == 0 and pixels.viewpoint_change(square, square * 3 + 200, 640, 480) > 0.7
    ramp = np.tile(np.arange(18.0), (16, 1))
    assert pixels.difference_hash(ramp) == -1 and pixels.difference_hash(-ramp) == 0


@pytest.mark.parametrize("width", [0.5, 2.0, 50.0])
def test_range_joins_agree_with_nested_loops(spark, width):
    r = np.random.default_rng(7)
    points = [(int(k), int(r.integers(0, 3)), float(np.round(r.uniform(-20, 80), 1))) for k in range(150)]
    spans = [(int(k), int(r.integers(0, 3)), float(s), float(s + r.uniform(0, 9))) for k, s in enumerate(np.round(r.uniform(-20, 80, 40), 1))]
    p, s = spark.createDataFrame(points, "id long, k long, t double"), spark.createDataFrame(spans, "span long, k long, a double, b double")
    got = {(x.id, x.span) for x in interval_join(p, s, "k", "t", "a", "b", width).collect()}
    assert got == {(i, j) for i, k, t in points for j, m, a, b in spans if k == m and a <= t <= b}
    q = spark.createDataFrame([(i, k, t) for i, k, t in points[75:]], "other long, k long, u double")
    near = {x.id: x.other for x in nearest_join(p.limit(150).filter("id < 75"), q, "k", "t", "u", 1.5, "other", ["id"]).collect()}
    want = {}
    for i, k, t in points[:75]:
        options = sorted((abs(t - u), j) for j, m, u in points[75:] if m == k and abs(t - u) <= 1.5)
        if options:
            want[i] = options[0][1]
    assert near == want


def test_empty_inputs(spark):
    none = table(spark).limit(0)
    assert consolidate.consolidate(none).count() == 0 and consolidate.suppress(none).count() == 0 and policy.classify(none).count() == 0
    assert scenes.segment(frames.score_frames(spark.createDataFrame([], FRAME))).count() == 0
