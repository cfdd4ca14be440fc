"""Features, visual similarity, and comparison and merging of findings by all signals, against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import consolidate, evidence, scenes

from .test_brute_force import by_time, findings, overlap, text_score
from .test_golden import FINDING

IMAGE = "image_id long, px array<int>, signature array<double>"


def r5(x):
    return float(np.floor(x * 1e5 + 0.5) / 1e5)


def descriptors(px):
    g = np.array(px).reshape(8, 8)
    out = []
    for y in range(5):
        for x in range(5):
            w = g[y : y + 4, x : x + 4].ravel()
            out.append(sum(1 << k for k, v in enumerate(w) if v * 16 > w.sum()))
    return out


def feature(a, b):
    """similarity, good matches, share of coherent ones."""
    shifts = []
    for i, u in enumerate(a):
        near = sorted((bin(u ^ v).count("1"), j) for j, v in enumerate(b))
        if near[0][0] < 0.75 * near[1][0]:
            j = near[0][1]
            shifts.append((j // 5 - i // 5, j % 5 - i % 5))
    ratio = max(map(shifts.count, shifts)) / len(shifts) if len(shifts) >= 6 else None
    return r5(min(1, len(shifts) / 8) * (0.25 if ratio is None else 0.4 + 0.6 * ratio)), len(shifts), ratio


def correlation(a, b):
    a, b = np.array(a, float), np.array(b, float)
    if a.std() == 0 or b.std() == 0:
        return 1.0
    return r5(min(1, max(0, ((a - a.mean()) * (b - b.mean())).mean() / (a.std() * b.std()))))


def hashed(px, wide):
    return [px[i] > px[i - 1] for i in range(len(px)) if i % wide]


def agree(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / len(a)


def whole(a, b):
    hsv, bits, local = correlation(a[2], b[2]), agree(hashed(a[1], 8), hashed(b[1], 8)), feature(descriptors(a[1]), descriptors(b[1]))[0]
    return r5(0.45 * hsv + 0.25 * bits + 0.3 * local)


def part(px, f):
    at = lambda low, size, k: min(7, max(0, int(np.floor((low + size * (k + 0.5) / 4) * 8))))
    return [px[at(f[8], f[10], k // 4) * 8 + at(f[7], f[9], k % 4)] for k in range(16)]


def compared(m, row, shown):
    """score and reasons of two findings of one video, room and category."""
    over, text, gap = r5(overlap(m, row)), r5(text_score(m[5], row[5])), abs(m[2] - row[2])
    centre = r5(np.hypot(m[7] + m[9] / 2 - row[7] - row[9] / 2, m[8] + m[10] / 2 - row[8] - row[10] / 2))
    time = r5(max(0, 1 - gap / 12))
    a, b = shown.get(m[0]), shown.get(row[0])
    reasons = ["gap"] if gap > 12 else []
    if over < 0.05 and centre > 0.22:
        reasons.append("region_location_changed")
    if a is None or b is None:
        score = r5((0.15 * time + 0.35 + 0.2 * over + 0.15 * text) / 0.85)
        reasons += [n for n, low in (("metadata_only_bbox_iou_too_low", over < 0.3), ("metadata_only_semantic_similarity_too_low", text < 0.65), ("metadata_only_score_too_low", score < 0.78)) if low]
        return score, reasons
    image, p, q = whole(a, b), part(a[1], m), part(b[1], row)
    region = r5(0.7 * r5(0.65 * correlation(p, q) + 0.35 * agree(hashed(p, 4), hashed(q, 4))) + 0.3 * over)
    score = r5(0.15 * time + 0.35 + 0.15 * image + 0.2 * region + 0.15 * text)
    reasons += [n for n, low in (("whole_image_similarity_too_low", image < 0.55), ("region_similarity_too_low", region < 0.5), ("semantic_similarity_too_low", text < 0.4), ("weighted_score_too_low", score < 0.68)) if low]
    return score, reasons


def pictures(seed, n=12):
    r = np.random.default_rng(seed)
    scenes_ = [r.integers(0, 256, 64) for _ in range(3)]
    rows = []
    for k in range(n):
        px = np.clip(scenes_[k % 3] + r.integers(-6, 7, 64), 0, 255)
        rows.append((k, [int(x) for x in px], [float(x) for x in px / 255]))
    return rows


@pytest.mark.parametrize("share", [0.0, 0.7, 1.0])
def test_merging_by_all_signals(spark, share):
    rows, df = findings(spark, 11, 140, 50)
    images, r = pictures(5), np.random.default_rng(1)
    known = {x[0]: x for x in images}
    links = [(f[0], int(f[2] // 8) % 4 * 3 if r.random() < share else None) for f in rows] + [(10_000, 3)]
    links[7] = (links[7][0], 777)  # an image that isn't there
    shown = {i: known.get(k) for i, k in links if k in known}
    clusters = []
    for row in by_time(rows):
        best = None
        for n, c in enumerate(clusters):
            if any(c[0][k] != row[k] for k in (1, 3, 4)) or row[2] - min(m[2] for m in c) > 20:
                continue
            for m in c:
                score, reasons = compared(m, row, shown)
                if not reasons and (best is None or score > best[0]):
                    best = (score, n)
        if best:
            clusters[best[1]].append(row)
        else:
            clusters.append([row])
    want = {m[0]: (min(x[0] for x in c), len(c)) for c in clusters for m in c}
    linked = spark.createDataFrame(links, "finding_id long, image_id long")
    pictures_ = spark.createDataFrame(images, IMAGE)
    got = {x.finding_id: (x.cluster, x.members) for x in evidence.consolidate_evidence(df, linked, pictures_).collect()}
    assert got == want and len(clusters) < len(rows)
    by_id = {x[0]: x for x in rows}
    pairs = evidence.compare_evidence(df, linked, pictures_).collect()
    for p in pairs:
        score, reasons = compared(by_id[p.finding_id], by_id[p.r_finding_id], shown)
        assert (p.score, p.reasons, p.merge) == (pytest.approx(score, abs=1.1e-5), ",".join(reasons), not reasons)
    assert (share == 0) == (not any(p.image is not None for p in pairs))
    if share == 0:  # then it is the merging without images
        assert {x.finding_id: x.cluster for x in consolidate.consolidate(df).collect()} == {k: v[0] for k, v in got.items()}


def test_five_views_of_one_stain_become_one_issue(spark):
    images = [(k, [int(x) for x in np.roll(np.arange(64) * 4 % 256, 0)], [0.1 * j for j in range(8)]) for k in range(5)] + [(9, [int(x) for x in 255 - np.arange(64) * 4 % 256], [0.1 * (8 - j) for j in range(8)])]
    times = [268.0, 270.0, 271.0, 274.0, 276.0]
    say = "Possible staining near bathroom vanity"
    rows = [(k, 1, t, "bathroom", "visible_staining", say, 0.8 + k / 100, 0.39 + k * 0.002, 0.48, 0.22, 0.25) for k, t in enumerate(times)]
    rows.append((9, 1, 271.5, "bathroom", "visible_staining", "Dark stain near shower ceiling", 0.8, 0.04, 0.04, 0.16, 0.14))
    rows += [(20, 1, 270.0, "bedroom", "visible_staining", say, 0.8, 0.39, 0.48, 0.22, 0.25), (21, 1, 270.0, "bathroom", "wall_stain", say, 0.8, 0.39, 0.48, 0.22, 0.25), (22, 1, 300.0, "bathroom", "visible_staining", say, 0.8, 0.39, 0.48, 0.22, 0.25)]
    df = spark.createDataFrame(rows, FINDING)
    links = spark.createDataFrame([(k, k) for k in (0, 1, 2, 3, 4, 9)], "finding_id long, image_id long")
    got = {x.finding_id: x.cluster for x in evidence.consolidate_evidence(df, links, spark.createDataFrame(images, IMAGE)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 9: 9, 20: 20, 21: 21, 22: 22}
    pairs = evidence.compare_evidence(df, links, spark.createDataFrame(images, IMAGE))
    assert "region_location_changed" in pairs.filter("r_finding_id = 9 or finding_id = 9").first().reasons


def test_features_agree_with_a_plain_matcher(spark):
    r = np.random.default_rng(8)
    base = r.integers(0, 256, (8, 8))
    grids = [base, np.roll(base, 1, 1), r.integers(0, 256, (8, 8)), np.full((8, 8), 7)]
    rows = [(k, [int(x) for x in g.ravel()]) for k, g in enumerate(grids)] + [(4, [1, 2, 3]), (5, None)]
    df = spark.createDataFrame(rows, "k long, px array<int>").withColumn("features", evidence.features_of("px"))
    pairs = df.select(F.col("k").alias("a"), F.col("features").alias("fa")).crossJoin(df.select(F.col("k").alias("b"), F.col("features").alias("fb")))
    for p in evidence.matched(pairs, "fa", "fb").collect():
        if max(p.a, p.b) > 3:
            assert (p.feature_similarity, p.good_matches, p.inlier_ratio) == (None, 0, None)
            continue
        a, b = (descriptors(rows[k][1]) for k in (p.a, p.b))
        assert (p.fa, p.fb) == (a, b)
        value, good, ratio = feature(a, b)
        assert (p.feature_similarity, p.good_matches) == (pytest.approx(value), good) and (p.inlier_ratio is None if ratio is None else p.inlier_ratio == pytest.approx(ratio))
        assert evidence.feature_value(np.array(a), np.array(b)) == pytest.approx(value)
    same, moved, other = (feature(descriptors(rows[0][1]), descriptors(rows[k][1]))[0] for k in (0, 1, 2))
    assert same == 1.0 and moved > other
    assert evidence.feature_value(None, np.array([1, 2])) is None


def test_boundaries_with_features():
    c = scenes.SceneLimits()
    at = lambda prior, reference, features, elapsed=10.0, motion=None: scenes.boundary(prior, reference, elapsed, motion, c, features)
    assert at(0.3, 0.3, (0.05, 0.05)) == (True, "hsv_and_feature_drop")
    assert at(0.3, 0.3, (None, None)) == (True, "hsv_drop_features_unavailable")
    assert at(0.3, 0.3, (0.05, 0.05), elapsed=2.0) == (False, "suppressed_by_minimum_scene_duration")
    assert at(0.9, 0.2, (0.9, 0.1)) == (True, "stable_view_differs_from_scene_reference")
    assert at(0.55, 0.5, (0.5, 0.4)) == (True, "scene_reference_divergence")
    assert at(0.9, 0.9, (0.9, 0.9)) == (False, "similar_scene")
    assert at(0.9, 0.9, (0.9, 0.9), elapsed=30.0) == (True, "maximum_scene_duration")
    # features that agree hold a scene together when colours drop
    assert at(0.3, 0.3, (1.0, 1.0))[1] != "hsv_and_feature_drop"
    state = scenes.SceneState()
    calls = []
    value = lambda a, b: calls.append((a, b)) or None
    assert [state.step(float(t), np.array([1.0, 2.0, t % 2]), False, None, c, np.array([t]), value)[0] for t in range(3)] == [0, 0, 0]
    assert [None if a is None else a.tolist() for a, _ in calls] == [None, None, [0], [0], [1], [0]]  # the frame before, the scene's first
