"""Order-dependent operators without SQL, each against a plain version that looks at everything, on random small tables."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import consolidate, evaluate, keyframes, scenes
from framewright.operators.scenes import similarity
from framewright.plans import catalog

from .test_golden import FINDING

TEXTS = ["Water stain on the wall", "Possible water stain near window", "Crack along wall", "Visible crack on the wall near door", "Paint scuff", None, "the a"]


def findings(spark, seed, n, span):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        box = [float(np.round(x, 2)) for x in (*r.uniform(0, 0.4, 2), *r.uniform(0.1, 0.5, 2))]
        rows.append((i, int(r.integers(1, 4)), float(np.round(r.uniform(0, span), 1)), ["kitchen", "bath"][int(r.integers(0, 2))], ["wall_stain", "wall_crack"][int(r.integers(0, 2))], TEXTS[int(r.integers(0, len(TEXTS)))], float(np.round(r.uniform(0.2, 1), 2)), *box))
    return rows, spark.createDataFrame(rows, FINDING)


def words(text):
    return [consolidate.ALIASES.get(w, w) for w in re.findall("[a-z0-9]+", (text or "").lower()) if w not in consolidate.STOP_WORDS]


def text_score(a, b):
    x, y = words(a), words(b)
    if not x or not y:
        return 0.0
    return max(len(set(x) & set(y)) / len(set(x) | set(y)), difflib.SequenceMatcher(None, " ".join(x), " ".join(y)).ratio())


def overlap(a, b):
    w = max(0.0, min(a[7] + a[9], b[7] + b[9]) - max(a[7], b[7]))
    h = max(0.0, min(a[8] + a[10], b[8] + b[10]) - max(a[8], b[8]))
    union = a[9] * a[10] + b[9] * b[10] - w * h
    return w * h / union if union > 0 else 0.0


def by_time(rows):
    return sorted(rows, key=lambda r: (r[2], r[0]))


@pytest.mark.parametrize("seed", [1, 2])
def test_consolidation(spark, seed):
    rows, df = findings(spark, seed, 160, 60)
    limits, weights, clusters = consolidate.MergeLimits(), consolidate.WEIGHTS, []
    for row in by_time(rows):
        best = None
        for c in clusters:
            if c[0][1] != row[1] or c[0][3] != row[3] or c[0][4] != row[4] or max(m[2] for m in [*c, row]) - min(m[2] for m in [*c, row]) > limits.cluster_span:
                continue
            for m in c:
                over, text, gap = overlap(m, row), text_score(m[5], row[5]), abs(m[2] - row[2])
                score = (weights["time"] * max(0, 1 - gap / limits.pair_gap) + weights["room"] + weights["category"] + weights["region"] * over + weights["text"] * text) / (1 - weights["image"])
                if gap <= limits.pair_gap and over >= limits.blind_iou and text >= limits.blind_text and score >= limits.blind_score and (best is None or score > best[0]):
                    best = (score, c)
        if best:
            best[1].append(row)
        else:
            clusters.append([row])
    want = {m[0]: (min(x[0] for x in c), len(c)) for c in clusters for m in c}
    assert {r.finding_id: (r.cluster, r.members) for r in consolidate.consolidate(df).collect()} == want and len(clusters) < len(rows)


def test_consensus(spark):
    rows, df = findings(spark, 3, 120, 40)
    clusters = []
    for row in by_time(rows):
        own = words(row[5])
        for c in clusters:
            head = c[0]
            if head[1] == row[1] and head[3] == row[3] and abs(head[2] - row[2]) <= 4.0 and (text_score(head[5], row[5]) >= 0.45 or len(set(words(head[5])) & set(own)) >= 2):
                c.append(row)
                break
        else:
            clusters.append([row])
    want = sorted((min(m[0] for m in c), len(c), max(m[6] for m in c), len(c) >= 2 or max(m[6] for m in c) >= 0.9) for c in clusters)
    assert sorted(map(tuple, consolidate.consensus(df).collect())) == want


def test_suppression(spark):
    rows, df = findings(spark, 4, 150, 30)
    kept = []
    for row in sorted(rows, key=lambda r: (-r[6], r[0])):
        if not any(k[1] == row[1] and k[4] == row[4] and abs(k[2] - row[2]) <= 5.0 and overlap(k, row) >= 0.3 for k in kept):
            kept.append(row)
    assert sorted(r.finding_id for r in consolidate.suppress(df).collect()) == sorted(k[0] for k in kept) and len(kept) < len(rows)


def test_semantic_similarity(spark):
    rows, df = findings(spark, 5, 80, 40)
    known = {r[0]: r for r in rows}
    pairs = consolidate.compare_findings(df).collect()
    assert len(pairs) > 50
    for p in pairs:
        assert p.text == pytest.approx(text_score(known[p.finding_id][5], known[p.r_finding_id][5]), abs=1e-9)


def test_matching_one_to_one(spark):
    rows, df = findings(spark, 6, 60, 6)
    boxes = [(100 + i, r[1], float(np.round(r[2] + 0.05, 2)), r[4], r[7], r[8], r[9], r[10]) for i, r in enumerate(rows[::2])]
    truth = spark.createDataFrame(boxes, "box_id long, video_id long, ts_s double, category string, x double, y double, width double, height double")
    pairs = [p for p in evaluate.box_pairs(df, truth).collect() if p.reason == "verified_match"]
    taken, used, want = set(), set(), set()
    for f in sorted({p.finding_id for p in pairs}, key=lambda f: min((-p.overlap, p.finding_id, p.box_id) for p in pairs if p.finding_id == f)):
        free = sorted((p for p in pairs if p.finding_id == f and (p.video_id, p.box_id) not in taken), key=lambda p: (-p.overlap, p.box_id))
        if free:
            taken.add((free[0].video_id, free[0].box_id))
            want.add((f, free[0].box_id))
            used.add(f)
    assert {(r.finding_id, r.box_id) for r in evaluate.match_one_to_one(evaluate.box_pairs(df, truth)).collect()} == want and len(want) < len(pairs)


def scene(spark, seed, n):
    r = np.random.default_rng(seed)
    views = r.normal(size=(5, 16))
    rows = []
    for k in range(n):
        signature = None if k % 11 == 7 else [float(x) for x in views[int(r.integers(0, 5))] + r.normal(0, 0.12, 16)]
        rows.append((k % 2, k // 2 % 3, k, float(k), float(np.round(r.uniform(20, 90), 1)), float(np.round(r.uniform(20, 90), 1)), float(r.uniform(40, 220)), float(r.uniform(0, 20)), None if k % 7 == 3 else float(r.uniform(0, 25)), signature, ""))
    schema = "video_id long, scene_index int, frame_number long, t double, sharpness double, quality double, brightness_mean double, dark_pct double, motion_pct double, signature array<double>, reasons string"
    return rows, spark.createDataFrame(rows, schema).withColumn("bright_pct", F.lit(0.0))


def close(a, b):
    return 0.0 if a[9] is None or b[9] is None else similarity(np.array(a[9]), np.array(b[9]))


def heads_of(rows, threshold):
    heads, out = [], {}
    for r in sorted(rows, key=lambda r: (-r[4], -r[5], r[3])):
        out[r[2]] = next((h[2] for h in heads if close(r, h) >= threshold), r[2])
        if out[r[2]] == r[2]:
            heads.append(r)
    return out


def test_duplicate_clusters(spark):
    rows, df = scene(spark, 7, 120)
    want = {}
    for v in (0, 1):
        for s in (0, 1, 2):
            want |= heads_of([r for r in rows if r[:2] == (v, s)], 0.94)
    assert {r.frame_number: r.head for r in keyframes.duplicate_clusters(df).collect()} == want and len(set(want.values())) < len(want)


@pytest.mark.parametrize("limits", [keyframes.KeyframeLimits(), keyframes.KeyframeLimits(duplicate=0.999, most=5, worth=0.3), keyframes.KeyframeLimits(duplicate=0.5, least=8)])
def test_diverse_selection(spark, limits):
    rows, df = scene(spark, 8, 90)
    want = {}
    for v in (0, 1):
        for s in (0, 1, 2):
            own = [r for r in rows if r[:2] == (v, s)]
            heads = heads_of(own, limits.duplicate)
            left = [r for r in own if heads[r[2]] == r[2]]
            want |= {r[2]: ("rejected_duplicate", 0) for r in own if heads[r[2]] != r[2]}
            top = np.log1p(max(r[4] for r in left))
            needed, chosen = min(keyframes.least_for(own[-1][3] - own[0][3], limits.least), len(left), limits.most), []

            def worth(r, chosen=chosen, top=top):
                steady = 0.70 if r[8] is None else max(0, 1 - r[8] / limits.motion)
                base = limits.sharpness * np.log1p(r[4]) / top + limits.brightness * max(0, max(0, 1 - abs(r[6] - 127.5) / 127.5) - r[7] / 100) + limits.stability * steady
                if not chosen:
                    return base + limits.distinct + limits.spread
                return base + limits.distinct * (1 - max(close(r, k) for k in chosen)) + limits.spread * min(1.0, min(abs(r[3] - k[3]) for k in chosen) / limits.apart_s)

            while left and len(chosen) < limits.most:
                best = max(left, key=lambda r: (worth(r), -r[3]))
                if len(chosen) >= needed and worth(best) < limits.worth:
                    break
                chosen.append(best)
                left.remove(best)
                want[best[2]] = ("selected_keyframe", len(chosen))
            why = "rejected_scene_limit" if len(chosen) >= limits.most else "rejected_adaptive_selection"
            want |= {r[2]: (why, 0) for r in left}
    assert {r.frame_number: (r.decision, r.selection_rank) for r in keyframes.select_keyframes(df, limits).collect()} == want


@pytest.mark.parametrize("few", [1, 7, 10_000])
def test_quantiles_agree_with_sorting(spark, monkeypatch, few):
    from framewright.operators import quantiles as q

    monkeypatch.setattr(q, "FEW", few)
    monkeypatch.setattr(q, "BINS", 5)
    monkeypatch.setattr(q, "MOST_PASSES", 40)
    r = np.random.default_rng(6)
    groups = {1: r.normal(0, 1, 400), 2: np.full(300, 2.5), 3: np.array([7.0]), 4: np.concatenate([np.full(200, -1.0), [1e300, -1e300], np.arange(50.0)]), 5: np.array([1.0, 2.0]), 6: np.round(r.exponential(1, 300), 1)}
    rows = [(g, float(v), "x") for g, vs in groups.items() for v in vs] + [(1, None, "x"), (8, None, "x"), (None, 3.0, "x"), (None, 4.0, "x")]
    wanted = {"low": 0.0, "half": 0.5, "most": 0.95, "top": 1.0}
    df = spark.createDataFrame(rows, "g long, value double, rank string")
    got = {r.g: [r[k] for k in wanted] for r in q.quantiles(df.filter("g is not null"), ["g"], "value", wanted).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.allclose(got[g], [np.quantile(vs, p) for p in wanted.values()], rtol=1e-12)
    assert q.quantiles(df.limit(0), ["g"], "value", wanted).count() == 0


def test_prefixes_meet_both_ways(spark):
    from framewright.operators import jobs

    rules = [(1, "a/b/", True, True), (2, "a/", True, True), (3, "", True, True), (4, "a/b/c/d", True, True), (5, "b/", True, True), (6, "a/b/", False, True), (7, "a/b/", True, False), (8, None, True, True), (9, "ä/", True, True), (10, "a/c", True, True)]
    roots = ["a/b/c/", "ä/x", "q"]
    want = {i for i, p, e, x in rules if e and x and p is not None and any(p.startswith(r) or r.startswith(p) for r in roots)}
    df = jobs.conflicts(spark.createDataFrame(rules, "rule_id long, prefix string, enabled boolean, expires boolean"), spark.createDataFrame([(r,) for r in roots], "root string"))
    assert sorted(r.rule_id for r in df.collect()) == sorted(want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_neighbours_agree_with_a_plain_list(spark):
    from framewright.operators import keyframes

    r = np.random.default_rng(9)
    views = r.normal(size=(4, 16))
    rows = []
    for v in range(6):
        t, scene = 0.0, 0
        for n in range(60):
            t += float(r.choice([0.3, 1.0, 4.0]))
            scene += int(r.random() < 0.4)
            rows.append((v, scene, n, t, float(r.integers(0, 5)), [float(x) for x in views[r.integers(4)] + r.normal(0, 0.02, 16)]))
    want = []
    for v in range(6):
        kept = []
        for f in [x for x in rows if x[0] == v]:
            far = [k for k, o in enumerate(kept) if f[3] - o[3] > 8.0]
            near = [k for k, o in enumerate(kept) if k > max(far, default=-1) and abs(o[1] - f[1]) == 1 and keyframes.alike(keyframes.signature_of(o[5]), keyframes.signature_of(f[5])) >= 0.94]
            if not near:
                kept.append(f)
            elif f[4] > kept[near[-1]][4]:
                kept[near[-1]] = f
        want += [x[:3] for x in kept]
    df = spark.createDataFrame(rows, "video_id long, scene_index int, frame_number long, t double, sharpness double, signature array<double>")
    got = sorted(map(tuple, keyframes.remove_across_scenes(df).collect()))
    assert got == sorted(want) and len(got) < len(rows)


def test_change_scores_with_repeated_missing_and_empty_signatures(spark):
    """Images are compared by id, each pair once, however many frames show it."""
    images = {0: [1.0, 2.0, 4.0], 1: [3.0, 1.0, 0.0], 2: [5.0, 5.0, 5.0], 3: None, 4: [0.5, 0.25, 8.0]}
    shown = {7: [0, 1, 0, 4, 1, 2, 3, 9, None, 4, 0], 8: [None, 1, 1, 4, 0, 4]}
    frames = spark.createDataFrame([(v, n, 2.0 * n, None if n % 3 else 5.0, i) for v, ids in shown.items() for n, i in enumerate(ids)], "video_id long, frame_number long, t double, motion_pct double, signature_id long")
    signatures = spark.createDataFrame([*images.items(), (5, [])], "signature_id long, signature array<float>")
    told = scenes.change_scores(frames, signatures)
    assert "array<" not in str(told.schema) and "signature#" not in told._jdf.queryExecution().executedPlan().toString()
    got = {(r.video_id, r.frame_number): (r.prior, r.reference) for r in told.collect()}
    assert set(got) == {(v, n) for v, ids in shown.items() for n in range(3, len(ids))}
    array = lambda i: None if images.get(i) is None else np.array(images[i])
    for (v, n), values in got.items():
        want = [scenes.similarity(array(shown[v][k]), array(shown[v][n])) for k in (n - 1, 0)]
        assert np.allclose(values, want, atol=2e-6)


def test_similarities_are_told_once_for_equal_images():
    r, calls = np.random.default_rng(5), []
    images = [r.normal(size=8) for _ in range(6)]
    value = lambda a, b: calls.append(1) or similarity(a, b)
    shown = r.integers(0, 6, 2000).tolist()
    for arrays, pairs in ((4096, 16384), (4, 7)):  # also when all that was seen is forgotten on the way
        calls.clear()
        like, plain, known = scenes.Remembered(value, arrays, pairs), scenes.SceneState(), scenes.SceneState()
        for n, i in enumerate(shown):
            a = None if n % 11 == 0 else images[i].copy()
            args = (float(n), a, n % 5 == 0, None if n % 3 else 14.0, scenes.SceneLimits())
            assert plain.step(*args) == known.step(args[0], like.one(a), *args[2:], like=like)
        assert len(like.seen) <= arrays and len(like.told) <= pairs
        assert (arrays < 6) or len([c for c in calls]) <= 36 + 2 * (2000 // 11 + 1) * 3
    assert plain.scene > 10


@pytest.mark.parametrize(("name", "left"), [("t10_minimum_fill", 0), ("t10_fill_to_sixteen", 0), ("w13_adjacent_scene_duplicates", 1)])
def test_frames_are_segmented_once(spark, name, left):
    """Passes of the segmentation that are left in the result's plan: none where the selection is written before."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == left


def test_small_groups_are_sorted_in_tasks_of_a_fixed_size(spark, monkeypatch):
    from framewright.operators import quantiles as q

    monkeypatch.setattr(q, "SORTED", 50)
    df = spark.createDataFrame([(None if i % 30 == 0 else i % 30, float(i * 7919 % 601)) for i in range(600)], "g long, value double")
    told = q.quantiles(df, ["g"], "value", {"p95": 0.95})
    assert told.rdd.getNumPartitions() == 12  # more with more values: a task's memory doesn't grow
    want = {}
    for i in range(600):
        want.setdefault(None if i % 30 == 0 else i % 30, []).append(float(i * 7919 % 601))
    got = {r.g: r.p95 for r in told.collect()}
    assert set(got) == set(want) and all(abs(got[g] - np.quantile(v, 0.95)) < 1e-9 for g, v in want.items())  # rows without a key too
