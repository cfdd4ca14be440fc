"""Pixel kernels on gray images given as rows (height, width, pixels): sharpness, exposure, hashes, components, crops.

Images are independent rows, so the kernels run in Arrow batches on the executors, with NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import r6
from ..plans.registry import register


def laplacian(gray: np.ndarray) -> np.ndarray:
    """Second differences with mirrored borders (the edge pixel is not repeated)."""
    g = np.pad(gray.astype(float), 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray.astype(float), 1, mode="edge")
    return g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]


def sharpness(gray: np.ndarray, tiles: int = 3, least: float = 45.0) -> tuple[float, float, float]:
    """Variance of the Laplacian, the median over tiles, and the percentage of sharp tiles."""
    parts = [float(laplacian(t).var()) for row in np.array_split(gray, tiles, 0) for t in np.array_split(row, tiles, 1) if t.size]
    return float(laplacian(gray).var()), float(np.median(parts)), float(np.mean(np.array(parts) >= least) * 100)


def exposure(gray: np.ndarray, dark: int = 16, bright: int = 240) -> tuple[float, float, float, float, float]:
    p5, p95 = np.percentile(gray, [5, 95])
    return float(gray.mean()), float(p5), float(p95), float((gray <= dark).mean() * 100), float((gray >= bright).mean() * 100)


def hue_saturation(rgb: np.ndarray, hues: int = 50, levels: int = 60) -> np.ndarray:
    """A hue and saturation histogram of unit length."""
    c = rgb.reshape(-1, 3).astype(float)
    high, low = c.max(1), c.min(1)
    spread = np.where(high > low, high - low, 1)
    r, g, b = c.T
    hue = np.where(high == r, (g - b) / spread % 6, np.where(high == g, (b - r) / spread + 2, (r - g) / spread + 4)) * 30
    saturation = np.where(high > 0, (high - low) / np.where(high > 0, high, 1), 0) * 255
    # the least bit over an edge belongs to the bin above it, whatever the rounding
    row = np.minimum(np.floor(np.where(high > low, hue, 0) * hues / 180 + 1e-9), hues - 1)
    column = np.minimum(np.floor(saturation * levels / 256 + 1e-9), levels - 1)
    h = np.bincount((row * levels + column).astype(np.int64), minlength=hues * levels).astype(float)
    return h / max(np.sqrt(h @ h), 1e-12)


def average_to(gray: np.ndarray, rows: int, cols: int) -> np.ndarray:
    return np.array([[t.mean() for t in np.array_split(r, cols, 1)] for r in np.array_split(gray.astype(float), rows, 0)])


def difference_hash(gray: np.ndarray) -> int:
    """64 bits: whether each cell of a 8 x 9 average is brighter than the one on its left."""
    small = average_to(gray, 8, 9)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return int(np.packbits(bits).view(">u8")[0].astype(np.uint64).view(np.int64))


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Area, left, top, width, height of the 4-connected parts of a mask, in reading order: rows are cut into runs, and
    runs that touch are united."""
    runs, parent = [], []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[int] = []
    for y, row in enumerate(mask.astype(np.int8)):
        edge = np.diff(row, prepend=0, append=0)
        here = []
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            k = len(runs)
            runs.append((y, a, b))
            parent.append(k)
            for o in above:
                if runs[o][1] < b and a < runs[o][2]:
                    x, z = find(o), find(k)
                    parent[max(x, z)] = min(x, z)
            here.append(k)
        above = here
    out: dict[int, list[int]] = {}
    for k, (y, a, b) in enumerate(runs):
        r = out.setdefault(find(k), [0, a, y, b, y])
        r[0] += b - a
        r[1], r[3], r[4] = min(r[1], a), max(r[3], b), max(r[4], y)
    return [(n, x, y, x2 - x, y2 - y + 1) for n, x, y, x2, y2 in out.values()]


def brighten(gray: np.ndarray, target: float = 127.5, most: float = 60.0, contrast: float = 1.15) -> np.ndarray:
    """Shifts the mean towards ``target`` by at most ``most``, stretches around it, clips."""
    shift = max(-most, min(most, target - float(gray.mean())))
    return np.clip((gray.astype(float) + shift - target) * contrast + target, 0, 255).round().astype(np.uint8)


MEASURES = "video_id long, frame_number long, sharpness double, tile_median double, sharp_tiles_pct double, mean double, p05 double, p95 double, dhash long, parts int, largest int, bright_mean double"


def measure(images: DataFrame, wide: int = 8) -> DataFrame:
    """All measures of each image of ``images`` (video_id, frame_number, px: rows of ``wide`` gray values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in MEASURES.split(", ")]
        types = [pa.int64(), pa.int64(), *[pa.float64()] * 6, pa.int64(), pa.int32(), pa.int32(), pa.float64()]
        for batch in batches:
            out = []
            for v, n, px in zip(*(batch.column(k).to_pylist() for k in ("video_id", "frame_number", "px")), strict=True):
                gray = np.array(px, float).reshape(-1, wide)
                parts = components(gray >= 150)
                mean, p5, p95, *_ = exposure(gray)
                out.append((v, n, *sharpness(gray), mean, p5, p95, difference_hash(gray), len(parts), max((p[0] for p in parts), default=0), float(brighten(gray).mean())))
            cols = list(zip(*out, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return images.select(F.col("video_id").cast("long"), F.col("frame_number").cast("long"), "px").mapInArrow(run, MEASURES)


def from_images(images: DataFrame) -> DataFrame:
    """Rows of the ``image`` source as gray pixels (one channel as it is, more channels by their mean)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for o, w, h, c, d in zip(*(batch.column(k).to_pylist() for k in ("origin", "width", "height", "nChannels", "data")), strict=True):
                px = np.frombuffer(d, np.uint8).reshape(h, w, c).mean(2)
                out.append((o, w, px.ravel().tolist()))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.float64()))], names=["origin", "width", "px"])

    return images.select("image.origin", "image.width", "image.height", "image.nChannels", "image.data").mapInArrow(run, "origin string, width int, px array<double>")


register("f08_pixel_measures", "frame_px", measure)


def viewpoint_change(a: np.ndarray, b: np.ndarray, wide: float, high: float) -> float:
    """0 to 1: how far a quad has moved, grown and changed shape."""
    area = lambda q: max(1.0, abs(float(np.dot(q[:, 0], np.roll(q[:, 1], -1)) - np.dot(q[:, 1], np.roll(q[:, 0], -1)))) / 2)
    edges = lambda q: np.maximum(np.linalg.norm(np.roll(q, -1, 0) - q, axis=1), 1e-6)
    moved = float(np.linalg.norm(b.mean(0) - a.mean(0))) / max(1.0, float(np.hypot(wide, high)))
    grown, bent = abs(float(np.log(area(b) / area(a)))), float(np.std(np.log(edges(b) / edges(a))))
    return min(1.0, 0.45 * min(1.0, moved / 0.18) + 0.30 * min(1.0, grown / 0.65) + 0.25 * min(1.0, bent / 0.30))


def score_batches(frames: DataFrame, scorer, schema: str) -> DataFrame:
    """A scorer on batches of frames, with a fixed output: where a model is called, it is called here."""
    return frames.mapInPandas(lambda batches: (scorer(b) for b in batches), schema)


def rule_scorer(batch):
    import pandas as pd

    return pd.DataFrame({"video_id": batch["video_id"], "frame_number": batch["frame_number"], "score": np.clip(batch["sharpness"] / 100, 0, 1)})


register("y02_batch_scorer", "frames", lambda f: score_batches(f.select("video_id", "frame_number", "sharpness"), rule_scorer, "video_id long, frame_number long, score double"), "SELECT video_id, frame_number, greatest(0.0, least(1.0, sharpness / 100)) AS score FROM frames")


def parts_of(images: DataFrame, least: int = 150, wide: int = 8) -> DataFrame:
    """The 4-connected parts of bright pixels of each image (video_id, frame_number, px: rows of ``wide`` gray values)."""
    schema = pa.schema([("video_id", pa.int64()), ("frame_number", pa.int64()), *[(k, pa.int32()) for k in ("area", "x", "y", "width", "height")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v, n, px in zip(*(batch.column(k).to_pylist() for k in ("video_id", "frame_number", "px")), strict=True):
                out += [(v, n, *part) for part in components(np.array(px).reshape(-1, wide) >= least)]
            cols = list(zip(*out, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return images.select(F.col("video_id").cast("long"), F.col("frame_number").cast("long"), "px").mapInArrow(run, "video_id long, frame_number long, area int, x int, y int, width int, height int")


register(
    "f26_components", "frame_px", parts_of,
    """WITH RECURSIVE m AS (SELECT video_id, frame_number, i - 1 AS pos FROM (SELECT *, unnest(range(1, len(px) + 1)) AS i FROM frame_px) u WHERE px[i] >= 150),
r AS (SELECT video_id, frame_number, pos AS a, pos AS b FROM m UNION SELECT r.video_id, r.frame_number, r.a, m.pos FROM r JOIN m ON r.video_id = m.video_id AND r.frame_number = m.frame_number AND (abs(m.pos - r.b) = 8 OR (abs(m.pos - r.b) = 1 AND m.pos // 8 = r.b // 8))),
p AS (SELECT video_id, frame_number, b AS pos, min(a) AS root FROM r GROUP BY ALL)
SELECT CAST(video_id AS BIGINT) AS video_id, CAST(frame_number AS BIGINT) AS frame_number, CAST(count(*) AS INTEGER) AS area, CAST(min(pos % 8) AS INTEGER) AS x, CAST(min(pos // 8) AS INTEGER) AS y,
  CAST(max(pos % 8) - min(pos % 8) + 1 AS INTEGER) AS width, CAST(max(pos // 8) - min(pos // 8) + 1 AS INTEGER) AS height FROM p GROUP BY p.video_id, p.frame_number, root""",
)


def histograms(images: DataFrame) -> DataFrame:
    """The hue and saturation histogram of each image (video_id, frame_number, rgb: three values a pixel): one row for each
    bin that is not empty."""
    schema = pa.schema([("video_id", pa.int64()), ("frame_number", pa.int64()), ("bin", pa.int32()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v, n, rgb in zip(*(batch.column(k).to_pylist() for k in ("video_id", "frame_number", "rgb")), strict=True):
                h = hue_saturation(np.array(rgb).reshape(-1, 3))
                out += [(v, n, int(k), float(h[k])) for k in np.flatnonzero(h)]
            cols = list(zip(*out, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return images.select(F.col("video_id").cast("long"), F.col("frame_number").cast("long"), "rgb").mapInArrow(run, "video_id long, frame_number long, bin int, share double")


_HUE = "CASE WHEN hi = lo THEN 0.0 WHEN hi = r THEN CASE WHEN g < b THEN ((g - b) / (hi - lo) + 6) * 30 ELSE (g - b) / (hi - lo) * 30 END WHEN hi = g THEN ((b - r) / (hi - lo) + 2) * 30 ELSE ((r - g) / (hi - lo) + 4) * 30 END"
register(
    "f10_histogram", "frame_px",
    lambda i: histograms(i.withColumn("rgb", F.slice("px", 1, 63))).select("video_id", "frame_number", "bin", r6(F.col("share")).alias("share")),
    f"""WITH p AS (SELECT video_id, frame_number, CAST(px[i] AS DOUBLE) AS r, CAST(px[i + 1] AS DOUBLE) AS g, CAST(px[i + 2] AS DOUBLE) AS b FROM (SELECT *, unnest(range(1, 64, 3)) AS i FROM frame_px) u),
m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM p),
c AS (SELECT video_id, frame_number, CAST(least(49, floor(({_HUE}) * 50 / 180 + 1e-9)) * 60 + floor(CASE WHEN hi > 0 THEN (hi - lo) / hi * 255 ELSE 0 END * 60 / 256 + 1e-9) AS INTEGER) AS bin, count(*) AS n FROM m GROUP BY ALL)
SELECT CAST(video_id AS BIGINT) AS video_id, CAST(frame_number AS BIGINT) AS frame_number, bin, R6(n / sqrt(sum(n * n) OVER (PARTITION BY video_id, frame_number))) AS share FROM c""",
)


def brightened(images: DataFrame, target: float = 127.5, most: float = 60.0, contrast: float = 1.15) -> DataFrame:
    """Gray images (px) moved towards a mean and stretched around it, as expressions: ``shift`` and ``bright``."""
    mean = F.aggregate("px", F.lit(0.0), lambda s, x: s + x, lambda s: s / F.size("px"))
    shift = F.greatest(F.lit(-most), F.least(F.lit(most), F.lit(target) - mean))
    told = images.withColumn("shift", shift)
    return told.withColumn("bright", F.transform("px", lambda x: F.bround(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (x + F.col("shift") - target) * contrast + target)), 0).cast("int")))


register(
    "f25_region_gain", "frame_px", lambda i: brightened(i).select("video_id", "frame_number", r6(F.col("shift")).alias("shift"), F.array_join("bright", ",").alias("bright")),
    """WITH s AS (SELECT video_id, frame_number, px, greatest(-60.0, least(60.0, 127.5 - list_sum(px) / CAST(len(px) AS DOUBLE))) AS shift FROM frame_px)
SELECT video_id, frame_number, R6(shift) AS shift, array_to_string([CAST(round_even(least(255.0, greatest(0.0, (x + shift - 127.5) * 1.15 + 127.5)), 0) AS INTEGER) for x in px], ',') AS bright FROM s""",
)


def quads(lines: DataFrame) -> DataFrame:
    """Per frame the quad between its lines 1 and 2 (a) and the one between its lines 3 and 4 (b), corner by corner."""
    at = lambda n, c: F.max(F.when(F.col("line_no") == n, F.col(c)))
    corners = [(1, "1"), (1, "2"), (2, "2"), (2, "1")]
    quad = lambda shift: F.array(*[F.struct(at(n + shift, f"x{k}").cast("double").alias("x"), at(n + shift, f"y{k}").cast("double").alias("y")) for n, k in corners])
    return lines.filter("line_no <= 4").groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("line_no").alias("lines"), quad(0).alias("a"), quad(2).alias("b")).filter("n = 4 and lines = 4").drop("n", "lines")


def viewpoint(pairs: DataFrame, wide: float = 640.0, high: float = 480.0) -> DataFrame:
    """``change`` of each pair of quads (a, b: arrays of corners), as expressions: moved, grown and bent, 0 to 1."""
    nxt = lambda q, i: F.get(q, (i + 1) % 4)
    over = lambda q, f: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: f(F.get(q, i), nxt(q, i)))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    area = lambda q: F.greatest(F.lit(1.0), F.abs(total(over(q, lambda p, r: p["x"] * r["y"] - p["y"] * r["x"])))) / 2
    edges = lambda q: over(q, lambda p, r: F.greatest(F.lit(1e-6), F.sqrt((r["x"] - p["x"]) * (r["x"] - p["x"]) + (r["y"] - p["y"]) * (r["y"] - p["y"]))))
    mean = lambda q, k: total(F.transform(q, lambda p: p[k])) / 4
    a, b = F.col("a"), F.col("b")
    dx, dy = mean(b, "x") - mean(a, "x"), mean(b, "y") - mean(a, "y")
    moved = F.sqrt(dx * dx + dy * dy) / F.lit(max(1.0, float(np.hypot(wide, high))))
    with_edges = pairs.withColumns({"moved": moved, "grown": F.abs(F.log(area(b) / area(a))), "ratios": F.zip_with(edges(b), edges(a), lambda x, y: F.log(x / y))})
    centred = with_edges.withColumn("mid", total(F.col("ratios")) / 4)
    bent = F.sqrt(total(F.transform("ratios", lambda x: (x - F.col("mid")) * (x - F.col("mid")))) / 4)
    part = lambda w, x, full: w * F.least(F.lit(1.0), x / full)
    return centred.withColumn("change", F.least(F.lit(1.0), part(0.45, F.col("moved"), 0.18) + part(0.30, F.col("grown"), 0.65) + part(0.25, bent, 0.30)))


_QUAD = "SELECT frame_id, {k} AS k, {x} AS x, {y} AS y FROM lines WHERE line_no = {n}"
_CORNERS = " UNION ALL ".join(f"SELECT '{q}' AS q, * FROM ({_QUAD.format(k=k, x=f'CAST(x{e} AS DOUBLE)', y=f'CAST(y{e} AS DOUBLE)', n=n + s)}) u" for q, s in (("a", 0), ("b", 2)) for k, (n, e) in enumerate(((1, 1), (1, 2), (2, 2), (2, 1))))
register(
    "f20_viewpoint_change", "lines", lambda x: viewpoint(quads(x)).select("frame_id", r6(F.col("change")).alias("change")),
    f"""WITH c AS ({_CORNERS}), e AS (SELECT p.q, p.frame_id, p.k, p.x, p.y, p.x * n.y - p.y * n.x AS turn, greatest(1e-6, sqrt((n.x - p.x) ** 2 + (n.y - p.y) ** 2)) AS edge
  FROM c p JOIN c n ON p.q = n.q AND p.frame_id = n.frame_id AND n.k = (p.k + 1) % 4),
g AS (SELECT q, frame_id, sum(x) / 4 AS mx, sum(y) / 4 AS my, greatest(1.0, abs(sum(turn))) / 2 AS area FROM e GROUP BY ALL HAVING count(*) = 4 AND count(DISTINCT k) = 4),
s AS (SELECT a.frame_id, stddev_pop(ln(b.edge / a.edge)) AS bent FROM e a JOIN e b ON a.q = 'a' AND b.q = 'b' AND a.frame_id = b.frame_id AND a.k = b.k GROUP BY ALL)
SELECT frame_id, R6(least(1.0, 0.45 * least(1.0, sqrt((b.mx - a.mx) ** 2 + (b.my - a.my) ** 2) / 800.0 / 0.18) + 0.3 * least(1.0, abs(ln(b.area / a.area)) / 0.65) + 0.25 * least(1.0, bent / 0.3))) AS change
FROM g a JOIN g b USING (frame_id) JOIN s USING (frame_id) WHERE a.q = 'a' AND b.q = 'b'""",
)
