"""Signals over time: pairs of consecutive frames, flicker, localized motion, recurrence in the grid, line geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import ex, r6
from ..plans.registry import register

def by_video():
    return Window.partitionBy("video_id").orderBy("frame_number")


def pearson(a: str, b: str):
    """Correlation of two arrays of one length, clamped to 0..1."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(x)
    ma, mb = mean(a), mean(b)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)
    cov = total(F.zip_with(a, b, lambda x, y: (x.cast("double") - ma) * (y.cast("double") - mb)))
    va = total(F.transform(a, lambda x: (x.cast("double") - ma) * (x.cast("double") - ma)))
    vb = total(F.transform(b, lambda x: (x.cast("double") - mb) * (x.cast("double") - mb)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).otherwise(1.0)))


def pixel_pairs(px: DataFrame) -> DataFrame:
    """Each frame beside the one before it in its video."""
    return px.withColumns({"prior": F.lag("px").over(by_video()), "prior_signature": F.lag("signature").over(by_video()), "prior_frame": F.lag("frame_number").over(by_video())}).filter("prior is not null")


def mean_of(xs):
    return F.aggregate(xs, F.lit(0), lambda s, v: s + v).cast("double") / F.size(xs)


def pair_signals(px: DataFrame) -> DataFrame:
    """Change of mean brightness and mean absolute difference of consecutive frames."""
    return pixel_pairs(px).select(
        "video_id", "frame_number", F.abs(mean_of("px") - mean_of("prior")).alias("brightness_delta"), mean_of(F.zip_with("px", "prior", lambda a, b: F.abs(a - b))).alias("difference"),
        (F.size(F.filter(F.zip_with("px", "prior", lambda a, b: F.abs(a - b)), lambda d: d >= 25)) / F.size("px")).alias("residual"),
    )


_PAIRS = "pairs AS (SELECT *, lag(px) OVER w AS prior, lag(signature) OVER w AS prior_signature FROM frame_px WINDOW w AS (PARTITION BY video_id ORDER BY frame_number))"
_SIGNALS = f"""{_PAIRS}, signals AS (SELECT video_id, frame_number, abs(list_avg(px) - list_avg(prior)) AS brightness_delta,
  list_avg([abs(z[1] - z[2]) for z in list_zip(px, prior)]) AS difference, len([1 for z in list_zip(px, prior) if abs(z[1] - z[2]) >= 25]) / CAST(len(px) AS DOUBLE) AS residual FROM pairs WHERE prior IS NOT NULL)"""
register("w01_pair_deltas", "frame_px", lambda p: pair_signals(p).select("video_id", "frame_number", r6(F.col("brightness_delta")).alias("brightness_delta"), r6(F.col("difference")).alias("difference")), f"WITH {_SIGNALS} SELECT video_id, frame_number, R6(brightness_delta) AS brightness_delta, R6(difference) AS difference FROM signals")
register("f13_residual_fraction", "frame_px", lambda p: pair_signals(p).select("video_id", "frame_number", r6(F.col("residual")).alias("residual")), f"WITH {_SIGNALS} SELECT video_id, frame_number, R6(residual) AS residual FROM signals")


def flicker(px: DataFrame, least_delta: float = 3.0, least_ratio: float = 0.05) -> DataFrame:
    """Videos whose brightness jumps (95th percentile) without as much other change."""
    p = pair_signals(px).groupBy("video_id").agg(F.percentile("brightness_delta", 0.95).alias("b"), F.percentile("difference", 0.95).alias("d"))
    ratio = F.when(F.col("d") > 0, F.col("b") / F.col("d")).otherwise(0.0)
    return p.select("video_id", r6(F.col("b")).alias("brightness_p95"), r6(F.col("d")).alias("difference_p95"), r6(ratio).alias("ratio"), ((F.col("b") >= least_delta) & (ratio >= least_ratio)).alias("flickers"))


register(
    "a06_flicker", "frame_px", flicker,
    f"""WITH {_SIGNALS}, p AS (SELECT video_id, quantile_cont(brightness_delta, 0.95) AS b, quantile_cont(difference, 0.95) AS d FROM signals GROUP BY video_id)
SELECT video_id, R6(b) AS brightness_p95, R6(d) AS difference_p95, R6(CASE WHEN d > 0 THEN b / d ELSE 0.0 END) AS ratio, b >= 3.0 AND CASE WHEN d > 0 THEN b / d ELSE 0.0 END >= 0.05 AS flickers FROM p""",
)
register(
    "f05_histogram_correlation", "frame_px", lambda p: pixel_pairs(p).select("video_id", "frame_number", r6(pearson("signature", "prior_signature")).alias("similarity")),
    f"""WITH {_PAIRS} SELECT video_id, frame_number, R6(greatest(0.0, least(1.0, (SELECT corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE)) FROM (SELECT unnest(signature) AS a, unnest(prior_signature) AS b))))) AS similarity
FROM pairs WHERE prior IS NOT NULL""",
)
register(
    "f09_pixel_exposure", "frame_px",
    lambda p: p.select("video_id", "frame_number", r6(mean_of("px")).alias("mean"), r6(F.size(F.filter("px", lambda v: v <= 100)) * 100.0 / F.size("px")).alias("dark_pct"), r6(F.size(F.filter("px", lambda v: v >= 150)) * 100.0 / F.size("px")).alias("bright_pct")),
    "SELECT video_id, frame_number, R6(list_avg(px)) AS mean, R6(len([1 for v in px if v <= 100]) * 100.0 / len(px)) AS dark_pct, R6(len([1 for v in px if v >= 150]) * 100.0 / len(px)) AS bright_pct FROM frame_px",
)


def difference_hash(px: str = "px", wide: int = 8):
    """56 bits of an 8 x 8 grid: whether a pixel is brighter than the one on its left."""
    bits = F.filter(F.sequence(F.lit(0), F.size(px) - 1), lambda i: i % wide != 0)
    return F.transform(bits, lambda i: (F.element_at(px, (i + 1).cast("int")) > F.element_at(px, i.cast("int"))).cast("int"))


register(
    "f11_dhash_agreement", "frame_px",
    lambda p: pixel_pairs(p).withColumns({"a": difference_hash("px"), "b": difference_hash("prior")}).select("video_id", "frame_number", r6(F.aggregate(F.zip_with("a", "b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v) / F.size("a")).alias("agreement")),
    f"""WITH {_PAIRS} SELECT video_id, frame_number, R6(len([1 for i in range(1, 65) if (i - 1) % 8 <> 0 AND (px[i] > px[i - 1]) = (prior[i] > prior[i - 1])]) / 56.0) AS agreement FROM pairs WHERE prior IS NOT NULL""",
)
register(
    "y01_image_table_join", "frame_px image_uses",
    lambda p, u: p.select(F.col("frame_number").alias("image_id"), mean_of("px").alias("light")).join(u, "image_id").groupBy("video_id").agg(F.count(F.lit(1)).alias("loaded"), r6(F.avg("light")).alias("light")),
    "WITH i AS (SELECT frame_number AS image_id, list_avg(px) AS light FROM frame_px) SELECT u.video_id, count(*) AS loaded, R6(avg(light)) AS light FROM image_uses u JOIN i ON i.image_id = u.image_id GROUP BY u.video_id",
)

# The grid of residual motion
PER_PAIR = "case_id, pair_index"


def grid_per_pair(cells: DataFrame) -> DataFrame:
    """Of each pair: the sum, the largest and the second largest residual, and where the largest is."""
    ranked = cells.withColumn("n", F.row_number().over(Window.partitionBy("case_id", "pair_index").orderBy(F.col("residual_fraction").desc(), "row_no", "col_no")))
    first = lambda c, n: F.max(F.when(F.col("n") == n, F.col(c)))
    return ranked.groupBy("case_id", "pair_index", "stabilized").agg(F.sum("residual_fraction").alias("total"), first("residual_fraction", 1).alias("top"), first("residual_fraction", 2).alias("second"), first("row_no", 1).alias("top_row"), first("col_no", 1).alias("top_col"))


_GRID = """ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id, pair_index ORDER BY residual_fraction DESC, row_no, col_no) AS n FROM grid_cells),
grid AS (SELECT case_id, pair_index, stabilized, sum(residual_fraction) AS total, max(CASE WHEN n = 1 THEN residual_fraction END) AS top, max(CASE WHEN n = 2 THEN residual_fraction END) AS second,
  max(CASE WHEN n = 1 THEN row_no END) AS top_row, max(CASE WHEN n = 1 THEN col_no END) AS top_col FROM ranked GROUP BY ALL)"""
register(
    "a11_grid_residual", "grid_cells", lambda c: grid_per_pair(c).select("case_id", "pair_index", r6(F.col("total")).alias("total"), r6(F.col("top")).alias("top"), r6(F.col("second")).alias("second"), r6(ex("try_divide(top, second)")).alias("ratio")),
    f"WITH {_GRID} SELECT case_id, pair_index, R6(total) AS total, R6(top) AS top, R6(second) AS second, R6(top / nullif(second, 0)) AS ratio FROM grid",
)
register(
    "a08_localized_motion", "grid_cells",
    lambda c: grid_per_pair(c).groupBy("case_id").agg(F.count(F.lit(1)).alias("pairs"), r6(F.count_if(~F.col("stabilized")) / F.count(F.lit(1))).alias("failure_rate"), r6(F.percentile(F.when(F.col("stabilized"), F.col("top")), 0.95)).alias("top_p95"), r6(F.max(F.when(F.col("stabilized"), F.col("top")))).alias("top_max")),
    f"WITH {_GRID} SELECT case_id, count(*) AS pairs, R6(count(*) FILTER (WHERE NOT stabilized) / CAST(count(*) AS DOUBLE)) AS failure_rate, R6(quantile_cont(top, 0.95) FILTER (WHERE stabilized)) AS top_p95, R6(max(top) FILTER (WHERE stabilized)) AS top_max FROM grid GROUP BY case_id",
)
register(
    "a07_feature_summary", "grid_cells",
    lambda c: grid_per_pair(c).groupBy("case_id").agg(r6(F.max("total")).alias("total_max"), r6(F.percentile("total", 0.95)).alias("total_p95"), r6(F.percentile("second", 0.95)).alias("second_p95")),
    f"WITH {_GRID} SELECT case_id, R6(max(total)) AS total_max, R6(quantile_cont(total, 0.95)) AS total_p95, R6(quantile_cont(second, 0.95)) AS second_p95 FROM grid GROUP BY case_id",
)
register(
    "a09_concentration_gap", "grid_cells",
    lambda c: grid_per_pair(c).withColumn("gap", F.col("top") - F.col("second")).groupBy("case_id").agg(r6(F.percentile("gap", 0.95)).alias("p95"), r6(F.median("gap")).alias("median"), r6(F.max("gap")).alias("max")),
    f"WITH {_GRID} SELECT case_id, R6(quantile_cont(top - second, 0.95)) AS p95, R6(median(top - second)) AS median, R6(max(top - second)) AS max FROM grid GROUP BY case_id",
)
register(
    "t02_top_events", "grid_cells",
    lambda c: grid_per_pair(c).withColumn("n", F.row_number().over(Window.partitionBy("case_id").orderBy((F.col("top") - F.col("second")).desc(), "pair_index"))).filter("n <= 5").select("case_id", "pair_index", "n"),
    f"WITH {_GRID} SELECT case_id, pair_index, CAST(row_number() OVER (PARTITION BY case_id ORDER BY top - second DESC, pair_index) AS INTEGER) AS n FROM grid QUALIFY n <= 5",
)


def recurrence(cells: DataFrame, size: int = 8) -> DataFrame:
    """The modal top cell of each case, the share of the three commonest, and the 3 x 3 neighbourhood with most energy."""
    tops = grid_per_pair(cells).groupBy("case_id", "top_row", "top_col").agg(F.count(F.lit(1)).alias("times"))
    ranked = tops.withColumn("n", F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("times").desc(), "top_row", "top_col")))
    modal = ranked.groupBy("case_id").agg(F.max(F.when(F.col("n") == 1, F.col("top_row"))).alias("row_no"), F.max(F.when(F.col("n") == 1, F.col("top_col"))).alias("col_no"), r6(F.sum(F.when(F.col("n") <= 3, F.col("times")).otherwise(0)) / F.sum("times")).alias("top3_share"))
    near = F.filter(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.struct((F.col("row_no") + F.floor(i / 3) - 1).cast("int").alias("r"), (F.col("col_no") + i % 3 - 1).cast("int").alias("c"))), lambda p: p["r"].between(0, size - 1) & p["c"].between(0, size - 1))
    energy = cells.groupBy("case_id", "row_no", "col_no").agg(F.sum(F.floor(F.col("residual_fraction") * 1e9)).alias("e")).select("case_id", "e", F.explode(near).alias("p")).groupBy("case_id", "p.r", "p.c").agg(F.sum("e").alias("e"))
    best = energy.groupBy("case_id").agg(F.min_by(F.struct("r", "c"), F.struct(-F.col("e"), "r", "c")).alias("b")).select("case_id", F.col("b.r").alias("centre_row"), F.col("b.c").alias("centre_col"))
    return modal.join(best, "case_id")


register(
    "a10_spatial_recurrence", "grid_cells", recurrence,
    f"""WITH {_GRID}, tops AS (SELECT case_id, top_row, top_col, count(*) AS times FROM grid GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY times DESC, top_row, top_col) AS n FROM tops),
modal AS (SELECT case_id, max(CASE WHEN n = 1 THEN top_row END) AS row_no, max(CASE WHEN n = 1 THEN top_col END) AS col_no, R6(sum(CASE WHEN n <= 3 THEN times ELSE 0 END) / CAST(sum(times) AS DOUBLE)) AS top3_share FROM r GROUP BY case_id),
cell AS (SELECT case_id, row_no, col_no, sum(floor(residual_fraction * 1e9)) AS e FROM grid_cells GROUP BY ALL), grid_rc AS (SELECT CAST(a AS INTEGER) AS r, CAST(b AS INTEGER) AS c FROM range(0, 8) x(a), range(0, 8) y(b)),
hood AS (SELECT case_id, r, c, sum(e) AS e FROM cell JOIN grid_rc ON abs(row_no - r) <= 1 AND abs(col_no - c) <= 1 GROUP BY ALL), best AS (SELECT case_id, r AS centre_row, c AS centre_col FROM hood QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY e DESC, r, c) = 1)
SELECT case_id, row_no, col_no, top3_share, centre_row, centre_col FROM modal JOIN best USING (case_id)""",
)


def longest_runs(cells: DataFrame, size: int = 8) -> DataFrame:
    """For each case the longest run of consecutive pairs whose top cell stays within one 3 x 3 neighbourhood."""
    tops = grid_per_pair(cells).withColumn("n", F.row_number().over(Window.partitionBy("case_id").orderBy("pair_index")))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    inside = tops.select("case_id", "n", F.explode(steps).alias("s"), "top_row", "top_col").select("case_id", "n", (F.col("top_row") + F.col("s.a")).alias("r"), (F.col("top_col") + F.col("s.b")).alias("c")).filter(F.col("r").between(0, size - 1) & F.col("c").between(0, size - 1))
    island = inside.withColumn("g", F.col("n") - F.row_number().over(Window.partitionBy("case_id", "r", "c").orderBy("n")))
    return island.groupBy("case_id", "r", "c", "g").agg(F.count(F.lit(1)).alias("run")).groupBy("case_id").agg(F.max("run").alias("longest"))


register(
    "w07_longest_run", "grid_cells", longest_runs,
    f"""WITH {_GRID}, o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pair_index) AS k FROM grid), grid_rc AS (SELECT a AS r, b AS c FROM range(0, 8) x(a), range(0, 8) y(b)),
i AS (SELECT case_id, k, r, c, k - row_number() OVER (PARTITION BY case_id, r, c ORDER BY k) AS g FROM o JOIN grid_rc ON abs(top_row - r) <= 1 AND abs(top_col - c) <= 1),
n AS (SELECT case_id, r, c, g, count(*) AS run FROM i GROUP BY ALL) SELECT case_id, max(run) AS longest FROM n GROUP BY case_id""",
)
register(
    "f27_component_filter", "frame_px",
    lambda p: p.select("video_id", "frame_number", F.size(F.filter("px", lambda v: v >= 150)).alias("area"), F.array_max("px").alias("peak")).filter("area between 3 and 20 and peak >= 160").select("video_id", "frame_number", "area"),
    "WITH a AS (SELECT video_id, frame_number, CAST(len([1 for v in px if v >= 150]) AS INTEGER) AS area, list_max(px) AS peak FROM frame_px) SELECT video_id, frame_number, area FROM a WHERE area BETWEEN 3 AND 20 AND peak >= 160",
)

# Lines
ANGLE = "(CASE WHEN degrees(atan2(y2 - y1, x2 - x1)) > 90 THEN degrees(atan2(y2 - y1, x2 - x1)) - 180 WHEN degrees(atan2(y2 - y1, x2 - x1)) < -90 THEN degrees(atan2(y2 - y1, x2 - x1)) + 180 ELSE degrees(atan2(y2 - y1, x2 - x1)) END)"
LENGTH = "sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))"
register(
    "f19_line_geometry", "lines", lambda x: x.select("frame_id", "line_no", ex(f"R6({ANGLE})").alias("angle"), ex(f"R6({LENGTH})").alias("length"), ex("(x1 + x2) / 2.0").alias("center_x")),
    f"SELECT frame_id, line_no, R6({ANGLE}) AS angle, R6({LENGTH}) AS length, (x1 + x2) / 2.0 AS center_x FROM lines",
)
_HOLDER, _REFERENCE = "len >= 60 AND abs(angle) <= 30 AND (x1 + x2) / 2.0 >= 200", "len >= 100 AND abs(angle) <= 20"


def holder_geometry(lines: DataFrame) -> DataFrame:
    """Videos in which the longest lines of a holder hang lower than the reference lines in two frames or more."""
    measured = lines.withColumns({"angle": ex(f"R6({ANGLE})"), "len": ex(f"R6({LENGTH})")})
    one = lambda rule, name: measured.filter(ex(rule)).withColumn("n", F.row_number().over(Window.partitionBy("video_id", "frame_id").orderBy(F.col("len").desc(), "line_no"))).filter("n <= 8").groupBy("video_id", "frame_id").agg(F.median("angle").alias(name))
    both = one(_HOLDER, "holder").join(one(_REFERENCE, "reference"), ["video_id", "frame_id"])
    supports = both.filter(F.col("holder") - F.col("reference") <= -1.0)
    return supports.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"), r6(F.min(F.col("holder") - F.col("reference"))).alias("lowest")).filter("frames >= 2")


register(
    "a24_holder_geometry", "lines", holder_geometry,
    f"""WITH m AS (SELECT *, R6({ANGLE}) AS angle, R6({LENGTH}) AS len FROM lines),
h AS (SELECT video_id, frame_id, median(angle) AS holder FROM (SELECT * FROM m WHERE {_HOLDER} QUALIFY row_number() OVER (PARTITION BY video_id, frame_id ORDER BY len DESC, line_no) <= 8) GROUP BY ALL),
r AS (SELECT video_id, frame_id, median(angle) AS reference FROM (SELECT * FROM m WHERE {_REFERENCE} QUALIFY row_number() OVER (PARTITION BY video_id, frame_id ORDER BY len DESC, line_no) <= 8) GROUP BY ALL)
SELECT video_id, count(*) AS frames, R6(min(holder - reference)) AS lowest FROM h JOIN r USING (video_id, frame_id) WHERE holder - reference <= -1.0 GROUP BY video_id HAVING count(*) >= 2""",
)
register(
    "f21_alternate_view_score", "lines",
    lambda x: x.select("frame_id", "line_no", ex("R6(0.70 * least(1.0, x1 / 640.0) + 0.30 * least(1.0, 0.55 * (y1 / 480.0) + 0.45 * least(1.0, line_no / 30.0)))").alias("score")),
    "SELECT frame_id, line_no, R6(0.70 * least(1.0, x1 / 640.0) + 0.30 * least(1.0, 0.55 * (y1 / 480.0) + 0.45 * least(1.0, line_no / 30.0))) AS score FROM lines",
)
