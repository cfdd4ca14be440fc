"""Statistics of benchmark runs, comparisons of environments, equivalence of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import ex, r6
from ..plans.registry import register
from .quantiles import quantiles


def run_stats(runs: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median, 95th percentile and sample deviation (0 for one run) of the measured, successful runs; failures."""
    ok = F.col("success")
    value = F.when(ok, F.col("wall_clock_seconds"))
    measured = runs.filter("phase = 'measured'")
    stats = measured.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(ok).alias("successes"), r6(F.avg(value)).alias("mean"), r6(F.when(F.count(value) > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0)))).alias("deviation")
    )
    ranked = quantiles(measured.filter(ok), by, "wall_clock_seconds", {"median": 0.5, "p95": 0.95})
    return stats.join(ranked, by, "left").select(*by, "attempts", "successes", "mean", r6(F.col("median")).alias("median"), r6(F.col("p95")).alias("p95"), "deviation")


_OK = "FILTER (WHERE success)"
_STATS = f"""count(*) AS attempts, count(*) {_OK} AS successes, R6(avg(wall_clock_seconds) {_OK}) AS mean, R6(median(wall_clock_seconds) {_OK}) AS median, R6(quantile_cont(wall_clock_seconds, 0.95) {_OK}) AS p95,
  R6(CASE WHEN count(*) {_OK} > 0 THEN coalesce(stddev_samp(wall_clock_seconds) {_OK}, 0.0) END) AS deviation"""
register("a12_run_stats", "runs", lambda r: run_stats(r, ["environment"]), f"SELECT environment, {_STATS} FROM runs WHERE phase = 'measured' GROUP BY environment")
register("f17_percentile", "runs", lambda r: quantiles(r, ["workload_id"], "frames_per_second", {"p95": 0.95}).select("workload_id", r6(F.col("p95")).alias("p95")), "SELECT workload_id, R6(quantile_cont(frames_per_second, 0.95)) AS p95 FROM runs GROUP BY workload_id")


def compare_environments(runs: DataFrame) -> DataFrame:
    """Change of means between two environments, in percent; null where there is nothing to compare with."""
    ok = runs.filter("phase = 'measured' and success")
    mean = lambda c, e: F.avg(F.when(F.col("environment") == e, F.col(c)))
    m = ok.groupBy("workload_id").agg(mean("wall_clock_seconds", "F").alias("a"), mean("wall_clock_seconds", "O").alias("b"), mean("frames_per_second", "F").alias("fa"), mean("frames_per_second", "O").alias("fb"))
    return m.select("workload_id", r6(ex("try_divide(a - b, a) * 100")).alias("speedup_pct"), r6(ex("try_divide(fb - fa, fa) * 100")).alias("throughput_pct"))


_MEANS = "m AS (SELECT workload_id, avg(wall_clock_seconds) FILTER (WHERE environment = 'F') AS a, avg(wall_clock_seconds) FILTER (WHERE environment = 'O') AS b, avg(frames_per_second) FILTER (WHERE environment = 'F') AS fa, avg(frames_per_second) FILTER (WHERE environment = 'O') AS fb FROM runs WHERE phase = 'measured' AND success GROUP BY workload_id)"
register("a13_environment_change", "runs", compare_environments, f"WITH {_MEANS} SELECT workload_id, R6((a - b) / nullif(a, 0) * 100) AS speedup_pct, R6((fb - fa) / nullif(fa, 0) * 100) AS throughput_pct FROM m")
_VERDICT = "CASE WHEN calls_a <> calls_b OR a IS NULL OR b IS NULL OR a = 0 OR b = 0 THEN 'not_comparable' WHEN b < a * 0.95 THEN 'improvement' WHEN b > a * 1.05 THEN 'regression' ELSE 'no_material_benefit' END"


def speedups(runs: DataFrame) -> DataFrame:
    """Per workload whether the median changed by over 5 percent; only with equal numbers of calls."""
    one = lambda c, e: F.when(F.col("environment") == e, F.col(c))
    m = runs.groupBy("workload_id").agg(F.median(one("wall_clock_seconds", "F")).alias("a"), F.median(one("wall_clock_seconds", "O")).alias("b"), F.count(one("wall_clock_seconds", "F")).alias("calls_a"), F.count(one("wall_clock_seconds", "O")).alias("calls_b"))
    return m.select("workload_id", ex(_VERDICT).alias("verdict"), r6(ex("try_divide(a, b)")).alias("speedup"))


register(
    "a14_speedup_verdict", "runs", speedups,
    f"""WITH m AS (SELECT workload_id, median(wall_clock_seconds) FILTER (WHERE environment = 'F') AS a, median(wall_clock_seconds) FILTER (WHERE environment = 'O') AS b,
  count(*) FILTER (WHERE environment = 'F') AS calls_a, count(*) FILTER (WHERE environment = 'O') AS calls_b FROM runs GROUP BY workload_id) SELECT workload_id, {_VERDICT} AS verdict, R6(a / nullif(b, 0)) AS speedup FROM m""",
)


def equivalence(runs: DataFrame, tolerance: float = 100.0) -> DataFrame:
    """Positions at which the runs of two environments differ by more than a tolerance, or only one has any."""
    mean = lambda e: runs.filter(F.col("environment") == e).groupBy("workload_id").agg(F.avg("wall_clock_seconds").alias(f"v_{e}"))
    both = mean("F").join(mean("O"), "workload_id", "full_outer")
    same = F.coalesce(F.abs(F.col("v_F") - F.col("v_O")) <= tolerance, F.lit(False))
    return both.agg(F.count(F.lit(1)).alias("positions"), F.count_if(~same).alias("different"), F.count_if(F.col("v_F").isNull() | F.col("v_O").isNull()).alias("one_sided"), F.bool_and(same).alias("equivalent"))


_SIDES = "a AS (SELECT workload_id, avg(wall_clock_seconds) AS va FROM runs WHERE environment = 'F' GROUP BY 1), b AS (SELECT workload_id, avg(wall_clock_seconds) AS vb FROM runs WHERE environment = 'O' GROUP BY 1), j AS (SELECT va, vb, coalesce(abs(va - vb) <= 100.0, false) AS same FROM a FULL OUTER JOIN b USING (workload_id))"
register("j15_run_equivalence", "runs", equivalence, f"WITH {_SIDES} SELECT count(*) AS positions, count(*) FILTER (WHERE NOT same) AS different, count(*) FILTER (WHERE va IS NULL OR vb IS NULL) AS one_sided, bool_and(same) AS equivalent FROM j")


def invariants(runs: DataFrame, plan: DataFrame) -> DataFrame:
    """Runs that there are against those that the plan (environment, phase, expected) asks for, matched exactly; a field
    that is on one side only is a drift too."""
    actual = runs.groupBy("environment", "phase").agg(F.count(F.lit(1)).alias("actual"))
    joined = actual.join(plan, ["environment", "phase"], "full_outer")
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unplanned").when(F.col("actual") == F.col("expected"), "equal").otherwise("drift")
    return joined.select("environment", "phase", (F.coalesce("actual", F.lit(0)) - F.coalesce("expected", F.lit(0))).alias("drift"), state.alias("state"))


register(
    "j16_invariants", "runs run_plan", invariants,
    """WITH s AS (SELECT environment, phase, 1 AS n, 1 AS a, 0 AS p FROM runs UNION ALL SELECT environment, phase, -expected, 0, 1 FROM run_plan)
SELECT environment, phase, CAST(sum(n) AS BIGINT) AS drift, CASE WHEN sum(a) = 0 THEN 'missing' WHEN sum(p) = 0 THEN 'unplanned' WHEN sum(n) = 0 THEN 'equal' ELSE 'drift' END AS state FROM s GROUP BY environment, phase""",
)
_METRICS = ("wall_clock_seconds", "frames_per_second")


def long_metrics(runs: DataFrame) -> DataFrame:
    sums = runs.groupBy("environment").agg(*[F.avg(m).alias(m) for m in _METRICS])
    return sums.unpivot("environment", list(_METRICS), "metric", "value")


register(
    "s08_metric_pivot", "runs", lambda r: long_metrics(r).groupBy("metric").pivot("environment", ["F", "O"]).agg(r6(F.first("value"))),
    " UNION ALL ".join(f"SELECT '{m}' AS metric, R6(avg({m}) FILTER (WHERE environment = 'F')) AS F, R6(avg({m}) FILTER (WHERE environment = 'O')) AS O FROM runs" for m in _METRICS),
)
register(
    "j19_arm_delta", "runs", lambda r: (lambda m: m.filter("environment = 'O'").alias("o").join(m.filter("environment = 'F'").alias("f"), "metric").select("metric", r6(F.col("o.value") - F.col("f.value")).alias("delta")))(long_metrics(r)),
    " UNION ALL ".join(f"SELECT '{m}' AS metric, R6(avg({m}) FILTER (WHERE environment = 'O') - avg({m}) FILTER (WHERE environment = 'F')) AS delta FROM runs" for m in _METRICS),
)
