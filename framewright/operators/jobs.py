"""Job events: progress, phases, retries, transitions, idempotence, quotas, completeness, windows of telemetry; artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import ex, r6
from ..plans.registry import register

def by_job():
    return Window.partitionBy("job_id").orderBy("at_s", "event_id")
_W = "OVER (PARTITION BY job_id ORDER BY at_s, event_id)"

PHASE = """CASE WHEN status IN ('QUEUED', 'PROCESSING') THEN CASE WHEN cancellable THEN 'PRIMARY_JOB' ELSE 'UNAVAILABLE' END WHEN status = 'PROGRESS' THEN 'PENDING' WHEN status = 'FAILED' THEN 'TERMINAL'
  WHEN status = 'COMPLETE' THEN CASE follow_up WHEN 'pending' THEN 'PENDING' WHEN 'agent' THEN 'AGENT_JOB' ELSE 'UI_ONLY' END ELSE 'UNAVAILABLE' END"""


def cancellation_phase(jobs: DataFrame) -> DataFrame:
    """What a cancel request can reach: the job itself, work that follows it, or nothing (status, cancellable, follow_up)."""
    return jobs.withColumn("phase", ex(PHASE))


register(
    "p25_cancellation_phase", "job_events", lambda j: cancellation_phase(j).select("event_id", "phase"),
    """WITH p (status, cancellable, follow_up, phase) AS (VALUES ('QUEUED', true, NULL, 'PRIMARY_JOB'), ('PROCESSING', true, NULL, 'PRIMARY_JOB'), ('PROGRESS', NULL, NULL, 'PENDING'), ('FAILED', NULL, NULL, 'TERMINAL'),
  ('COMPLETE', NULL, 'pending', 'PENDING'), ('COMPLETE', NULL, 'agent', 'AGENT_JOB'), ('COMPLETE', NULL, 'none', 'UI_ONLY'))
SELECT event_id, coalesce(phase, 'UNAVAILABLE') AS phase FROM job_events j LEFT JOIN p ON j.status = p.status AND (p.cancellable IS NULL OR j.cancellable) AND (p.follow_up IS NULL OR p.follow_up = j.follow_up)""",
)
TERMINAL = "(status = 'FAILED' AND (amount > 100.0 OR attempt >= 5))"
DELAY = "least(900.0, greatest(5.0, pow(2.0, attempt - 1) * 30.0))"


def retries(jobs: DataFrame) -> DataFrame:
    """Whether a failure is final, and how long the next attempt waits (status, amount, attempt)."""
    return jobs.withColumns({"is_terminal": ex(TERMINAL), "delay": ex(DELAY)})


register(
    "p26_terminal_and_delay", "job_events", lambda j: retries(j).select("event_id", "is_terminal", "delay"),
    "SELECT event_id, status = 'FAILED' AND NOT (amount <= 100.0 AND attempt < 5) AS is_terminal, CAST([30, 60, 120, 240, 480, 900][attempt] AS DOUBLE) AS delay FROM job_events",
)
PERCENT = "CASE WHEN total > 0 AND completed <= total THEN least(CASE WHEN status = 'COMPLETE' THEN 100 ELSE 99 END, DIV(100 * completed, total)) END"


def stage_percent(jobs: DataFrame) -> DataFrame:
    """Percent of a stage, 99 at most until it is complete; null where the total isn't known or is exceeded."""
    return jobs.withColumn("percent", ex(PERCENT).cast("long"))


register(
    "p27_stage_percent", "job_events", lambda j: stage_percent(j).select("event_id", F.coalesce("percent", F.lit(-1)).alias("percent")),
    "SELECT event_id, CAST(CASE WHEN total IS NULL OR total = 0 OR completed > total THEN -1 WHEN status <> 'COMPLETE' AND completed = total THEN 99 ELSE floor(100.0 * completed / total) END AS BIGINT) AS percent FROM job_events",
)
register(
    "p32_retention", "job_events", lambda j: (lambda m: j.crossJoin(F.broadcast(m)).filter("status = 'FAILED' and now - at_s >= 48 * 3600").select("event_id"))(j.agg(F.max("at_s").alias("now"))),
    "SELECT event_id FROM job_events WHERE status = 'FAILED' AND (SELECT max(at_s) FROM job_events) - at_s >= 48 * 3600",
)
register(
    "p33_admission", "job_events", lambda j: j.groupBy("job_id").agg(F.count_if(F.col("status") == "QUEUED").alias("admitted")).select("job_id", (F.col("admitted") < 12).alias("is_open"), F.greatest(F.lit(0), 12 - F.col("admitted")).alias("remaining")),
    "WITH a AS (SELECT job_id, count(*) FILTER (WHERE status = 'QUEUED') AS n FROM job_events GROUP BY job_id) SELECT job_id, n < 12 AS is_open, greatest(0, 12 - n) AS remaining FROM a",
)

# Which status may follow which.
LEGAL = (("QUEUED", "PROCESSING"), ("QUEUED", "FAILED"), ("PROCESSING", "PROGRESS"), ("PROCESSING", "COMPLETE"), ("PROCESSING", "FAILED"), ("PROGRESS", "PROGRESS"), ("PROGRESS", "COMPLETE"), ("PROGRESS", "FAILED"), ("FAILED", "QUEUED"))


def transitions(events: DataFrame) -> DataFrame:
    """Each event with whether its status may follow the one before it; the table of legal steps is broadcast."""
    legal = events.sparkSession.createDataFrame([(*x, True) for x in LEGAL], "prior string, status string, ok boolean")
    steps = events.withColumn("prior", F.lag("status").over(by_job()))
    return steps.join(F.broadcast(legal), ["prior", "status"], "left").select("event_id", "job_id", "status", (F.col("prior").isNull() | F.coalesce("ok", F.lit(False))).alias("legal"))


_LEGAL = ", ".join(f"('{a}', '{b}')" for a, b in LEGAL)
register("x03_transition_legality", "job_events", transitions, f"WITH s AS (SELECT *, lag(status) {_W} AS prior FROM job_events) SELECT event_id, job_id, status, prior IS NULL OR coalesce((prior, status) IN ({_LEGAL}), false) AS legal FROM s")
register(
    "x04_idempotent_events", "job_events", lambda j: j.withColumn("bucket", F.floor(F.col("at_s") / 3600)).groupBy("job_id", "status", "bucket").agg(F.min_by("event_id", F.struct("at_s", "event_id")).alias("event_id")).select("job_id", "status", "event_id"),
    "SELECT job_id, status, event_id FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id, status, floor(at_s / 3600) ORDER BY at_s, event_id) = 1",
)


def stale_writers(events: DataFrame, lease: float = 3600.0) -> DataFrame:
    """Progress that no live claim covers: the last claim before it is too old, ended, or missing."""
    claim = F.last(F.when(F.col("status") == "PROCESSING", F.col("at_s")), ignorenulls=True).over(by_job())
    ended = F.last(F.when(F.col("status").isin("COMPLETE", "FAILED"), F.col("at_s")), ignorenulls=True).over(by_job())
    state = events.withColumns({"claimed": claim, "ended": ended})
    live = F.coalesce((F.col("at_s") - F.col("claimed") <= lease) & (F.col("ended").isNull() | (F.col("ended") < F.col("claimed"))), F.lit(False))
    return state.filter("status = 'PROGRESS'").select("event_id", "job_id", live.alias("accepted"))


register(
    "x05_stale_writers", "job_events", stale_writers,
    f"""WITH s AS (SELECT *, last_value(CASE WHEN status = 'PROCESSING' THEN at_s END IGNORE NULLS) {_W} AS claimed, last_value(CASE WHEN status IN ('COMPLETE', 'FAILED') THEN at_s END IGNORE NULLS) {_W} AS ended FROM job_events)
SELECT event_id, job_id, coalesce(at_s - claimed <= 3600.0 AND (ended IS NULL OR ended < claimed), false) AS accepted FROM s WHERE status = 'PROGRESS'""",
)


def worker_phase(events: DataFrame, fresh: float = 86400.0) -> DataFrame:
    """The phase of each job's worker from its last event, against the latest event of all."""
    last = events.groupBy("job_id").agg(F.max("at_s").alias("beat"), F.max_by("status", F.struct("at_s", "event_id")).alias("status"))
    now = F.broadcast(events.agg(F.max("at_s").alias("now")))
    stale = F.col("beat") < F.col("now") - fresh
    return last.crossJoin(now).select("job_id", F.when(F.col("status").isin("PROCESSING", "PROGRESS"), F.when(stale, "UNAVAILABLE").otherwise("BUSY")).when(F.col("status") == "QUEUED", F.when(stale, "STARTING").otherwise("READY")).when(stale, "STOPPED").otherwise("IDLE").alias("phase"))


register(
    "x06_worker_phase", "job_events", worker_phase,
    """WITH l AS (SELECT job_id, at_s AS beat, status, (SELECT max(at_s) FROM job_events) AS now_s FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY at_s DESC, event_id DESC) = 1)
SELECT job_id, CASE WHEN status IN ('PROCESSING', 'PROGRESS') THEN CASE WHEN beat < now_s - 86400.0 THEN 'UNAVAILABLE' ELSE 'BUSY' END WHEN status = 'QUEUED' THEN CASE WHEN beat < now_s - 86400.0 THEN 'STARTING' ELSE 'READY' END
  WHEN beat < now_s - 86400.0 THEN 'STOPPED' ELSE 'IDLE' END AS phase FROM l""",
)


def telemetry_windows(events: DataFrame, minutes: int = 5, alarm: int = 2) -> DataFrame:
    """Failures and sums by tumbling window; windows with ``alarm`` failures or more raise one."""
    w = F.window(F.col("ts").cast("timestamp"), f"{minutes} minutes")
    return events.groupBy(w.alias("w")).agg(F.count_if(F.col("status") == "FAILED").alias("errors"), F.count(F.lit(1)).alias("events"), r6(F.sum("amount")).alias("amount")).select(F.unix_seconds("w.start").alias("start_s"), "errors", "events", "amount", (F.col("errors") >= alarm).alias("alarm"))


register(
    "x08_tumbling_errors", "job_events", telemetry_windows,
    "SELECT CAST(floor(at_s / 300) * 300 AS BIGINT) AS start_s, count(*) FILTER (WHERE status = 'FAILED') AS errors, count(*) AS events, R6(sum(amount)) AS amount, count(*) FILTER (WHERE status = 'FAILED') >= 2 AS alarm FROM job_events GROUP BY 1",
)


def admissions(events: DataFrame, limit: int = 5) -> DataFrame:
    """The first ``limit`` operations of each day that a job asks for, one of a kind per job."""
    day = F.floor(F.col("at_s") / 86400).cast("long")
    once = events.withColumn("day", day).groupBy("day", "job_id", "status").agg(F.min(F.struct("at_s", "event_id")).alias("first")).select("day", "job_id", "status", "first.*")
    return once.withColumn("n", F.row_number().over(Window.partitionBy("day").orderBy("at_s", "event_id"))).filter(F.col("n") <= limit).select("day", "event_id", "n")


register(
    "x09_quota_admission", "job_events", admissions,
    """WITH o AS (SELECT CAST(floor(at_s / 86400) AS BIGINT) AS day, * FROM job_events QUALIFY row_number() OVER (PARTITION BY floor(at_s / 86400), job_id, status ORDER BY at_s, event_id) = 1)
SELECT day, event_id, CAST(row_number() OVER (PARTITION BY day ORDER BY at_s, event_id) AS INTEGER) AS n FROM o QUALIFY n <= 5""",
)
FATE = f"CASE WHEN status <> 'FAILED' THEN 'ok' WHEN {TERMINAL} THEN 'dead' ELSE 'retry' END"
register("x10_dead_letter_split", "job_events", lambda j: j.select("event_id", ex(FATE).alias("fate")), f"SELECT event_id, {FATE} AS fate FROM job_events")
REQUIRED = ("QUEUED", "PROCESSING", "PROGRESS", "COMPLETE")
register(
    "x11_required_events", "job_events",
    lambda j: j.groupBy("job_id").agg(F.collect_set("status").alias("have")).select("job_id", F.array_join(F.array_except(F.array(*[F.lit(x) for x in REQUIRED]), "have"), ",").alias("missing")),
    "WITH h AS (SELECT job_id, list(DISTINCT status) AS have FROM job_events GROUP BY job_id) SELECT job_id, array_to_string([x for x in ['QUEUED', 'PROCESSING', 'PROGRESS', 'COMPLETE'] if NOT list_contains(have, x)], ',') AS missing FROM h",
)


def latest_state(events: DataFrame) -> DataFrame:
    """The upsert's result: the last status of each job, and the version that wrote it."""
    return events.groupBy("job_id").agg(F.max_by(F.struct("status", "amount", "event_id"), F.struct("at_s", "event_id")).alias("s"), F.count(F.lit(1)).alias("version")).select("job_id", "s.status", "s.event_id", "version")


register("s12_latest_state", "job_events", latest_state, "SELECT job_id, arg_max(status, at_s * 1e6 + event_id * 1e-6) AS status, arg_max(event_id, at_s * 1e6 + event_id * 1e-6) AS event_id, count(*) AS version FROM job_events GROUP BY job_id")


def telemetry_roll_up(events: DataFrame) -> DataFrame:
    """Counts and sums by job and status and by job alone (status ``*``), from one rollup."""
    return events.groupingSets([["job_id", "status"], ["job_id"]], "job_id", "status").agg(F.count(F.lit(1)).alias("events"), r6(F.sum("amount")).alias("amount")).withColumn("status", F.coalesce("status", F.lit("*")))


register("a27_telemetry_roll_up", "job_events", telemetry_roll_up, "SELECT job_id, coalesce(status, '*') AS status, count(*) AS events, R6(sum(amount)) AS amount FROM job_events GROUP BY GROUPING SETS ((job_id, status), (job_id))")

# Artifacts
KIND = "CASE WHEN content_type LIKE 'video/%' THEN 'original' WHEN content_type LIKE 'image/%' THEN 'evidence' ELSE 'reports' END"
KEY = f"concat('inspections/', CAST(issue_id AS {{t}}), '/', {KIND}, '/', CAST(object_id AS {{t}}))"
register("s09_artifact_key", "inventory", lambda i: i.select("object_id", ex(KIND).alias("kind"), ex(KEY.format(t="STRING")).alias("key")), f"SELECT object_id, {KIND} AS kind, {KEY.format(t='VARCHAR')} AS key FROM inventory")
register(
    "s13_evidence_snapshot", "inventory",
    lambda i: i.groupBy("issue_id", "path").agg(F.min("object_id").alias("object_id")).withColumn("n", F.row_number().over(Window.partitionBy("issue_id").orderBy("object_id"))).select("issue_id", "object_id", F.format_string("inspections/%d/evidence/frame-%02d.jpg", "issue_id", "n").alias("destination")),
    "WITH d AS (SELECT issue_id, path, min(object_id) AS object_id FROM inventory GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY object_id) AS n FROM d) SELECT issue_id, object_id, printf('inspections/%d/evidence/frame-%02d.jpg', issue_id, n) AS destination FROM n",
)
ADMIT = "(content_type IN ('video/mp4', 'video/quicktime') AND RX(lower(filename), '[.](mp4|mov)$'))"
register("p21_upload_admission", "inventory", lambda i: i.select("object_id", ex(ADMIT).alias("admitted")), f"SELECT object_id, {ADMIT} AS admitted FROM inventory")
register(
    "j08_stale_anti_join", "inventory", lambda i: i.filter("age_hours >= 48").join(i.filter("content_type = 'text/html'").select("issue_id").distinct(), "issue_id", "left_anti").select("object_id"),
    "SELECT object_id FROM inventory WHERE age_hours >= 48 AND issue_id NOT IN (SELECT issue_id FROM inventory WHERE content_type = 'text/html')",
)


def cut_at(texts: DataFrame, column: str, lengths: list[int]) -> DataFrame:
    """Each text with its own prefixes (``cut``) at those of the lengths that it has."""
    n = F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x <= F.char_length(column))
    return texts.withColumn("cut", F.explode(F.transform(n, lambda x: F.substring(F.col(column), F.lit(1), x))))


def conflicts(rules: DataFrame, roots: DataFrame) -> DataFrame:
    """rule_id of the enabled rules (rule_id, prefix, enabled, expires) that expire something and whose prefix holds a retained
    root (root), or is held by one. A prefix join is two equi-joins: each side is cut at the lengths that the other side has
    (object names, and so lengths, are bounded by 1,024), so no pair is formed that doesn't match."""
    live = rules.filter("enabled and expires").select("rule_id", "prefix")
    lengths = lambda df, c: [r.n for r in df.select(F.char_length(c).alias("n")).distinct().collect()]
    held = cut_at(live, "prefix", lengths(roots, "root")).join(roots.select(F.col("root").alias("cut")), "cut", "left_semi")
    holds = live.join(cut_at(roots, "root", lengths(live, "prefix")).select(F.col("cut").alias("prefix")), "prefix", "left_semi")
    return held.select("rule_id").unionByName(holds.select("rule_id")).distinct()


register(
    "j20_retention_conflicts", "retention_rules retained_roots", conflicts,
    "SELECT rule_id FROM retention_rules r WHERE enabled AND expires AND EXISTS (SELECT 1 FROM retained_roots p WHERE starts_with(p.root, r.prefix) OR starts_with(r.prefix, p.root))",
)


def merged_rules(saved: DataFrame, new: DataFrame) -> DataFrame:
    """New rules (rule_id) replace saved ones (rule_id, legacy) of the same id; a legacy rule stays, disabled."""
    old = saved.select("rule_id", F.when(F.col("legacy"), "Disabled").otherwise("Enabled").alias("status"))
    return old.join(new.select("rule_id"), "rule_id", "left_anti").unionByName(new.select("rule_id", F.lit("New").alias("status")))


register(
    "u05_keyed_replace", "saved_rules new_rules", merged_rules,
    "SELECT coalesce(n.rule_id, s.rule_id) AS rule_id, CASE WHEN n.rule_id IS NOT NULL THEN 'New' WHEN legacy THEN 'Disabled' ELSE 'Enabled' END AS status FROM saved_rules s FULL OUTER JOIN new_rules n ON s.rule_id = n.rule_id",
)
