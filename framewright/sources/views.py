"""Evidence tables derived from the plain test tables: frames, findings, annotations, requests, job events and others.

Each view is a query over the tables before it, written once for Spark and once for the SQL that checks it where the two
differ. On a cluster the same names are tables of their own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_SECONDS = ("(unix_micros(CAST(ts AS TIMESTAMP)) / 1e6)", "(epoch_us(ts) / 1e6)")

#: What the names of temporary views begin with, so that none of the session's own is replaced.
OWN = "framewright_base_"
#: name: (views it needs, SQL or (Spark SQL, check SQL)). Fixed definitions of the test inputs.
VIEWS: dict[str, tuple[tuple[str, ...], str | tuple[str, str]]] = {
    "keyed": ((), "SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events"),
    "frames": (
        ("keyed",),
        """SELECT user_id AS video_id, event_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_number,
  ({EPOCH} - min({EPOCH}) OVER (PARTITION BY user_id)) / 14400e0 AS t,
  value AS sharpness, value * 9e-1 AS tile_median, (event_id * 7 % 10) * 100e0 / 9e0 AS sharp_tiles_pct,
  k * 255e-2 AS brightness_mean,
  CASE WHEN k < 12 THEN 60e0 + k ELSE (100 - k) * 3e-1 END AS dark_pct,
  CASE WHEN k > 92 THEN 36e0 ELSE k * 2e-1 END AS bright_pct,
  CASE WHEN event_type = 'signup' THEN CAST(NULL AS DOUBLE) ELSE (event_id * 7919 % 4000) / 100e0 END AS motion_pct,
  event_id % 64 AS signature_id FROM keyed""",
    ),
    "findings": (
        ("keyed", "frames"),
        """SELECT f.event_id AS finding_id, f.video_id, f.t AS ts_s,
  CASE f.event_id % 4 WHEN 0 THEN 'kitchen' WHEN 1 THEN 'bath' WHEN 2 THEN 'Living' ELSE 'garage attic' END AS room,
  CASE f.event_id % 15 WHEN 0 THEN 'wall_hole' WHEN 1 THEN 'wall_crack' WHEN 2 THEN 'paint_damage' WHEN 3 THEN 'wall_stain'
    WHEN 4 THEN 'trim_damage' WHEN 5 THEN 'floor_damage' WHEN 6 THEN 'floor_stain' WHEN 7 THEN 'broken_tile'
    WHEN 8 THEN 'fixture_damage' WHEN 9 THEN 'missing_hardware' WHEN 10 THEN 'visible_staining' WHEN 11 THEN 'cleanliness'
    WHEN 12 THEN 'visible_damage' WHEN 13 THEN 'other' ELSE 'roof_leak' END AS category,
  CASE f.event_id % 12 WHEN 0 THEN 'Visible hole in the drywall near the window' WHEN 1 THEN 'Possible mold and discoloration on ceiling'
    WHEN 2 THEN 'Structural crack along the wall' WHEN 3 THEN 'Exposed wiring at outlet is dangerous'
    WHEN 4 THEN 'Minor chipped trim' WHEN 5 THEN 'Paint scuff' WHEN 6 THEN 'Dirty floor with residue'
    WHEN 7 THEN 'Cabinet mounting fastener hole' WHEN 8 THEN 'Bathtub rim crack' WHEN 9 THEN 'Water leak stain under the sink'
    WHEN 10 THEN 'Surface looks worn' ELSE 'ok' END AS description,
  CAST(ev.k + 1 AS DOUBLE) / 100e0 AS confidence,
  (f.event_id * 37 % 60) / 100e0 AS x, (f.event_id * 53 % 60) / 100e0 AS y,
  CASE WHEN f.event_id % 97 = 0 THEN 95e-2 ELSE (5 + f.event_id * 11 % 35) / 100e0 END AS width,
  (5 + f.event_id * 13 % 35) / 100e0 AS height,
  f.event_id % 4 AS independent_views, f.event_id % 5 <> 0 AS visible, f.event_id % 7 <> 0 AS category_holds, f.event_id % 2 = 0 AS reworded
FROM frames f JOIN keyed ev ON f.event_id = ev.event_id""",
    ),
    "truth_intervals": (
        ("frames",),
        """SELECT event_id AS interval_id, video_id, t - 1e0 AS start_s, t + 1e0 AS end_s,
  CASE event_id % 3 WHEN 0 THEN 'drywall_hole' WHEN 1 THEN 'bathtub_rim_crack' ELSE 'water_dripping' END AS category
FROM frames WHERE event_id % 11 = 0""",
    ),
    "actions": (
        (),
        """SELECT conv_id AS candidate_id, turn + 1 AS sequence_no, role AS action, CAST(length(text) % 30 AS BIGINT) AS frames_returned,
  ((conv_id * 31 + turn * 17) % 101) / 100e0 AS confidence_after FROM conversations""",
    ),
    "candidate_truth": ((), "SELECT DISTINCT conv_id AS candidate_id, CASE WHEN conv_id % 2 = 0 THEN 'present' ELSE 'absent' END AS truth FROM conversations"),
    "requests": (
        (),
        """SELECT l_orderkey AS request_id, l_linenumber AS attempt, l_suppkey AS video_id, l_returnflag AS model_id,
  CAST(l_quantity * 100 AS BIGINT) AS input_tokens, CAST(l_linenumber * 10 AS BIGINT) AS output_tokens,
  l_extendedprice / 1000e0 AS model_seconds FROM lineitem""",
    ),
    "runs": (
        (),
        """SELECT l_linestatus AS environment, l_partkey AS workload_id, CASE WHEN l_linenumber = 1 THEN 'warmup' ELSE 'measured' END AS phase,
  l_returnflag <> 'A' AS success, l_extendedprice / 100e0 AS wall_clock_seconds, l_quantity AS frames_per_second FROM lineitem""",
    ),
    "run_plan": ((), "SELECT o_orderstatus AS environment, CASE WHEN o_custkey % 7 = 0 THEN 'warmup' ELSE 'measured' END AS phase, count(*) AS expected FROM orders GROUP BY 1, 2"),
    "grid_cells": (
        (),
        (
            """SELECT label AS case_id, vec_id AS pair_index, CAST(pos DIV 8 AS INT) AS row_no, CAST(pos % 8 AS INT) AS col_no,
  abs(CAST(v AS DOUBLE)) AS residual_fraction, vec_id % 9 <> 0 AS stabilized FROM embeddings LATERAL VIEW posexplode(embedding) p AS pos, v""",
            """SELECT label AS case_id, vec_id AS pair_index, CAST((i - 1) // 8 AS INT) AS row_no, CAST((i - 1) % 8 AS INT) AS col_no,
  abs(CAST(embedding[i] AS DOUBLE)) AS residual_fraction, vec_id % 9 <> 0 AS stabilized
FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) u""",
        ),
    ),
    "lines": (
        (),
        """SELECT l_suppkey AS video_id, l_orderkey AS frame_id, l_linenumber AS line_no, l_partkey % 640 AS x1, l_orderkey % 480 AS y1,
  (l_partkey % 640) + 40 + (l_partkey * 7 % 120) AS x2, (l_orderkey % 480) + (l_orderkey * 3 % 60) - 30 AS y2 FROM lineitem""",
    ),
    "job_events": (
        (),
        """SELECT event_id, ts, user_id AS job_id, CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'PROCESSING' WHEN 'click' THEN 'PROGRESS'
    WHEN 'purchase' THEN 'COMPLETE' ELSE 'FAILED' END AS status, value AS amount, {EPOCH} AS at_s,
  event_id % 6 + 1 AS attempt, event_id % 30 AS completed, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 0 ELSE 26 END AS total,
  event_id % 3 <> 0 AS cancellable, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'agent' ELSE 'none' END AS follow_up FROM events""",
    ),
    "clip_verdicts": (
        (),
        """SELECT d.doc_id AS clip_id, d.source AS source_group, l.toxic = 1 AS positive, d.n_chars % 5 = 0 AS predicted_positive,
  d.n_chars AS input_tokens FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "truth_boxes": (
        ("findings",),
        """SELECT finding_id AS box_id, video_id, ts_s + 5e-2 AS ts_s, category, x, y,
  CASE WHEN finding_id % 2 = 0 THEN width ELSE 1e-2 END AS width, height FROM findings WHERE finding_id % 11 = 0""",
    ),
    "checklist_status": (
        ("findings",),
        """SELECT finding_id, CASE finding_id % 4 WHEN 0 THEN 'Open' WHEN 1 THEN 'In progress' WHEN 2 THEN 'Resolved' ELSE 'Lost' END AS status
FROM findings WHERE finding_id % 3 = 0""",
    ),
    "inventory": (
        (),
        """SELECT page_id AS object_id, url AS path, page_id % 40 AS issue_id,
  CASE page_id % 4 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'video/quicktime' WHEN 2 THEN 'image/jpeg' ELSE 'text/html' END AS content_type,
  CASE page_id % 3 WHEN 0 THEN 'clip.MP4' WHEN 1 THEN 'clip.mov' ELSE 'clip.txt' END AS filename, page_id * 3 % 120 AS age_hours FROM pages""",
    ),
    "saved_rules": ((), "SELECT page_id AS rule_id, page_id % 10 = 0 AS legacy FROM pages WHERE page_id % 9 <> 0"),
    "new_rules": ((), "SELECT page_id AS rule_id FROM pages WHERE page_id % 4 = 1"),
    "evidence": (("findings",), "SELECT finding_id, CASE WHEN finding_id % 6 <> 5 THEN CAST(video_id * 31 + floor(ts_s / 6e0) AS BIGINT) % 530 END AS image_id FROM findings"),
    "retention_rules": ((), "SELECT page_id AS rule_id, substring(url, 1, CAST(9 + page_id % 40 AS INT)) AS prefix, page_id % 5 <> 0 AS enabled, page_id % 6 <> 0 AS expires FROM pages"),
    "retained_roots": ((), "SELECT DISTINCT substring(url, 1, CAST(14 + page_id % 12 AS INT)) AS root FROM pages WHERE page_id % 50 = 1"),
    "annotated": (("truth_intervals",), "SELECT *, CASE WHEN interval_id % 5 = 0 THEN false END AS should_detect FROM truth_intervals"),
    "clip_images": (("clip_verdicts",), "SELECT clip_id, clip_id * 3 % 1009 AS image_id FROM clip_verdicts"),
    "image_uses": (("frame_px",), "SELECT video_id, frame_number * 7 % 600 AS image_id FROM frame_px"),
    "reviews": (("findings",), "SELECT finding_id, finding_id % 13 = 0 AS pending FROM findings"),
    "answers": (
        (),
        """SELECT l_suppkey AS video_id, CAST((n - 1) / 8 - (n - 1) % 8 / 8e0 AS BIGINT) AS batch,
  CAST((n - 1) % 8 + CASE WHEN l_orderkey % 17 = 0 THEN 8 ELSE 0 END AS BIGINT) AS place
FROM (SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) numbered""",
    ),
    "frame_px": (
        (),
        (
            """SELECT label AS video_id, vec_id AS frame_number, embedding AS signature,
  transform(embedding, e -> CAST(floor(greatest(0e0, least(255e0, (CAST(e AS DOUBLE) + 5e-1) * 255e0))) AS INT)) AS px FROM embeddings""",
            """SELECT label AS video_id, vec_id AS frame_number, embedding AS signature,
  [CAST(floor(greatest(0e0, least(255e0, (CAST(e AS DOUBLE) + 5e-1) * 255e0))) AS INT) for e in embedding] AS px FROM embeddings""",
        ),
    ),
}


def _order(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for x in [*_order(VIEWS[name][0]), name]:
            if x not in out:
                out.append(x)
    return out


def _with(names: tuple[str, ...], dialect: int) -> str:
    parts = []
    for name in _order(names):
        sql = VIEWS[name][1]
        sql = sql if isinstance(sql, str) else sql[dialect]
        parts.append(f"{name} AS (\n{sql.replace('{EPOCH}', _SECONDS[dialect])}\n)")
    return ",\n".join(parts)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view over the tables in ``sf_dir``."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = f"WITH {_with((name,), 0)}\nSELECT * FROM {name}"
    for table in BASE:
        if f"FROM {table}" in sql or f"JOIN {table}" in sql:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"{OWN}{table}")
            sql = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {OWN}{table}", sql)
    return spark.sql(sql)


def check_sql(names: tuple[str, ...], sql: str) -> str:
    """``sql`` with the views it names before it."""
    names = tuple(n for n in names if n not in BASE)
    sql = sql.strip()
    if not names:
        return sql
    recursive = "RECURSIVE " if sql.upper().startswith("WITH RECURSIVE") else ""
    if sql[:4].upper() == "WITH":
        sql = sql[4:].strip()
        sql = sql[9:].strip() if recursive else sql
        return f"WITH {recursive}{_with(names, 1)},\n{sql}"
    return f"WITH {_with(names, 1)}\n{sql}"
