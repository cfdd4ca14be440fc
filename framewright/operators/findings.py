"""Findings: normalization to a closed schema, gates, boxes, identities and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import ex, r6
from ..plans.registry import register
from .rangejoin import nearest_join

# The closed taxonomy (category -> group), and names of rooms that are written in several ways.
GROUPS = {
    "wall_hole": "walls", "wall_crack": "walls", "paint_damage": "walls", "wall_stain": "walls", "trim_damage": "walls",
    "floor_damage": "flooring", "floor_stain": "flooring", "broken_tile": "flooring",
    "fixture_damage": "fixtures", "missing_hardware": "fixtures",
    "visible_staining": "general", "cleanliness": "general", "visible_damage": "general", "other": "other",
}
ROOM_ALIASES = {"living": "living_room", "livingroom": "living_room", "bath": "bathroom", "bath_room": "bathroom", "hall": "hallway", "corridor": "hallway", "outside": "exterior", "outdoors": "exterior"}
ROOMS = ("kitchen", "bathroom", "bedroom", "living_room", "dining_room", "hallway", "garage", "exterior", "laundry", "unknown")


def case_of(column: str, table: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


def listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def snake(column: str, default: str, most: int) -> str:
    """Lower case, runs of other characters as one underscore, none at the ends."""
    return f"substring(coalesce(nullif(trim(BOTH '_' FROM SNAKE(lower({column}))), ''), '{default}'), 1, {most})"



def room(column: str) -> str:
    plain = snake(column, "unknown", 40)
    named = case_of(plain, ROOM_ALIASES, plain)
    return f"CASE WHEN {named} IN {listed(ROOMS)} THEN {named} ELSE 'unknown' END"


def for_spark(text: str) -> str:
    """SNAKE(x) stands for the replacement of runs of other characters, which the two dialects write differently."""
    return _snakes(text, "regexp_replace({x}, '[^a-z0-9]+', '_')")


def for_check(text: str) -> str:
    return _snakes(text, "regexp_replace({x}, '[^a-z0-9]+', '_', 'g')")


def _snakes(text: str, form: str) -> str:
    while (at := text.find("SNAKE(")) >= 0:
        depth, k = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            k += 1
        text = text[:at] + form.replace("{x}", text[at + 6 : k - 1]) + text[k:]
    return text


BOX_OK = "(x >= 0.0 AND x <= 1.0 AND y >= 0.0 AND y <= 1.0 AND width > 0.0 AND width <= 1.0 AND height > 0.0 AND height <= 1.0 AND x + width <= 1.000001 AND y + height <= 1.000001)"
CATEGORY = f"CASE WHEN category IN {listed(GROUPS)} THEN category ELSE 'other' END"
GROUP = case_of("category", GROUPS, "'other'")
LABEL = "CASE WHEN confidence IS NULL OR NOT (confidence >= 0.0 AND confidence <= 1.0) THEN NULL WHEN confidence >= 0.80 THEN 'High' WHEN confidence >= 0.60 THEN 'Medium' ELSE 'Low' END"
GATE = 0.65


def box4(column: str) -> str:
    return f"(floor(({column}) * 1e4 + 0.5) / 1e4)"


def normalize_findings(raw: DataFrame, frames: DataFrame, least: float = GATE) -> DataFrame:
    """Raw findings in the closed schema: rows without a valid box, a frame within 0.051 s, enough confidence or a
    description are left out; unknown categories become ``other`` and keep their name as label."""
    gated = raw.withColumn("conf", ex("greatest(0.0, least(1.0, confidence))")).filter((F.col("conf") >= least) & ex(BOX_OK))
    timed = nearest_join(gated.select("finding_id", "video_id", "ts_s", "room", "category", "description", "conf", "x", "y", "width", "height"), frames.select("video_id", F.col("t").alias("frame_t"), "frame_number"), "video_id", "ts_s", "frame_t", 0.051, "frame_number", ["finding_id"])
    text = "substring(trim(description), 1, 180)"
    return timed.select(
        "finding_id", "video_id", "frame_number", r6(F.col("frame_t")).alias("ts_s"), F.expr(for_spark(room("room"))).alias("room"), ex(CATEGORY).alias("category"),
        ex(f"CASE WHEN category NOT IN {listed(GROUPS)} THEN substring(category, 1, 80) WHEN category = 'other' THEN 'other_visible_issue' END").alias("other_label"),
        ex(text).alias("description"), r6(F.col("conf")).alias("confidence"), ex(box4("x")).alias("x"), ex(box4("y")).alias("y"),
        ex(box4("least(width, 1.0 - x)")).alias("width"), ex(box4("least(height, 1.0 - y)")).alias("height"),
    ).filter(F.length("description") >= 3)


NEAREST = """near AS (SELECT f.finding_id, r.frame_number, r.t AS frame_t FROM findings f JOIN frames r ON f.video_id = r.video_id AND abs(f.ts_s - r.t) <= 0.051
  QUALIFY row_number() OVER (PARTITION BY f.finding_id ORDER BY abs(f.ts_s - r.t), r.frame_number) = 1)"""

register(
    "j01_nearest_frame", "findings frames",
    lambda f, r: nearest_join(f.select("finding_id", "video_id", "ts_s"), r.select("video_id", F.col("t").alias("frame_t"), "frame_number"), "video_id", "ts_s", "frame_t", 0.051, "frame_number", ["finding_id"]).select("finding_id", "frame_number", r6(F.col("frame_t")).alias("frame_t")),
    f"WITH {NEAREST} SELECT finding_id, frame_number, R6(frame_t) AS frame_t FROM near",
)
register(
    "p07_normalize_findings", "findings frames", normalize_findings,
    for_check(f"""WITH {NEAREST} SELECT finding_id, video_id, frame_number, R6(frame_t) AS ts_s, {room('room')} AS room, {CATEGORY} AS category,
  CASE WHEN category NOT IN {listed(GROUPS)} THEN substring(category, 1, 80) WHEN category = 'other' THEN 'other_visible_issue' END AS other_label,
  substring(trim(description), 1, 180) AS description, R6(greatest(0.0, least(1.0, confidence))) AS confidence,
  {box4('x')} AS x, {box4('y')} AS y, {box4('least(width, 1.0 - x)')} AS width, {box4('least(height, 1.0 - y)')} AS height
FROM findings JOIN near USING (finding_id) WHERE confidence >= {GATE} AND {BOX_OK} AND length(trim(description)) >= 3"""),
)
register(
    "p08_box_validation", "findings", lambda f: f.select("finding_id", ex(BOX_OK).alias("valid"), ex(f"CASE WHEN {BOX_OK} THEN {box4('least(width, 1.0 - x)')} END").alias("width")),
    f"SELECT finding_id, {BOX_OK} AS valid, CASE WHEN {BOX_OK} THEN {box4('least(width, 1.0 - x)')} END AS width FROM findings",
)
register("p09_confidence_gate", "findings", lambda f: f.filter(F.col("confidence") >= GATE).select("finding_id"), f"SELECT finding_id FROM findings WHERE confidence >= {GATE}")
BANDS = "confidence >= 0.50 AND confidence <= 0.85 AS ambiguous, confidence >= 0.45 AND confidence <= 0.80 AS reinspect"
register(
    "p10_ambiguous_band", "findings", lambda f: f.select("finding_id", F.col("confidence").between(0.50, 0.85).alias("ambiguous"), F.col("confidence").between(0.45, 0.80).alias("reinspect")), f"SELECT finding_id, {BANDS} FROM findings"
)
register("p11_confidence_label", "findings", lambda f: f.select("finding_id", ex(LABEL).alias("label")), f"SELECT finding_id, {LABEL} AS label FROM findings")
MOUNTING = "(category IN ('fixture_damage', 'missing_hardware') AND RX(lower(description), 'cabinet|vanity') AND RX(lower(description), 'mount|hole|fastener') AND width * height > 0.0 AND width * height < 0.005)"
CRACK = "(category IN ('fixture_damage', 'visible_damage', 'other') AND RX(lower(description), 'crack') AND width * height > 0.0 AND width * height < 0.01)"
register("p22_refinement_triggers", "findings", lambda f: f.select("finding_id", ex(MOUNTING).alias("mounting"), ex(CRACK).alias("crack")), f"SELECT finding_id, {MOUNTING} AS mounting, {CRACK} AS crack FROM findings")


def pixel_box(findings: DataFrame, wide: int = 1920, high: int = 1080, pad: float = 0.12) -> DataFrame:
    """The box in pixels (half-even rounding) and the padded crop around it, inside the image."""
    return findings.withColumns(
        {
            "x1": F.bround(F.col("x") * wide, 0).cast("long"), "y1": F.bround(F.col("y") * high, 0).cast("long"),
            "x2": F.bround((F.col("x") + F.col("width")) * wide, 0).cast("long"), "y2": F.bround((F.col("y") + F.col("height")) * high, 0).cast("long"),
            "crop_x1": F.greatest(F.lit(0), F.floor((F.col("x") - F.col("width") * pad) * wide)).cast("long"), "crop_x2": F.least(F.lit(wide), F.ceil((F.col("x") + F.col("width") * (1 + pad)) * wide)).cast("long"),
        }
    ).select("finding_id", "x1", "y1", "x2", "y2", "crop_x1", "crop_x2")


register(
    "p28_pixel_box", "findings", pixel_box,
    """SELECT finding_id, CAST(round_even(x * 1920, 0) AS BIGINT) AS x1, CAST(round_even(y * 1080, 0) AS BIGINT) AS y1, CAST(round_even((x + width) * 1920, 0) AS BIGINT) AS x2,
  CAST(round_even((y + height) * 1080, 0) AS BIGINT) AS y2, CAST(greatest(0, floor((x - width * 0.12) * 1920)) AS BIGINT) AS crop_x1, CAST(least(1920, ceil((x + width * 1.12) * 1920)) AS BIGINT) AS crop_x2 FROM findings""",
)


def tiles(wide: int, high: int) -> list[tuple[int, int, int, int]]:
    """Four half-frame tiles that overlap by an eighth."""
    mx, my, px, py = wide // 2, high // 2, max(1, wide // 16), max(1, high // 16)
    return [(x1, y1, x2, y2) for y1, y2 in ((0, my + py), (my - py, high)) for x1, x2 in ((0, mx + px), (mx - px, wide))]


def tile_views(findings: DataFrame, wide: int = 1920, high: int = 1080) -> DataFrame:
    """Each finding's box as if it had been found in each of the tiles, mapped back to the whole frame."""
    table = F.array(*[F.struct(F.lit(n).alias("tile"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.lit(d).alias("d")) for n, (a, b, c, d) in enumerate(tiles(wide, high))])
    out = findings.select("finding_id", "x", "y", "width", "height", F.explode(table).alias("t"))
    return out.select(
        "finding_id", "t.tile", r6((F.col("t.a") + F.col("x") * (F.col("t.c") - F.col("t.a"))) / wide).alias("x"), r6((F.col("t.b") + F.col("y") * (F.col("t.d") - F.col("t.b"))) / high).alias("y"),
        r6(F.col("width") * (F.col("t.c") - F.col("t.a")) / wide).alias("width"), r6(F.col("height") * (F.col("t.d") - F.col("t.b")) / high).alias("height"),
    )


_TILES = " UNION ALL ".join(f"SELECT {n} AS tile, {a} AS a, {b} AS b, {c} AS c, {d} AS d" for n, (a, b, c, d) in enumerate(tiles(1920, 1080)))
register(
    "p29_tile_remap", "findings", tile_views,
    f"""WITH tiles AS ({_TILES}) SELECT finding_id, tile, R6((a + x * (c - a)) / 1920) AS x, R6((b + y * (d - b)) / 1080) AS y, R6(width * (c - a) / 1920) AS width,
  R6(height * (d - b) / 1080) AS height FROM findings, tiles""",
)
register("p30_candidate_view", "findings", lambda f: f.select("finding_id", "video_id", r6(F.col("ts_s")).alias("ts_s"), "room", "category", "description", "confidence"), "SELECT finding_id, video_id, R6(ts_s) AS ts_s, room, category, description, confidence FROM findings")
register("f14_room_label", "findings", lambda f: f.select("finding_id", F.expr(for_spark(snake("room", "unknown", 40))).alias("label"), F.expr(for_spark(room("room"))).alias("room")), for_check(f"SELECT finding_id, {snake('room', 'unknown', 40)} AS label, {room('room')} AS room FROM findings"))
IDENTITY = "concat_ws('|', room, category, lower(trim(description)), CAST(CAST(floor(ts_s * 1000 + 0.5) AS BIGINT) AS {t}), CAST(CAST(floor(confidence * 10000 + 0.5) AS BIGINT) AS {t}))"
register(
    "f15_identity", "findings", lambda f: f.select("finding_id", F.concat(F.lit("issue-"), F.substring(F.sha2(ex(IDENTITY.format(t="STRING")), 256), 1, 16)).alias("issue_id")),
    f"SELECT finding_id, 'issue-' || substring(sha256({IDENTITY.format(t='VARCHAR')}), 1, 16) AS issue_id FROM findings",
)
JOB = "concat_ws('|', CAST(video_id AS {t}), room, category)"
register(
    "f16_job_id", "findings", lambda f: f.select("video_id", "room", "category").distinct().select("video_id", "room", "category", F.concat(F.lit("job-"), F.substring(F.sha2(ex(JOB.format(t="STRING")), 256), 1, 32)).alias("job_id")),
    f"SELECT DISTINCT video_id, room, category, 'job-' || substring(sha256({JOB.format(t='VARCHAR')}), 1, 32) AS job_id FROM findings",
)


def with_group(findings: DataFrame) -> DataFrame:
    """The taxonomy's group of each finding; the taxonomy is a fixed table of a few rows, so it is broadcast."""
    table = findings.sparkSession.createDataFrame(list(GROUPS.items()), "category string, grp string")
    return findings.join(F.broadcast(table), "category", "left").withColumn("grp", F.coalesce("grp", F.lit("other")))


register("j10_taxonomy_group", "findings", lambda f: with_group(f).groupBy("grp").agg(F.count(F.lit(1)).alias("findings")), f"SELECT {GROUP} AS grp, count(*) AS findings FROM findings GROUP BY 1")


def best_by_identity(findings: DataFrame) -> DataFrame:
    """Of findings of one video, room, category and description, the one with the most confidence, then the first."""
    return findings.groupBy("video_id", "room", "category", "description").agg(F.min_by("finding_id", F.struct(-F.col("confidence"), "finding_id")).alias("finding_id"), F.max("confidence").alias("confidence"))


register(
    "u02_best_by_identity", "findings", best_by_identity,
    "SELECT video_id, room, category, description, finding_id, confidence FROM findings QUALIFY row_number() OVER (PARTITION BY video_id, room, category, description ORDER BY confidence DESC, finding_id) = 1",
)
register(
    "u01_union_sources", "findings",
    lambda f: f.filter("confidence >= 0.65").select("finding_id", "category", F.lit("base").alias("source")).unionByName(f.filter("category like 'wall%'").select("finding_id", "category", "room"), allowMissingColumns=True),
    "SELECT finding_id, category, 'base' AS source, NULL AS room FROM findings WHERE confidence >= 0.65 UNION ALL SELECT finding_id, category, NULL, room FROM findings WHERE category LIKE 'wall%'",
)
register(
    "y04_five_views", "findings", lambda f: f.select("finding_id", F.explode(F.array(F.lit("full"), *[F.lit(f"tile_{n}") for n in range(4)])).alias("view")),
    "SELECT finding_id, unnest(['full', 'tile_0', 'tile_1', 'tile_2', 'tile_3']) AS view FROM findings",
)
register(
    "t12_first_frames", "findings", lambda f: f.withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy("ts_s", "finding_id"))).filter("n <= 8").select("video_id", "finding_id", "n"),
    "SELECT video_id, finding_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY ts_s, finding_id) AS INTEGER) AS n FROM findings QUALIFY n <= 8",
)
register(
    "f22_timestamp_label", "findings",
    lambda f: f.withColumn("s", F.greatest(F.lit(0), F.bround(F.col("ts_s") * 40, 0)).cast("long")).select("finding_id", F.when(F.col("s") >= 3600, F.format_string("%02d:%02d:%02d", F.floor(F.col("s") / 3600), F.floor(F.col("s") % 3600 / 60), F.col("s") % 60)).otherwise(F.format_string("%02d:%02d", F.floor(F.col("s") / 60), F.col("s") % 60)).alias("label")),
    """WITH l AS (SELECT finding_id, greatest(0, CAST(round_even(ts_s * 40, 0) AS BIGINT)) AS s FROM findings)
SELECT finding_id, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS label FROM l""",
)
register(
    "f23_nearest_element", "findings",
    lambda f: f.groupBy("video_id").agg(F.collect_list("ts_s").alias("all"), F.avg("ts_s").alias("mid")).select("video_id", r6(F.array_min(F.transform("all", lambda x: F.struct(F.abs(x - F.col("mid")).alias("d"), x.alias("x"))))["x"]).alias("nearest")),
    "WITH m AS (SELECT video_id, avg(ts_s) AS mid FROM findings GROUP BY video_id) SELECT video_id, R6(arg_min(ts_s, abs(ts_s - mid) * 1e6 + ts_s * 1e-9)) AS nearest FROM findings JOIN m USING (video_id) GROUP BY video_id",
)
register(
    "f24_title_label", "findings", lambda f: f.select("finding_id", F.initcap(F.replace(F.trim("category"), F.lit("_"), F.lit(" "))).alias("label")),
    "SELECT finding_id, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(replace(trim(category), '_', ' '), ' ')], ' ') AS label FROM findings",
)
register(
    "u07_distinct_times", "findings",
    lambda f: f.groupBy("video_id", "room").agg(F.array_join(F.array_sort(F.array_distinct(F.transform(F.collect_list("ts_s"), lambda x: F.floor(F.greatest(F.lit(0.0), x)).cast("long")))), ",").alias("seconds")),
    "SELECT video_id, room, string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) AS seconds FROM (SELECT DISTINCT video_id, room, CAST(floor(greatest(0.0, ts_s)) AS BIGINT) AS s FROM findings) GROUP BY video_id, room",
)
