"""Policy: routing by confidence, safety sensitivity, sufficiency of evidence, severity, wording, checklist texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import ex, r6
from ..plans.registry import register
from .findings import case_of, listed

# Phrases that make a finding sensitive, and the order of severity classes.
SAFETY_TERMS = ("fire", "smoke", "gas leak", "carbon monoxide", "exposed wire", "exposed wiring", "electrical", "spark", "active leak", "water leak", "flood", "mold", "structural", "collapse", "ceiling sag", "trip hazard", "broken glass", "sharp edge")
FIX, REVIEW, COSMETIC = "Fix before renting", "Review recommended", "Cosmetic"

BEFORE, AFTER = "(^|[^a-z0-9_])", "([^a-z0-9_]|$)"


def phrase(term: str, column: str = "lower(description)") -> str:
    return f"RX({column}, '{BEFORE}{term}{AFTER}')"


def safety_reasons() -> str:
    """Reasons in the order of their text."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {phrase(t)} THEN 'safety phrase: {t}' END" for t in sorted(SAFETY_TERMS)) + ")"


SENSITIVE = f"({safety_reasons()} <> '')"


def route(exhausted: str = "false", sensitive: str = SENSITIVE) -> str:
    """Accept strictly above 0.85; reject below 0.50 unless it is sensitive; investigate else, or ask a person."""
    return f"CASE WHEN confidence > 0.85 THEN 'ACCEPT_CANDIDATE' WHEN confidence < 0.50 AND NOT {sensitive} THEN 'REJECT_CANDIDATE' WHEN {exhausted} THEN 'REQUEST_HUMAN_APPROVAL' ELSE 'INVESTIGATE_CANDIDATE' END"


register("p12_route_confidence", "findings", lambda f: f.select("finding_id", ex(route()).alias("route"), ex(route("true")).alias("exhausted_route")), f"SELECT finding_id, {route()} AS route, {route('true')} AS exhausted_route FROM findings")
POST = "CASE WHEN confidence_after >= 0.80 THEN 'ACCEPT_FINDING' WHEN confidence_after < 0.45 THEN 'DISMISS_FINDING' ELSE 'REQUEST_HUMAN_APPROVAL' END"
STEP = "CASE WHEN confidence_after > 0.85 THEN 'present' WHEN confidence_after < 0.50 THEN 'absent' ELSE 'investigate' END"
register("p13_post_check_action", "actions", lambda a: a.select("candidate_id", "sequence_no", ex(POST).alias("next_action"), ex(STEP).alias("outcome")), f"SELECT candidate_id, sequence_no, {POST} AS next_action, {STEP} AS outcome FROM actions")


def safety(findings: DataFrame) -> DataFrame:
    """Sensitive phrases found in the description."""
    return findings.select("finding_id", ex(safety_reasons()).alias("reasons")).withColumn("sensitive", F.col("reasons") != "")


register("p14_safety_sensitivity", "findings", safety, f"SELECT finding_id, {safety_reasons()} AS reasons, {SENSITIVE} AS sensitive FROM findings")
MISSING = "concat_ws(',', CASE WHEN independent_views = 0 THEN 'candidate_visibility' END, CASE WHEN evidence_quality < 0.55 THEN 'evidence_quality' END, CASE WHEN independent_views < 2 THEN 'independent_support' END)"


def sufficiency(findings: DataFrame) -> DataFrame:
    """Whether the evidence of a finding (independent_views, evidence_quality) suffices, what is missing, and what to do next."""
    told = findings.withColumn("missing", ex(MISSING)).withColumn("sufficient", F.col("missing") == "")
    return told.withColumn("next_step", F.when(F.col("sufficient"), "VERIFY_EVIDENCE").otherwise("CALL_INSPECT_INTERVAL"))


register(
    "p15_evidence_sufficiency", "findings", lambda f: sufficiency(f.withColumn("evidence_quality", F.col("confidence"))).select("finding_id", "sufficient", "missing", "next_step"),
    """WITH m AS (SELECT finding_id, independent_views >= 2 AND confidence >= 0.55 AS sufficient, [CASE WHEN independent_views = 0 THEN 'candidate_visibility' END, CASE WHEN confidence < 0.55 THEN 'evidence_quality' END, CASE WHEN independent_views < 2 THEN 'independent_support' END] AS parts FROM findings)
SELECT finding_id, sufficient, array_to_string([x for x in parts if x IS NOT NULL], ',') AS missing, CASE WHEN sufficient THEN 'VERIFY_EVIDENCE' ELSE 'CALL_INSPECT_INTERVAL' END AS next_step FROM m""",
)
SUPPORT = "CASE WHEN frames_returned >= 3 THEN {a} ELSE {b} END"
register(
    "p31_interval_evidence", "actions",
    lambda a: a.select("candidate_id", "sequence_no", ex(f"CASE WHEN confidence_after >= 0.5 THEN {SUPPORT.format(a=2, b=0)} ELSE 0 END").alias("independent_views"), ex(f"CASE WHEN confidence_after >= 0.5 THEN {SUPPORT.format(a=1.0, b=0.4)} ELSE 0.4 END").alias("quality_score"), ex("CASE WHEN confidence_after >= 0.5 THEN frames_returned ELSE 0 END").alias("observation_count")),
    f"SELECT candidate_id, sequence_no, CASE WHEN confidence_after >= 0.5 THEN {SUPPORT.format(a=2, b=0)} ELSE 0 END AS independent_views, CASE WHEN confidence_after >= 0.5 THEN {SUPPORT.format(a=1.0, b=0.4)} ELSE 0.4 END AS quality_score, CASE WHEN confidence_after >= 0.5 THEN frames_returned ELSE 0 END AS observation_count FROM actions",
)

# Rules of the severity cascade, in order; the first that is found in the text decides.
_TEXT = "lower(concat_ws(' ', description, category))"
SEVERITY_RULES = (
    ("broken_condition", FIX, "(broken|shattered|snapped)"),
    ("missing_protective_cover", FIX, "((missing|absent|removed)[^a-z0-9_](.{0,28}[^a-z0-9_])?(cover|plate|cap|guard)|(uncovered|exposed)[^a-z0-9_](.{0,28}[^a-z0-9_])?(outlet|opening|fixture|wiring))"),
    ("detached_condition", FIX, "(detached|hanging|loose fixture)"),
    ("hole_or_puncture", FIX, "(hole|puncture)"),
    ("possible_moisture_evidence", REVIEW, "(moisture|water|leak|stain|staining|discoloration)"),
    ("visible_cracking", REVIEW, "(crack|cracked|cracking|fracture)"),
    ("paint_scuff", COSMETIC, "(paint scuff|scuff|scuffed|paint mark)"),
    ("minor_trim_damage", COSMETIC, "(minor[^a-z0-9_](.{0,18}[^a-z0-9_])?trim)"),
    ("cleanliness", COSMETIC, "(cleanliness|dirty|dirt|dust|grime|residue|trash|clutter)"),
)
FIX_CATEGORIES = ("wall_hole", "floor_damage", "broken_tile", "fixture_damage", "missing_hardware", "visible_damage")
REVIEW_CATEGORIES = ("wall_crack", "wall_stain", "floor_stain", "visible_staining", "other")
COSMETIC_CATEGORIES = ("paint_damage", "trim_damage", "cleanliness")
RULE = (
    "CASE " + " ".join(f"WHEN {phrase(p, _TEXT)} THEN '{r}'" for r, _, p in SEVERITY_RULES)
    + f" WHEN category IN {listed(FIX_CATEGORIES + REVIEW_CATEGORIES + COSMETIC_CATEGORIES)} THEN concat('category:', category) ELSE 'fallback:review' END"
)
SEVERITY = (
    "CASE " + " ".join(f"WHEN {phrase(p, _TEXT)} THEN '{s}'" for _, s, p in SEVERITY_RULES)
    + f" WHEN category IN {listed(FIX_CATEGORIES)} THEN '{FIX}' WHEN category IN {listed(COSMETIC_CATEGORIES)} THEN '{COSMETIC}' ELSE '{REVIEW}' END"
)


def classify(findings: DataFrame) -> DataFrame:
    """``rule_id`` and ``severity`` beside the columns of ``findings``."""
    return findings.withColumns({"rule_id": ex(RULE), "severity": ex(SEVERITY)})


CLASSIFIED = f"classified AS (SELECT *, {RULE} AS rule_id, {SEVERITY} AS severity FROM findings)"
register("p16_severity", "findings", lambda f: classify(f).select("finding_id", "rule_id", "severity"), f"WITH {CLASSIFIED} SELECT finding_id, rule_id, severity FROM classified")


def classify_by_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """The severity cascade with the rules as a table (position, rule_id, severity, pattern), so that users add rules
    without code. The table is small by nature (a rule is written by hand) and is sent along as one array."""
    packed = rules.agg(F.array_sort(F.collect_list(F.struct("position", "rule_id", "severity", "pattern"))).alias("rules"))
    text = F.lower(F.concat_ws(" ", "description", "category"))
    joined = findings.join(F.broadcast(packed))
    first = F.try_element_at(F.filter("rules", lambda r: F.regexp_like(text, F.concat(F.lit(BEFORE), r["pattern"], F.lit(AFTER)))), F.lit(1))
    return joined.withColumn("hit", first).select("finding_id", "hit.rule_id", "hit.severity")


def rule_table(spark) -> DataFrame:
    return spark.createDataFrame([(n, *r) for n, r in enumerate(SEVERITY_RULES)], "position int, rule_id string, severity string, pattern string")


register(
    "y03_rules_as_data", "findings", lambda f: classify_by_rules(f, rule_table(f.sparkSession)),
    f"WITH {CLASSIFIED} SELECT finding_id, CASE WHEN rule_id NOT LIKE 'category:%' AND rule_id <> 'fallback:review' THEN rule_id END AS rule_id, CASE WHEN rule_id NOT LIKE 'category:%' AND rule_id <> 'fallback:review' THEN severity END AS severity FROM classified",
)

# Wording rules and the texts that replace what they find.
SAFE_TEXTS = {
    "no_mold_diagnosis": "Visible discoloration may warrant inspection for moisture or other causes.",
    "no_electrical_safety_determination": "Visible electrical fixture appears damaged. Qualified inspection recommended.",
    "no_structural_significance_determination": "Visible cracking detected. Human inspection recommended to determine significance.",
}
_LOW = "lower(description)"
CLAIMS = {
    "no_mold_diagnosis": phrase("mou?ld(s|y|ing)?"),
    "no_electrical_safety_determination": f"({phrase('(electrical|electric|wiring|wire|outlet|receptacle|socket|breaker|panel|fixture)')} AND {phrase('(unsafe|hazard|hazardous|dangerous|live|fire +risk|code +violation|not +safe)')})",
    "no_structural_significance_determination": f"({phrase('structural(ly)?')} AND {phrase('(crack|cracks|cracked|cracking|damage|damaged|failure|compromised)')})",
}
RULES_HIT = "concat_ws(',', " + ", ".join(f"CASE WHEN {hit} THEN '{r}' END" for r, hit in CLAIMS.items()) + ")"
SAFE = "CASE WHEN " + RULES_HIT + " = '' THEN description ELSE concat_ws(' ', " + ", ".join(f"CASE WHEN {hit} THEN '{SAFE_TEXTS[r]}' END" for r, hit in CLAIMS.items()) + ") END"
register("p17_responsible_text", "findings", lambda f: f.select("finding_id", ex(SAFE).alias("description"), ex(RULES_HIT).alias("applied")), f"SELECT finding_id, {SAFE} AS description, {RULES_HIT} AS applied FROM findings")


def scrub(findings: DataFrame) -> DataFrame:
    """Nested evidence, scrubbed text by text: every description in each room's list of structs."""
    return findings.withColumn("safe", ex(SAFE)).groupBy("video_id", "room").agg(F.array_sort(F.collect_list(F.struct("finding_id", "safe"))).alias("payload"))


register(
    "p18_scrub_payload", "findings",
    lambda f: scrub(f).select("video_id", "room", F.size("payload").cast("long").alias("items"), F.sha2(F.array_join(F.transform("payload", lambda p: F.concat_ws(":", p["finding_id"].cast("string"), p["safe"])), ";"), 256).alias("payload_sha256")),
    f"""WITH s AS (SELECT video_id, room, finding_id, array_to_string([x for x in [CASE WHEN regexp_matches(lower(description), '\\bmou?ld(s|y|ing)?\\b') THEN '{SAFE_TEXTS["no_mold_diagnosis"]}' END,
  CASE WHEN regexp_matches(lower(description), '\\b(electrical|electric|wiring|wire|outlet|receptacle|socket|breaker|panel|fixture)\\b') AND regexp_matches(lower(description), '\\b(unsafe|hazard|hazardous|dangerous|live|fire +risk|code +violation|not +safe)\\b') THEN '{SAFE_TEXTS["no_electrical_safety_determination"]}' END,
  CASE WHEN regexp_matches(lower(description), '\\bstructural(ly)?\\b') AND regexp_matches(lower(description), '\\b(crack|cracks|cracked|cracking|damage|damaged|failure|compromised)\\b') THEN '{SAFE_TEXTS["no_structural_significance_determination"]}' END] if x IS NOT NULL], ' ') AS hit, description FROM findings)
SELECT video_id, room, count(*) AS items, sha256(string_agg(CAST(finding_id AS VARCHAR) || ':' || CASE WHEN hit = '' THEN description ELSE hit END, ';' ORDER BY finding_id)) AS payload_sha256 FROM s GROUP BY video_id, room""",
)

# Words of the checklist and of the report.
FALLBACK_SUBJECTS = {
    "wall_hole": "damaged wall", "wall_crack": "wall crack", "paint_damage": "paint", "wall_stain": "wall discoloration", "trim_damage": "damaged trim", "floor_damage": "damaged floor",
    "floor_stain": "floor stain", "broken_tile": "broken tile", "fixture_damage": "damaged fixture", "missing_hardware": "missing fixture hardware", "visible_staining": "discoloration",
    "cleanliness": "affected area", "visible_damage": "damaged surface", "other": "visible condition",
}
TITLES = {
    "wall_hole": "Visible wall opening", "wall_crack": "Visible wall cracking", "paint_damage": "Visible paint damage", "wall_stain": "Possible moisture-related wall staining", "trim_damage": "Visible trim damage",
    "floor_damage": "Visible floor damage", "floor_stain": "Possible floor staining", "broken_tile": "Visible broken tile", "fixture_damage": "Visible fixture damage", "missing_hardware": "Missing fixture hardware",
    "visible_staining": "Possible moisture-related staining", "cleanliness": "Cleaning recommended", "visible_damage": "Visible property damage",
}
GENERIC = ("condition", "damage", "damaged area", "discoloration", "stain", "wall", "paint", "affected area", "visible condition")
_VERB = f"""CASE WHEN severity = '{FIX}' THEN CASE WHEN category IN ('broken_tile', 'missing_hardware') THEN 'Replace' ELSE 'Repair' END
  WHEN severity = '{COSMETIC}' THEN CASE WHEN category = 'paint_damage' THEN 'Touch up' WHEN category IN ('cleanliness', 'floor_stain', 'visible_staining', 'wall_stain') THEN 'Clean' ELSE 'Address' END
  WHEN category IN ('visible_damage', 'fixture_damage', 'floor_damage', 'trim_damage') THEN 'Check' ELSE 'Inspect' END"""
_PLAIN = "regexp_replace(regexp_replace(lower(trim(BOTH ' .' FROM description)), '^(there (is|are) |an? |the )', ''), '^visible +', '')"
_FALLBACK = case_of("category", FALLBACK_SUBJECTS, "'visible condition'")
_SUBJECT = f"CASE WHEN {_PLAIN} = '' OR length({_PLAIN}) > 100 THEN {_FALLBACK} WHEN {_PLAIN} IN {listed(GENERIC)} THEN concat(lower(room), ' ', {_FALLBACK}) ELSE {_PLAIN} END"
ACTION = f"concat({_VERB}, ' ', {_SUBJECT})"
TITLE = case_of("category", TITLES, "'Visible condition'")
SUMMARY = "CASE WHEN category IN ('visible_staining', 'wall_stain', 'floor_stain') THEN 'Discoloration' ELSE 'The visible condition' END"
register("p19_checklist_action", "findings", lambda f: classify(f).select("finding_id", ex(ACTION).alias("action")), f"WITH {CLASSIFIED} SELECT finding_id, {ACTION} AS action FROM classified")


def titled(findings: DataFrame) -> DataFrame:
    """Title and summary of each finding; the titles are a fixed table of a few rows, broadcast."""
    table = findings.sparkSession.createDataFrame(list(TITLES.items()), "category string, named string")
    return findings.join(F.broadcast(table), "category", "left").select("finding_id", F.coalesce("named", F.lit("Visible condition")).alias("title"), F.concat(ex(SUMMARY), F.lit(" is visible in the selected evidence frame.")).alias("summary"))


register("p20_issue_title", "findings", titled, f"SELECT finding_id, {TITLE} AS title, {SUMMARY} || ' is visible in the selected evidence frame.' AS summary FROM findings")


def verified(findings: DataFrame) -> DataFrame:
    """Verdicts of a verification pass: by confidence of what is visible; and of one that may reword a finding (visible,
    category_holds, reworded, confidence)."""
    verdict = F.when(~F.col("visible"), "REJECT").when(F.col("confidence") >= 0.85, "ACCEPT").when(F.col("confidence") < 0.50, "REJECT").otherwise("HUMAN_REVIEW")
    normal = F.when(~(F.col("visible") & F.col("category_holds")), "REJECT").when(F.col("confidence") < 0.80, "HUMAN_REVIEW").when(F.col("reworded"), "ACCEPT_NORMALIZED").otherwise("ACCEPT_UNCHANGED")
    return findings.withColumns({"verdict": verdict, "normalizing": normal})


register(
    "p24_verification_verdicts", "findings", lambda f: verified(f).select("finding_id", "verdict", "normalizing"),
    """SELECT finding_id, CASE WHEN visible AND confidence >= 0.85 THEN 'ACCEPT' WHEN visible AND confidence >= 0.50 THEN 'HUMAN_REVIEW' ELSE 'REJECT' END AS verdict,
  CASE WHEN visible AND category_holds AND confidence >= 0.80 THEN CASE WHEN reworded THEN 'ACCEPT_NORMALIZED' ELSE 'ACCEPT_UNCHANGED' END WHEN visible AND category_holds THEN 'HUMAN_REVIEW' ELSE 'REJECT' END AS normalizing FROM findings""",
)
register(
    "t03_closest_to_gate", "findings", lambda f: f.filter("confidence between 0.45 and 0.80").groupBy("video_id").agg(F.min_by("finding_id", F.struct(F.abs(F.col("confidence") - 0.65), "finding_id")).alias("finding_id")),
    "SELECT video_id, finding_id FROM findings WHERE confidence BETWEEN 0.45 AND 0.80 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY abs(confidence - 0.65), finding_id) = 1",
)
_RANK = f"CASE {route()} WHEN 'INVESTIGATE_CANDIDATE' THEN 0 WHEN 'ACCEPT_CANDIDATE' THEN 1 ELSE 2 END"


def policy_candidate(findings: DataFrame) -> DataFrame:
    """Each video's first finding by route, safety, confidence and id; whether it is sensitive is told once a row."""
    ranked = findings.select("video_id", "finding_id", "confidence", ex(SENSITIVE).alias("sensitive")).withColumn("route", ex(route(sensitive="sensitive")))
    ranked = ranked.withColumn("route_rank", ex("CASE route WHEN 'INVESTIGATE_CANDIDATE' THEN 0 WHEN 'ACCEPT_CANDIDATE' THEN 1 ELSE 2 END"))
    first = Window.partitionBy("video_id").orderBy("route_rank", ~F.col("sensitive"), F.col("confidence").desc(), "finding_id")
    return ranked.withColumn("n", F.row_number().over(first)).filter("n = 1").select("video_id", "finding_id", "route_rank")


register(
    "t04_policy_candidate", "findings",
    policy_candidate,
    f"SELECT video_id, finding_id, {_RANK} AS route_rank FROM findings QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY {_RANK}, NOT {SENSITIVE}, confidence DESC, finding_id) = 1",
)

# The report
register(
    "a15_severity_counts", "findings", lambda f: classify(f).groupBy("video_id").agg(*[F.count_if(F.col("severity") == s).alias(n) for n, s in (("fix", FIX), ("review", REVIEW), ("cosmetic", COSMETIC))]),
    f"WITH {CLASSIFIED} SELECT video_id, count(*) FILTER (WHERE severity = '{FIX}') AS fix, count(*) FILTER (WHERE severity = '{REVIEW}') AS review, count(*) FILTER (WHERE severity = '{COSMETIC}') AS cosmetic FROM classified GROUP BY video_id",
)


def readiness(counts: DataFrame) -> DataFrame:
    """100 less 5, 1.5 and 0.2 for each finding of the classes, not below 0, rounded half up (in decimals)."""
    tenths = 1000 - 50 * F.col("fix") - 15 * F.col("review") - 2 * F.col("cosmetic")
    return counts.withColumn("score", F.round((F.greatest(F.lit(0), tenths) / 10).cast("decimal(20,1)"), 0).cast("long"))


register(
    "a16_readiness_score", "findings",
    lambda f: readiness(classify(f).groupBy("video_id").agg(*[F.count_if(F.col("severity") == s).alias(n) for n, s in (("fix", FIX), ("review", REVIEW), ("cosmetic", COSMETIC))])).select("video_id", "score"),
    f"""WITH {CLASSIFIED}, c AS (SELECT video_id, sum(CASE severity WHEN '{FIX}' THEN 50 WHEN '{REVIEW}' THEN 15 ELSE 2 END) AS off FROM classified GROUP BY video_id)
SELECT video_id, CAST((greatest(0, 1000 - off) + 5) // 10 AS BIGINT) AS score FROM c""",
)
_ORDER = f"CASE severity WHEN '{FIX}' THEN 0 WHEN '{COSMETIC}' THEN 2 ELSE 1 END"
register(
    "t08_report_order", "findings",
    lambda f: classify(f).withColumn("place", F.row_number().over(Window.partitionBy("video_id").orderBy(ex(_ORDER), F.lower("room"), "ts_s", "finding_id"))).select("video_id", "finding_id", "place"),
    f"WITH {CLASSIFIED} SELECT video_id, finding_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY {_ORDER}, lower(room), ts_s, finding_id) AS INTEGER) AS place FROM classified",
)


def rooms_report(findings: DataFrame) -> DataFrame:
    """A nested report: for each video its rooms, for each room its findings in report order."""
    ranked = classify(findings).withColumn("at", F.struct(ex(_ORDER).alias("rank"), F.lower("room").alias("low"), "ts_s", "finding_id"))
    per_room = ranked.groupBy("video_id", "room").agg(F.array_sort(F.collect_list("at")).alias("issues"))
    return per_room.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(F.col("issues")[0].alias("first"), "room", "issues"))).alias("rooms"))


register(
    "a31_room_report", "findings",
    lambda f: rooms_report(f).select("video_id", F.explode("rooms").alias("r")).select("video_id", "r.room", F.array_join(F.transform("r.issues", lambda i: i["finding_id"].cast("string")), ",").alias("issues")),
    f"WITH {CLASSIFIED} SELECT video_id, room, string_agg(CAST(finding_id AS VARCHAR), ',' ORDER BY {_ORDER}, lower(room), ts_s, finding_id) AS issues FROM classified GROUP BY video_id, room",
)


def checklist(findings: DataFrame, statuses: DataFrame) -> DataFrame:
    """Each finding's saved status; Open where none or an unknown one is saved."""
    saved = findings.join(statuses, "finding_id", "left")
    return saved.withColumn("status", F.when(F.col("status").isin("Open", "In progress", "Resolved"), F.col("status")).otherwise("Open"))


STATUS = "CASE WHEN status IN ('Open', 'In progress', 'Resolved') THEN status ELSE 'Open' END"
register("j09_saved_status", "findings checklist_status", lambda f, s: checklist(f, s).select("finding_id", "status"), f"SELECT finding_id, {STATUS} AS status FROM findings LEFT JOIN checklist_status USING (finding_id)")
register(
    "a17_status_counts", "findings checklist_status",
    lambda f, s: checklist(f, s).groupBy("video_id").agg(F.count_if(F.col("status") == "Open").alias("open"), F.count_if(F.col("status") == "In progress").alias("in_progress"), F.count_if(F.col("status") == "Resolved").alias("resolved"), F.count(F.lit(1)).alias("items")),
    f"WITH c AS (SELECT video_id, {STATUS} AS s FROM findings LEFT JOIN checklist_status USING (finding_id)) SELECT video_id, count(*) FILTER (WHERE s = 'Open') AS open, count(*) FILTER (WHERE s = 'In progress') AS in_progress, count(*) FILTER (WHERE s = 'Resolved') AS resolved, count(*) AS items FROM c GROUP BY video_id",
)
HISTOGRAM = "count(*) FILTER (WHERE confidence < 0.5) AS below, count(*) FILTER (WHERE confidence >= 0.5 AND confidence < 0.65) AS low, count(*) FILTER (WHERE confidence >= 0.65 AND confidence <= 0.85) AS middle, count(*) FILTER (WHERE confidence > 0.85) AS high"
register(
    "a18_confidence_histogram", "findings",
    lambda f: f.groupBy("category").agg(F.count_if(F.col("confidence") < 0.5).alias("below"), F.count_if((F.col("confidence") >= 0.5) & (F.col("confidence") < 0.65)).alias("low"), F.count_if(F.col("confidence").between(0.65, 0.85)).alias("middle"), F.count_if(F.col("confidence") > 0.85).alias("high")),
    f"SELECT category, {HISTOGRAM} FROM findings GROUP BY category",
)
register(
    "w10_confidence_chain", "actions",
    lambda a: a.withColumn("confidence_before", F.lag("confidence_after").over(Window.partitionBy("candidate_id").orderBy("sequence_no"))).select("candidate_id", "sequence_no", "confidence_before", "confidence_after", r6(F.col("confidence_after") - F.col("confidence_before")).alias("delta")),
    "WITH c AS (SELECT *, lag(confidence_after) OVER (PARTITION BY candidate_id ORDER BY sequence_no) AS confidence_before FROM actions) SELECT candidate_id, sequence_no, confidence_before, confidence_after, R6(confidence_after - confidence_before) AS delta FROM c",
)
register(
    "w08_sequence_contiguity", "actions",
    lambda a: a.withColumn("n", F.row_number().over(Window.partitionBy("candidate_id").orderBy("sequence_no"))).groupBy("candidate_id").agg(F.bool_and(F.col("n") == F.col("sequence_no")).alias("contiguous"), F.count(F.lit(1)).alias("actions")),
    "WITH n AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY sequence_no) AS n FROM actions) SELECT candidate_id, bool_and(n = sequence_no) AS contiguous, count(*) AS actions FROM n GROUP BY candidate_id",
)
_TERMINAL = "(confidence_after > 0.85 OR confidence_after < 0.50)"
register(
    "w09_first_terminal_step", "actions",
    lambda a: a.withColumn("ended", F.max(ex(_TERMINAL)).over(Window.partitionBy("candidate_id").orderBy("sequence_no").rowsBetween(Window.unboundedPreceding, -1))).groupBy("candidate_id").agg(F.coalesce(F.min(F.when(ex(_TERMINAL), F.col("sequence_no"))), F.lit(0)).cast("long").alias("first_terminal"), F.count_if(F.coalesce("ended", F.lit(False))).alias("calls_after")),
    f"WITH e AS (SELECT *, bool_or({_TERMINAL}) OVER (PARTITION BY candidate_id ORDER BY sequence_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM actions) SELECT candidate_id, CAST(coalesce(min(CASE WHEN {_TERMINAL} THEN sequence_no END), 0) AS BIGINT) AS first_terminal, count(*) FILTER (WHERE ended) AS calls_after FROM e GROUP BY candidate_id",
)


def agent_scores(actions: DataFrame, truth: DataFrame) -> DataFrame:
    """Against the truth (candidate_id, truth): accuracy before and after investigation, resolution and unnecessary calls: from flags per candidate."""
    steps = actions.withColumns({"outcome": ex(STEP), "n": F.row_number().over(Window.partitionBy("candidate_id").orderBy("sequence_no"))})
    per = steps.groupBy("candidate_id").agg(F.min_by("outcome", "n").alias("initial"), F.max_by("outcome", "n").alias("final"), F.count(F.lit(1)).alias("calls")).join(truth, "candidate_id", "left")
    return per.agg(
        F.count(F.lit(1)).alias("candidates"), r6(F.avg((F.col("initial") == F.col("truth")).cast("int"))).alias("accuracy_before"), r6(F.avg((F.col("final") == F.col("truth")).cast("int"))).alias("accuracy_after"),
        F.count_if(F.col("initial") == "investigate").alias("ambiguous"), F.count_if((F.col("initial") == "investigate") & (F.col("final") != "investigate")).alias("resolved"),
        r6(F.count_if((F.col("initial") == "investigate") & (F.col("final") != "investigate")) / F.nullif(F.count_if(F.col("initial") == "investigate"), F.lit(0))).alias("resolved_rate"),
        r6(F.avg("calls")).alias("average_calls"), F.sum(F.when(F.col("initial") != "investigate", F.col("calls")).otherwise(0)).alias("unnecessary_calls"),
        F.count_if((F.col("truth") == "present") & (F.col("initial") != "present") & (F.col("final") == "present")).alias("recovered"),
    )


register(
    "a21_agent_scores", "actions candidate_truth", agent_scores,
    f"""WITH s AS (SELECT *, {STEP} AS outcome FROM actions), p AS (
  SELECT candidate_id, arg_min(outcome, sequence_no) AS initial, arg_max(outcome, sequence_no) AS final, count(*) AS calls, any_value(t.truth) AS truth FROM s LEFT JOIN candidate_truth t USING (candidate_id) GROUP BY candidate_id)
SELECT count(*) AS candidates, R6(avg(CAST(initial = truth AS INT))) AS accuracy_before, R6(avg(CAST(final = truth AS INT))) AS accuracy_after, count(*) FILTER (WHERE initial = 'investigate') AS ambiguous,
  count(*) FILTER (WHERE initial = 'investigate' AND final <> 'investigate') AS resolved,
  R6(count(*) FILTER (WHERE initial = 'investigate' AND final <> 'investigate') / CAST(nullif(count(*) FILTER (WHERE initial = 'investigate'), 0) AS DOUBLE)) AS resolved_rate,
  R6(avg(calls)) AS average_calls, CAST(sum(CASE WHEN initial <> 'investigate' THEN calls ELSE 0 END) AS BIGINT) AS unnecessary_calls,
  count(*) FILTER (WHERE truth = 'present' AND initial <> 'present' AND final = 'present') AS recovered FROM p""",
)
register(
    "s10_action_log", "actions",
    lambda a: a.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("sequence_no", "action", "frames_returned"))).alias("log")).select("candidate_id", F.sha2(F.array_join(F.transform("log", lambda x: F.concat_ws(":", x["sequence_no"].cast("string"), x["action"], x["frames_returned"].cast("string"))), ","), 256).alias("document_sha256")),
    "SELECT candidate_id, sha256(string_agg(concat_ws(':', CAST(sequence_no AS VARCHAR), action, CAST(frames_returned AS VARCHAR)), ',' ORDER BY sequence_no)) AS document_sha256 FROM actions GROUP BY candidate_id",
)
