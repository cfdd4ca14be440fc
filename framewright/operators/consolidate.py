"""Entity resolution of repeated findings: similarity signals, banded self-join, islands, and the greedy merge."""

from __future__ import annotations

import functools
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.dialect import ex, r6
from ..plans.registry import register
from ..sources.scratch import dropped, stored
from .evaluate import MOST_ROUNDS, iou
from .groups import walked
from .rangejoin import band_join

# Words that carry no meaning, forms that mean one thing, and the weights of the signals.
STOP_WORDS = ("a", "an", "and", "appears", "are", "at", "by", "in", "is", "it", "near", "of", "on", "possible", "possibly", "the", "there", "to", "visible", "visibly")
ALIASES = {"discoloration": "stain", "discolored": "stain", "stained": "stain", "staining": "stain", "stains": "stain", "chipped": "chip", "chipping": "chip", "cracked": "crack", "cracking": "crack", "damaged": "damage"}
WEIGHTS = {"time": 0.15, "room": 0.15, "category": 0.20, "image": 0.15, "region": 0.20, "text": 0.15}


@dataclass(frozen=True)
class MergeLimits:
    pair_gap: float = 12.0
    cluster_span: float = 20.0
    score: float = 0.68
    text: float = 0.40
    image: float = 0.55
    region: float = 0.50
    box_iou: float = 0.05
    centre: float = 0.22
    blind_score: float = 0.78
    blind_text: float = 0.65
    blind_iou: float = 0.30


def tokens(text: Column) -> Column:
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), lambda w: ~w.isin(*STOP_WORDS))
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of matching blocks; only pairs that passed the cheap gates get here."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


_TOKENS = "list_transform(list_filter(regexp_extract_all(lower({d}), '[a-z0-9]+'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")), lambda w: CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items()) + " ELSE w END)"
_JACCARD = "len(list_intersect(list_distinct({a}), list_distinct({b}))) / CAST(nullif(len(list_distinct(list_concat({a}, {b}))), 0) AS DOUBLE)"

register("f03_tokens", "findings", lambda f: f.select("finding_id", F.array_join(tokens(F.col("description")), " ").alias("tokens")), f"SELECT finding_id, array_to_string({_TOKENS.format(d='description')}, ' ') AS tokens FROM findings")


def near_pairs(findings: DataFrame, gap: float = 12.0) -> DataFrame:
    """Pairs of findings of one video, room and category at most ``gap`` seconds apart, the earlier (then smaller id) left.

    The equality gates are part of the join key, so only pairs that can merge are ever formed."""
    keyed = findings.withColumn("gate", F.concat_ws("|", F.col("video_id").cast("string"), "room", "category"))
    right = keyed.select("gate", *[F.col(c).alias(f"r_{c}") for c in ("finding_id", "ts_s", "description", "confidence", "x", "y", "width", "height")])
    pairs = band_join(keyed, right, "gate", "ts_s", "r_ts_s", gap)
    return pairs.filter((F.col("ts_s") < F.col("r_ts_s")) | ((F.col("ts_s") == F.col("r_ts_s")) & (F.col("finding_id") < F.col("r_finding_id"))))


_CENTRE = "sqrt(pow((x + width / 2) - (r_x + r_width / 2), 2) + pow((y + height / 2) - (r_y + r_height / 2), 2))"
_NEAR = """r AS (SELECT video_id AS v, room AS rm, category AS ct, finding_id AS r_finding_id, ts_s AS r_ts_s, description AS r_description, x AS r_x, y AS r_y, width AS r_width, height AS r_height FROM findings),
near AS (SELECT * FROM findings JOIN r ON video_id = v AND room = rm AND category = ct AND abs(ts_s - r_ts_s) <= 12.0 AND (ts_s < r_ts_s OR (ts_s = r_ts_s AND finding_id < r_finding_id)))"""


def compare_findings(findings: DataFrame, limits: MergeLimits = MergeLimits(), with_ratio: bool = True) -> DataFrame:
    """The near pairs with their signals, weighted score (over the signals that are there) and whether they merge.
    Without images the stricter limits hold."""
    p = near_pairs(findings, limits.pair_gap)
    left, right = tokens(F.col("description")), tokens(F.col("r_description"))
    text = jaccard(left, right)
    if with_ratio:
        text = F.greatest(text, sequence_ratio(F.array_join(left, " "), F.array_join(right, " ")))
    p = p.withColumns({"overlap": ex(iou("", "r_")), "centre": ex(_CENTRE), "text": text, "time": F.greatest(F.lit(0.0), 1 - F.abs(F.col("ts_s") - F.col("r_ts_s")) / limits.pair_gap)})
    here = sum(v for k, v in WEIGHTS.items() if k != "image")
    score = (WEIGHTS["time"] * F.col("time") + WEIGHTS["room"] + WEIGHTS["category"] + WEIGHTS["region"] * F.col("overlap") + WEIGHTS["text"] * F.col("text")) / here
    p = p.withColumn("score", score)
    together = (F.col("overlap") >= limits.box_iou) | (F.col("centre") <= limits.centre)
    return p.withColumn("merge", together & (F.col("overlap") >= limits.blind_iou) & (F.col("text") >= limits.blind_text) & (F.col("score") >= limits.blind_score))


_TEXT = f"coalesce({_JACCARD.format(a=_TOKENS.format(d='description'), b=_TOKENS.format(d='r_description'))}, 0.0)"
_COMPARED = f"""{_NEAR}, s AS (SELECT *, {iou('', 'r_')} AS overlap, {_CENTRE} AS centre, {_TEXT} AS text_sim, greatest(0.0, 1 - abs(ts_s - r_ts_s) / 12.0) AS time_sim FROM near),
c AS (SELECT *, (0.15 * time_sim + 0.15 + 0.20 + 0.20 * overlap + 0.15 * text_sim) / 0.85 AS score FROM s)"""
register(
    "j06_band_self_join", "findings",
    lambda f: compare_findings(f, with_ratio=False).select("finding_id", "r_finding_id", r6(F.col("overlap")).alias("overlap"), r6(F.col("text")).alias("text"), r6(F.col("score")).alias("score"), "merge"),
    f"WITH {_COMPARED} SELECT finding_id, r_finding_id, R6(overlap) AS overlap, R6(text_sim) AS text, R6(score) AS score, (overlap >= 0.05 OR centre <= 0.22) AND overlap >= 0.30 AND text_sim >= 0.65 AND score >= 0.78 AS merge FROM c",
)
register("f01_box_iou", "findings", lambda f: near_pairs(f).select("finding_id", "r_finding_id", ex(f"R6({iou('', 'r_')})").alias("overlap")), f"WITH {_NEAR} SELECT finding_id, r_finding_id, R6({iou('', 'r_')}) AS overlap FROM near")
register("f02_centre_distance", "findings", lambda f: near_pairs(f).select("finding_id", "r_finding_id", ex(f"R6({_CENTRE})").alias("centre"), ex(f"({iou('', 'r_')} >= 0.05 OR {_CENTRE} <= 0.22)").alias("together")), f"WITH {_NEAR} SELECT finding_id, r_finding_id, R6({_CENTRE}) AS centre, ({iou('', 'r_')} >= 0.05 OR {_CENTRE} <= 0.22) AS together FROM near")
register("f04_text_similarity", "findings", lambda f: near_pairs(f).select("finding_id", "r_finding_id", r6(jaccard(tokens(F.col("description")), tokens(F.col("r_description")))).alias("similarity")), f"WITH {_NEAR} SELECT finding_id, r_finding_id, R6({_TEXT}) AS similarity FROM near")


register("f04_semantic_similarity", "findings", lambda f: compare_findings(f).select("finding_id", "r_finding_id", r6(F.col("text")).alias("text"), r6(F.col("score")).alias("score"), "merge"))


def islands(findings: DataFrame, gap: float = 12.0) -> DataFrame:
    """Numbers the runs of findings of one video, room and category without a gap over ``gap`` seconds. Findings that can
    merge are always in one island, so islands can be resolved apart from each other, in parallel."""
    w = Window.partitionBy("video_id", "room", "category").orderBy("ts_s", "finding_id")
    start = (F.col("ts_s") - F.lag("ts_s").over(w) > gap).cast("int")
    return findings.withColumn("__start", F.coalesce(start, F.lit(0))).withColumn("island", F.sum("__start").over(w)).drop("__start")


_ISLAND = """i AS (SELECT *, coalesce(CAST(ts_s - lag(ts_s) OVER w > 12.0 AS INT), 0) AS starts FROM findings WINDOW w AS (PARTITION BY video_id, room, category ORDER BY ts_s, finding_id)),
n AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY video_id, room, category ORDER BY ts_s, finding_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM i)"""
register("q02_islands", "findings", lambda f: islands(f).select("finding_id", F.col("island").cast("long").alias("island")), f"WITH {_ISLAND} SELECT finding_id, island FROM n")


def _tokens_of(text: str | None) -> list[str]:
    import re

    return [ALIASES.get(w, w) for w in re.findall("[a-z0-9]+", (text or "").lower()) if w not in STOP_WORDS]


def words_alike(x: list[str], y: list[str]) -> float:
    """The better of shared words over all words and the ratio of matching characters."""
    if not x or not y:
        return 0.0
    return max(len({*x} & {*y}) / len({*x} | {*y}), SequenceMatcher(None, " ".join(x), " ".join(y)).ratio())


def text_similarity(a: str | None, b: str | None) -> float:
    return words_alike(_tokens_of(a), _tokens_of(b))


def box_overlap(a, b) -> float:
    w = max(0.0, min(a.x + a.width, b.x + b.width) - max(a.x, b.x))
    h = max(0.0, min(a.y + a.height, b.y + b.height) - max(a.y, b.y))
    union = a.width * a.height + b.width * b.height - w * h
    return w * h / union if union > 0 else 0.0


class Merging:
    """The greedy merge of one island in order of time. A cluster is held until its last member is too far behind to be
    matched; its members lie within the span, so what is held is bounded by the findings of a few seconds."""

    def __init__(self, limits: MergeLimits):
        self.limits, self.clusters = limits, []

    @staticmethod
    def told(clusters: list[list]) -> list[tuple]:
        return [(m.finding_id, min(x.finding_id for x, _ in c), len(c)) for c in clusters for m, _ in c]

    def score(self, m, words: list[str], row, own: list[str]) -> float | None:
        gap, over = abs(m.ts_s - row.ts_s), box_overlap(m, row)
        if gap > self.limits.pair_gap or over < self.limits.blind_iou:
            return None
        text = words_alike(words, own)
        score = (WEIGHTS["time"] * max(0.0, 1 - gap / self.limits.pair_gap) + WEIGHTS["room"] + WEIGHTS["category"] + WEIGHTS["region"] * over + WEIGHTS["text"] * text) / (1 - WEIGHTS["image"])
        return score if text >= self.limits.blind_text and score >= self.limits.blind_score else None

    def push(self, row) -> list[tuple]:
        own = _tokens_of(row.description)
        gone = [c for c in self.clusters if row.ts_s - c[-1][0].ts_s > self.limits.pair_gap]
        if gone:
            self.clusters = [c for c in self.clusters if row.ts_s - c[-1][0].ts_s <= self.limits.pair_gap]
        best = None
        for cluster in self.clusters:
            if row.ts_s - cluster[0][0].ts_s > self.limits.cluster_span:
                continue
            for m, words in cluster:
                score = self.score(m, words, row, own)
                if score is not None and (best is None or score > best[0]):
                    best = (score, cluster)
        if best is None:
            self.clusters.append([(row, own)])
        else:
            best[1].append((row, own))
        return self.told(gone)

    def end(self) -> list[tuple]:
        return self.told(self.clusters)


def consolidate(findings: DataFrame, limits: MergeLimits = MergeLimits()) -> DataFrame:
    """cluster (the smallest finding of the cluster) of each finding: the greedy merge in order of time, one island a
    group. A finding joins the cluster of its best-scoring earlier match whose span would stay within the limit."""
    wanted = islands(findings).select("video_id", "room", "category", "island", "finding_id", "ts_s", "description", "x", "y", "width", "height")
    return walked(wanted, ["video_id", "room", "category", "island"], ["ts_s", "finding_id"], lambda: Merging(limits), "finding_id long, cluster long, members long")


register("q02_consolidation", "findings", consolidate)


def roll_up(findings: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per cluster: representative (most confidence, then earliest), sorted members, an id over them."""
    joined = findings.join(clusters, "finding_id")
    out = joined.groupBy("cluster").agg(
        F.min_by("finding_id", F.struct(-F.col("confidence"), "ts_s", "finding_id")).alias("representative"), F.array_sort(F.collect_list(F.struct("ts_s", "finding_id"))).alias("m"), F.max("confidence").alias("confidence")
    )
    ids = F.array_join(F.transform("m", lambda x: x["finding_id"].cast("string")), ",")
    return out.select("cluster", "representative", "confidence", F.size("m").cast("long").alias("members"), ids.alias("member_ids"), F.concat(F.lit("issue-cluster-"), F.substring(F.sha2(ids, 256), 1, 16)).alias("issue_id"))


register(
    "a22_cluster_roll_up", "findings",
    lambda f: roll_up(f, islands(f).select("finding_id", F.min("finding_id").over(Window.partitionBy("video_id", "room", "category", "island")).alias("cluster"))),
    f"""WITH {_ISLAND}, k AS (SELECT *, min(finding_id) OVER (PARTITION BY video_id, room, category, island) AS cluster FROM n),
g AS (SELECT cluster, string_agg(CAST(finding_id AS VARCHAR), ',' ORDER BY ts_s, finding_id) AS member_ids, count(*) AS members, max(confidence) AS confidence FROM k GROUP BY cluster),
b AS (SELECT cluster, finding_id AS representative FROM k QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY confidence DESC, ts_s, finding_id) = 1)
SELECT cluster, representative, confidence, members, member_ids, 'issue-cluster-' || substring(sha256(member_ids), 1, 16) AS issue_id FROM g JOIN b USING (cluster)""",
)
register(
    "a30_consolidation_counters", "findings",
    lambda f: islands(f).groupBy("video_id").agg(F.count(F.lit(1)).alias("raw"), F.count_distinct("room", "category", "island").alias("islands")).select("video_id", "raw", "islands", (F.col("raw") - F.col("islands")).alias("merged")),
    f"WITH {_ISLAND} SELECT video_id, count(*) AS raw, count(DISTINCT (room, category, island)) AS islands, count(*) - count(DISTINCT (room, category, island)) AS merged FROM n GROUP BY video_id",
)
register(
    "j07_semi_join_gate", "findings",
    lambda f: (lambda k: k.select("cluster", "finding_id").join(f.filter("confidence >= 0.9").select("finding_id"), "finding_id", "left_semi").select("cluster").distinct())(islands(f).withColumn("cluster", F.min("finding_id").over(Window.partitionBy("video_id", "room", "category", "island")))),
    f"WITH {_ISLAND}, k AS (SELECT *, min(finding_id) OVER (PARTITION BY video_id, room, category, island) AS cluster FROM n) SELECT DISTINCT cluster FROM k WHERE confidence >= 0.9",
)


def suppress(findings: DataFrame, gap: float = 5.0, overlap: float = 0.3) -> DataFrame:
    """Findings that stay when each that stays suppresses the less certain ones of its video and category that are near in time
    and place (of equally certain ones the smaller id comes first).

    In rounds over all videos at once: a finding that no undecided better neighbour can suppress stays, and its neighbours go,
    until nothing is undecided. Neighbours are the pairs of a join on time buckets, so no group is ever held in memory."""
    keyed = findings.select(F.concat_ws("|", F.col("video_id").cast("string"), "category").alias("of"), "finding_id", "ts_s", "confidence", "x", "y", "width", "height")
    other = keyed.select("of", *[F.col(c).alias(f"r_{c}") for c in keyed.columns[1:]])
    better = (F.col("confidence") > F.col("r_confidence")) | ((F.col("confidence") == F.col("r_confidence")) & (F.col("finding_id") < F.col("r_finding_id")))
    pairs = band_join(keyed, other, "of", "ts_s", "r_ts_s", gap).filter(better & (ex(iou("", "r_")) >= overlap))
    edges, gone = stored(pairs.select(F.col("finding_id").alias("better"), F.col("r_finding_id").alias("worse")), "neighbours"), []
    for _ in range(MOST_ROUNDS):
        if edges.isEmpty():
            break
        stays = edges.select(F.col("better").alias("id")).distinct().join(edges.select(F.col("worse").alias("id")), "id", "left_anti")  # of those that could suppress
        gone.append(stored(edges.join(stays, edges["better"] == stays["id"]).select(F.col("worse").alias("id")).distinct(), "suppressed"))
        before = edges
        # what went suppresses nothing, and what stays has no undecided neighbour left
        edges = stored(edges.join(gone[-1], edges["better"] == gone[-1]["id"], "left_anti").join(gone[-1], F.col("worse") == gone[-1]["id"], "left_anti"), "neighbours")
        dropped(before)
    else:
        raise RuntimeError("the suppression did not settle")
    ids = findings.select("finding_id")
    for part in gone:
        ids = ids.join(part, ids["finding_id"] == part["id"], "left_anti")
    return ids


_IOU = "greatest(0.0, least({a}.x + {a}.width, {b}.x + {b}.width) - greatest({a}.x, {b}.x)) * greatest(0.0, least({a}.y + {a}.height, {b}.y + {b}.height) - greatest({a}.y, {b}.y))".format(a="k", b="o")
_HIT = f"k.ts_s - o.ts_s <= 5.0 AND o.ts_s - k.ts_s <= 5.0 AND CASE WHEN k.width * k.height + o.width * o.height - {_IOU} > 0 THEN {_IOU} / (k.width * k.height + o.width * o.height - {_IOU}) ELSE 0.0 END >= 0.3"
register(
    "t06_suppression", "findings", suppress,
    f"""WITH RECURSIVE o AS (SELECT video_id, category, finding_id, {{'ts_s': ts_s, 'x': x, 'y': y, 'width': width, 'height': height}} AS o, row_number() OVER (PARTITION BY video_id, category ORDER BY confidence DESC, finding_id) AS n FROM findings),
walk AS (SELECT video_id, category, n, finding_id, true AS stays, [o] AS kept FROM o WHERE n = 1
  UNION ALL SELECT video_id, category, n, finding_id, NOT hit, CASE WHEN hit THEN kept ELSE list_append(kept, o) END
  FROM (SELECT o.*, w.kept, len(list_filter(w.kept, lambda k: {_HIT.replace('o.', 'o.o.')})) > 0 AS hit FROM walk w JOIN o ON o.video_id = w.video_id AND o.category = w.category AND o.n = w.n + 1))
SELECT finding_id FROM walk WHERE stays""",
)


def spaced_top(findings: DataFrame, k: int = 3, apart: float = 1.0) -> DataFrame:
    """Of each video the ``k`` least certain ambiguous findings that are ``apart`` seconds from each other: ``k`` rounds, each
    with the best finding that is left of each video (a map-side minimum), which takes those too near to it out."""
    left, found = findings.filter("confidence between 0.5 and 0.85").select("video_id", "finding_id", "ts_s", "confidence"), []
    for _ in range(k):
        first = left.groupBy("video_id").agg(F.min(F.struct("confidence", "ts_s", "finding_id")).alias("b"))
        found.append(stored(first.select("video_id", "b.finding_id", F.col("b.ts_s").alias("at")), "spaced"))
        left = left.join(found[-1].select("video_id", "at"), "video_id").filter(F.abs(F.col("ts_s") - F.col("at")) >= apart).drop("at")
    return functools.reduce(DataFrame.unionByName, [t.select("video_id", "finding_id") for t in found])


_AMBIGUOUS = "a AS (SELECT video_id, finding_id, ts_s, confidence FROM findings WHERE confidence BETWEEN 0.5 AND 0.85)"
_FIRST = "arg_min({{'id': finding_id, 'at': ts_s}}, (confidence, ts_s, finding_id)) AS b"
register(
    "t05_spaced_top", "findings", spaced_top,
    f"""WITH {_AMBIGUOUS}, one AS (SELECT video_id, {_FIRST.format()} FROM a GROUP BY video_id),
two AS (SELECT a.video_id, {_FIRST.format()} FROM a JOIN one ON one.video_id = a.video_id AND abs(ts_s - one.b.at) >= 1.0 GROUP BY a.video_id),
three AS (SELECT a.video_id, {_FIRST.format()} FROM a JOIN one ON one.video_id = a.video_id AND abs(ts_s - one.b.at) >= 1.0 JOIN two ON two.video_id = a.video_id AND abs(ts_s - two.b.at) >= 1.0 GROUP BY a.video_id)
SELECT video_id, b.id AS finding_id FROM one UNION ALL SELECT video_id, b.id FROM two UNION ALL SELECT video_id, b.id FROM three""",
)


class Agreement:
    """Clusters of one room's findings around their first member, let go of when it is too far behind to be joined."""

    def __init__(self, gap: float, alike: float, alone: float):
        self.gap, self.alike, self.alone = gap, alike, alone
        self.clusters: list[list] = []  # first member's time and words, smallest id, members, most confidence

    def told(self, clusters: list[list]) -> list[tuple]:
        return [(least, n, top, n >= 2 or top >= self.alone) for _, _, least, n, top in clusters]

    def push(self, row) -> list[tuple]:
        own = _tokens_of(row.description)
        gone = [c for c in self.clusters if row.ts_s - c[0] > self.gap]
        if gone:
            self.clusters = [c for c in self.clusters if row.ts_s - c[0] <= self.gap]
        for c in self.clusters:
            if words_alike(c[1], own) >= self.alike or len({*c[1]} & {*own}) >= 2:
                c[2], c[3], c[4] = min(c[2], row.finding_id), c[3] + 1, max(c[4], row.confidence)
                break
        else:
            self.clusters.append([row.ts_s, own, row.finding_id, 1, row.confidence])
        return self.told(gone)

    def end(self) -> list[tuple]:
        return self.told(self.clusters)


def consensus(findings: DataFrame, gap: float = 4.0, alike: float = 0.45, alone: float = 0.90) -> DataFrame:
    """Clusters of findings of a room that agree across frames; accepted with two supporters, or one that is sure."""
    wanted = findings.select("video_id", "room", "finding_id", "ts_s", "description", "confidence")
    return walked(wanted, ["video_id", "room"], ["ts_s", "finding_id"], lambda: Agreement(gap, alike, alone), "cluster long, support long, confidence double, accepted boolean")


register("a23_consensus", "findings", consensus)
