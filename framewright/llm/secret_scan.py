"""Secret scans through a trigram index.

For each rule the mandatory trigrams are derived from its parsed regular expression, as a Boolean query (an AND of ORs of
ANDs). Each task indexes its rows block by block: an inverted index from the trigrams that any rule asks for to sorted
postings of rows, made with array operations over the block's bytes. A rule's query unites and intersects postings, and
only the candidates are verified with the regular expression. Rules without mandatory trigrams scan every text in full.
The index is case-folded for all rules, which can only add candidates. Blocks are independent, so nothing is shuffled,
gathered or kept, and a lost executor costs its blocks only.

Spans are in code points, end exclusive. Defined results: null text is empty and has no spans; each row is scanned by
itself, repeated rows alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _parser as sre

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import light, read_table, small_batches, utf8


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and non-overlapping, that ``holds`` accepts (by its group lengths)."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.A | (re.I if self.ignore_case else 0))


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 20),
    Rule("hex", r"[0-9a-f]+", False, 0, 24),
)
#: Rules beside the contract's base: public formats of well-known credentials.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

Query = list[list[frozenset[int]]]  # AND of ORs of ANDs of trigrams
#: Most alternatives of an exact string that are followed before the string is cut.
MOST = 48


def codes(text: str) -> frozenset[int]:
    raw = text.encode().lower()
    return frozenset(raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2))


def exact_strings(op, arg) -> set[str] | None:
    """The strings that a parsed item can match, if they are few; else None."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg)}
    if name == "IN":
        if len(arg) <= 6 and all(str(k) == "LITERAL" for k, _ in arg):
            return {chr(v) for _, v in arg}
        return None
    if name == "SUBPATTERN":
        return sequence(arg[3])
    if name == "BRANCH":
        parts = [sequence(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if name == "MAX_REPEAT" and arg[1] == 1:
        inner = sequence(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    if name == "MAX_REPEAT" and arg[0] == arg[1] and arg[0] <= 4:
        inner = sequence(arg[2])
        return None if inner is None else product([inner] * arg[0])
    return None


def product(parts: list[set[str]]) -> set[str] | None:
    out = {""}
    for p in parts:
        out = {a + b for a in out for b in p}
        if len(out) > MOST:
            return None
    return out


def sequence(items) -> set[str] | None:
    parts = [exact_strings(op, arg) for op, arg in items]
    return None if any(p is None for p in parts) else product(parts)


def trigram_query(pattern: str) -> Query:
    """What any match must contain: for each run of items that match few strings, one of these strings."""
    query: Query = []
    run = {""}

    def cut() -> None:
        if all(len(s.encode()) >= 3 for s in run):
            query.append([codes(s) for s in sorted(run)])

    for op, arg in sre.parse(pattern):
        strings = exact_strings(op, arg)
        longer = None if strings is None else product([run, strings])
        if longer is not None:
            run = longer
            continue
        cut()
        run = strings if strings is not None else {""}
    cut()
    return query


def hex_runs(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the runs of [0-9a-f] of ``least`` bytes or more."""
    table = np.zeros(256, np.int8)
    table[[*range(48, 58), *range(97, 103)]] = 1
    edge = np.diff(table[data], prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= least
    return starts[long], ends[long]


def fold(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


class Scanner:
    """The queries and patterns of some rules, and the trigrams they ask for."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(k, r, r.compiled(), trigram_query(r.pattern)) for k, r in enumerate(rules)]
        asked = sorted({t for *_, q in self.rules for any_of in q for all_of in any_of for t in all_of})
        self.asked = np.array(asked, np.int64)
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[self.asked] = True

    def postings(self, offsets: np.ndarray, data: np.ndarray) -> Callable[[int], np.ndarray]:
        """The block's inverted index: rows (ascending) by trigram. Trigrams across two rows only add candidates."""
        low = fold(data).astype(np.int32)
        grams = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:] if len(low) > 2 else np.zeros(0, np.int32)
        at = np.flatnonzero(self.wanted[grams])
        pairs = np.unique(np.stack([grams[at].astype(np.int64), np.searchsorted(offsets, at, "right") - 1], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        bounds = dict(zip(self.asked.tolist(), zip(np.searchsorted(pairs[:, 0], self.asked, "left").tolist(), np.searchsorted(pairs[:, 0], self.asked, "right").tolist(), strict=True), strict=True))
        return lambda gram: pairs[slice(*bounds[gram]), 1]

    def candidates(self, query: Query, rows_of: Callable[[int], np.ndarray]) -> np.ndarray:
        found: np.ndarray | None = None
        for any_of in query:
            union = []
            for all_of in any_of:
                rows: np.ndarray | None = None
                for gram in all_of:
                    rows = rows_of(gram) if rows is None else np.intersect1d(rows, rows_of(gram), assume_unique=True)
                    if not len(rows):
                        break
                union.append(rows)
            hits = np.unique(np.concatenate(union))
            found = hits if found is None else np.intersect1d(found, hits, assume_unique=True)
        return found

    def scan(self, offsets: np.ndarray, data: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """By row: (start, rule's number, end) in code points."""
        n = len(offsets) - 1
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        rows_of = self.postings(offsets, data)
        raw = data.tobytes()
        texts: dict[int, str] = {}

        def text(i: int) -> str:
            if i not in texts:
                texts[i] = raw[offsets[i] : offsets[i + 1]].decode()
            return texts[i]

        for k, rule, pattern, query in self.rules:
            if query:
                rows = self.candidates(query, rows_of).tolist()
            elif rule.pattern == BASE[2].pattern:  # a full scan for one class of bytes, done with arrays
                starts, ends = hex_runs(data, rule.least)
                for s, e, i in zip(starts.tolist(), ends.tolist(), (np.searchsorted(offsets, starts, "right") - 1).tolist(), strict=True):
                    while s < e:  # a run may go on into the next rows
                        stop = min(e, int(offsets[i + 1]))
                        if stop - s >= rule.least:
                            at = len(raw[offsets[i] : s].decode())
                            out[i].append((at, k, at + stop - s))
                        s, i = stop, i + 1
                continue
            else:
                rows = range(n)
            for i in rows:
                out[i] += [(m.start(), k, m.end()) for m in pattern.finditer(text(i)) if len(m[rule.group]) >= rule.least]
        return [sorted(x) for x in out]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and spans (array of kind, start, end; by start, then kind as listed) of each row of ``docs`` (doc_id, text)."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in small_batches(batches, "text"):
            found = scanner.scan(*utf8(batch.column("text")))
            rows = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(span))], names=["doc_id", "spans"])

    return light(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    base = [r.kind for r in BASE]
    spans = scan(read_table(spark, sf_dir, "documents"))
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in base],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


