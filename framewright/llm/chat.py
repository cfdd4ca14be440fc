"""Chat formatting: a finite-state machine over roles emits text segments with loss flags from a declarative template.

The rows of a conversation are streamed in order through one task (hash-partitioned by conversation, sorted inside the
partition); the machine holds its state and the number of the turn only, so a conversation of any length needs constant
memory. The output is a table of segments; the concatenation of a conversation's segments is its formatted text.

The template is data: for each role the marks around a turn, the loss flag of its text, and the roles that may follow.
Control strings inside texts are escaped by a backslash before the characters that begin one (``<``, ``[``) and before
backslashes; :func:`unescape` reverts it, so a text can never be read as a mark.

Defined results: null texts are empty; a null role is the role ``""``; roles that the template doesn't name get a general
mark that holds the (escaped) name, and no loss. Turn order is validated, not repaired: each segment carries ``valid``,
false from the first row on at which the order is broken. Rows that repeat a turn are all formatted, ordered by role and
text; null turns come first; rows of a null conv_id are one conversation. The conversation -7 that the query adds joins rows
that the table may already have under that number. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool
    follows: frozenset[str]


@dataclass(frozen=True)
class Template:
    """``begin`` opens a conversation. ``turns``: by role. A role may come after the states in its ``follows``; the state
    is the role before, or START."""

    begin: str = "<s>"
    turns: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("<<SYS>>", "<</SYS>>", False, frozenset({"START"})),
            "user": Turn("[INST] ", " [/INST]", False, frozenset({"START", "system", "assistant"})),
            "assistant": Turn("<a>", "</s>", True, frozenset({"user"})),
        }
    )
    other: tuple[str, str, str] = ("[ROLE ", "]", "[/ROLE]")


TEMPLATE = Template()
SEGMENTS = "conv_id long, seq long, turn long, kind string, text string, loss boolean, valid boolean"


def escape(text: str) -> str:
    return re.sub(r"([\\<\[])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def ordered(conversations: DataFrame) -> DataFrame:
    lean = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return lean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chats(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """The segments of all conversations; each task's rows lie in order of conversation and ``seq``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, seq, valid = object(), "START", 0, True
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("conv_id", "seq", "turn", "kind", "text", "loss", "valid")}
            for conv, turn, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text")), strict=True):
                parts = []
                if conv != current:
                    current, state, seq, valid = conv, "START", 0, True
                    parts.append(("mark", template.begin, False))
                rule = template.turns.get(role)
                valid = valid and rule is not None and state in rule.follows
                if rule:
                    parts += [("mark", rule.before, False), ("text", escape(text), rule.loss), ("mark", rule.after, False)]
                else:
                    head, close, end = template.other
                    parts += [("mark", head + re.sub(r"([\\<\[\]])", r"\\\1", role) + close, False), ("text", escape(text), False), ("mark", end, False)]
                state = role
                for kind, piece, loss in parts:
                    for k, v in zip(out, (conv, seq, turn, kind, piece, loss, valid), strict=True):
                        out[k].append(v)
                    seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], names=list(out))

    return ordered(conversations).mapInArrow(run, SEGMENTS)


def reader(template: Template = TEMPLATE) -> re.Pattern:
    """One formatted turn: a mark, the escaped text, the mark that ends it. Unescaped ``<`` or ``[`` only begin marks."""
    body = r"((?:[^\\<\[]|\\.)*)"
    named = [f"(?P<{role}>{re.escape(t.before)}){body}{re.escape(t.after)}" for role, t in template.turns.items()]
    head, close, end = map(re.escape, template.other)
    name = r"((?:[^\\\]]|\\.)*)"
    # " [/INST]" begins with a blank, so a text's own blank at its end is given back by the match going back one step
    return re.compile("|".join([*named, f"(?P<other_>{head}){name}{close}{body}{end}"]), re.S)


def read_turn(formatted: str, pattern: re.Pattern) -> tuple[str, str]:
    m = pattern.fullmatch(formatted)
    if m is None:
        raise ValueError(f"not a formatted turn: {formatted[:80]!r}")
    role = next(k for k, v in m.groupdict().items() if v is not None)
    texts = [unescape(g) for g in m.groups() if g is not None][1:]
    return (texts[0], texts[1]) if role == "other_" else (role, texts[0])


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segments: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Digests of each conversation, read from the formatted text and its loss mask. ``segments`` as format_chats leaves
    them: a conversation's segments in one task and in order."""
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = reader(template)
        current, started, done = None, False, []
        n = chars = loss_chars = 0
        turns = loss_sum = None
        valid, piece = True, ""

        def flush():
            if started:
                if piece:
                    raise ValueError("a conversation ends inside a turn")
                done.append((current, n, turns.hexdigest(), loss_chars, loss_sum.hexdigest(), chars, valid))

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=[x.split()[0] for x in DIGESTS.split(", ")])

        for batch in batches:
            for conv, seq, text, loss, ok in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "seq", "text", "loss", "valid")), strict=True):
                if not started or seq == 0:
                    flush()
                    current, started, n, chars, loss_chars = conv, True, 0, 0, 0
                    turns, loss_sum, valid, piece = hashlib.sha256(), hashlib.sha256(), True, ""
                chars += len(text)
                valid = valid and ok
                if loss:
                    plain = unescape(text)
                    loss_chars += len(plain)
                    loss_sum.update(plain.encode())
                if seq == 0 and text == template.begin:
                    continue
                piece += text
                if (seq - 1) % 3 == 2:  # a turn is three segments
                    role, said = read_turn(piece, pattern)
                    turns.update(f"{role}\n{said}\n".encode())
                    n, piece = n + 1, ""
            if len(done) >= 4096:
                yield table()
                done.clear()
        flush()
        if done:
            yield table()

    return segments.mapInArrow(run, DIGESTS)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    conversations = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(conversations.unionByName(added)))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, lag(role, 1, 'START') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prior,
    length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7
      ELSE 14 + length(role) + length(regexp_replace(role, '[^\\<\[\]]', '', 'g')) END AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN prior = 'START' WHEN 'user' THEN prior IN ('START', 'system', 'assistant')
    WHEN 'assistant' THEN prior = 'user' ELSE false END) AS valid
FROM e GROUP BY conv_id
"""
