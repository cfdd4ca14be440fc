"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The queue holds one bucket per merge rank with the linked-list positions at which that merge is possible, and a bitmap of the
ranks whose bucket is not empty, with two summary levels above it. Find-first-set from the top picks the lowest rank in
constant time, whatever the length; entries whose pair has changed meanwhile are stale and are skipped. A pre-token of n
bytes costs O(n log n), so a text without a single blank does no harm.

One queue serves all pre-tokens of a block of texts that are not yet known: their lists lie one after another, no pair
reaches across, and since the order of merges matters within a pre-token only, a bucket is emptied at once with array
operations (from the left, where merges overlap). Only where emptying a bucket at once could have changed the order within
a pre-token (two of its merges in one bucket, and one of them makes a pair of lower rank), that pre-token is done again by
the same queue, one position at a time. Pre-tokens that were seen before come from a bounded table.

Defined results: null text is empty; an empty text has no ids. Texts are never cut. Each row is encoded by itself, so
ties and repeated rows need no rule.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import light, read_table, small_batches

#: Pre-tokens kept with their ids; longer ones than LONG bytes are not kept. Bytes of text in a block; bytes
#: of pre-tokens (one, if it is longer) in one queue.
KEPT, LONG, BLOCK, QUEUED = 1 << 18, 64, 4 << 20, 1 << 18


class RankQueue:
    """Buckets by rank under a bitmap of three levels. A bucket is whatever is put there."""

    def __init__(self, ranks: int):
        words = (ranks >> 6) + 1
        self.low = [0] * words
        self.mid = [0] * ((words >> 6) + 1)
        self.top = 0
        self.buckets: dict[int, list] = {}

    def bucket(self, rank: int) -> list:
        """The bucket of a rank, to put something in."""
        found = self.buckets.get(rank)
        if found is None:
            found = self.buckets[rank] = []
            w = rank >> 6
            self.low[w] |= 1 << (rank & 63)
            self.mid[w >> 6] |= 1 << (w & 63)
            self.top |= 1 << (w >> 6)
        return found

    def lowest(self) -> int | None:
        if not self.top:
            return None
        m = (self.top & -self.top).bit_length() - 1
        word = self.mid[m]
        w = (m << 6) + (word & -word).bit_length() - 1
        word = self.low[w]
        return (w << 6) + (word & -word).bit_length() - 1

    def empty(self, rank: int) -> list:
        """Takes a rank's bucket away."""
        w = rank >> 6
        self.low[w] ^= 1 << (rank & 63)
        if not self.low[w]:
            self.mid[w >> 6] ^= 1 << (w & 63)
            if not self.mid[w >> 6]:
                self.top ^= 1 << (w >> 6)
        return self.buckets.pop(rank)

    def push(self, rank: int, position: int) -> None:
        heappush(self.bucket(rank), position)

    def pop(self) -> tuple[int, int] | None:
        """The lowest position of the lowest rank."""
        rank = self.lowest()
        if rank is None:
            return None
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            self.empty(rank)
        return rank, position


class Codec(dict):
    """The ids (little-endian unsigned 32-bit) of the pre-tokens that were seen, by their text."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.pieces[rank] = token
        self.split = regex.compile(pattern).findall
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(a << 32 | b, r) for t, r in self.ranks.items() for k in range(1, len(t)) if (a := self.ranks.get(t[:k])) is not None and (b := self.ranks.get(t[k:])) is not None]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.keys, self.values = np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1])

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def merge_one(self, piece: bytes) -> list[int]:
        """The ids of one pre-token, one position at a time."""
        ranks, queue = self.ranks, RankQueue(len(self.pieces))
        n = len(piece)
        token: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            if (r := ranks.get(token[i] + token[i + 1])) is not None:
                queue.push(r, i)
        while (least := queue.pop()) is not None:
            rank, i = least
            if token[i] is None or (j := after[i]) >= n or ranks.get(joined := token[i] + token[j]) != rank:
                continue  # stale
            token[i], token[j] = joined, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(joined + token[k])) is not None:
                    queue.push(r, i)
            if (h := before[i]) >= 0 and (r := ranks.get(token[h] + joined)) is not None:
                queue.push(r, h)
        return [ranks[t] for t in token if t is not None]

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of many pre-tokens, through one queue."""
        sizes = np.array([len(p) for p in pieces])
        token = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(token)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        ends = np.cumsum(sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = n  # place n stands for nothing
        before[ends - sizes] = n
        token, after, before = np.append(token, -1), np.append(after, n), np.append(before, n)
        queue = RankQueue(len(self.pieces))

        def offer(places: np.ndarray) -> np.ndarray:
            """Puts the pairs that begin at these places into their buckets, with what they are made of; their ranks."""
            left, right = token[places], token[after[places]]
            rank = np.where(right >= 0, self.rank_of(left, np.maximum(right, 0)), -1)
            found = np.flatnonzero(rank >= 0)
            if len(found):
                found = found[np.argsort(rank[found], kind="stable")]
                r = rank[found]
                heads = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])).tolist()
                places, left, right = places[found], left[found], right[found]
                for k, s, e in zip(r[heads].tolist(), heads, [*heads[1:], len(r)], strict=True):
                    queue.bucket(k).append((places[s:e], left[s:e], right[s:e]))
            return rank

        offer(np.arange(n))
        again = np.zeros(len(pieces), bool)
        while (rank := queue.lowest()) is not None:
            held = queue.empty(rank)
            at, left, right = held[0] if len(held) == 1 else (np.concatenate(x) for x in zip(*held, strict=True))
            fresh = (token[at] == left) & (token[after[at]] == right)  # the others are stale
            at = at[fresh]
            if len(held) > 1:
                at = np.unique(at)
            if not len(at):
                continue
            if len(at) > 1:
                # where one merge would take what the next one begins with, every other one of the row is left out
                linked = after[at[:-1]] == at[1:]
                if linked.any():
                    first = np.concatenate([[True], ~linked])
                    row = np.arange(len(at))
                    at = at[(row - np.maximum.accumulate(np.where(first, row, 0))) % 2 == 0]
            gone = after[at]
            token[at], token[gone] = rank, -1
            after[at] = behind = after[gone]
            before[behind] = at
            before[n] = n
            prior = before[at]
            whole = prior < n
            new = offer(np.concatenate([at, prior[whole]]))
            lower = (new >= 0) & (new < rank)
            if lower.any() and len(at) > 1:
                own = owner[at]
                several = np.flatnonzero(np.bincount(own, minlength=len(pieces)) > 1)
                again[np.intersect1d(np.concatenate([own, own[whole]])[lower], several)] = True
        alive = np.flatnonzero(token[:n] >= 0)
        ids = token[alive].astype("<u4").tobytes()
        stops = (np.cumsum(np.bincount(owner[alive], minlength=len(pieces))) * 4).tolist()
        out = [ids[s:e] for s, e in zip([0, *stops[:-1]], stops, strict=True)]
        for k in np.flatnonzero(again).tolist():
            out[k] = np.array(self.merge_one(pieces[k]), "<u4").tobytes()
        return out

    def encode_block(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        asked: dict[str, str] = {}  # one object for all places of a pre-token
        split = [list(map(asked.setdefault, parts, parts)) for parts in (self.split(t) if t else [] for t in texts)]
        if len(self) + len(asked) > KEPT:
            self.clear()
        new = [t for t in asked if t not in self]
        todo, long = [], []
        for t in new:
            raw = t.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self[t] = whole.to_bytes(4, "little")
            else:
                todo.append((t, raw))
            if len(raw) > LONG:
                long.append(t)
        ends = np.cumsum([len(raw) for _, raw in todo])
        start = 0
        while start < len(todo):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + QUEUED, "right")))
            for (t, _), ids in zip(todo[start:stop], self.merge_all([raw for _, raw in todo[start:stop]]), strict=True):
                self[t] = ids
            start = stop
        out = [b"".join(map(self.__getitem__, s)) for s in split]
        for t in long:
            del self[t]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(1)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each row of ``docs`` (doc_id, text). ``path``: a rank file that all executors have."""
    path, pattern = path or default_files()[0], pattern or default_files()[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in small_batches(batches, "text", BLOCK):
            ids = c.encode_block(batch.column("text").to_pylist())
            flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            offsets = np.concatenate([[0], np.cumsum([len(x) >> 2 for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "ids"])

    return light(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and decoded (binary) of each row of ``encoded`` (doc_id, ids)."""
    path, pattern = path or default_files()[0], pattern or default_files()[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            out = [c.decode(np.asarray(x if x is not None else [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, beside: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the columns ``beside`` them: encodes each text, decodes the ids,
    and keeps the digests only, in one pass, so neither ids nor texts travel."""
    path, pattern = path or default_files()[0], pattern or default_files()[1]
    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", *[f"{c} {docs.schema[c].dataType.simpleString()}" for c in beside]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in small_batches(batches, "text", BLOCK):
            n, ids_sum, text_sum = [], [], []
            for ids in c.encode_block(batch.column("text").to_pylist()):
                n.append(len(ids) >> 2)
                ids_sum.append(hashlib.sha256(ids).hexdigest())
                text_sum.append(hashlib.sha256(c.decode(ids)).hexdigest())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sum, pa.string()), pa.array(text_sum, pa.string()), *[batch.column(c) for c in beside]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *beside])

    return light(docs).select("doc_id", "text", *beside).mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))
