"""Removal of repeated passages by column-wise construction of a suffix order over many strings.

A window is a string of ``LENGTH`` bytes. The work is split so that equal windows always meet, in pieces of bounded size:

1. In each window the smallest hash among its ``GRAM``-byte strings is its anchor; neighbouring windows with one anchor
   form a fragment of at most LENGTH + SPAN - 1 bytes. Equal windows have equal anchors. GRAM-byte strings that are very
   frequent (a bounded list, from a frequent-items sketch over all texts) are anchors only where there is no other, so
   a common line doesn't gather its neighbourhoods in one group.
2. Fragments meet by anchor, as hashes and places only. Fragments with the same two hashes (64 bits of the anchor, 64 of the
   whole) count as equal and are resolved at once: all but the first are repeats, already in the map task where possible.
   An anchor with one fragment left can't have repeats. One row is held, however often an anchor occurs.
3. The texts of the fragments that are left are fetched and cut once more, by the largest hash of their windows, so that
   windows meet only where both anchors are the same. Strings of equal bytes stand side by side in the sorted files and
   become one. Of what is left each task builds, chunk of anchors by chunk, the
   Burrows-Wheeler transform and the common prefixes of the chunk's strings column by column: each round inserts the next
   symbol of every string, from the right, at the place given by its rank, and updates the common prefixes there. After
   the last round the suffixes that share LENGTH symbols stand together; all but the first window of each are repeats.
   Spark's sorted shuffle files play the part of the sequential external files: a chunk is read once, in order.
4. Fragments of an anchor at which more than ``HEAVY`` different ones meet are cut to their windows before step 3, so that
   no chunk has more strings than a task can hold; windows whose hash occurs once are left out, all others go the same way,
   where their bytes decide.
5. The repeated windows of each document are laid over its bytes.

Order of windows: doc_id (null first), then a hash of the text (for rows that repeat an id), then the start. Defined
results: null texts are empty; texts of fewer than LENGTH bytes stay as they are; rows that repeat both id and text are
one document listed twice: each gets that document's result. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frequent, light, read_table, small_batches, utf8, written

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Bytes hashed at a time (its width in bits is part of the choice of anchors); frequent anchors listed, counters of the sketch.
PIECE_BITS = 22
PIECE = 1 << PIECE_BITS
FREQUENT, COUNTERS = 2000, 20_000
#: Strings of a chunk, and different fragments of one anchor that aren't cut to windows, so that a chunk has no more than both together.
CHUNK, HEAVY = 8192, 32_768
_BASE = 0x9E3779B97F4A7C15 | 1
_SYMBOLS = np.random.default_rng(97).integers(0, 2**64, 256, np.uint64)
FIRST = np.iinfo(np.int64).min  # stands for a null doc_id


def _powers(base: int) -> np.ndarray:
    out = np.empty(PIECE + 1, np.uint64)
    out[0], n = 1, 1
    while n < len(out):
        m = min(n, len(out) - n)
        out[n : n + m] = out[:m] * np.uint64(pow(base, n, 1 << 64))
        n += m
    return out


class Hasher:
    """Hashes of any substring of a piece from prefix sums modulo 2**64."""

    def __init__(self):
        with np.errstate(over="ignore"):
            self.up, self.down = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SYMBOLS[data] * self.up[: len(data)], dtype=np.uint64)])

    def of(self, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((prefix[stop] - prefix[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def grams(self, prefix: np.ndarray) -> np.ndarray:
        """The hashes of all strings of GRAM bytes."""
        n = len(prefix) - GRAM
        with np.errstate(over="ignore"):
            h = prefix[GRAM:] - prefix[:n]
            h *= self.down[:n]
            return _mixed(h)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits, in place."""
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h


_hasher: Hasher | None = None


def hasher() -> Hasher:
    global _hasher
    if _hasher is None:
        _hasher = Hasher()
    return _hasher


def fragments(offsets: np.ndarray, data: np.ndarray, common: np.ndarray, largest: bool = False) -> tuple[np.ndarray, ...]:
    """Row, start in the row, number of windows, anchor's hash, fragment's hash; over at most PIECE bytes. The anchor of a
    window is its smallest hash, or its largest."""
    h = hasher()
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    prefix = h.prefix(data)
    grams = h.grams(prefix)
    low = np.uint64(PIECE - 1)
    keys = (~grams if largest else grams) >> np.uint64(1)
    if len(common):
        table = np.zeros(1 << 16, bool)
        table[(common >> np.uint64(48)).astype(np.int64)] = True
        maybe = np.flatnonzero(table[grams.view(np.uint16)[3::4]])  # by the highest two bytes
        maybe = maybe[common[np.minimum(np.searchsorted(common, grams[maybe]), len(common) - 1)] == grams[maybe]]
        keys[maybe] |= np.uint64(1 << 63)
    keys &= ~low
    keys |= np.arange(len(keys), dtype=np.uint64)  # the place breaks ties, leftmost first
    least, width = keys, 1
    while width * 2 <= SPAN:
        least, width = np.minimum(least[: len(least) - width], least[width:]), width * 2
    rest = SPAN - width
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    anchor = (least & low).astype(np.int64)  # for each start of a window
    # runs of one anchor, cut where a row's last window is; then those without a window of one row are left out
    change = anchor[1:] != anchor[:-1]
    edges = np.concatenate([offsets[:-1], offsets[1:] - LENGTH + 1])
    edges = edges[(edges > 0) & (edges < len(anchor))]
    change[edges - 1] = True
    start = np.concatenate([[0], np.flatnonzero(change) + 1])
    count = np.diff(np.append(start, len(anchor)))
    row = np.searchsorted(offsets, start, "right") - 1
    inside = start + LENGTH <= offsets[row + 1]
    start, count, row = start[inside], count[inside], row[inside]
    return row, start - offsets[row], count, grams[anchor[start]], h.of(prefix, start, start + count - 1 + LENGTH)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Rows, offsets, bytes, and the place of the first byte in its row; a text longer than a piece comes in several, which
    overlap so that each window is in exactly one."""
    for batch in small_batches(batches, "text", PIECE):
        offsets, data = utf8(batch.column("text"))
        if len(data) <= PIECE:
            yield batch, offsets, data, 0
            continue
        for s in range(0, len(data) - LENGTH + 1, PIECE - LENGTH + 1):
            part = data[s : s + PIECE]
            yield batch, np.array([0, len(part)]), part, s


def packed(th: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """36 bits of the start, 7 of the number of windows: ordered as the windows of a text are. ``th`` (20 bits) stands above
    them; it is 0 here, as 20 bits don't tell the texts of one id apart: their hash is a column of its own."""
    return th << 43 | start << 7 | count


def keyed(docs: DataFrame) -> DataFrame:
    """doc (null as FIRST), th (63 bits of a hash of the text, its lowest 20 bits first) and text. doc and th are the key of
    a document, in order."""
    h = F.xxhash64("text")
    th = F.shiftleft(h.bitwiseAND(F.lit((1 << 20) - 1)), 43).bitwiseOR(F.shiftrightunsigned(h, 21))
    return light(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc"), th.alias("th"), F.coalesce("text", F.lit("")).alias("text"))


def frequent_anchors(docs: DataFrame) -> np.ndarray:
    """At most FREQUENT anchors that are in the most places, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, offsets, data, _ in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(fragments(offsets, data, np.zeros(0, np.uint64))[3].view(np.int64))], names=["ah"])

    top = frequent(keyed(docs).mapInArrow(run, "ah long"), "ah", FREQUENT, COUNTERS).collect()  # FREQUENT rows at most
    return np.sort(np.array([r.item for r in top], np.int64).view(np.uint64))


def differ(*columns: np.ndarray) -> np.ndarray:
    """Of each row but the first, whether it differs from the one before in any of ``columns``."""
    return np.logical_or.reduce([c[1:] != c[:-1] for c in columns])


FOUND = "ah long, fh long, doc long, th long, pack long"
MET = "ah long, doc long, th long, pack long"


def all_fragments(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """ah, fh, doc, th, pack: the fragments of all texts, but for those that a task has seen before in the same piece: they
    are repeats, marked by a negative pack, and have no anchor to meet at."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, offsets, data, base in pieces(batches):
            row, start, count, ah, fh = fragments(offsets, data, sent.value)
            doc, th = batch.column("doc").to_numpy()[row], batch.column("th").to_numpy()[row]
            pack = packed(np.int64(0), start + base, count)
            order = np.lexsort((pack, th, doc, fh, ah))
            ah, fh, doc, th, pack = ah[order], fh[order], doc[order], th[order], pack[order]
            again = np.concatenate([[False], (ah[1:] == ah[:-1]) & (fh[1:] == fh[:-1]) & differ(doc, th, pack)]) if len(ah) else np.zeros(0, bool)
            with np.errstate(over="ignore"):
                ah = np.where(again, (doc.view(np.uint64) * np.uint64(_BASE)) ^ th.view(np.uint64) ^ pack.view(np.uint64), ah)
            columns = [ah.view(np.int64), np.where(again, 0, fh.view(np.int64)), doc, th, np.where(again, pack | np.int64(FIRST), pack)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["ah", "fh", "doc", "th", "pack"])

    return keyed(docs).mapInArrow(run, FOUND)


def resolve(found: DataFrame) -> DataFrame:
    """ah, doc, th, pack: of the fragments, the repeats (negative pack), and the first ones of anchors that have several.
    One row is held at most: rows of an anchor go on as they come once it has a second fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(ah, doc, th, pack) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (ah, doc, th, pack)], names=["ah", "doc", "th", "pack"])

        last: np.ndarray | None = None  # ah, fh, doc, th and pack of the first row of the last fragment
        alone = False  # whether it is its anchor's only fragment so far, and waits
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy() for k in ("ah", "fh", "doc", "th", "pack")])
            marked = rows[4] < 0
            if marked.any():
                yield told(*rows[:, marked][[0, 2, 3, 4]])
                rows = rows[:, ~marked]
            if not rows.shape[1]:
                continue
            carried = last is not None
            if carried:
                rows = np.concatenate([last[:, None], rows], 1)
            ah, fh, *place = rows
            fresh = np.concatenate([[True], differ(ah, fh)])
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(ah)), 0))
            again = np.logical_or.reduce([x != x[head] for x in place])
            if again.any():
                yield told(ah[again], *(x[again] for x in place[:2]), place[2][again] | FIRST)
            different = rows[:, fresh]
            group = np.cumsum(np.concatenate([[0], different[0][1:] != different[0][:-1]]))
            several = np.bincount(group) > 1
            stays = several[group]
            if carried and not alone:  # the first row is told already, and its anchor has several
                stays[group == 0] = True
                stays[0] = False
            last = different[:, -1].copy()
            alone = not several[-1] and not (carried and not alone and group[-1] == 0)
            if stays.any():
                yield told(*different[:, stays][[0, 2, 3, 4]])

    return found.repartition("ah").sortWithinPartitions("ah", "fh", "doc", "th", "pack").mapInArrow(run, MET)


def suffix_order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all suffixes of LENGTH bytes or more, in order: string, start, and common prefix with the suffix before (at most
    255; 0 where shorter suffixes stand between). Built column by column, from the right.

    ``rows`` lists the places of the BWT by symbol, so that row r of it leads to suffix r among those that aren't empty;
    it is carried along from round to round, as only the new symbols have to be put in."""
    m = len(strings)
    sizes = np.array([len(s) for s in strings])
    width = int(sizes.max())
    columns = np.zeros((width, m), np.uint8)  # columns[j]: the symbol j places from the end, 1 or more, or 0 for none
    alphabet = np.zeros(256, np.uint8)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    used = np.unique(flat)
    alphabet[used] = np.arange(1, len(used) + 1)  # bytes of UTF-8 never take all 256 values
    columns[np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(len(flat)), np.repeat(np.arange(m), sizes)] = alphabet[flat]
    file = columns[0].astype(np.uint16)  # the symbols of the BWT, and above them the common prefixes
    rows, starts = np.zeros(0, np.int32), np.zeros(len(used) + 2, np.int64)  # starts[s]: the first row of symbol s
    place, active = np.arange(m), np.arange(m)  # the strings that go on, and where their last suffix stands
    for j in range(1, width + 1):
        # the symbols before the last suffixes take their rows
        symbols = columns[j - 1][active].astype(np.int64)
        order = np.argsort(symbols << 32 | place)
        by, at = symbols[order], place[order]
        counts = np.bincount(by, minlength=len(starts) - 1)
        ends = np.cumsum(counts)
        spots = np.empty(len(at), np.int64)
        for s in np.flatnonzero(counts).tolist():
            own = slice(int(ends[s] - counts[s]), int(ends[s]))
            spots[own] = starts[s] + np.searchsorted(rows[starts[s] : starts[s + 1]], at[own])
        rows = np.insert(rows, spots, at.astype(np.int32))
        starts[1:] += ends
        mine = np.empty(len(at), np.int64)
        mine[order] = spots + np.arange(len(at))
        new = m + mine  # empty suffixes come first, then all others by first symbol and rank
        bwt, levels = file.astype(np.uint8), [(file >> 8).astype(np.uint8)]

        def shared(r: np.ndarray, rows=rows, bwt=bwt, levels=levels) -> np.ndarray:
            """1 + the minimum of the old common prefixes between the places of rows r - 1 and r, if they have one symbol."""
            out = np.zeros(len(r), np.uint8)
            ok = np.flatnonzero((r > 0) & (r < len(rows)))
            lo, hi = rows[r[ok] - 1], rows[r[ok]]
            same = bwt[lo] == bwt[hi]
            ok, lo, hi = ok[same], lo[same] + 1, hi[same]
            depth = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
            while len(levels) <= depth.max(initial=0):  # minima over twice as many places
                step = 1 << (len(levels) - 1)
                levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
            least = np.empty(len(lo), np.uint8)
            for d in np.flatnonzero(np.bincount(depth)).tolist():
                own = depth == d
                least[own] = np.minimum(levels[d][lo[own]], levels[d][hi[own] + 1 - (1 << d)])
            out[ok] = np.minimum(least, 254) + 1
            return out

        before, behind = shared(mine), shared(mine + 1)
        total = len(file) + len(active)
        old = np.ones(total, bool)
        old[new] = False
        rows = np.flatnonzero(old).astype(np.int32)[rows]
        grown = np.empty(total, np.uint16)
        grown[old] = file
        following = columns[j][active] if j < width else np.zeros(len(active), np.uint8)
        grown[new] = following.astype(np.uint16) | before.astype(np.uint16) << 8
        fits = np.flatnonzero(new + 1 < total)
        at = new[fits] + 1
        grown[at] = (grown[at] & 255) | behind[fits].astype(np.uint16) << 8
        file = grown
        goes_on = following != 0
        place, active = new[goes_on], active[goes_on]
        if not len(active):
            break
    # which suffix stands where: once more from the right, along the finished rows
    leads = np.zeros(len(file), np.int64)
    leads[rows] = m + np.arange(len(rows))
    who, size = np.zeros(len(file), np.int64), np.zeros(len(file), np.int64)
    place, active = np.arange(m), np.arange(m)
    for j in range(1, width + 1):
        goes_on = sizes[active] >= j
        active = active[goes_on]
        place = leads[place[goes_on]]
        if j >= LENGTH:
            who[place], size[place] = active, j
    full = size >= LENGTH
    common = np.where(np.concatenate([[False], full[:-1]]), file >> 8, 0)[full]
    return who[full], sizes[who[full]] - size[full], common


def repeated_windows(strings: list[bytes], doc: np.ndarray, pack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """doc and pack of the runs of windows of ``strings`` (different ones, each at its first place) that stand earlier as well."""
    who, start, common = suffix_order(strings)
    group = np.cumsum(common < LENGTH)
    at = (pack & ~np.int64(127))[who] + (start.astype(np.int64) << 7)
    order = np.lexsort((at, doc[who], group))
    d, a, g = doc[who][order], at[order], group[order]
    head = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(g) != 0]), np.arange(len(g)), 0)) if len(g) else g
    again = (d != d[head]) | (a != a[head])
    d, a = d[again], a[again]
    order = np.lexsort((a, d))
    d, a = d[order], a[order]
    keep = np.concatenate([[True], (np.diff(d) != 0) | (np.diff(a) != 0)]) if len(d) else np.zeros(0, bool)
    d, a = d[keep], a[keep]
    if not len(d):
        return d, a
    new = (np.diff(d) != 0) | (np.diff(a) != 1 << 7)
    # runs of at most 127 windows, so that the count fits its bits
    heads = np.flatnonzero(np.concatenate([[True], new]))
    inside = np.arange(len(d)) - np.repeat(heads, np.diff(np.append(heads, len(d))))
    heads = np.flatnonzero(inside % 127 == 0)
    return d[heads], a[heads] + np.diff(np.append(heads, len(d)))


def fetch(docs: DataFrame, first: DataFrame) -> DataFrame:
    """ah, fh, doc, th, pack, part (binary): the bytes of the fragments of ``first`` (ah, doc, th, pack), cut once more by the
    largest hash of their windows: equal windows have both anchors in common, so fewer strings meet, in smaller groups."""
    lists = first.groupBy("doc", "th").agg(F.collect_list(F.struct("ah", "pack")).alias("parts"))
    joined = keyed(docs).join(lists.hint("shuffle_hash"), ["doc", "th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            offsets, data = utf8(batch.column("text"))
            parts = batch.column("parts")
            flat = parts.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(parts.offsets.to_numpy()))
            ah, pack = flat.field(0).to_numpy().view(np.uint64), flat.field(1).to_numpy()
            start = offsets[row] + ((pack >> 7) & ((1 << 36) - 1))
            size = (pack & 127) - 1 + LENGTH
            doc, th = batch.column("doc").to_numpy()[row], batch.column("th").to_numpy()[row]
            ends, s = np.cumsum(size), 0
            while s < len(size):  # as many fragments as a piece holds
                e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + PIECE, "right")))
                bounds = np.concatenate([[0], np.cumsum(size[s:e])])
                joint = data[np.repeat(start[s:e] - bounds[:-1], size[s:e]) + np.arange(bounds[-1])]
                k, at, count, second, fh = fragments(bounds, joint, np.zeros(0, np.uint64), True)
                raw, begin = joint.tobytes(), bounds[k] + at
                texts = [raw[x:y] for x, y in zip(begin.tolist(), (begin + count - 1 + LENGTH).tolist(), strict=True)]
                k = k + s
                with np.errstate(over="ignore"):
                    both = _mixed(ah[k] * np.uint64(_BASE) ^ second)
                own = (pack[k] & ~np.int64(127)) + (at.astype(np.int64) << 7) + count
                yield pa.RecordBatch.from_arrays([pa.array(both.view(np.int64)), pa.array(fh.view(np.int64)), pa.array(doc[k]), pa.array(th[k]), pa.array(own), pa.array(texts, pa.binary())], names=["ah", "fh", "doc", "th", "pack", "part"])
                s = e

    return joined.mapInArrow(run, FOUND + ", part binary")


def windows_of(docs: DataFrame, first: DataFrame) -> DataFrame:
    """ah, doc, th, pack: the windows of the fragments of ``first`` (ah, doc, th, pack) as fragments of their own, with
    the window's hash as part of the anchor; those that occur once are left out."""
    lists = first.groupBy("doc", "th").agg(F.collect_list(F.struct("ah", "pack")).alias("parts"))
    joined = keyed(docs).join(lists.hint("shuffle_hash"), ["doc", "th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hasher()
        for batch in small_batches(batches, "text"):
            offsets, data = utf8(batch.column("text"))
            parts = batch.column("parts")
            flat = parts.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(parts.offsets.to_numpy()))
            ah, pack = flat.field(0).to_numpy().view(np.uint64), flat.field(1).to_numpy()
            doc, th = batch.column("doc").to_numpy()[row], batch.column("th").to_numpy()[row]
            for s in range(0, len(ah), PIECE // (2 * LENGTH)):  # as many fragments as a piece holds, at two lengths each at most
                own = slice(s, s + PIECE // (2 * LENGTH))
                count, at = pack[own] & 127, (pack[own] >> 7) & ((1 << 36) - 1)
                size = count - 1 + LENGTH
                bounds = np.concatenate([[0], np.cumsum(size)])
                joint = data[np.repeat(offsets[row[own]] + at - bounds[:-1], size) + np.arange(bounds[-1])]
                of = np.repeat(np.arange(len(count)), count)
                step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                begin = bounds[:-1][of] + step
                wh = h.of(h.prefix(joint), begin, begin + LENGTH)
                with np.errstate(over="ignore"):
                    both = _mixed(ah[own][of] * np.uint64(_BASE) ^ wh)
                yield pa.RecordBatch.from_arrays([pa.array(both.view(np.int64)), pa.array(doc[own][of]), pa.array(th[own][of]), pa.array((at[of] + step) << 7 | 1)], names=["ah", "doc", "th", "pack"])

    windows = written(joined.mapInArrow(run, MET), "windows")
    several = windows.groupBy(F.col("ah").alias("a")).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    return windows.join(several, F.col("ah") == F.col("a"), "left_semi")


def compare(parts: DataFrame) -> DataFrame:
    """doc, th, pack: the runs of repeated windows within ``parts``. Strings of equal bytes become one, whose further places are
    told as they pass; of anchors with several different ones these go to the construction, in chunks of whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # different strings, each at its first place
        last: pa.RecordBatch | None = None  # the row before

        def chunk(table: pa.Table) -> pa.RecordBatch:
            ah = table.column("ah").to_numpy()
            group = np.cumsum(np.concatenate([[True], ah[1:] != ah[:-1]])) - 1
            table = table.filter(pa.array((np.bincount(group) > 1)[group]))
            d = t = p = np.zeros(0, np.int64)
            if table.num_rows:
                doc, th = table.column("doc").to_numpy(), table.column("th").to_numpy()
                order = np.lexsort((th, doc))
                doc, th = doc[order], th[order]
                new = np.concatenate([[True], differ(doc, th)])
                place = np.empty(len(order), np.int64)  # of the documents of the chunk, in order
                place[order] = np.cumsum(new) - 1
                d, p = repeated_windows(table.column("part").to_pylist(), place, table.column("pack").to_numpy())
                d, t = doc[new][d], th[new][d]
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(p)], names=["doc", "th", "pack"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            ah, doc, th, pack = (rows.column(k).to_numpy() for k in ("ah", "doc", "th", "pack"))
            part = rows.column("part")
            alike = pc.equal(part.slice(1), part.slice(0, len(part) - 1)).to_numpy(zero_copy_only=False).astype(bool)
            same = np.concatenate([[False], (ah[1:] == ah[:-1]) & alike])
            # a string's first place, or that of a row which repeats it: equal places stand side by side
            again = same & np.concatenate([[False], differ(doc, th, pack)])
            if again.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[again]) for x in (doc, th, pack)], names=["doc", "th", "pack"])
            fresh = ~same
            fresh[0] = last is None  # else it is the row before, whose string is held
            last = batch.slice(batch.num_rows - 1)
            held.append(rows.filter(pa.array(fresh)))
            if sum(t.num_rows for t in held) >= 2 * CHUNK:
                table = pa.concat_tables(held)
                ah = table.column("ah").to_numpy()
                ends = np.flatnonzero(ah[1:] != ah[:-1]) + 1  # the last anchor may go on
                done = 0
                while len(ends) and ends[-1] > done:
                    cut = int(ends[max(0, int(np.searchsorted(ends, done + CHUNK, "right")) - 1)])
                    if cut <= done:
                        cut = int(ends[np.searchsorted(ends, done, "right")])
                    yield chunk(table.slice(done, cut - done))
                    done = cut
                held = [table.slice(done)]
        if held:
            yield chunk(pa.concat_tables(held))

    return parts.repartition("ah").sortWithinPartitions("ah", "fh", "doc", "th", "pack").mapInArrow(run, "doc long, th long, pack long")


def repeats(docs: DataFrame) -> DataFrame:
    """doc, th, runs (array of long, pairs of start and number of windows packed): the repeated windows of all texts."""
    found = written(resolve(all_fragments(docs, frequent_anchors(docs))), "fragments")
    first = found.filter("pack >= 0")
    heavy = written(first.groupBy("ah").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HEAVY).select("ah"), "heavy")
    if not heavy.isEmpty():
        first = first.join(heavy, "ah", "left_anti").unionByName(windows_of(docs, first.join(heavy, "ah", "left_semi")))
    within = compare(fetch(docs, first))
    again = found.filter("pack < 0").select("doc", "th", F.col("pack").bitwiseAND(F.lit((1 << 63) - 1)).alias("pack"))
    return again.unionByName(within).groupBy("doc", "th").agg(F.collect_list("pack").alias("runs"))


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans of each row of ``docs`` (doc_id, text)."""
    return _remove(docs, False)


def _remove(docs: DataFrame, digest: bool) -> DataFrame:
    runs = written(repeats(docs), "repeats")
    joined = keyed(docs).join(runs.hint("shuffle_hash"), ["doc", "th"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            offsets, data = utf8(batch.column("text"))
            ids, removed, spans, kept = batch.column("doc").to_pylist(), [], [], []
            for i, packs in enumerate(batch.column("runs")):
                text = data[offsets[i] : offsets[i + 1]]
                if packs.is_valid:
                    p = packs.values.to_numpy()
                    edge = np.zeros(len(text) + 1, np.int32)
                    np.add.at(edge, p >> 7, 1)
                    np.add.at(edge, (p >> 7) + (p & 127) - 1 + LENGTH, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    text = text[~gone]
                    removed.append(int(gone.sum()))
                    spans.append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
                else:
                    removed.append(0)
                    spans.append(0)
                raw = text.tobytes()
                kept.append(hashlib.sha256(raw).hexdigest() if digest else raw)
            yield pa.RecordBatch.from_arrays(
                [pa.array([None if x == FIRST else x for x in ids], pa.int64()), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string() if digest else pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return joined.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _remove(read_table(spark, sf_dir, "documents"), True).withColumnRenamed("kept", "kept_sha256")
