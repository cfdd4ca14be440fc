"""Main text of web pages by wrapper induction: pages of one host are aligned as trees, what is constant becomes template, and
of the varying slots those of the host's main area are content.

A page's tree (its *shape*) has the elements that structure it (containers, and any block element with a class, id or role);
paragraphs, list items and the like only part text into blocks, and the blocks between two structuring elements are one slot,
so that a page of any length has a small tree. Neighbours with one and the same class fold into one node.

1. A scan parses each page into its shape and, for each slot, a hash of the text, its code points and those inside links.
   These are aggregated for each host and shape, copies counted once.
2. A host's most frequent shape is the wrapper. The others stream past it and are aligned by simple tree matching (equal
   labels match, children in order, most matched nodes); their slots' figures add to those of the slots that they match.
3. A slot with equal text on all pages (``FEWEST`` different ones at least) is template. From the root the walk goes down
   to the child that holds most of the varying text outside of links, an article's weighted up, menus, footers, adverts,
   forms, comments and so on (told by element, role and class) at nothing: where it ends is the main area.
4. A second scan aligns each page with its host's wrapper and joins the blocks of the slots in the main area. Slots that
   have no counterpart there are content if they stand in the main area. A page whose main area isn't found, or whose host
   is unknown, is its own wrapper.

Wrappers meet pages in an ordinary join (which Spark turns into a broadcast only below its limit of size); a frequent host's
pages can be split there, and nothing gathers a host's pages anywhere.

Defined results: null or empty html, and pages without main text, give an empty text; a null or odd url is a host of its
own; repeated rows each give a row; white space is Unicode's, so a decoded no-break space counts; a line break (br) is white
space inside its block; unknown or unterminated references stay as they are; text outside of the html element and in unclosed
elements counts where it stands; very long pages are one row's memory; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import html as entities
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import light, read_table, small_batches, written

#: Different pages that must agree before a slot counts as template; the share of the weight that leads the walk downwards;
#: the weight of an article's text against others'; the depth below which elements no longer make nodes of their own.
FEWEST, DOMINANT, PRIOR, DEEPEST = 4, 0.5, 10.0, 60

# The names of HTML elements by what they do to text, and words of classes, ids and roles.
SKIPPED = "script style noscript template title textarea select iframe object svg math canvas audio video"
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br"
CONTAINERS = "html body div section article main nav header footer aside form fieldset dialog h1 center menu"
NOISE_ELEMENTS = "nav footer aside form fieldset dialog menu button"
NOISE_WORDS = (
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer contentinfo sidebar complementary widget ad ads advert adverts advertisement advertising "
    "sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "signup share sharing social related recommended search login pagination pager toolbar skip copyright hidden"
)
COMMENT_WORDS = "comment comments disqus reply replies respond"
VOID = "area base br col embed hr img input link meta source track wbr"

_skipped, _inline, _containers, _void = (frozenset(x.split()) for x in (SKIPPED, INLINE, CONTAINERS, VOID))
_noise_elements, _noise_words, _comment_words = (frozenset(x.split()) for x in (NOISE_ELEMENTS, NOISE_WORDS, COMMENT_WORDS))
#: A comment or declaration, or a tag with its attributes (up to the next bracket where quotes don't close).
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SLOT = "~"


class Page:
    """labels and parents of a page's nodes in document order (node 0 is the page), and its blocks (node, text, code points
    inside links)."""

    def __init__(self, html: str):
        self.labels, self.parents, self.blocks = [""], [-1], []
        self.last: list[int | None] = [None]  # each node's last child, with which an equal neighbour folds
        self._open: list[tuple[str, int]] = []  # open elements that aren't inline: tag, node
        self._pieces: list[str] = []
        self._linked, self._in_link = 0, False
        at = 0
        while (m := MARKUP.search(html, at)) is not None:
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self._close(tag)
                elif tag in _skipped and not m[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                    at = end.end() if end else len(html)
                else:
                    self._start(tag, m[3])
        self._text(html[at:])
        self._flush()

    def _node(self) -> int:
        return self._open[-1][1] if self._open else 0

    def _child(self, label: str, folds: bool) -> int:
        parent = self._node()
        before = self.last[parent]
        if folds and before is not None and self.labels[before] == label:
            return before
        self.labels.append(label)
        self.parents.append(parent)
        self.last.append(None)
        self.last[parent] = len(self.labels) - 1
        return self.last[parent]

    def _text(self, raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self._pieces.append(text)
        if self._in_link:
            self._linked += len("".join(text.split()))

    def _flush(self) -> None:
        text = " ".join("".join(self._pieces).split())
        if text:
            self.blocks.append((self._child(SLOT, True), text, min(self._linked, len(text))))
        self._pieces, self._linked = [], 0

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _inline:
            if tag == "br":
                self._pieces.append(" ")
            elif tag == "a":
                self._in_link = True
            return
        self._flush()
        self._in_link = False
        if tag in _void:
            return
        if self._open and (self._open[-1][0] == tag and tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or self._open[-1][0] == "p"):
            self._open.pop()  # ends where the next one begins
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        words = sorted({w for k in ("class", "id", "role") for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", found.get(k, "")).lower()) if w})
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
            words.append("hidden")
        if (tag in _containers or words) and len(self._open) < DEEPEST:
            self._open.append((tag, self._child(".".join([tag, *words]), bool(words))))
        else:
            self._open.append((tag, self._node()))

    def _close(self, tag: str) -> None:
        if tag in _inline:
            self._in_link = self._in_link and tag != "a"
            return
        self._flush()
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                del self._open[k:]
                break

    def shape(self) -> str:
        return "\n".join(f"{p} {label}" for p, label in zip(self.parents, self.labels, strict=True))

    def slots(self) -> list[tuple[int, int, int]]:
        """(hash of the text, code points, code points inside links) of each slot, in the order of nodes."""
        out: dict[int, list] = {k: [xxhash.xxh3_64(), 0, 0] for k, label in enumerate(self.labels) if label == SLOT}
        for k, text, linked in self.blocks:
            out[k][0].update(text.encode("utf-8", "replace") + b"\n")
            out[k][1] += len(text)
            out[k][2] += linked
        return [(struct.unpack("<q", h.digest())[0], n, linked) for h, n, linked in out.values()]


class Tree:
    """A shape, read back."""

    def __init__(self, shape: str):
        pairs = [line.split(" ", 1) for line in shape.split("\n")]
        self.parents, self.labels = [int(p) for p, _ in pairs], [label for _, label in pairs]
        self.children: list[list[int]] = [[] for _ in pairs]
        for k, p in enumerate(self.parents):
            if p >= 0:
                self.children[p].append(k)
        self.slots = [k for k, label in enumerate(self.labels) if label == SLOT]
        self.noise, self.prior = self._judged()

    def _judged(self) -> tuple[list[bool], list[bool]]:
        """Whether each node stands in a part that isn't content by its names, and whether in an article."""
        size = len(self.labels)
        tags = [label.split(".")[0] for label in self.labels]
        words = [frozenset(label.split(".")[1:]) for label in self.labels]
        holds = [t in ("article", "main") for t in tags]  # it or one below it
        for k in range(size - 1, 0, -1):
            holds[self.parents[k]] |= holds[k]
        noise, prior = [False] * size, [False] * size
        for k in range(1, size):
            p = self.parents[k]
            named = tags[k] in _noise_elements or words[k] & _noise_words or (tags[k] == "header" or "header" in words[k]) and not prior[p]
            noise[k] = noise[p] or bool(words[k] & _comment_words) or bool(named and not holds[k] and tags[k] not in ("html", "body"))
            prior[k] = prior[p] or tags[k] in ("article", "main")
        return noise, prior


def matched(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: node of ``b`` to node of ``a``, as many as can be, in order."""
    scores: dict[tuple[int, int], tuple[int, list]] = {}

    def score(x: int, y: int) -> int:
        if a.labels[x] != b.labels[y]:
            return 0
        if (x, y) not in scores:
            xs, ys = a.children[x], b.children[y]
            table = np.zeros((len(xs) + 1, len(ys) + 1), np.int64)
            own = {}
            for i, u in enumerate(xs):
                for j, v in enumerate(ys):
                    w = score(u, v)
                    own[i, j] = w
                    table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + w if w else 0)
            pairs, i, j = [], len(xs), len(ys)
            while i and j:
                if table[i, j] == table[i - 1, j]:
                    i -= 1
                elif table[i, j] == table[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((xs[i], ys[j]))
            scores[x, y] = 1 + int(table[-1, -1]), pairs
        return scores[x, y][0]

    score(0, 0)
    out, todo = {}, [(0, 0)]
    while todo:
        x, y = todo.pop()
        out[y] = x
        todo += scores[x, y][1]
    return out


class Wrapper:
    """A host's tree with the figures of its slots."""

    def __init__(self, shape: str):
        self.tree = Tree(shape)
        n = len(self.tree.labels)
        self.pages, self.chars, self.linked = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.least, self.largest = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)

    def add(self, tree: Tree, figures: list[tuple[int, int, int, int, int]]) -> None:
        """The figures (pages, least hash, largest hash, code points, those in links) of the slots of pages of one shape."""
        to = matched(self.tree, tree)
        for k, (pages, least, largest, chars, linked) in zip(tree.slots, figures, strict=True):
            if k in to:
                x = to[k]
                self.pages[x] += pages
                self.chars[x] += chars
                self.linked[x] += linked
                self.least[x], self.largest[x] = min(self.least[x], least), max(self.largest[x], largest)

    def constant(self) -> np.ndarray:
        return (self.least == self.largest) & (self.pages >= FEWEST)

    def main(self) -> int:
        """The node whose slots are the main text; -1 if there is none."""
        t = self.tree
        # an article's text counts even if all pages are copies of one
        own = np.where(np.array(t.noise), 0.0, np.where(np.array(t.prior), PRIOR, np.where(self.constant(), 0.0, 1.0))) * (self.chars - self.linked)
        below = own.copy()
        for k in range(len(own) - 1, 0, -1):
            below[t.parents[k]] += below[k]
        node = 0
        if below[0] <= 0:
            return -1
        while True:
            kids = [c for c in t.children[node] if t.labels[c] != SLOT and below[c] > 0]
            best = max(kids, key=lambda c: below[c], default=None)
            tag = t.labels[node].split(".")[0]
            titled = any(t.labels[c].split(".")[0] == "h1" for c in kids)
            article = best is not None and t.labels[best].split(".")[0] in ("article", "main")
            if best is None or tag == "article" or titled and not article or below[best] < DOMINANT * below[node] or t.labels[best].split(".")[0] == "h1":
                return node
            node = best

    def content(self, main: int) -> list[bool]:
        """Whether each node is content; constant slots of the main area are template unless it is an article."""
        t, constant = self.tree, self.constant()
        inside = [False] * len(t.labels)
        for k in range(len(inside)):
            inside[k] = k == main or k > 0 and inside[t.parents[k]]
        return [i and not t.noise[k] and not (constant[k] and not t.prior[k]) for k, i in enumerate(inside)]


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, shape and slots of each page (host, html)."""
    kind = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64()), ("linked", pa.int64())]))
    for batch in small_batches(batches, "html"):
        pages = [Page(h or "") for h in batch.column("html").to_pylist()]
        slots = pa.array([[{"h": h, "n": n, "linked": x} for h, n, x in p.slots()] for p in pages], kind)
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([p.shape() for p in pages], pa.string()), slots], names=["host", "shape", "slots"])


def induced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrapper of each host, whose shapes come one after the other, the most frequent first."""
    host, wrapper, shape = None, None, ""

    def done() -> list[tuple]:
        if wrapper is None:
            return []
        main = wrapper.main()
        return [(host, shape, main, [bool(x) for x in wrapper.constant()])]

    for batch in batches:
        out = []
        for own, text, figures in zip(batch.column("host").to_pylist(), batch.column("shape").to_pylist(), batch.column("figures").to_pylist(), strict=True):
            if wrapper is None or own != host:
                out += done()
                host, shape, wrapper = own, text, Wrapper(text)
            wrapper.add(Tree(text), [(f["pages"], f["least"], f["largest"], f["n"], f["linked"]) for f in figures])
        if out:
            yield _wrappers(out)
    if out := done():
        yield _wrappers(out)


def _wrappers(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.bool_()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["of", "wrapper", "main", "constant"])


def main_text(page: Page, wrapper: str | None, main: int | None, constant: list[bool] | None, known: dict) -> str:
    """The main text by the host's wrapper; by the page itself where that has no main area or the page doesn't match it.
    ``known`` keeps which nodes are content for the shapes that came before."""
    shape = page.shape()
    key = (wrapper, shape)
    if wrapper is not None and key not in known:
        tree, of = Tree(shape), Tree(wrapper)
        to = matched(of, tree)
        inside = [to.get(k) == main for k in range(len(tree.labels))]
        for k in range(1, len(inside)):
            inside[k] |= inside[tree.parents[k]]
        if len(known) > 1000:
            known.clear()
        known[key] = [i and not tree.noise[k] and not (k in to and constant[to[k]] and not tree.prior[k]) for k, i in enumerate(inside)] if main in to.values() else None
    content = known.get(key)
    if content is None:
        own = Wrapper(shape)
        own.add(own.tree, [(1, h, h, n, x) for h, n, x in page.slots()])
        content = own.content(own.main())
    return "\n".join(text for k, text, _ in page.blocks if content[k])


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in small_batches(batches, "html"):
        columns = [batch.column(c).to_pylist() for c in ("html", "wrapper", "main", "constant")]
        texts = [main_text(Page(h), *rest, known) if h else "" for h, *rest in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_of(url):
    """The lower-case host of an url; null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """of (host), wrapper (its shape), main, constant (of each of its nodes) for each host of ``pages`` (url, html)."""
    known = light(pages).select(host_of(F.col("url")).alias("host"), "html").filter("host is not null and html is not null")
    parsed = written(known.mapInArrow(scanned, "host string, shape string, slots array<struct<h: bigint, n: bigint, linked: bigint>>"), "shapes")
    different = written(parsed.groupBy("host", "shape", "slots").agg(F.count(F.lit(1)).alias("copies")), "different")
    figures = different.select("host", "shape", F.posexplode("slots").alias("at", "s")).groupBy("host", "shape", "at").agg(F.count(F.lit(1)).alias("pages"), F.min("s.h").alias("least"), F.max("s.h").alias("largest"), F.sum("s.n").alias("n"), F.sum("s.linked").alias("linked"))
    by_shape = figures.groupBy("host", "shape").agg(F.max("pages").alias("pages"), F.sort_array(F.collect_list(F.struct("at", "pages", "least", "largest", "n", "linked"))).alias("figures"))
    # rows of hosts and shapes, not of pages; they stream past the wrapper in sorted order
    return written(by_shape.repartition("host").sortWithinPartitions(F.col("host"), F.col("pages").desc(), F.col("shape")).mapInArrow(induced, "of string, wrapper string, main int, constant array<boolean>"), "wrappers")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html)."""
    ids = dict(pages.dtypes)
    met = light(pages).select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(wrappers(pages), F.col("host") == F.col("of"), "left")
    return met.select("page_id", "url", "html", "wrapper", "main", "constant").mapInArrow(extracted, f"page_id {ids['page_id']}, url string, text string, n_chars long")


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read_table(spark, sf_dir, "pages"))
