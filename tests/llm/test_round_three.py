"""Filter audit, main text of pages and hard negatives against brute-force versions."""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from framewright.llm import filter_audit, negatives, pages, topk

from .cases import SCHEMA, awkward, documents

SF = "/root/testdata/sf0.001"


def failures(rows):
    """The filters that each document fails."""
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[t or ""].append(i)
    out = []
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and any(k is not None and k < i for k in texts[t])]
        out.append({f for f, fails in zip("ABCDE", tests, strict=True) if fails})
    return out


def test_audit_agrees_with_brute_force(spark):
    rows = awkward() + [(300, "AAA BBB $ x", "en", "a", 1), (301, "AAA BBB $ x", None, "a", 1), (302, "word " * 300, "de", "a", 1), (303, "A " * 200, "de", "a", 1)]
    marks = [(1, 1, 0), (1, 0, 1), (8, 1, None), (100, None, 1), (None, 1, 1), (302, 1, 1), (9999, 1, 1)]
    want = defaultdict(Counter)
    for (i, _, lang, *_), bad in zip(rows, failures(rows), strict=True):
        good, toxic = (i is not None and any(m[0] == i and m[k] == 1 for m in marks) for k in (1, 2))
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for s, f in enumerate(order):
                c = want[(lang or "", order, s + 1)]
                here = f in bad and not gone
                c["kept"] += not gone and f not in bad
                c["removed"] += here
                c["redundant"] += f in bad and gone
                c["unique_fails"] += bad == {f}
                c["good_lost"] += here and good
                c["toxic_lost"] += here and toxic
                want[(lang or "", f)]["shapley"] += here
                gone = gone or f in bad
    df = documents(spark, rows).selectExpr("*", "1 as part", "2 as code", "3 as digest", "4 as w", "5 as t")
    got = filter_audit.audit(df, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 600 * len({r[2] or "" for r in rows}) == len({(r.part, r.filter_order, r.step) for r in got})
    for r in got:
        c = want[(r.part, r.filter_order, r.step)]
        assert [r[k] for k in filter_audit.COUNTS] == [c[k] for k in filter_audit.COUNTS]
        assert r.shapley == want[(r.part, r.filter_order[r.step - 1])]["shapley"]
    none = spark.createDataFrame([], SCHEMA)
    assert filter_audit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_packed_counters_do_not_overflow(monkeypatch):
    many = 2**55
    total = sum(many * n for n in filter_audit.integers())  # 128 masks, 2**62 documents in all
    assert (filter_audit.unpacked(total) == many * sum(filter_audit.outcomes(c & 31, bool(c & 32), bool(c & 64)) for c in range(128))).all()
    import pyarrow as pa

    monkeypatch.setattr(filter_audit, "HELD", 2)
    batch = pa.RecordBatch.from_pydict({"part": ["a", "b", "c", "a", None or ""], "code": pa.array([1, 2, 3, 4, 127], pa.int32())})
    parts = [(p, n) for b in filter_audit.summed(iter([batch, batch])) for p, n in zip(b["part"].to_pylist(), b["sum"].to_pylist(), strict=True)]
    assert len(parts) > 4  # let go of more than once
    parts.sort()
    again = pa.RecordBatch.from_pydict({"part": [p for p, _ in parts], "sum": pa.array([n for _, n in parts], pa.binary())})
    whole = {p: int.from_bytes(n, "little") for b in filter_audit.met(iter([again.slice(0, 3), again.slice(3)])) for p, n in zip(b["part"].to_pylist(), b["sum"].to_pylist(), strict=True)}
    of = filter_audit.integers()
    assert whole == {"a": 2 * (of[1] + of[4]), "b": 2 * of[2], "c": 2 * of[3], "": 2 * of[127]}


def plain(page):
    """The blocks of the article of a page of the test tables."""
    found = re.search(r"<article>(.*?)</article>", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", found[1]) if found else []
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in parts]
    return "\n".join(x for x in blocks if x)


def test_main_text_of_the_test_pages(spark):
    got = {r.page_id: r for r in pages.op12_main_text(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert (got[r.page_id].text, got[r.page_id].url) == (plain(r.html), r.url)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def site(k, title, body, extra=""):
    """A page whose parts have no telling names."""
    links = "".join(f"<a href=/{x}>Section {x}</a> " for x in range(6))
    return f"<html><body><div>{links}</div><div>Welcome to the site of all sites, which greets everybody alike with these many words</div><div><h1>{title}</h1>{body}</div>{extra}<div>Set on page {k}</div></body></html>"


def test_wrapper_tells_template_from_content(spark):
    prose = [" ".join(f"word{(k * 31 + j * 7) % 97}" for j in range(40)) for k in range(8)]
    rows = [(k, f"https://a.example/{k}", site(k, f"Title {k}", f"<p>{prose[k]}</p><p>{prose[-k]}<p>Tom &amp; Co&nbsp;&amp &copy;")) for k in range(6)]
    rows.append((6, "https://A.example:80/x", site(6, "Other", f"<p>{prose[6]}</p><ul><li>one<li>two <b>three</b></ul>", "<div class='user-comments'><article><p>I like it very much, and so did all of us who read it</p></article></div>")))
    rows += [(10 + k, f"http://b.example/{k}", f"<header>Top of b</header><main><article class=post><header><h1>T{k}</h1></header><div><p>{prose[0]}</p></div><aside>{prose[5]}</aside><form>Mail <input></form><div id=cookieNotice>{prose[1]}</div>end {k}</article></main>") for k in range(5)]
    rows += [(20, None, f"<div><p>{prose[3]}</p></div><nav>{prose[4]}</nav>"), (21, "no url", "plain words"), (22, "http://a.example/y", None), (23, "http://c.example", ""), (24, "http://c.example", "<p>unclosed <b>one<p>two<script>if (a<b) '</p>'</script>"), (24, "http://c.example", "<p>unclosed <b>one<p>two<script>if (a<b) '</p>'</script>")]
    got = defaultdict(list)
    for r in pages.main_texts(spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, main int")).collect():
        got[r.page_id].append(r.text)
    for k in range(6):
        assert got[k] == [f"Title {k}\n{prose[k]}\n{prose[-k]}\nTom & Co & ©"]
    assert got[6] == [f"Other\n{prose[6]}\none\ntwo three"]
    for k in range(5):  # the article's title and text stay, though they are alike on all pages
        assert got[10 + k] == [f"T{k}\n{prose[0]}\nend {k}"]
    assert (got[20], got[21], got[22], got[23], got[24]) == ([prose[3]], ["plain words"], [""], [""], ["unclosed one\ntwo"] * 2)
    assert pages.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_does_not_depend_on_the_layout(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    key = lambda d: sorted(map(repr, pages.wrappers(d).collect()))
    assert key(df) == key(df.repartition(9))


def brute_match(a, b, x, y):
    """The most nodes that match, over all orderly choices of children."""
    if a.labels[x] != b.labels[y]:
        return 0
    xs, ys = a.children[x], b.children[y]
    best = 0
    for n in range(min(len(xs), len(ys)) + 1):
        for p in itertools.combinations(xs, n):
            for q in itertools.combinations(ys, n):
                scores = [brute_match(a, b, u, v) for u, v in zip(p, q, strict=True)]
                best = max(best, sum(scores) if all(scores) else 0)
    return 1 + best


def test_tree_matching_is_the_best_there_is():
    r = np.random.default_rng(3)
    for _ in range(60):
        trees = []
        for _ in range(2):
            n = int(r.integers(1, 9))
            trees.append(pages.Tree("\n".join(["-1 ", *(f"{int(r.integers(0, k))} {'abc'[int(r.integers(3))]}" for k in range(1, n))])))
        a, b = trees
        to = pages.matched(a, b)
        assert len(to) == len(set(to.values())) == brute_match(a, b, 0, 0)
        assert all(a.labels[x] == b.labels[y] and (y == 0 or to[b.parents[y]] == a.parents[x]) for y, x in to.items())


def test_deep_long_and_broken_pages():
    deep = pages.Page("<div>" * 5000 + "in the deep" + "</div>" * 5000)
    assert len(deep.labels) < 70 and pages.main_text(deep, None, None, None, {}) == "in the deep"
    long = pages.Page("<article>" + "<h2>a</h2><p>b" * 50_000 + "</article>")
    assert len(long.labels) == 3 and pages.main_text(long, None, None, None, {}).count("\n") == 99_999
    broken = "<article><p>a < b & c &am &lt;<p class=\"x>one</p><!-- never closed <p>two"
    assert pages.main_text(pages.Page(broken), None, None, None, {}).startswith("a < b & c &am <")


def vectors(dim=6):
    r = np.random.default_rng(2)
    rows = [(k, [float(x) for x in np.float32(r.normal(0.1 * (k % 4), 0.3, dim))], k % 4) for k in range(1500)]
    rows += [(1500 + k, rows[50][1], k % 5) for k in range(300)]  # a very common vector
    rows += [(2000, None, 1), (2100, [float("nan")] * dim, 1), (2200, [1.0, None] + [0.0] * (dim - 2), 1), (2300, [0.5], 1), (2400, [], 1), (2500, rows[9][1], None), (-100, [0.0] * dim, 2), (None, rows[9][1], 1)]
    rows += [(100, rows[100][1], 0)] * 3 + [(200, rows[7][1], 3), (200, rows[8][1], 1), (3000, rows[9][1], 77), (3100, [float(-x) for x in rows[9][1]], 78), (3101, rows[9][1], 78)]
    return rows


@pytest.mark.parametrize(("shard", "leaf", "fan", "block", "routes"), [(300, 16, 4, 4, 8), (150, 4, 3, 1000, 64), (10_000, 64, 12, 4096, 64)])
def test_hard_negatives_agree_with_brute_force(spark, monkeypatch, shard, leaf, fan, block, routes):
    for name, value in (("SHARD", shard), ("LEAF", leaf), ("FAN", fan), ("BLOCK", block), ("ROUTES", routes)):
        monkeypatch.setattr(negatives, name, value)
    valid = [(i, [int(np.floor(256 * np.float64(x))) for x in v] + [0] * (6 - len(v)), label) for i, v, label in vectors() if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x, want = np.array([v for _, v, _ in valid]), Counter()
    for n, (i, v, label) in enumerate(valid):
        if i % 100:
            continue
        scored = sorted((-int(s), valid[m][0], valid[m][2]) for m, s in enumerate(x @ np.array(v)) if m != n)
        for s, p, _ in [t for t in scored if t[2] == label][:5]:
            window = [t for t in scored if t[2] != label and 80 * -s <= 100 * -t[0] <= 100 * -s][:5]
            want.update((i, p, k + 1, t[1], -s, -t[0]) for k, t in enumerate(window))
    df = spark.createDataFrame([(*r, 1, "x") for r in vectors()], "vec_id long, embedding array<float>, label int, rank int, qid string")
    assert Counter(map(tuple, negatives.mine(df).collect())) == want and len(want) > 100
    assert negatives.mine(df.filter("label is null")).count() == 0


def test_siblings_are_eliminated_by_their_ranges(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 16)
    monkeypatch.setattr(negatives, "FAN", 5)
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(c, 3, (200, 4)) for c in r.normal(0, 200, (10, 4))]).round().astype(np.int64)
    label = r.integers(0, 3, len(x))
    most = float((x * x).sum(1).max())
    points = topk.lifted(x, most)
    nodes, order, ranges = negatives.build(points)
    assert sorted(order) == list(range(len(x)))
    x, points, label = x[order], points[order], label[order]
    for k in np.flatnonzero(~nodes["leaf"]):  # each range holds the distances of all entries below
        m = nodes["stop"][k] - nodes["start"][k]
        table = ranges[nodes["ranges"][k] : nodes["ranges"][k] + 2 * m * m].reshape(m, m, 2)
        for j in range(m):
            below, todo = [], [nodes["start"][k] + j]
            while todo:
                c = todo.pop()
                if nodes["leaf"][c]:
                    below += range(nodes["start"][c], nodes["stop"][c])
                else:
                    todo += range(nodes["start"][c], nodes["stop"][c])
            for i in range(m):
                d = topk.distances(points[below], points[nodes["point"][nodes["start"][k] + i]])
                assert np.allclose(table[i, j], (d.min(), d.max()))
    asked = np.arange(0, len(x), 97)
    scores = x[asked] @ x.T
    high = np.array([np.sort(s[label == label[n]])[-3] for n, s in zip(asked, scores, strict=True)])
    low = -(-4 * high // 5)
    for kind in (np.int64, np.float64):
        r, e, got, computed = negatives.search(x[asked].astype(kind), most, low, high, label[asked], (x.astype(kind), points, label, nodes, ranges), 5)
        assert (x[asked][r] * x[e]).sum(1).tolist() == got.astype(int).tolist() and computed < 0.5 * scores.size
        for n, s in enumerate(scores):
            want = np.sort(s[(label != label[asked[n]]) & (s >= low[n]) & (s <= high[n])])[::-1][:5]
            assert sorted(got[r == n].tolist(), reverse=True)[:5] == want.tolist()
    r, _, got, _ = negatives.search(x[asked], most, np.full(len(asked), -np.inf), np.full(len(asked), np.inf), np.full(len(asked), negatives.NOBODY), (x, points, label, nodes, ranges), 5)
    assert all(sorted(got[r == n].tolist(), reverse=True)[:5] == np.sort(s)[::-1][:5].tolist() for n, s in enumerate(scores))
