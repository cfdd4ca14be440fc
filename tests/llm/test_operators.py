"""Each operator against a brute-force version on awkward documents, and on empty tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from framewright.llm import bpe, chat, exact_dedup, language, mixing, near, quality, repeats, secret_scan, simhash, topk

from .cases import SCHEMA, awkward, documents

BLANKS = re.compile(r"[\x20\x09-\x0D]")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_exact_dedup_agrees_with_brute_force(spark):
    rows = awkward()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[hashlib.sha256(BLANKS.sub("", t or "").encode()).hexdigest()].append((i, t or ""))
    want = Counter()
    for digest, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        kept = False
        for i, t in sorted(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0)):
            want[(i, best[0], len(members), not kept, digest)] += 1
            kept = True
    for heavy in (1, 1000):  # with a heavy-hitter list that is too short for the ties as well
        got = Counter(tuple(r.values()) for r in rows_of(exact_dedup.decide(documents(spark), max_heavy=heavy).drop("th")))
        assert got == want
    kept = exact_dedup.dedup(documents(spark).selectExpr("*", "1 as kept", "2 as keep_id", "3 as dig"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "keep_id", "dig"]
    assert kept.count() == len(groups)


def test_rows_are_parted_by_a_bit_map(spark, monkeypatch):
    from framewright.llm import common

    docs = documents(spark).selectExpr("*", "1 as __key", "2 as p")
    keys = docs.select(common.row_key(docs["doc_id"], F.xxhash64("text")).alias("__key"))
    for bits in (1 << 26, 1 << 15, 8):  # in a map of eight bits nearly all rows share theirs
        monkeypatch.setattr(common, "MAP_BITS", bits)
        others, hit = common.parted(docs, keys.filter("__key like '1%'"))
        assert others.columns == docs.columns and others.count() + hit.count() == len(awkward())
        assert not [r for r in others.collect() if str(r.doc_id).startswith("1")]
        assert bits < 100 or {str(r.doc_id)[0] for r in hit.collect()} == {"1"}


def test_mixing_meets_targets_and_repeats(spark):
    rows = awkward()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for _, t, _, s, _ in rows:
        total[s] += size(t)
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, todo, words = {}, set(names), sum(total.values())
    while todo:
        level = words / sum(weight[s] for s in todo)
        over = {s for s in todo if weight[s] * level > 3 * total[s]}
        if not over:
            target |= {s: weight[s] * level for s in todo}
            break
        target |= {s: 3.0 * total[s] for s in over}
        words -= sum(3 * total[s] for s in over)
        todo -= over
    got = rows_of(mixing.assign(documents(spark)))
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(target[s] + 1e-9) for s in names)
    key = lambda xs: sorted((str(r["doc_id"]), r["key"], r["size"], r["taken"], r["ahead"]) for r in xs)
    assert key(got) == key(rows_of(mixing.assign(documents(spark).repartition(7))))
    for r in rows_of(mixing.positions(mixing.assign(documents(spark)))):
        start, end = mixing.SCHEDULES[r["weight"]]
        at = [int(x) / 1e9 for x in r["positions"].split(",")] if r["taken"] else []
        assert r["times"] == len(at) == -(-r["taken"] // r["size"] if r["taken"] else 0) and (r["position"] is None) == (not at)
        for n, x in enumerate(at):  # the share of the target demanded by then is what stands ahead
            assert (start * x + (end - start) * x * x / 2) / ((start + end) / 2) * r["target"] == pytest.approx(r["ahead"] + n * r["source_size"], rel=1e-5, abs=1e-3)
    mixed = mixing.mix(documents(spark).selectExpr("*", "1 as taken", "2 as size"))
    assert mixed.columns[-2:] == ["taken", "size"]
    want = Counter()
    for r in got:
        want[(r["doc_id"], r["source"], r["size"])] += -(-r["taken"] // r["size"]) if r["taken"] else 0
    assert Counter((r["doc_id"], r["source"], size(r["text"])) for r in rows_of(mixed)) == +want


def test_mixing_position_inverts_the_schedule():
    for start, end in mixing.SCHEDULES.values():
        t = np.linspace(0, 1, 11)
        share = (start * t + (end - start) * t * t / 2) / ((start + end) / 2)
        slope, area = end - start, share * (start + end) / 2
        back = share if slope == 0 else (np.sqrt(start * start + 2 * slope * area) - start) / slope
        assert np.allclose(back, t)


def test_bpe_agrees_with_tiktoken(spark):
    import base64

    import tiktoken

    path, pattern = bpe.default_files()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    real = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t, *_ in awkward():
        ids = real.encode_ordinary(t or "")
        raw = np.array(ids, "<u4").tobytes()
        want[(i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r.values()) for r in rows_of(bpe.round_trip(documents(spark)))) == want
    back = rows_of(bpe.decode(bpe.encode(documents(spark))))
    assert Counter(bytes(r["decoded"]) for r in back) == Counter((t or "").encode() for _, t, *_ in awkward())


def test_rank_queue_orders_by_rank_then_place():
    q = bpe.RankQueue(50_000)
    entries = [(int(r), int(p)) for r, p in np.random.default_rng(1).integers(0, 50_000, (3000, 2))]
    for e in entries:
        q.push(*e)
    assert [q.pop() for _ in entries] == sorted(entries) and q.pop() is None and not q.top


def removed_by_brute_force(rows):
    order = sorted({(i is not None, i or 0, xxh(t), t or "") for i, t, *_ in rows})
    seen, out = set(), {}
    for has, i, _, t in order:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
        out[(i if has else None, t)] = (i if has else None, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def xxh(t):
    """The library's order of texts that share an id."""
    return (xxhash.xxh64_intdigest(t.encode(), 42) if t is not None else 42) % (1 << 20)


@pytest.mark.parametrize("heavy", [32_768, 2, 0])
def test_repeats_agree_with_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(repeats, "HEAVY", heavy)
    rows = awkward()
    want = removed_by_brute_force(rows)
    got = repeats._remove(documents(spark), True)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()) == Counter(want[(i, t or "")] for i, t, *_ in rows)


def test_repeats_tell_texts_of_one_id_apart(spark):
    passage = "".join(map(chr, np.random.default_rng(3).integers(33, 127, 400)))
    clean = {xxh(t): t for t in (f"{k} clean" for k in range(5000))}
    longer = (f"{k} {passage}. {passage}" for k in range(5000))
    long = next(t for t in longer if xxh(t) in clean)  # one of the clean texts has a hash that agrees in 20 bits
    rows = [(i, t, "en", "a", 1) for i, t in ((None, clean[xxh(long)]), (None, long), (7, passage), (8, long), (8, clean[xxh(long)]))]
    want = removed_by_brute_force(rows)
    got = repeats._remove(documents(spark, rows), True)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()) == Counter(want[(i, t)] for i, t, *_ in rows)


@pytest.mark.parametrize("rows_a_batch", [1, 7, 10_000])
def test_bytes_and_not_hashes_tell_that_strings_are_equal(spark, rows_a_batch):
    """All strings of an anchor have one hash: a string's further places and shared windows are found, nothing else."""
    r = np.random.default_rng(8)
    strings = [bytes(r.integers(33, 127, 120, np.uint8)) for _ in range(6)]
    strings.append(strings[0][10:] + b"0123456789")  # shares its first 11 windows with the last 11 of the first string
    rows = [(a, 5, int(d), 0, int(repeats.packed(np.int64(0), np.int64(40 * a), np.int64(21))), strings[k]) for a in range(3) for d, k in enumerate(r.integers(0, 7, 30))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_a_batch))
    try:
        for a in range(3):
            own = [x for x in rows if x[0] == a]
            seen, want = set(), set()
            for _, _, doc, _, pack, part in sorted(own, key=lambda x: (x[2], x[4])):
                for o in range(21):
                    (want if part[o : o + 100] in seen else set()).add((doc, (pack >> 7) + o))
                    seen.add(part[o : o + 100])
            table = spark.createDataFrame(own, repeats.FOUND + ", part binary")
            got = {(x.doc, (x.pack >> 7) + o) for x in repeats.compare(table).collect() for o in range(x.pack & 127)}
            assert got == want and want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("rows_a_batch", [1, 3, 10_000])
def test_resolve_holds_one_row(spark, rows_a_batch):
    """Anchors of one, two and many fragments, with copies, across batches of any size."""
    r = np.random.default_rng(10)
    rows = [(int(a), int(f), int(d), 0, int(repeats.packed(np.int64(0), np.int64(100 * k), np.int64(5)))) for k, (a, f, d) in enumerate(zip(r.integers(0, 12, 120) ** 2 % 37, r.integers(0, 3, 120), r.integers(0, 9, 120)))]
    rows += [(a, 1, 1, 0, 7) for a in (1000, 1001, 1001)]  # an anchor that occurs once, and a row that is there twice
    rows += [(5, 5, 5, 5, int(repeats.FIRST) | 99)]
    first = {}
    for a, f, *place in sorted(x for x in rows if x[4] >= 0):
        first.setdefault((a, f), tuple(place))
    want = Counter((a, *place) for (a, _), place in first.items() if sum(k[0] == a for k in first) > 1)
    want += Counter((a, d, t, p | int(repeats.FIRST)) for a, f, d, t, p in rows if p >= 0 and (d, t, p) != first[a, f])
    want += Counter((a, d, t, p) for a, _, d, t, p in rows if p < 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_a_batch))
    try:
        got = Counter(tuple(x) for x in repeats.resolve(spark.createDataFrame(rows, repeats.FOUND)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_repeats_in_pieces_and_small_chunks(monkeypatch):
    text = b"".join(b"%d," % (k * k % 997) for k in range(4000))
    strings = [text[s : s + 150] for s in range(0, 9000, 37)]
    doc, pack = np.zeros(len(strings), np.int64), repeats.packed(np.zeros(len(strings), np.int64), np.arange(len(strings)) * 1000, np.full(len(strings), 51))
    d, p = repeats.repeated_windows(strings, doc, pack)
    got = {(int(x >> 7)) + k for x in p for k in range(int(x & 127))}
    seen, want = set(), set()
    for n, s in enumerate(strings):
        for o in range(len(s) - 99):
            w = s[o : o + 100]
            if w in seen:
                want.add(n * 1000 + o)
            seen.add(w)
    assert got == want and want


def test_simhash_agrees_with_brute_force(spark):
    rows = awkward()
    prints = []
    for _, t, *_ in rows:
        raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
        w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        least[find(k)].append(i)
    want = Counter((i, f"{prints[k]:016x}", min([x for x in least[find(k)] if x is not None], default=None)) for k, (i, *_) in enumerate(rows))
    found = simhash.near_duplicates(documents(spark))
    got = Counter((r["doc_id"], f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in rows_of(found))
    assert got == want
    kept = simhash.dedup(documents(spark).selectExpr("*", "1 as fp", "2 as root"))
    assert kept.columns[-2:] == ["fp", "root"] and kept.count() == len(least)


def test_simhash_links_through_all_levels(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    r = np.random.default_rng(3)
    centres = r.integers(0, 2**64, 4, np.uint64)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(60):
            x = int(c)
            for b in r.integers(0, 64, r.integers(1, 4)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    root = {f: f for f in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    prints = simhash.written(spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)], "doc_id long, fp long"), "t")
    got = {r["fp"] % (1 << 64): r["component_id"] for r in rows_of(simhash.classes(prints))}
    want = defaultdict(list)
    for k, f in enumerate(fps):
        want[find(f)].append(k)
    assert got == {f: min(want[find(f)]) for f in fps}


def test_fingerprints_of_long_texts_in_parts(monkeypatch):
    text = " ".join(f"w{k * k % 97}" for k in range(3000)).encode() + b"   \n"
    whole = simhash.fingerprint(text), [int(h) for part in simhash.shingle_hashes(text, 5) for h in part]
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(simhash, "PART", size)
        assert (simhash.fingerprint(text), [int(h) for part in simhash.shingle_hashes(text, 5) for h in part]) == whole
    assert [len(x) for x in simhash.shingle_hashes(b" a b ", 5)] == [1] and list(simhash.shingle_hashes(b" \n", 5)) == []


def test_pivots_discard_pairs_before_they_are_verified(monkeypatch):
    fps = np.random.default_rng(6).integers(0, 2**64, 400, np.uint64)
    fps[1], fps[7] = fps[0] ^ np.uint64(5), fps[3] ^ np.uint64(1 << 40)
    tried = []
    real = np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: tried.append(len(x)) or real(x))
    table = real(fps[:, None] ^ simhash.REFERENCES[None, :]).astype(np.uint8)
    assert sorted(map(sorted, simhash.forest(fps, table, 2))) == [[0, 1], [3, 7]]
    with_table = sum(tried)
    tried.clear()
    assert sorted(map(sorted, simhash.forest(fps, np.zeros_like(table), 2))) == [[0, 1], [3, 7]]
    assert with_table < sum(tried) / 1000  # the table spares nearly all verifications


def near_copies(seed, groups, size):
    """Groups of texts that differ from their group's text in a few words, near and across the similarity of 0.8."""
    r = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{x}" for x in r.integers(0, 500, 120)]
        for _ in range(size):
            own = list(base)
            for _ in range(int(r.integers(0, 4))):
                own[int(r.integers(0, len(own)))] = f"x{r.integers(0, 10**6)}"
            out.append((len(out) + 1000, " ".join(own), "en", "a", 1))
    return out


def shingle_classes(rows, words=5, least=0.8):
    """The components of texts by brute force, as lists of row numbers."""
    sets = []
    for _, text, *_ in rows:
        w = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()).split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else {()})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = defaultdict(list)
    for k in range(len(rows)):
        out[find(k)].append(k)
    return list(out.values())


@pytest.mark.parametrize("group", [1024, 6])
def test_near_copies_agree_with_brute_force(spark, monkeypatch, group):
    rows = awkward() + near_copies(3, 5, 40)
    want = Counter()
    for members in shingle_classes(rows):
        want[frozenset((rows[k][0], rows[k][1]) for k in members)] += 1
    got = defaultdict(set)
    texts = {(i, hash_of(t)): t for i, t, *_ in rows}
    if group < 1000:
        monkeypatch.setattr(near, "GROUP_SHINGLES", 4000)  # so that the long text's blocks are large by their shingles
    for r in near.similar(documents(spark, rows), group=group).collect():
        got[r["root"]].add((r["doc_id"], texts[(r["doc_id"], r["th"])]))
    assert Counter(map(frozenset, got.values())) == want
    kept = near.dedup(documents(spark, rows).selectExpr("*", "1 as n", "2 as node", "3 as root", "4 as th"))
    assert kept.columns[-4:] == ["n", "node", "root", "th"]
    firsts = [min(((rows[k][0] is None, rows[k][0] or 0) for k in m)) for m in shingle_classes(rows)]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted(firsts)


def hash_of(text):
    """Spark's 64-bit hash of a string, as a signed number; 42 for null."""
    h = xxhash.xxh64_intdigest(text.encode(), 42) if text is not None else 42
    return h - (1 << 64) if h >> 63 else h


def test_secret_scan_agrees_with_regular_expressions(spark):
    want = Counter()
    for i, t, *_ in awkward():
        t, spans = t or "", []
        for k, rule in enumerate(secret_scan.BASE + secret_scan.MORE):
            spans += [(m.start(), k, m.end()) for m in rule.compiled().finditer(t) if len(m[rule.group]) >= rule.least]
        want[(i, ",".join(f"{(secret_scan.BASE + secret_scan.MORE)[k].kind}:{s}:{e}" for s, k, e in sorted(spans)))] += 1
    got = Counter((r["doc_id"], ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"])) for r in rows_of(secret_scan.scan(documents(spark))))
    assert got == want
    assert any(s for _, s in want)


def table_folder(spark, tmp_path, name, df):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_secret_scan_query_returns_its_contract(spark, tmp_path):
    rows = [r for r in awkward() if r[0] is not None] + [(900, "secret=\"abcdef\" secret = 'abc' SECRET:x.y/z+_-= passwd=123456 password=secret=abcdefg", "en", "a", 1), (901, "é AKIA" + "B" * 16 + " AKIA" + "B" * 15 + " " + "abcdef0123" * 3 + "G", "en", "a", 1)]
    patterns = (
        ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    want = Counter()
    for i, t, *_ in rows:
        found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, rule, good) in enumerate(patterns) for m in rule.finditer(t or "") if good(m)]
        n = Counter(k for _, k, _ in found)
        want[(i, n[0], n[1], n[2], hashlib.sha256(",".join(x for *_, x in sorted(found)).encode()).hexdigest())] += 1
    got = secret_scan.op9_secret_scan(spark, table_folder(spark, tmp_path, "documents", documents(spark, rows))).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    assert all(set(x.split(":")[0] for x in r.spans.split(",")) >= {"assign"} for r in got if r.n_assign)


def test_queries_on_awkward_tables(spark, tmp_path):
    rows = [r for r in awkward() if len(r[1] or "") < 20_000]
    folder = table_folder(spark, tmp_path, "documents", documents(spark, rows))
    for query in (mixing.op3_mixing, exact_dedup.op4_exact_dedup, bpe.op6_bpe, repeats.op7_repeats, simhash.op8_simhash, language.op2_language_id):
        got = query(spark, folder).collect()
        assert len(got) == len(rows) and Counter(r.doc_id for r in got) == Counter(r[0] for r in rows), query.__name__


def test_trigram_queries():
    q = secret_scan.trigram_query(secret_scan.BASE[0].pattern)
    assert secret_scan.codes("secret") in q[0] or any(secret_scan.codes("secret") <= alt for alt in q[0])
    assert secret_scan.trigram_query("[0-9a-f]+") == []
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == [[secret_scan.codes("akia")]]


def test_chat_round_trip_and_machine(spark):
    rows = [
        (1, 0, "system", "be [INST] good", "x"), (1, 1, "user", "hi \\ <s> ", "x"), (1, 2, "assistant", "</s>yes\n", "x"), (2, 0, "assistant", "first", "x"), (2, 1, None, None, "x"),
        (3, 0, "user", None, "x"), (3, 0, "user", None, "x"), (None, None, "tool[]", "[ROLE a]", "x"), (-7, 0, "user", "</s>[INST] ok [/INST]", "x"), (-7, 1, "assistant", "</s>[INST] ok [/INST]", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")
    got = {r["conv_id"]: r for r in rows_of(chat.read_back(chat.format_chats(df)))}
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: False, 3: False, None: False, -7: True}
    formatted = "".join(r["text"] for r in sorted(rows_of(chat.format_chats(df).filter("conv_id = -7")), key=lambda r: r["seq"]))
    assert formatted == r"<s>[INST] \</s>\[INST] ok \[/INST] [/INST]<a>\</s>\[INST] ok \[/INST]</s>" and len(formatted) == got[-7]["formatted_chars"]


def vectors(spark, monkeypatch, shard, leaf, fan, block):
    for name, value in (("SHARD", shard), ("LEAF", leaf), ("FAN", fan), ("BLOCK", block)):
        monkeypatch.setattr(topk, name, value)
    r = np.random.default_rng(2)
    rows = [(k, [float(x) for x in r.normal(0, 0.3, 6)]) for k in range(600)]
    rows += [(600 + k, rows[50][1]) for k in range(300)] + [(2000, None), (2050, [float("nan")] * 6), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2150, [0.5]), (2200, []), (50, rows[50][1]), (-50, [0.0] * 6)]
    rows += [(100, rows[100][1])] * 3 + [(150, rows[7][1]), (150, rows[8][1]), (3000, rows[9][1]), (3000, rows[9][1]), (None, rows[9][1])]
    return rows, spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, key string")


@pytest.mark.parametrize(("shard", "leaf", "fan", "block"), [(64, 512, 16, 4), (200, 8, 3, 7), (10_000, 4, 2, 4096)])
def test_top_k_agrees_with_brute_force(spark, monkeypatch, shard, leaf, fan, block):
    rows, df = vectors(spark, monkeypatch, shard, leaf, fan, block)
    valid = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v] + [0] * (6 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for n, (q, mine) in enumerate(valid):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for m, (i, v) in enumerate(valid) if m != n)[:5]
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert Counter(map(tuple, topk.top_k(df).collect())) == want


def test_trees_skip_by_stored_distances(monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 16)
    monkeypatch.setattr(topk, "FAN", 4)
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(c, 3, (200, 4)) for c in r.normal(0, 200, (10, 4))]).round().astype(np.int64)
    most = float((x * x).sum(1).max())
    nodes, order, entry_d = topk.build(topk.lifted(x, most))
    x = x[order]
    assert np.count_nonzero(~nodes["leaf"]) > 3 and set(nodes["to_parent"]) != {0.0}
    for q in x[::97]:
        found, looked_at = topk.search(q, most, x, topk.lifted(x, most), nodes, entry_d, 6, -np.inf)
        assert sorted((-s for s, _ in found))[:6] == sorted(-(x @ q))[:6]
        assert looked_at < len(x) / 2


def test_language_learns_and_answers(spark):
    r = np.random.default_rng(0)
    words = {"en": ["the", "ing", "with", "thorn"], "de": ["sch", "über", "keit", "und"]}
    rows = [(k, " ".join(r.choice(words[lang], 30)), lang, "s", 0) for k in range(300) for lang in [("en", "de")[k % 2]]]
    rows += [(1000, None, "en", "s", 0), (1001, "123 !", "de", "s", 0), (1002, "the with", None, "s", 0), (None, "über keit", "de", "s", 0)]
    df = documents(spark, rows)
    got = {x["doc_id"]: x for x in rows_of(language.predict(df, language.train(df)))}
    assert (got[1000]["lang_pred"], got[1001]["lang_pred"], got[1002]["lang_pred"], got[None]["lang_pred"]) == ("und", "und", "en", "de")
    assert np.mean([got[k]["lang_pred"] == ("en", "de")[k % 2] for k in range(300)]) > 0.98
    assert all(0 <= x["score"] <= 1 for x in got.values())


def test_quality_separates_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op1_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.97
    empty = documents(spark, [(1, None, None, None, None), (2, "", None, None, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.filter_quality(empty, labels).count() == 2  # nothing learned: even odds for all


def test_language_on_held_out_rows(spark):
    got = language.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97


def test_quality_agrees_with_a_plain_discriminant(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    x = np.array([quality.statistics((r.text or "").encode()) for r in docs])
    held = np.array([zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in docs])
    y = np.array([label.get(r.doc_id, -1) for r in docs])
    known = [x[(y == c) & ~held] for c in (0, 1)]
    n = np.array([len(k) for k in known])
    own = [np.cov(k.T, ddof=0) for k in known]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    density = []
    for c in (0, 1):
        lean = min(1.0, quality.POOLED + quality.SIZE / (n[c] + quality.SIZE))
        s = (1 - quality.DIAGONAL) * ((1 - lean) * own[c] + lean * pooled) + quality.DIAGONAL * np.diag(np.maximum(np.diag(pooled), 1e-3))
        d = x - known[c].mean(0)
        density.append(quality.TEMPERATURE * np.log(n[c] / n.sum()) - np.linalg.slogdet(s)[1] / 2 - (d * np.linalg.solve(s, d.T).T).sum(1) / 2)
    want = 1 / (1 + np.exp(-(density[1] - density[0]) / quality.TEMPERATURE))
    got = {r.doc_id: r for r in quality.op1_quality(spark, sf).collect()}
    for r, s, h in zip(docs, want, held, strict=True):
        assert got[r.doc_id].score == pytest.approx(s, abs=1e-6) and got[r.doc_id].held_out == h and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)


def test_quality_statistics_by_hand():
    s = dict(zip(quality.NAMES, quality.statistics(b"Stop STOP stop 12\nstop!\nstop!\n"), strict=True))
    assert s["words"] == pytest.approx(np.log(7)) and s["distinct_words"] == pytest.approx(np.log(6 / 7))
    assert s["upper"] == pytest.approx(np.log(5.5 / (len("Stop STOP stop 12\nstop!\nstop!\n") - 5 + 0.5))) and s["longest_word"] == pytest.approx(np.log(6))
    assert s["repeated_lines"] == pytest.approx(np.log(1.5 / 2.5)) and s["loud_words"] == pytest.approx(np.log(1.5 / 5.5))


def test_quality_on_awkward_documents(spark):
    docs = documents(spark).selectExpr("*", "1 as x", "2 as label", "3 as score")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 60)] + [(3, 1, 0), (3, None, 0), (None, 1, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.filter("quality = 1"), labels.limit(0)):
        model = quality.train(quality.features(docs), given)
        scores = model.score(np.array([r.x for r in quality.features(docs).collect()]))
        assert len(scores) == len(awkward()) and np.isfinite(scores).all() and (scores >= 0).all() and (scores <= 1).all()
        assert quality.filter_quality(docs, given).columns == docs.columns
        assert quality.filter_quality(docs, given).count() == np.count_nonzero(scores >= 0.3)


def test_leader_updates_agree_with_the_formula():
    r = np.random.default_rng(5)
    state = language.State(np.zeros((3, language.PLACES)), np.zeros((3, language.PLACES)))
    z, n = defaultdict(float), defaultdict(float)
    for _ in range(60):
        at, label = np.sort(r.choice(40, 12, replace=False)), int(r.integers(0, 3))
        x = r.uniform(0, 1, 12)
        w = {}
        for k in range(3):
            for i in at:
                over = abs(z[k, i]) - language.L1
                w[k, i] = 0.0 if over <= 0 else -np.sign(z[k, i]) * over / ((language.BETA + n[k, i] ** 0.5) / language.ALPHA + language.L2)
        e = [np.exp(sum(w[k, i] * v for i, v in zip(at, x, strict=True))) for k in range(3)]
        for k in range(3):
            for i, v in zip(at, x, strict=True):
                g = (e[k] / sum(e) - (k == label)) * v
                step = ((n[k, i] + g * g) ** 0.5 - n[k, i] ** 0.5) / language.ALPHA
                z[k, i] += g - step * w[k, i]
                n[k, i] += g * g
        state.learn(at, x, label)
    assert all(state.z[k, i] == pytest.approx(v) and state.n[k, i] == pytest.approx(n[k, i]) for (k, i), v in z.items())
    assert np.count_nonzero(state.weights()) < len(z)  # the penalty leaves some weights at zero


def test_language_query_agrees_with_plain_scoring(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(docs.select("doc_id", "text", "lang"))
    rows = docs.collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows}
    learned = [r.text for r in rows if not held[r.doc_id] and r.lang is not None and r.text is not None]
    seen = Counter(k for text in learned for k in plain_grams(text))
    assert model.langs == tuple(sorted({r.lang for r in rows if not held[r.doc_id] and r.lang}))
    got = {r.doc_id: r for r in language.op2_language_id(spark, sf).collect()}
    for r in rows:
        counts = plain_grams(r.text or "")
        if not counts:
            assert got[r.doc_id].lang_pred == "und"
            continue
        v = {k: (1 + np.log(c)) * (np.log((1 + len(learned)) / (1 + seen[k])) + 1) for k, c in counts.items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        z = np.array([sum(x / norm * model.weights[k, i] for i, x in v.items()) for k in range(len(model.langs))]) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[r.doc_id].lang_pred == model.langs[int(p.argmax())] and got[r.doc_id].score == pytest.approx(p.max(), abs=1e-5) and got[r.doc_id].held_out == held[r.doc_id]


def plain_grams(text):
    """Counts of character n-grams, one to three long, of a text whose runs of other characters are one blank."""
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    if not low.strip():
        return Counter()
    padded = " " + re.sub(" +", " ", low) + " "
    mask, mix = (1 << 64) - 1, [int(x) for x in language._MIX]
    shift, out = 64 - (language.PLACES.bit_length() - 1), Counter()
    for i, c in enumerate(padded):
        h = ord(c) * mix[0] & mask
        out[h >> shift] += 1
        for n in (1, 2):
            if i + n < len(padded):
                h = ((h ^ h >> 29) * mix[n] + ord(padded[i + n]) * mix[0]) & mask
                out[(h ^ h >> 31) * mix[2] % (1 << 64) >> shift] += 1
    return out


def test_rare_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "FIT_ROWS", 100)
    monkeypatch.setattr(language, "FLOOR", 30)
    rows = [(k, "the with thorn ing" if k % 100 else "sch über keit und", "xx" if k % 100 == 0 else "en", "s", 0) for k in range(4000)]
    model = language.train(documents(spark, rows))
    assert model.langs == ("en", "xx") and model.predict("über keit")[0] == "xx" and model.predict("thorn")[0] == "en"


def test_the_model_does_not_depend_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    twice = docs.unionByName(docs.limit(9))  # with repeated rows
    models = [language.train(df) for df in (twice, twice.repartition(7), twice.withColumn("doc_id", F.col("doc_id").cast("string")).coalesce(1))]
    assert models[0].langs == models[1].langs == models[2].langs and len(models[0].langs) > 1
    assert (models[0].weights == models[1].weights).all() and (models[0].idf == models[1].idf).all() and models[0].temperature == models[1].temperature
    assert language.TEMPERATURES[0] < models[0].temperature < language.TEMPERATURES[-1]
    assert np.isfinite(models[2].weights).all()  # ids of another type are hashed as they are


def test_calibration_against_a_plain_version():
    import pyarrow as pa

    r = np.random.default_rng(4)
    weights, idf, number = r.normal(0, 3, (3, language.PLACES)), np.ones(language.PLACES), {"a": 0, "b": 1, "c": 2}
    rows = [(np.sort(r.choice(200, 8, replace=False)), r.integers(1, 5, 8), "abc"[int(r.integers(3))]) for _ in range(50)]
    batch = pa.RecordBatch.from_pydict({"at": [x.tolist() for x, _, _ in rows], "counts": [c.tolist() for _, c, _ in rows], "lang": [k for *_, k in rows]})
    told = next(language.calibrated(iter([batch]), weights, idf, number)).to_pylist()
    from types import SimpleNamespace

    best, wrong = None, 1 / 52
    for k, t in enumerate(language.TEMPERATURES):
        loss = 0.0
        for at, counts, lang in rows:
            z = weights[:, at] @ language.weigh(at, counts, idf) / t
            p = z - z.max() - np.log(np.exp(z - z.max()).sum())
            for j in range(3):
                loss -= p[j] * (1 - wrong if j == number[lang] else wrong / 2)
        if best is None or loss < best[0] - 1e-9:
            best = (loss, t)
        assert told[k]["right"] * (1 - wrong) + told[k]["others"] * wrong == pytest.approx(loss)
    assert language.coolest([SimpleNamespace(**x) for x in told]) == pytest.approx(best[1])


def test_language_on_awkward_documents(spark):
    docs = documents(spark).selectExpr("*", "1 as at", "2 as share", "3 as of", "4 as counts")
    got = rows_of(language.predict(docs, language.train(docs)))
    assert len(got) == len(awkward()) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (4, 5, 6, 17)} == {"und"}


@pytest.mark.parametrize(
    "run",
    [exact_dedup.decide, exact_dedup.dedup, mixing.assign, mixing.mix, bpe.round_trip, bpe.encode, repeats.remove, simhash.near_duplicates, simhash.dedup, near.similar, near.dedup, secret_scan.scan, quality.features, lambda d: language.predict(d, language.train(d))],
)
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


CLASHING = ("doc", "th", "pack", "runs", "spans", "start", "ids", "n", "key", "keys", "uid", "len", "dig", "w", "of", "fp", "root", "node", "label", "x", "size", "weight", "target", "taken", "bucket", "words", "share", "decoded", "n_tokens", "row", "at", "kept")


@pytest.mark.parametrize(
    ("run", "names"),
    [(bpe.round_trip, ["doc_id", "n_tokens", "ids_sha256"]), (repeats.remove, ["doc_id", "n_removed", "kept"]), (secret_scan.scan, ["doc_id", "spans"]), (simhash.near_duplicates, ["doc_id", "fp", "component_id"]), (exact_dedup.decide, ["doc_id", "keep_id", "kept"]), (mixing.assign, ["doc_id", "taken", "ahead"]), (quality.features, ["doc_id", "x"])],
)
def test_columns_of_clashing_names_change_nothing(spark, run, names):
    rows = [r for r in awkward() if len(r[1] or "") < 20_000]
    plain = documents(spark, rows)
    clashing = plain.selectExpr("*", *[f"{k} as {c}" for k, c in enumerate(CLASHING)])
    told = lambda df: Counter(map(str, df.select(*names).collect()))
    assert told(run(clashing)) == told(run(plain))


def test_chats_with_clashing_columns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (-7, 0, "user", "own"), (-7, 1, "assistant", "kept")]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clashing = plain.selectExpr("*", "1 as seq", "2 as state", "3 as loss", "4 as valid", "5 as n_turns", "6 as segment")
    told = lambda df: Counter(map(str, chat.read_back(chat.format_chats(df)).collect()))
    assert told(clashing) == told(plain)


def test_empty_conversations_and_vectors(spark):
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_repeats_in_a_text_of_several_pieces(spark):
    r = np.random.default_rng(8)
    text = "".join(map(chr, r.integers(33, 127, repeats.PIECE + 300_000)))
    cut = repeats.PIECE - 400  # the copies lie across the end of the first piece and in the second one
    text = text[:cut] + text[1000:1900] + text[cut:] + text[5000:5150]
    got = repeats._remove(documents(spark, [(1, text, "en", "a", 1), (2, text[-2000:-1000], "en", "a", 1)]), True).orderBy("doc_id").collect()
    assert [(x.n_bytes, x.n_removed, x.n_spans) for x in got] == [(len(text), 1050, 2), (1000, 1000, 1)]
