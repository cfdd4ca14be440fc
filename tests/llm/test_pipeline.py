"""The pipeline against a brute-force version of its stages."""

from __future__ import annotations

import base64
import hashlib
import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm import bpe, common, quality

from .cases import awkward, documents

SF = "/root/testdata/sf0.001"


def one_of_each(rows, key):
    """The row with the most code points, then the smallest id, of each key."""
    groups = defaultdict(list)
    for r in rows:
        groups[key(r)].append(r)
    return [min(g, key=lambda r: (-len(r["text"]), r["doc_id"])) for g in groups.values()]


def near(rows):
    """The row with the smallest id of each component of texts that share 0.8 of their five-word shingles."""
    sets = []
    for r in rows:
        w = re.sub(rb"[A-Z]", lambda m: m[0].lower(), r["text"].encode()).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[find(k)].append(r)
    return [min(g, key=lambda r: r["doc_id"]) for g in groups.values()]


def mixed(rows):
    size = {id(r): len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows}
    total = Counter()
    for r in rows:
        total[r["source"]] += size[id(r)]
    names = sorted(total)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, todo, words = {}, set(names), sum(total.values())
    while todo:
        level = words / sum(weight[s] for s in todo)
        over = {s for s in todo if weight[s] * level > 3 * total[s]}
        target |= {s: 3.0 * total[s] if s in over else weight[s] * level for s in over or todo}
        words -= sum(3 * total[s] for s in over)
        todo = todo - over if over else set()
    out = []
    for s in names:
        ahead, whole = 0, int(target[s])
        start, end = {1: (1.5, 0.5), 2: (1.0, 1.0), 3: (0.5, 1.5)}[weight[s]]
        passes = whole // total[s]
        key = {id(r): hashlib.md5(f"{r['doc_id']}:{hashlib.md5(r['text'].encode()).hexdigest()}:+{r['source']}".encode()).hexdigest() for r in rows if r["source"] == s}
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: (key[id(r)], r["doc_id"]))
        for r in own:
            n = size[id(r)]
            taken = passes * n + max(0, min(n, whole - passes * total[s] - ahead))
            for copy in range(-(-taken // n) if n else 0):
                share = min(1.0, (ahead + copy * total[s]) / target[s])
                at = share if start == end else (math.sqrt(start * start + 2 * (end - start) * (share * (start + end) / 2)) - start) / (end - start)
                out.append((at, key[id(r)], copy, r))
            ahead += n
    return [r for *_, r in sorted(out, key=lambda x: x[:3])]


def test_pipeline_agrees_with_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    accepted = {r.doc_id for r in quality.op1_quality(spark, SF).filter("predicted = 1").collect()}
    rows = [r.asDict() for r in docs if r.doc_id in accepted]
    rows = one_of_each(rows, lambda r: re.sub(r"[\x20\x09-\x0D]", "", r["text"]))
    rows = mixed(near(rows))
    path, pattern = bpe.default_files()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    real = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = []
    for seq, r in enumerate(rows):
        ids = real.encode_ordinary(r["text"])
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest(), seq))
    mark = common.mark()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=lambda r: r[-1]) == want  # the training sequence
    assert common.mark() == mark + 2  # only the last stage's input and the starts of its parts are left of the tables on the way
    common.forget(spark, mark)


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    rows = awkward()
    docs = documents(spark, rows).selectExpr("*", "1 as n", "2 as root", "3 as kept", "'x' as key")
    spark.createDataFrame([(k, k % 2, 0) for k in range(1, 20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        if name != "encode":
            assert got.columns == docs.columns, name
            assert {(r.doc_id, r.text) for r in got.collect()} <= {(r[0], r[1]) for r in rows}, name
        else:
            assert got.count() == len(rows) and got.filter("seq is not null").isEmpty()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_sequence_outlives_any_order_of_reading(spark, tmp_path):
    """Parts of very different sizes, which Spark reads largest first, in splits and in tasks of several parts."""
    sizes = [3, 4000, 1, 900, 0, 2500]
    starts = [sum(sizes[:k]) for k in range(len(sizes))]
    rows = spark.range(sum(sizes)).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20 + (F.col("id") % 7).cast("int")).alias("text"))
    part = F.greatest(*[F.when(F.col("doc_id") >= s, F.lit(k)).otherwise(0) for k, s in enumerate(starts)])
    for k in range(len(sizes)):
        rows.filter(part == k).coalesce(1).sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/own-{k}")
        for name in os.listdir(f"{tmp_path}/own-{k}"):
            if name.startswith("part-"):
                os.makedirs(f"{tmp_path}/all", exist_ok=True)
                os.rename(f"{tmp_path}/own-{k}/{name}", f"{tmp_path}/all/" + name.replace("part-00000", f"part-{99998 + k:05d}"))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in ("2000", was):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            got = corpus_pipeline.encode_stage(spark, spark.read.parquet(f"{tmp_path}/all"), SF)
            assert got.count() == sum(sizes) and got.filter("seq is null or seq <> doc_id").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
