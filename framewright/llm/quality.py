"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One pass turns each whole text into a fixed vector of statistics (shares as logits, counts as logarithms). The class means
and covariances come from sums over all labelled training rows, made per task and added up: what reaches the driver is
a few matrices, whatever the number of rows. The covariances are shrunk to a mix of the pooled covariance and its
diagonal; their Cholesky factors are made once and sent to the tasks, which score by the difference of the two Mahalanobis
log densities.

Defined results: null text is empty and gets the vector of an empty text, so every row has a score; rows whose id is null
are never trained on; labels of other values than 0 and 1 or null are ignored. If a class has no training row the score
is the share of the other class. Repeated labels count once each. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, light, read_table, small_batches, written

THRESHOLD = 0.3
#: Weight of the pooled covariance, then of its diagonal, in each class covariance.
POOLED, DIAGONAL = 0.10, 0.05
#: Scale of the log-density difference: statistics are correlated and not quite normal, so raw differences overstate.
TEMPERATURE = 4.0
SYMBOLS = frozenset(b"!#$%&*|<>{}[]@~^_=+\\/`")
_CLASS = np.zeros(256, np.int64)  # 0 letters, 1 upper case, 2 digits, 3 symbols, 4 other punctuation, 5 blanks, 6 line ends, 7 bytes of longer characters
for _c in range(256):
    _CLASS[_c] = 7 if _c > 127 else 1 if 65 <= _c <= 90 else 0 if 97 <= _c <= 122 else 2 if 48 <= _c <= 57 else 6 if _c in (10, 13) else 5 if _c in (9, 11, 12, 32) else 3 if _c in SYMBOLS else 4
NAMES = (
    "words", "word_length", "upper", "digits", "symbols", "punctuation", "line_ends", "other_bytes", "distinct_words", "top_word",
    "repeated_lines", "repeated_pairs", "symbol_words", "loud_words", "title_words", "line_length", "entropy", "ended_lines", "longest_word",
)
SIZE = len(NAMES)


def logit(share: float, n: float) -> float:
    """Log odds with half a count added on either side."""
    return float(np.log((share * n + 0.5) / ((1 - share) * n + 0.5)))


def statistics(raw: bytes) -> np.ndarray:
    """The vector of one whole text."""
    n = max(len(raw), 1)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=hist, minlength=8)
    words = raw.split()
    m = max(len(words), 1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x.strip() for x in raw.split(b"\n") if x.strip()]
    k = max(len(lines), 1)
    pairs = len(set(zip(words, words[1:], strict=False)))
    symbol_words = loud = title = 0
    longest = 0
    for w, c in counts.items():
        if w.isupper() and len(w) > 1:
            loud += c
        elif w[:1].isupper():
            title += c
        if w[-1] in SYMBOLS or w[0] in SYMBOLS:
            symbol_words += c
        longest = max(longest, len(w))
    p = hist[hist > 0] / n
    ended = sum(x[-1] in b".!?:;\"')" for x in lines)
    return np.array(
        [
            np.log1p(len(words)), np.log((n + 1) / (m + 1)), logit(kinds[1] / n, n), logit(kinds[2] / n, n), logit(kinds[3] / n, n), logit(kinds[4] / n, n),
            logit(kinds[6] / n, n), logit(kinds[7] / n, n), np.log((len(counts) + 1) / (m + 1)), logit(max(counts.values(), default=0) / m, m),
            logit(1 - len(set(lines)) / k if lines else 0.0, k), logit(1 - pairs / max(m - 1, 1) if len(words) > 1 else 0.0, m), logit(symbol_words / m, m),
            logit(loud / m, m), logit(title / m, m), np.log((n + 1) / k), float(-(p * np.log2(p)).sum()) if len(p) else 0.0, logit(ended / k, k), np.log1p(longest),
        ]
    )


def vectors(texts) -> np.ndarray:
    return np.array([statistics((t or "").encode()) for t in texts]).reshape(-1, SIZE)


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors (lower) and log terms of the two classes."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    only: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        density = [c - 0.5 * ((x - m) @ f.T) ** 2 @ np.ones(x.shape[1]) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPERATURE, -700, 700)))


def moments(labelled: DataFrame) -> list[np.ndarray]:
    """By class: count, sums and sums of products of ``labelled`` (label, x), added up over all rows."""
    width = 1 + SIZE + SIZE * SIZE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width))
        for batch in batches:
            y = batch.column("label").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
            for c in (0, 1):
                own = x[y == c]
                sums[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        places = np.tile(np.arange(width), 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], width)), pa.array(places), pa.array(sums.ravel())], names=["label", "place", "v"])

    total = labelled.mapInArrow(run, "label long, place long, v double").groupBy("label", "place").agg(F.sum("v").alias("v")).toPandas()  # 2 * width rows
    out = np.zeros((2, width))
    out[total["label"], total["place"]] = total["v"]
    return [out[0], out[1]]


def fit(labelled: DataFrame) -> Model:
    sums = moments(labelled)
    n = np.array([s[0] for s in sums])
    if not n.all():
        return Model(np.zeros((2, SIZE)), np.zeros((2, SIZE, SIZE)), np.zeros(2), float(n[1] / n.sum()) if n.sum() else 0.5)
    means = np.array([s[1 : 1 + SIZE] / s[0] for s in sums])
    own = [s[1 + SIZE :].reshape(SIZE, SIZE) / s[0] - np.outer(m, m) for s, m in zip(sums, means, strict=True)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    ridge = np.diag(np.maximum(np.diag(pooled), 1e-3))
    factors, constants = [], []
    for k in (0, 1):
        # a class of few rows leans on the pooled covariance more
        lean = min(1.0, POOLED + SIZE / (n[k] + SIZE))
        shrunk = (1 - DIAGONAL) * ((1 - lean) * own[k] + lean * pooled) + DIAGONAL * ridge
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(n[k] / n.sum()) * TEMPERATURE - np.log(np.diag(lower)).sum())
    return Model(means, np.array(factors), np.array(constants))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x (array of double) of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            x = vectors(batch.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, SIZE, dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "x"])

    return light(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def train(table: DataFrame, labels: DataFrame) -> Model:
    """``table``: features() of all documents; only those that aren't held out are learned from."""
    known = labels.filter("quality in (0, 1)").select(F.col("doc_id").alias("__id"), F.col("quality").cast("long").alias("label"))
    return fit(table.filter(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("__id")).select("label", "x"))


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns. Only labelled rows are measured for
    training; then each text is scored as it passes."""
    known = labels.filter("quality in (0, 1)").select(F.col("doc_id").alias("__id")).distinct()
    rows = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("__id"), "left_semi")
    model = train(written(features(rows), "features"), labels)  # a table between the kernels: no task holds two workers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # whole rows, not a function of the text: tasks of one kind share their Python workers with the other operators
        for batch in small_batches(batches, "text"):
            yield batch.filter(pa.array(model.score(vectors(batch.column("text").to_pylist())) >= threshold))

    return light(docs).mapInArrow(run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = written(features(read_table(spark, sf_dir, "documents")), "features")
    model = train(table, read_table(spark, sf_dir, "labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = table.mapInArrow(run, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
