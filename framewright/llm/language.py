"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes a blank, and the n-grams of 1 to 3 characters are counted in hashed
places, with array operations. One pass over all training texts counts in how many each place occurs (for the IDF) and
keeps the vectors of a bounded sample. The model is fitted on that sample with follow-the-regularised-leader under
elastic-net penalties: the sample is dealt out to ``SHARDS`` shards by a hash of the id, each is gone through in a fixed order
from a common state, Spark averages the states language by language, and so on for some rounds; so the model doesn't depend
on how files are split or how many tasks there are. Part of the sample is not fitted on; on it the temperature is chosen that
makes the probabilities least surprised at smoothed targets (as if one more row had each been right and wrong, so that texts
that are easily told apart don't ask for certainty). A second pass scores every whole text.

Bounds: ``FIT_ROWS`` expected rows in the sample (chosen by a hash of the id), at least ``FLOOR`` a language; the state is
languages x ``PLACES`` (256 kB a language in a task, half of it sent to the driver), for all languages that there are.
Document frequencies cover all training texts. Defined results: ``und`` with score 0 for null texts and texts without a
letter, and for all texts if nothing can be learned; ties between languages go to the first by code point. Rows with null
lang, null text or null id are not learned from. Repeated rows count each time; ids may be of any type. Empty tables give empty
results; a very long text is one row's memory (4 bytes a code point and some of their hashes); other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, light, read_table, small_batches, written

PLACES, FIT_ROWS, ROUNDS, SHARDS = 1 << 14, 12_000, 3, 6
#: Rows that a language is fitted on at least (in expectation, if it has so many).
FLOOR = 200
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
TEMPERATURES = np.geomspace(0.005, 50, 161)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of the n-grams of a whole text; none if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    own = letters()[points]
    if not own.any():
        return np.zeros(0, np.int64), np.zeros(0)
    blank = ~own
    keep = own | np.concatenate([[True], own[:-1]])  # runs of blanks count as one
    points = np.concatenate([[32], np.where(blank, 32, points)[keep], [32]]).astype(np.uint64)
    counts = np.zeros(PLACES, np.int64)
    shift = np.uint64(64 - (PLACES.bit_length() - 1))
    with np.errstate(over="ignore"):
        mixed = points * _MIX[0]
        counts += np.bincount((mixed >> shift).astype(np.int64), minlength=PLACES)
        for n in (1, 2):
            mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint64(29))) * _MIX[n] + points[n:] * _MIX[0]
            counts += np.bincount(((mixed ^ (mixed >> np.uint64(31))) * _MIX[2] >> shift).astype(np.int64), minlength=PLACES)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weigh(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf[at]
    return v / max(np.sqrt(v @ v), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


@dataclass
class State:
    """Per language and place: FTRL's sums of corrected gradients and of squared gradients."""

    z: np.ndarray
    n: np.ndarray

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(w @ x)
        p[label] -= 1
        g = p[:, None] * x[None, :]
        n = self.n[:, at]
        self.z[:, at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[:, at] = n + g * g


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = grams(text or "")
        if not len(at) or not self.langs:
            return "und", 0.0
        p = softmax(self.weights[:, at] @ weigh(at, counts, self.idf) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def listed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of an id, a language, two arrays, which become lists without a Python object for each of their numbers, and a total."""
    ids, langs, at, counts, totals = zip(*rows, strict=True)
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in at])]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), schema.field(k).type.value_type)) for k, x in ((2, at), (3, counts))]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(langs, pa.string()), *lists, pa.array(totals, pa.int64())], schema=schema)


def samples(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """Places, counts and language of each row of a batch, as slices of two arrays."""
    at, counts = (batch.column(k).flatten().to_numpy() for k in ("at", "counts"))
    ends = np.cumsum(pc.list_value_length(batch.column("at")).to_numpy(zero_copy_only=False)).tolist()
    for s, e, lang in zip([0, *ends[:-1]], ends, batch.column("lang").to_pylist(), strict=True):
        yield at[s:e], counts[s:e], lang


def measured(known: DataFrame) -> DataFrame:
    """doc_id, lang, at, counts: the n-grams of the sampled rows of ``known`` (doc_id, text, lang, taken); then one row a task
    with null lang whose ``total`` is the number of the task's texts and whose counts are, for each place, of those that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(PLACES, np.int64), 0
        schema = pa.schema([("doc_id", pa.string()), ("lang", pa.string()), ("at", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("total", pa.int64())])
        for batch in small_batches(batches, "text"):
            out = []
            for i, text, lang, taken in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "lang", "taken")), strict=True):
                at, counts = grams(text)
                seen[at] += 1
                total += 1
                if taken and len(at):
                    out.append((i, lang, at, counts, None))
            if out:
                yield listed(out, schema)
        yield listed([(None, None, np.flatnonzero(seen), seen[seen > 0], total)], schema)

    return light(known).mapInArrow(run, "doc_id string, lang string, at array<int>, counts array<long>, total long")


def calibrated(batches: Iterator[pa.RecordBatch], weights: np.ndarray, idf: np.ndarray, number: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """For each temperature the sums, over the rows, of the surprise at the right language and at all others."""
    right, others, rows = np.zeros(len(TEMPERATURES)), np.zeros(len(TEMPERATURES)), 0
    for batch in batches:
        for at, counts, lang in samples(batch):
            z = (weights[:, at] @ weigh(at, counts, idf))[None, :] / TEMPERATURES[:, None]
            surprise = np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z.T
            own = surprise[number[lang]]
            right += own
            others += (surprise.sum(0) - own) / max(len(weights) - 1, 1)
            rows += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(right))), pa.array(right), pa.array(others), pa.array(np.full(len(right), rows))], names=["k", "right", "others", "rows"])


def coolest(losses: list) -> float:
    """The temperature of least surprise, from rows (k, right, others, rows): the right language has probability
    (rows + 1) / (rows + 2), the others share the rest."""
    if not losses or not any(r.right or r.others for r in losses):
        return 1.0
    wrong = 1 / (losses[0].rows + 2)
    return float(TEMPERATURES[min(losses, key=lambda r: ((1 - wrong) * r.right + wrong * r.others, r.k)).k])


def train(docs: DataFrame) -> Model:
    """From the rows of ``docs`` (doc_id, text, lang) that aren't held out."""
    spark = docs.sparkSession
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 30)) / (1 << 30)
    labelled = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # of the two short columns alone
    rows = counts.agg(F.sum("n")).first()[0] or 0
    share = F.greatest(F.lit(FIT_ROWS / max(rows, 1)), F.lit(float(FLOOR)) / F.col("n"))
    shares = written(counts.select(F.col("lang").alias("of"), share.alias("share")), "shares")
    known = labelled.filter(F.col("text").isNotNull()).join(shares, F.col("lang") == F.col("of"), "left")
    table = written(measured(known.select(F.col("doc_id").cast("string"), "text", "lang", F.coalesce(unit < F.col("share"), F.lit(False)).alias("taken"))), "grams")
    tallies = table.filter("lang is null")
    total = tallies.agg(F.sum("total")).first()[0] or 0
    places = tallies.select(F.explode(F.arrays_zip("at", "counts")).alias("e")).groupBy("e.at").agg(F.sum("e.counts").alias("n")).toPandas()  # PLACES rows at most
    seen = np.zeros(PLACES)
    seen[places["at"]] = places["n"]
    idf = np.log((1 + total) / (1 + seen)) + 1
    sample = table.filter("lang is not null")
    langs = tuple(sorted(r[0] for r in sample.select("lang").distinct().collect()))
    if not langs:
        return Model((), idf, np.zeros((0, PLACES)), 1.0)
    number = {x: k for k, x in enumerate(langs)}
    part, turn = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(6)), F.xxhash64("doc_id", F.lit(17))
    dealt = written(sample.select("lang", "at", "counts", (part == 0).alias("kept_back"), F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(SHARDS)).cast("int").alias("shard"), turn.alias("turn")), "sample")
    # the same order whatever tasks there are, repeated ids included
    in_turn = dealt.filter("not kept_back").repartition("shard").sortWithinPartitions("shard", "turn", "lang", F.xxhash64("at", "counts"))
    constants = spark.sparkContext.broadcast((idf, number))

    def one_round(shared: State) -> State:
        sent = spark.sparkContext.broadcast(shared)

        def told(own: State, count: int) -> pa.RecordBatch:
            kinds = [np.full(len(own.z), count), np.arange(len(own.z))]
            lists = [pa.array([x.astype(np.float32).tobytes() for x in y]) for y in (own.z, own.n)]
            return pa.RecordBatch.from_arrays([*map(pa.array, kinds), *lists], names=["rows", "k", "z", "n"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, number = constants.value
            shard, own, count = None, None, 0
            for batch in batches:
                for of, (at, counts, lang) in zip(batch.column("shard").to_pylist(), samples(batch), strict=True):
                    if of != shard:
                        if count:
                            yield told(own, count)
                        shard, own, count = of, State(sent.value.z.copy(), sent.value.n.copy()), 0
                    own.learn(at, weigh(at, counts, idf), number[lang])
                    count += 1
            if count:
                yield told(own, count)

        def met(table: pa.Table) -> pa.Table:
            """The average of a language's states, in a fixed order: sums of doubles depend on it."""
            rows = sorted(zip(*(table.column(c).to_pylist() for c in ("rows", "z", "n")), strict=True))
            whole = sum(r for r, *_ in rows)
            z, n = (sum(r[0] / whole * np.frombuffer(r[k], np.float32).astype(np.float64) for r in rows) for k in (1, 2))
            return pa.table([table.column("k").slice(0, 1), pa.array([z.astype(np.float32).tobytes()]), pa.array([n.astype(np.float32).tobytes()])], names=["k", "z", "n"])

        states = in_turn.mapInArrow(run, "rows long, k long, z binary, n binary")  # SHARDS rows a language
        got = states.groupBy("k").applyInArrow(met, "k long, z binary, n binary").collect()  # one state in all
        sent.destroy()
        if not got:
            return shared
        back = lambda name: np.stack([np.frombuffer(r[name], np.float32).astype(np.float64) for r in sorted(got, key=lambda r: r.k)])
        return State(back("z"), back("n"))

    state = State(np.zeros((len(langs), PLACES)), np.zeros((len(langs), PLACES)))
    for _ in range(ROUNDS):
        state = one_round(state)
    weights = spark.sparkContext.broadcast(state.weights())
    losses = dealt.filter("kept_back").mapInArrow(lambda b: calibrated(b, weights.value, *constants.value), "k long, right double, others double, rows long")
    best = coolest(losses.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("right", "others", "rows")]).collect())
    return Model(langs, idf, weights.value, best)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            out = [sent.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return light(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = predict(docs, train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
