"""Helpers that several of the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

_own_dir: str | None = None
_tables: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is named, a folder of our own in local mode (tests); off local
    mode that is an error, as driver and executors share no local folder."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spark-")
    return _own_dir


def written(df: DataFrame, name: str, group_bytes: int = 128 << 20) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, so a lost executor costs no recomputation,
    and later exchanges on the table are plain ones that adaptive execution can split. See :func:`forget`. A task holds a
    row group of ``group_bytes`` when it writes and the columns of one when it reads."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", group_bytes).parquet(path)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place in the list of written tables, for :func:`forget`."""
    return len(_tables)


def forget(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Deletes the tables written from place ``since`` to before ``until``: when a result is written or collected, the
    tables on the way to it are of no more use."""
    for path in _tables[since:until]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _tables[since:until]


#: Bytes of an Arrow batch on its way to a Python worker and back, where the session has Spark's default of 64 MB.
ARROW_BYTES = 4 << 20


def light(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of few bytes in its session: rows of text are wide, and each task holds a batch on both sides."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(64 << 20):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df


#: Bytes of a row group in tables of whole texts or sets of shingles, which tasks hold beside their Python workers.
WIDE_GROUP = 16 << 20
#: Bits of the map that stands for a list of rows (8 MB in all), those of one of Spark's bitmaps, and of an entry cut from it.
MAP_BITS, BITMAP_BITS, ENTRY_BITS = 1 << 26, 1 << 15, 1 << 9


def row_key(doc_id: Column, th: Column) -> Column:
    """Names the rows that have this id and this hash of the text."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), th.cast("string"))


def parted(docs: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` (doc_id, text) that surely aren't in ``listed`` (__key: see :func:`row_key`; written), and those
    that may be, with their ``__own`` key. What is broadcast is a bit map of fixed size, so the texts of nearly all other
    rows never travel; the longer the list, the fuller the map, and in the end all rows go the second way."""
    place = F.pmod(F.xxhash64("__key"), F.lit(MAP_BITS))
    maps = listed.select(place.alias("p")).groupBy(F.floor(F.col("p") / BITMAP_BITS).alias("m")).agg(F.bitmap_construct_agg(F.col("p") % BITMAP_BITS).alias("bits"))
    cut = maps.select("m", "bits", F.explode(F.sequence(F.lit(0), F.lit(BITMAP_BITS // ENTRY_BITS - 1))).alias("i"))
    bits = cut.select((F.col("m") * (BITMAP_BITS // ENTRY_BITS) + F.col("i")).alias("__entry"), F.substring("bits", F.col("i") * (ENTRY_BITS // 8) + 1, F.lit(ENTRY_BITS // 8)).alias("__bits")).filter(F.col("__bits") != F.lit(bytes(ENTRY_BITS // 8)))  # 131,072 rows at most
    own = docs.withColumn("__own", row_key(F.col("doc_id"), F.xxhash64("text"))).withColumn("__p", F.pmod(F.xxhash64("__own"), F.lit(MAP_BITS)))
    at = F.col("__p") % ENTRY_BITS
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    told = own.join(F.broadcast(bits), F.floor(F.col("__p") / ENTRY_BITS) == F.col("__entry"), "left").withColumn("__hit", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return told.filter("not __hit").select(*kept), told.filter("__hit").select(*kept, "__own")


def staying(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judged`` (doc_id, th: a hash of the text, stays, n: rows that have both) lets stay, one
    of those that repeat id and text. Only rows that go or are repeated, and the few that share their bits, are shuffled."""
    listed = written(judged.filter("not stays or n > 1").select(row_key(F.col("doc_id"), F.col("th")).alias("__key"), F.col("stays").alias("__stays")), "marks")
    others, hit = parted(docs, listed)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    # the same join at every size: it brings a mark to a row that has one
    met = hit.join(listed.hint("merge"), F.col("__own") == F.col("__key"), "left")
    first = met.filter("__stays").withColumn("__n", F.row_number().over(Window.partitionBy("__own").orderBy(F.lit(1)))).filter("__n = 1")
    return others.unionByName(met.filter("__key is null").select(*kept)).unionByName(first.select(*kept))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5. A null id counts as the empty text (crc32 0: held out)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column, without a copy of the bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def small_batches(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most_bytes`` of text (one row at least), so that kernels need bounded memory."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def frequent(df: DataFrame, column: str, most: int, counters: int, together: int = 512) -> DataFrame:
    """item, count: at most ``most`` values of a column that are surely among the most frequent, from Misra-Gries
    summaries of ``counters`` counters: one per task, merged ``together`` at a time, then all, so that no task reads the
    summaries of very many others. Nothing for an empty table."""
    states = df.groupBy(F.floor(F.spark_partition_id() / together).alias("g")).agg(F.expr(f"approx_top_k_accumulate({column}, {int(counters)})").alias("state"))
    merged = states.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(state, {int(counters)})").alias("state"))
    return merged.select(F.explode(F.expr(f"approx_top_k_estimate(state, {int(most)})")).alias("e")).select("e.item", "e.count")
