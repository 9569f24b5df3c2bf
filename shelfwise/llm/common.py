"""Shared folder, materialised steps and vectorised text scanning for the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir and runs in one process.
LOCAL_SHARED = "/tmp/checkpoints/shelfwise"

#: Text bytes that one vectorised step works on; a longer single text makes a step of its own.
STEP_BYTES = 8 << 20

#: Bits of the maps of keys that are broadcast: to Python workers, and as a table to join with.
MAP_BITS, DROP_BITS = 1 << 26, 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = LOCAL_SHARED
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, makes values such as generated ids stable, and survives the loss of any executor.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of a frame's stored bytes from its inputs' sizes; 0 where these are not known."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


class Scratch:
    """Materialised steps of one operator, removed once its result has been written.

    ``finish`` writes the result and deletes the steps; if the operator fails before, they are
    deleted as well. The result itself stays in the shared folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        self.paths.append(shared_dir(self.spark, label))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def finish(self, df: DataFrame, label: str) -> DataFrame:
        out = materialize(df, label)
        self.clear()
        return out

    def clear(self, but: int = 0) -> None:
        """Delete the steps, but for the last ``but`` of them."""
        jvm = self.spark.sparkContext._jvm
        gone = self.paths[: len(self.paths) - but]
        for path in gone:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = self.paths[len(gone) :]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.clear()


def without_rows(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows that ``rows`` (doc_id, text_key, kept) does not keep, columns as they are.

    A row is found by its id and ``xxhash64`` of its text. Rows that ``rows`` does not name stay. Of
    those with one id and text as many stay as are kept, one at most. Most rows stay, so texts are not
    shuffled with their keys: a map of DROP_BITS bits with the keys that lose rows is broadcast, and
    only rows that it hits are joined. More keys than the map can tell apart make that join larger,
    not wrong.
    """
    found = rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("left")).filter("n > `left`").select("doc_id", "text_key", "left")
    found = materialize(found, "rows-to-drop")
    place = lambda: F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(DROP_BITS))
    bits = found.select(place().alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits"))
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key")) if docs.columns else docs
    own = own.withColumn("p", place()).withColumn("word", F.shiftright("p", 6))
    own = own.join(F.broadcast(bits), "word", "left")  # DROP_BITS / 64 rows of two numbers at most
    hit = F.coalesce(F.expr("shiftright(bits, cast(p % 64 as int)) & 1L"), F.lit(0)) == 1
    key, asked = ["doc_id", "text_key"], found.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "left")
    near = own.filter(hit).select("row", *key).join(asked, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("text_key").eqNullSafe(F.col("key")), "left")
    # a key that falls on another's bit is asked for in vain: its rows all stay
    near = near.filter("`left` is null or `left` > 0").withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))))
    stay = own.filter(~hit).select("row").unionAll(near.filter("`left` is null or n = 1").select("row"))
    return stay.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


@lru_cache(1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def trim() -> None:
    """Give the memory of a finished task's steps back: workers live on and stand beside others."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Let Arrow batches hold about as many bytes as a step, whatever the length of the rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(STEP_BYTES))
    return spark


def batches_by_bytes(batches, column: str, limit: int = STEP_BYTES):
    """Slices of Arrow batches whose texts add up to about ``limit`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column)))
        ends = np.cumsum(np.nan_to_num(sizes.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    trim()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's start in them (n + 1 offsets from 0); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null(pa.scalar("" if pa.types.is_large_string(column.type) else b"", column.type))
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(raw: np.ndarray, rows: np.ndarray, classes: tuple[np.ndarray, np.ndarray | None]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Split bytes into words and number the distinct ones.

    ``classes`` tells of each byte value whether it is part of words and what it is folded to. A word
    never crosses a row's end. Returns the dictionary-encoded words, the word offsets of the rows
    (n + 1) and each word's first byte.
    """
    inside = classes[0][raw]
    starts, ends = inside.copy(), inside.copy()
    if len(raw):
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        some = rows[:-1] < rows[1:]
        first, last = rows[:-1][some], rows[1:][some] - 1
        starts[first], ends[last] = inside[first], inside[last]
    begin = np.flatnonzero(starts)
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(np.flatnonzero(ends) + 1 - begin, out=offsets[1:])
    kept = raw[inside] if classes[1] is None else classes[1][raw[inside]]
    array = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return array.dictionary_encode(), np.searchsorted(begin, rows), begin


def byte_classes(separators, fold_ascii: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Tables for ``words``: the given byte values separate; A-Z become a-z if wanted."""
    inside, folded = np.ones(256, bool), np.arange(256, dtype=np.uint8)
    inside[list(separators)] = False
    folded[65:91] += 32
    return inside, folded if fold_ascii else None


SPACES = [0x20, *range(0x09, 0x0E)]
#: Words are runs of ASCII digits and letters, lower-cased, and of anything beyond ASCII.
ALNUM = byte_classes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], True)
#: Words are runs of anything but ASCII white space, lower-cased or as they are.
SPACED_LOWER = byte_classes(SPACES, True)
SPACED = byte_classes(SPACES, False)


def sha256_binary(column) -> F.Column:
    """SHA-256 of a string's UTF-8 bytes, as 32 bytes."""
    return F.unhex(F.sha2(column, 256))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each (start, length) in turn."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(total, dtype=np.int64)
    return out
