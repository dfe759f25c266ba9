"""Helpers that the operators share: shared tables, size-checked broadcast, text blocks, sums of models."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many bytes, counted before, is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 48 << 20

#: 64-bit odd multipliers of the mixing step below (the constants of the splitmix64 generator).
MIX_1, MIX_2, MIX_3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs
    in one process (tests). On a cluster it must be set: executors wouldn't see each other's local files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def lean(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches small enough for workers that hold several of them and whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


class Scratch:
    """Tables in the shared folder, by which jobs cut their lineage; all go when the session ends, or on drop()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(self.path)
        self.n = 0

    def table(self, df: DataFrame) -> DataFrame:
        """df, written once and read again."""
        self.n += 1
        at = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Free tables that no later step reads."""
        for x in tables:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(x._scratch_path), True)


def small_enough(rows: int, bytes_per_row: int) -> bool:
    """Whether a counted table may be broadcast."""
    return rows * bytes_per_row <= BROADCAST_BYTES


def text_or_empty(name: str = "text") -> Column:
    """A text column with null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores before it while df has such a column (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def is_fold(column: str, divisor: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor == remainder


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(MIX_1)
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX_2)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_3)
    x ^= x >> np.uint64(31)
    return x


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that the strings of one column hold about `most` bytes each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, _ = utf8_block(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
    trim()


def trim() -> None:
    """Give freed memory back to the system when a task ends: a worker lives on and shares the executor's memory."""
    import ctypes

    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if give_back is not None:
        give_back(0)


def utf8_block(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1, from 0) and bytes of a string or binary column without a copy; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


#: True at the bytes of words: all but space and tab to carriage return.
IN_WORD = np.array([not (b == 0x20 or 9 <= b <= 13) for b in range(256)])


def word_spans(offsets: np.ndarray, data: np.ndarray, in_word: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, maximal runs of bytes that in_word holds to be in words (by default
    `[^\\x20\\x09-\\x0D]+`), and each document's first word (documents + 1)."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = in_word[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]  # words never cross documents
    begins[edge] = inside[1:-1][edge]
    ends[edge - 1] = inside[1:-1][edge - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def cut_between_words(offsets: np.ndarray, data: np.ndarray, in_word: np.ndarray = IN_WORD, most: int = 4 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of about `most` bytes of a block of texts, with the offsets of all its documents inside each; cuts lie between
    words, so a long text needs no more memory than its longest word."""
    start = 0
    while start < len(data):
        stop = min(start + most, len(data))
        while stop < len(data):
            gap = np.flatnonzero(~in_word[data[stop : stop + most]])
            stop = min(stop + (int(gap[0]) if len(gap) else most), len(data))
            if len(gap):
                break
        yield np.clip(offsets, start, stop) - start, data[start:stop]
        start = stop


def join_hot(rows: DataFrame, groups: DataFrame, by: str, n: str, total: int) -> DataFrame:
    """rows joined on `by` with groups, whose rows are unique and tell in column n how many of the `total` rows each has.

    A group of over a thousandth of the rows is broadcast (at most a thousand are), so its rows stay where they are; the
    others meet in a shuffle, where none is large. Rows whose `by` is null or has no group are left out.
    """
    bound = max(10_000, total // 1000)
    hot, rest = F.broadcast(groups.filter(F.col(n) > bound).drop(n)), groups.filter(F.col(n) <= bound).drop(n)
    keys = F.broadcast(groups.filter(F.col(n) > bound).select(by))
    return rows.join(hot, by).unionByName(rows.join(keys, by, "left_anti").join(rest, by))


def sum_models(df: DataFrame, parts: int) -> DataFrame:
    """Sum rows (slice int, body binary) of float64 arrays by slice, with each partial sum held once per task.

    The rows of a slice come from all tasks; the sum streams over them, so memory is that of the model and not of the
    number of tasks.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(body.as_buffer(), dtype=np.float64)
                if at in total:
                    total[at] += x
                else:
                    total[at] = x.copy()
        yield model_rows(total)

    return df.repartition(parts, "slice").mapInArrow(add, "slice int, body binary")


def model_rows(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    """The record batch of sum_models for some slices."""
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.float64).tobytes() for x in total.values()], pa.binary())], names=["slice", "body"])


def collect_model(df: DataFrame, size: int, slice_size: int) -> np.ndarray:
    """The summed model of sum_models as one array; absent slices are 0. Its size is fixed by parameters."""
    out = np.zeros(size)
    for row in df.collect():
        x = np.frombuffer(row["body"], dtype=np.float64)
        out[row["slice"] * slice_size : row["slice"] * slice_size + len(x)] += x
    return out


def cut_model(model: np.ndarray, slice_size: int) -> dict[int, np.ndarray]:
    """The slices of a flat model that hold something other than 0."""
    return {k: x for k, at in enumerate(range(0, len(model), slice_size)) if (x := model[at : at + slice_size]).any()}

