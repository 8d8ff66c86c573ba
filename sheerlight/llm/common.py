"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: the space and the controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of text that one numpy step works on at most, a single longer text aside.
CHUNK_BYTES = 1 << 18
#: Bytes that one running sum spans at most, a longer word aside.
SUM_BYTES = 1 << 19
#: Narrow rows in a checkpoint file, at least, where their number is known.
ROWS_A_FILE = 100_000
#: Rows in an Arrow batch handed to Python; long texts make larger ones too costly.
ARROW_ROWS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A local folder is set only where the setting is missing and the session is local (tests on one machine).
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sheerlight-")
        spark.conf.set("spark.checkpoint.dir", found)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, without its lineage.

    Where the number of rows is known, they are written as so many files as they need: a file costs more than a few rows.
    """
    shared_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    return df.checkpoint(eager=True)


def delete_cut(df: DataFrame) -> None:
    """Remove the files of a frame that ``cut`` returned, which nothing may read any more."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        delete_path(df.sparkSession, file.get())


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that are gone: it does so when they are collected, which it seldom does by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared ones, with Hadoop's own file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Return memory that training has freed to the system, where the C library can; workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` with its memory given back at the end of a task: the workers of an executor live on."""

    def whole(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


Fitted = TypeVar("Fitted")


def fitted(rows: DataFrame, fit: Callable[[pa.Table], Fitted]) -> Fitted:
    """What ``fit`` makes of a bounded table, in one executor task: only the model comes to the driver, pickled.

    A lost executor costs one more run of the task; ``fit`` must not depend on the order of the rows.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            model = pickle.dumps(fit(pa.Table.from_batches(held)))
            held.clear()
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    model = pickle.loads(found[0]["model"]) if found else fit(pa.table({n: [] for n in names}))
    del found
    give_back()
    return model


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for texts of any length.

    Spark reads the setting when a plan runs, which is after this returns, so it is lowered for the session; a lower one stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def text_of(column: str | Column = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def running(df: DataFrame, order: list[Column], sums: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """Global order without a single task: adds ``_pos`` (0-based) and, for each new name in ``sums``, the
    sum of its column over all rows before this one.

    Rows are dealt by range over ``order``, kept by a checkpoint so that the ranges stay the same, and
    numbered within each range; only one total for each range comes to the driver.  Use narrow rows.
    Equal rows under ``order`` should be interchangeable or made distinct by a last column.
    """
    sums = sums or {}
    n = parts or shuffle_parts(df.sparkSession)
    held = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    totals = held.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{k}") for k, c in sums.items()])
    before: dict[str, dict[int, int]] = {"_pos": {}, **{k: {} for k in sums}}
    so_far = dict.fromkeys(before, 0)
    for row in sorted(totals.collect(), key=lambda r: r["_part"]):  # one row for each range
        for k in before:
            before[k][row["_part"]] = so_far[k]
            so_far[k] += (row["n"] if k == "_pos" else row[f"s_{k}"]) or 0
    w = Window.partitionBy("_part").orderBy(*order)
    offset = lambda k: _lookup(before[k], F.col("_part"))
    out = held.withColumn("_pos", F.row_number().over(w).cast("long") - 1)
    for k, c in sums.items():
        out = out.withColumn(k, F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    for k in before:
        out = out.withColumn(k, F.col(k) + offset(k))
    return out.drop("_part")


def long_array(values: list[int | None]) -> Column:
    """An array of longs as one literal, however many they are: the optimizer reads it once."""
    if not values:
        return F.array().cast("array<long>")
    told = F.split(F.lit(",".join("" if v is None else str(int(v)) for v in values)), ",")
    return F.transform(told, lambda x: F.when(x != "", x.cast("long"))) if None in values else told.cast("array<long>")


def _lookup(values: dict[int, int], key: Column) -> Column:
    return F.element_at(long_array([values.get(i, 0) for i in range(max(values) + 1)]), key + 1) if values else F.lit(0).cast("long")


# ---------------------------------------------------------------------------------------------- numpy on text

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        for k, base in enumerate((_ODD, _INVERSE)):
            _POWERS[k] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
    return _POWERS


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``data``, in order: a polynomial from one running sum, brought to the span's own place."""
    out = np.empty(len(start), np.uint64)
    first = 0
    while first < len(start):  # in blocks, so that the sums stay small
        last = max(first + 1, int(np.searchsorted(end, start[first] + SUM_BYTES, side="right")))
        base, n = start[first], int(end[last - 1] - start[first])
        forth, back = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data[base : base + n].astype(np.uint64) + np.uint64(1)) * forth[:n], out=total[1:])
        s, e = start[first:last] - base, end[first:last] - base
        out[first:last] = mix((total[e] - total[s]) * back[s] + (e - s).astype(np.uint64) * _ODD)
        first = last
    return out


class Words:
    """The words of some texts: ``start``/``end`` into ``data``, the text of each, and a 64-bit hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = _SPACE):
        self.data = data = _LOWER[data] if lower else data
        self.docs = len(offsets) - 1
        word = ~space[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = False
            before[1:] = word[:-1]
        before &= ~first[:-1]
        after = np.zeros(len(data), bool)
        if len(data):
            after[:-1] = word[1:]
        after &= ~first[1:]
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        marks = np.zeros(len(data) + 1, np.int32)
        np.add.at(marks, offsets[1:-1], 1)
        self.doc = np.cumsum(marks[:-1])[self.start]
        self.count = np.bincount(self.doc, minlength=self.docs)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts as (first row, row after the last, UTF-8 bytes, offsets); null is empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
