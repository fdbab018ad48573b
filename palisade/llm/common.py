"""Helpers shared by the corpus operators: shared-folder tables and vectorised byte-text hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised kernel holds at once; a single longer text is still taken whole.
SLICE_BYTES = 1 << 20
#: Rows of text that an Arrow batch has.
BATCH_ROWS = 1000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, one is made on a single machine (tests); on a cluster
    that is an error, as executors would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Whether a query's shuffle files are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables that ``materialise`` writes inside a ``scratch`` block of the same thread.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def materialise(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Cut lineage with a table written in the shared folder, which outlives lost executors. ``keep``: past a ``scratch``
    block too. What the write shuffles goes as soon as it is done, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not keep and (held := _scratch.get()) is not None:
        held.append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialised inside, by this thread, is removed at the end; nothing is to be computed from it any more."""
    mine: list[str] = []
    outer = _scratch.set(mine)
    try:
        yield
    finally:
        _scratch.reset(outer)
        remove(spark, mine)


def remove(spark: SparkSession, paths: list[str]) -> None:
    path_of, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        path_of(path).getFileSystem(conf).delete(path_of(path), True)


def release(*tables: DataFrame) -> None:
    """Remove what ``materialise`` returned, once nothing is to be computed from it any more."""
    for df in tables:
        remove(df.sparkSession, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def settled(spark: SparkSession, label: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """What ``compute`` returns, as a table; the tables that it writes on its way are removed."""
    with scratch(spark):
        out = materialise(compute(), label, keep=True)
    if (held := _scratch.get()) is not None:
        held += sorted({f.rsplit("/", 1)[0] for f in out.inputFiles()})
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into row runs that hold about ``limit`` bytes of ``column`` each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    group = (np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) - 1) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches put together to hold about ``limit`` bytes of ``column`` each, for kernels that need many rows."""
    held, size = [], 0
    for batch in batches:
        for part in text_slices(batch, column, limit):
            held.append(part)
            size += pc.sum(pc.binary_length(part.column(part.schema.get_field_index(column)))).as_py() or 0
            if size >= limit:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a polynomial hash depends on all of the input."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``span_hash`` reads any substring's hash from them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes in [start, end), equal for equal bytes wherever they stand."""
    raw = (prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the runs of bytes outside space and 0x09-0x0D, in order."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = edges[edges > 0] - 1
    after[edges] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session have ``BATCH_ROWS`` rows at most, as a batch of texts is in memory whole several
    times: on both sides of each pipe between Spark and Python."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)


def id_text(df: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator needs, so that others (of any name) can't clash with its own."""
    small_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
