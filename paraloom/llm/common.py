"""What the operators of this subpackage share: tables, cuts of lineage, blocks of documents."""

from __future__ import annotations

import ctypes
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import cache, wraps
from inspect import isgeneratorfunction, signature

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that one block holds at least (but for a partition's last block).
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; for local runs there is a default."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and (jdir := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = jdir.get()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "file:///tmp/checkpoints").rstrip("/")


#: Rows of a few numbers that one file of a small table holds at most.
FILE_ROWS = 20_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    rows: what df, the outcome of a shuffle, has at most, if that is known and rows are
    short; it then goes to no more files than it needs.

    Cuts the lineage: a lost executor costs a reread, and later passes see the
    very rows and partition numbers that were written. Removed when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.parquet(path)
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the files of a table made by written(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.startswith("file:/") or "://" in path:
            jpath = jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Let rows go to Python workers in batches of BATCH_BYTES from now on in this session, if its limit is higher.

    The usual limits are 10,000 rows and 64 MB, in the JVM's own memory outside the heap and in each worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def gapless_rank(rows: DataFrame, group: str, piece: str, order: list[str], name: str = "rank") -> DataFrame:
    """rows with a rank, gapless from 0 in each group.

    piece cuts a group into parts small enough for one task each; the parts' counts
    give each its start, so no group is sorted as a whole.
    """
    before = Window.partitionBy(group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(group, piece).count().select(group, piece, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(group, piece).orderBy(*order)
    ranked = rows.withColumn("__rank", F.row_number().over(within) - 1).join(starts, [group, piece])
    return ranked.withColumn(name, (F.col("__rank") + F.col("__start")).cast("long")).drop("__rank", "__start")


def text_digest() -> Column:
    """SHA-256 of the column text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def kept_once(docs: DataFrame, key: str, judged: DataFrame) -> DataFrame:
    """The rows of docs whose key and text are those of a kept row of judged (key, digest, kept), repeated ones once; null keys are equal.

    judged has a row for each of docs. All columns of docs are as before, whatever their names.
    """
    judged = written(judged.select(F.col(key).alias("__key"), F.col("digest").alias("__digest"), "kept"), "judged")
    marked = docs.withColumn("__text", text_digest())
    same = lambda t: marked[key].eqNullSafe(t["__key"]) & (marked["__text"] == t["__digest"])
    gone = judged.where("NOT kept").drop("kept").distinct()
    left = marked.join(gone, same(gone), "left_anti")
    again = judged.where("kept").groupBy("__key", "__digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if again.head(1):
        again = written(again, "repeats")
        left = left.join(again, same(again), "left_anti").union(marked.join(again, same(again), "left_semi").dropDuplicates([key, "__text"]))
    return left.drop("__text")


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined to the one row of groups that has their keys; rows carry pid, the partition they were written in.

    groups go to each (keys, pid) first, so a key that a third of all rows share
    is dealt out by pid and no task gets more than one partition's rows of it.
    """
    local = rows.select(*keys, "pid").distinct().join(groups, keys)
    return rows.join(local, [*keys, "pid"])


def utf8_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


@cache
def _library() -> ctypes.CDLL:
    return ctypes.CDLL(None)


@cache
def lean_memory() -> None:
    """Let this Python worker, which Spark keeps for later tasks, give freed arrays back to the system at once.

    The allocators would keep them otherwise: Arrow's own pool, and the C library's, whose limit for
    blocks that are mapped one by one rises with the largest freed one (where there is such a limit).
    """
    pa.set_memory_pool(pa.system_memory_pool())
    if mallopt := getattr(_library(), "mallopt", None):
        mallopt(-3, 16 << 20)  # bytes from which blocks are mapped one by one
        mallopt(-1, 32 << 20)  # free bytes at the heap's end that go back


def lean(work: Callable) -> Callable:
    """work, a function of one or two arguments or a generator of one that a Python worker runs, leaving no unused memory.

    Idle workers keep what they have (some for each core, as stages chain them), so what
    work freed goes back to the system when it ends.
    """

    def trimmed() -> None:
        if trim := getattr(_library(), "malloc_trim", None):
            trim(0)

    def whole(*tables: pa.Table) -> pa.Table:
        lean_memory()
        try:
            return work(*tables)
        finally:
            trimmed()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        try:
            yield from work(batches)
        finally:
            trimmed()

    if isgeneratorfunction(work):
        return wraps(work)(parts)
    return wraps(work)((lambda a: whole(a)) if len(signature(work).parameters) == 1 else (lambda a, b: whole(a, b)))  # Spark counts arguments


def text_blocks(batches: Iterator[pa.RecordBatch], at_least: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Gather record batches (with a column text) to blocks of about at_least bytes; a single huge row is its own block."""
    lean_memory()
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column("text")
        _, ends = utf8_column(lengths)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + max(1, at_least - size), side="left"))
            stop = min(max(stop, start + 1), batch.num_rows)
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop] - ends[start])
            start = stop
            if size >= at_least:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one blob: counts and type codes first."""
    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<Q4s", len(a), a.dtype.str[1:].encode().ljust(4)) for a in arrays)
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<I", blob, 0)
    at, heads = 4, []
    for _ in range(n):
        heads.append(struct.unpack_from("<Q4s", blob, at))
        at += 12
    out = []
    for count, code in heads:
        kind = np.dtype("<" + code.decode().strip())
        out.append(np.frombuffer(blob, kind, count, at))
        at += count * kind.itemsize
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place on a fresh uint64 array."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
