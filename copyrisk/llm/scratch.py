"""Intermediate tables in the folder that driver and executors share, and joins of bounded size with them.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, so a lost executor
costs a re-read and not a recomputation.  The folder is scratch space: it may be
emptied as soon as the results that were derived from it have been written.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Bytes of content up to which a side of a join is broadcast.
BROADCAST_BYTES = 16_000_000
#: Blocks of a filter of keys, of 4096 bytes (32,768 bits) each: 16 MB, whatever it is built from.
FILTER_BLOCKS, BLOCK_BITS = 4096, 32_768


#: Bytes of rows that go to a Python worker at once; by default Spark counts rows alone, 10,000 of any length.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Python workers get :data:`BATCH_BYTES` at once, unless it is set already."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def returning_memory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each, the worker gives memory that its work has freed back to the system.

    Workers outlive their tasks, and what they hold on to counts against the executor in all later ones.
    """
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of most clusters has it
    for b in batches:
        yield b
        pa.default_memory_pool().release_unused()
        if trim:
            trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; a fresh local one only for a local master without one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("copyrisk.scratch", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="copyrisk-")
        spark.conf.set("copyrisk.scratch", found)
    return found.rstrip("/")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and returns a frame that reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/copyrisk/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    if (held := _OPEN.get()) is not None:
        held.append(staged)
    return staged


#: What the innermost scratch() of this thread has staged; queries in other threads have their own.
_OPEN: ContextVar[list[DataFrame] | None] = ContextVar("copyrisk-staged", default=None)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes the tables that are staged within it at its end, but for those in the list it gives."""
    kept: list[DataFrame] = []
    outer, held = _OPEN.get(), []
    _OPEN.set(held)
    try:
        yield kept
    finally:
        _OPEN.set(outer)
        paths = {df.staged_at for df in kept}
        discard(*(df for df in held if df.staged_at not in paths))
        if outer is not None:
            outer.extend(kept)


def discard(*staged: DataFrame) -> None:
    """Deletes tables of :func:`stage_table` that nothing reads any more."""
    for df in staged:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _bytes_of(value: Column, kind: DataType) -> Column:
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType | BinaryType | ArrayType):
            return F.coalesce(F.aggregate(value, F.lit(0), lambda n, x: n + _bytes_of(x, kind.elementType)), F.lit(0)) + 16
        each = 8 * len(kind.elementType.fields) + 16 if isinstance(kind.elementType, StructType) else 8
        return F.greatest(F.size(value), F.lit(0)) * each + 16
    return F.lit(8)


def content_bytes(df: DataFrame) -> int:
    """Bytes of the rows of ``df`` in memory, nearly; ``df`` must be cheap to read, that is staged."""
    row = sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def small_or_not(df: DataFrame, limit: int | None = None) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if its content is of at most ``limit`` bytes; else as it is.

    ``df`` must be cheap to read, that is a staged table.
    """
    fits = content_bytes(df) <= (BROADCAST_BYTES if limit is None else limit)
    return (F.broadcast(df), True) if fits else (df, False)


def _slot(h: Column) -> tuple[Column, Column]:
    return F.pmod(h, F.lit(FILTER_BLOCKS)).cast("int"), F.pmod(F.shiftright(h, 20), F.lit(BLOCK_BITS)).cast("int")


def key_filter(keys: DataFrame, *hashes: Column) -> DataFrame:
    """A filter of fixed size with a bit for each of a key's ``hashes``, staged: ``block, bits``."""
    slots = F.explode(F.array(*(F.struct(*(x.alias(n) for x, n in zip(_slot(h), ("block", "bit")))) for h in hashes)))
    slots = keys.select(slots.alias("s")).select("s.block", F.col("s.bit").cast("long").alias("bit")).distinct()
    return stage_table(slots.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")), "filter")


def may_hold(df: DataFrame, key: Column, built: DataFrame, flag: str) -> DataFrame:
    """``df`` with a boolean column: false where ``key`` surely isn't among the filter's keys.

    The filter is broadcast, so no row of ``df`` moves.
    """
    block, bit = _slot(F.xxhash64(key, F.lit(5)))
    own = built.select(F.col("block").alias("_cr_block"), F.col("bits").alias("_cr_bits"))
    byte = F.conv(F.hex(F.substring("_cr_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, F.pmod(bit, F.lit(8))) == 1
    return df.join(F.broadcast(own), block == F.col("_cr_block"), "left").withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_cr_block", "_cr_bits")


def having(df: DataFrame, key: Column, keys: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """``df`` joined with the staged ``keys`` on ``on``, without moving rows that find no partner.

    ``key`` and the column ``_cr_k`` of ``keys`` are equal where ``on`` holds, and ``on`` must compare
    ``_cr_k`` with ``key``.  Keys of few bytes are broadcast.  Beyond that a filter of fixed size
    says which rows may have a partner, and those alone are shuffled.  ``how``: ``inner``,
    ``left_anti`` or ``left``.
    """
    few, fits = small_or_not(keys)
    if fits:
        return df.join(few, on, how)
    flagged = may_hold(df, key, key_filter(keys, F.xxhash64("_cr_k", F.lit(5))), "_cr_may")
    met = flagged.filter("_cr_may").drop("_cr_may").join(keys, on, how)
    if how == "inner":
        return met
    rest = flagged.filter("not _cr_may").drop("_cr_may")
    return met.unionByName(rest, allowMissingColumns=True)


def drawn(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows of the staged ``df``, those whose keys hash lowest; equal hashes go by the keys.

    A threshold from the count of rows keeps back nearly all others where they are, so that not
    every partition offers as many as are wanted.
    """
    n = df.count()
    h = F.xxhash64(*keys, F.lit(31))
    if n > rows:
        span = 1 << 40
        df = df.filter(F.pmod(h, F.lit(span)) < F.lit(min(span, int(span * (rows / n) * 1.05 + span * 5 / n))))
    return df.orderBy(F.pmod(h, F.lit(1 << 40)), *keys).limit(rows)
