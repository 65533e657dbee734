"""Writes that either happened or didn't: versions with a pointer, and batches with an id.

Data is written into a folder of its own that nobody reads, and a small file then names it.  That
file is created and never changed.  A writer that dies before leaves a folder that no reader sees;
one that repeats a batch finds its file and writes nothing.  No folder is deleted before its
successor is named.  It takes no renaming, so it works on stores in which that isn't atomic.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOG = "_commits"
#: Closes a complete file of the log.
_SEAL = "\n"


def _fs(spark: SparkSession, path: str) -> tuple:
    jvm = spark._jvm
    return jvm, jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _write(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> bool:
    """Creates a small file; false if it is there already."""
    jvm, fs = _fs(spark, path)
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not overwrite and fs.exists(where):
        return False
    out = fs.create(where, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def _log(spark: SparkSession, path: str) -> dict[str, str]:
    """Names and contents of the complete files of the log."""
    jvm, fs = _fs(spark, path)
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/{LOG}")
    out = {}
    for s in fs.listStatus(where) if fs.exists(where) else ():
        stream = fs.open(s.getPath())
        try:
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if text.endswith(_SEAL):
            out[s.getPath().getName()] = text.strip()
    return out


def replace(df: DataFrame, path: str, kind: str = "parquet", keep: int = 2, **options: str) -> str:
    """Makes ``df`` the content of ``path``; it may be derived from what stands there now.

    Of several writers at once the last to be named counts.  The last ``keep`` versions stay, for
    those who still read them.
    """
    spark = df.sparkSession
    folder = f"v-{uuid.uuid4().hex}"
    df.write.options(**options).format(kind).save(f"{path}/{folder}")
    number = max((int(n) for n in _log(spark, path)), default=0) + 1
    while not _write(spark, f"{path}/{LOG}/{number:012d}", folder + _SEAL):
        number += 1
    _drop_old(spark, path, keep)
    return folder


def _drop_old(spark: SparkSession, path: str, keep: int) -> None:
    jvm, fs = _fs(spark, path)
    log = _log(spark, path)
    for n in sorted(log)[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{log[n]}"), True)
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{LOG}/{n}"), False)


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that counts."""
    log = _log(spark, path)
    return f"{path}/{log[max(log)]}" if log else None


def append_once(df: DataFrame, path: str, batch: str | int) -> bool:
    """Appends ``df`` as the batch of that id; false, and nothing is written, if it is there already.

    For ``foreachBatch``: ``lambda df, i: append_once(df, path, i)`` writes each row once, however
    often a batch is tried.
    """
    spark = df.sparkSession
    if str(batch) in _log(spark, path):
        return False
    folder = f"b-{batch}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    return _write(spark, f"{path}/{LOG}/{batch}", folder + _SEAL)


def appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches; none, with ``schema``, before the first."""
    folders = sorted(_log(spark, path).values())
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)
