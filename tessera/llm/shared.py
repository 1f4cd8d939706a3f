"""Small helpers that the training-data operators share: shared storage, text keys, Arrow access."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``. In local mode, where driver and executors are one
    process, an unset one becomes a folder of the warehouse; on a cluster that is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoint"
    return folder.rstrip("/")


#: Set while a table is written: its shuffle files go, and Arrow batches stay small whatever the length of the texts.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors. The shuffle files of
    the write are dropped once it is done, as nothing reads them any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["stashed_at"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`stash` wrote, once no plan that is still to run reads them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.__dict__["stashed_at"])
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot where it has more than this share of all rows, so there are at most 1 / HOT hot keys, whatever the input.
HOT, SALTS = 0.001, 64


def hot_join(rows: DataFrame, counts: DataFrame, key: str, n: str, salt: Column, distinct: bool = False) -> DataFrame:
    """``rows`` joined by a long ``key`` with ``counts``, which has one row for each key and in ``n`` how many rows have it.
    The rows of hot keys are dealt over ``SALTS`` tasks by ``salt``; the hot keys are broadcast, they are no more than
    1 / HOT. With ``distinct``, repeated rows of ``rows`` are dropped where they meet."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    hot = [r[0] for r in counts.filter(F.col(n) > max(10_000, int(total * HOT))).select(key).collect()]
    if not hot:
        out = rows.join(counts, key)
        return out.dropDuplicates(rows.columns) if distinct else out
    known = F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in hot], f"{key} long").withColumn("__hot", F.lit(True)))
    dealt = F.when(F.col("__hot"), F.pmod(F.xxhash64(salt), F.lit(SALTS))).otherwise(0)
    every = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    left = rows.join(known, key, "left").withColumn("__salt", dealt.cast("int")).drop("__hot")
    right = counts.join(known, key, "left").withColumn("__salt", every).drop("__hot")
    out = left.join(right, [key, "__salt"])
    return (out.dropDuplicates([*rows.columns, "__salt"]) if distinct else out).drop("__salt")


def trimmed(run):
    """``run`` as it is; its memory goes back to the system at the end of a partition, as idle workers stay for a while."""

    def go(it):
        yield from run(it)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return go


def fits(df: DataFrame, limit_bytes: int) -> bool:
    """Whether Catalyst's size estimate of a table is within a limit (decides for a broadcast)."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit_bytes


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the n+1 offsets of its rows (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        col, kind = col.cast(pa.string()), np.int32
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind, count=n + 1, offset=col.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_blocks(off: np.ndarray, limit: int):
    """Row ranges (i, j) of at most ``limit`` bytes each, one row at least."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds (k1, k2), a 128-bit key of a row's id and text. Rows that are equal in both share it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return df.withColumn("k1", F.xxhash64(ident, text)).withColumn("k2", F.xxhash64(F.lit("second"), text, ident))
