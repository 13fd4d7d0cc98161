"""What the operators of this package share: input, checkpoints, checked broadcasts."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Bytes of rows that may be broadcast, estimated from counted rows; beyond it the same join shuffles.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.  Only a session on one machine may do without that setting."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in files that all executors share, so a lost one costs no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate rows from whatever file system it is on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded(df: DataFrame, more: Column | int = 0, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted, are small enough: each takes ``ROW_BYTES``
    and ``more``, which is a column where rows hold arrays or texts."""
    n, held = df.agg(F.count("*"), F.sum(more if isinstance(more, Column) else F.lit(more))).first()
    return F.broadcast(df) if n * ROW_BYTES + (held or 0) <= limit else df


def drop_rows(rows: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``rows`` without those whose keys, columns of ``rows``, equal a row of ``gone``, whose columns ``keys`` names; nulls are equal.

    ``gone`` should be cheap to count (checkpointed).  Texts are only shuffled when it is too long to broadcast.
    """
    names = unused(rows, *keys)
    gone = gone.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)))
    same = [c.eqNullSafe(F.col(n)) for c, n in zip(keys.values(), names, strict=True)]
    return rows.join(bounded(gone), reduce(Column.__and__, same), "left_anti").select(*rows.columns)


def text_hash(text: str = "text") -> Column:
    """What tells apart rows of one doc_id: null is an empty text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until ``df`` has no such column."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def arrow_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Before Python workers are used: ship the code and bound an Arrow batch by rows and bytes.

    The session's settings are only ever lowered: plans read them when they run, so they can't be set back before.
    """
    ship(spark)
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"([0-9]+)([kmgt]?)b?", spark.conf.get(key).lower())  # anything else is no bound
        if not now or not 0 < int(now[1]) << 10 * " kmgt".index(now[2] or " ") <= most:
            spark.conf.set(key, most)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, giving memory it no longer needs back to the system at the end, as workers live on
    beside those of the next stage."""

    def running(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return running


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(doc_id.cast("string")) % n
