"""What the training-data operators share: table reading, stage tables in the shared folder, size-checked joins."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from contextvars import ContextVar, Token

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its estimated bytes, from a count of its rows, stay below this.
BROADCAST_BYTES = 8 << 20
#: The words of the contracts: runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session, whose tasks share the machine's disk, gets a temporary folder; a cluster is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(spark, "_skyloom_shared", None)
        if base is None:
            base = spark._skyloom_shared = f"file://{tempfile.mkdtemp(prefix='skyloom-')}"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base


#: The tables staged in the innermost open ``scratch`` of this thread, by path.
_OWNED: ContextVar[list[str] | None] = ContextVar("skyloom_owned", default=None)


class Scratch:
    """Tables staged while it is open. At its end all are deleted but those whose result was ``kept``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self._before = _OWNED.set(self.paths)
        return self

    def __exit__(self, *_) -> None:
        _OWNED.reset(self._before)
        self.drop()

    def drop(self, paths: list[str] | None = None) -> None:
        """Deletes what was staged so far, or the tables at ``paths``; no plan that reads these tables may run any more."""
        for path in list(self.paths if paths is None else paths):
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
            self.paths.remove(path)

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` staged in a table that outlives this scratch; it belongs to the one around it, if any."""
        token = _OWNED.set(self._before.old_value if self._before.old_value is not Token.MISSING else None)
        try:
            return staged(df, name)
        finally:
            _OWNED.reset(token)


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: a cut of lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skyloom/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    owned = _OWNED.get()
    if owned is not None:
        owned.append(path)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Gives memory that is no longer in use back to the system, so that idle Python workers stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not this C library


def slices(batches, rows: int = 512):
    """The same rows in batches of at most ``rows``, so that what is built from a batch stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str, row_bytes: int) -> DataFrame:
    """A join that broadcasts ``right`` when ``row_bytes`` times its row count is within BROADCAST_BYTES, else shuffles.

    ``right`` should be a staged table, so that the count costs a footer read.
    """
    if right.count() * row_bytes <= BROADCAST_BYTES:
        right = F.broadcast(right)
    return left.join(right, on, how)
