"""Tables staged in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its estimated bytes, from a count of its rows, stay below this.
BROADCAST_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local session gets a temporary folder and a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(spark, "_skyloom_folder", None)
        if folder is None:
            folder = spark._skyloom_folder = f"file://{tempfile.mkdtemp(prefix='skyloom-')}"
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back; a cut of lineage that outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/skyloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if a count of its rows shows it to be small, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
