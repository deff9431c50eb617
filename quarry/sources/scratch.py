"""Tables kept for the rest of a session, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in local mode without it, a temporary one of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-tables-"))
    return _own[0]


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df``, written once and read back; the files go when the driver ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A broadcast of up to ``most`` rows, which are counted; more are joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df
