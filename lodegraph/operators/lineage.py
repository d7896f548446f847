"""Cuts in the lineage of iterative plans."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def own_folder(spark: SparkSession) -> str:
    """A folder on this machine, for sessions whose executors run in the driver: on a cluster each
    executor would write to a disk of its own."""
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return "file://" + tempfile.mkdtemp(prefix="lodegraph-")


def settle(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the shared folder of ``spark.checkpoint.dir``; a folder of our
    own only where none is set."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or own_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the same folder, computed once and a fraction of a checkpoint's size; it goes when
    the application ends, so loops are better served by ``settle``."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = own_folder(spark)
        spark.sparkContext.setCheckpointDir(named)
    at = f"{named.rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(at)
    atexit.register(_forget, spark, at)
    return spark.read.schema(df.schema).parquet(at)


def _forget(spark: SparkSession, at: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has gone: the folder's owner clears it
        pass
